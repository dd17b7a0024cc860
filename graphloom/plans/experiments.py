"""Whole experiments: link prediction and community detection by models.

A model is a function ``(edges, dim) -> (id, vec)``.  ``Fitted`` keeps what a
model gave, so that vectors are computed again only for another dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage
from graphloom.operators import evaluate
from graphloom.operators.graph import block_shuffled
from graphloom.operators.models import bias_fit
from graphloom.operators.splits import Split

Model = Callable[[DataFrame, int], DataFrame]
#: A null model of a graph, as edges of the same form.
Randomizer = Callable[[DataFrame], DataFrame]


class Fitted:
    """A model on a graph: ``transform(dim)`` computes and keeps both tables of vectors.

    A model gives (id, vec, out); one that gives (id, vec) alone has its
    vectors on both sides.  A subclass may give ``vectors_of`` of its own.
    """

    def __init__(self, model: Model, edges: DataFrame) -> None:
        self.model, self.edges, self.dim = model, edges, 0
        self.vectors: DataFrame | None = None

    def vectors_of(self, dim: int) -> DataFrame:
        return self.model(self.edges, dim)

    def transform(self, dim: int, out: bool = False) -> DataFrame:
        """(id, vec) of the in- or the out-vectors."""
        if dim != self.dim or self.vectors is None:
            self.dim, self.vectors = dim, cut_lineage(self.vectors_of(dim))
        side = "out" if out and "out" in self.vectors.columns else "vec"
        return self.vectors.select("id", F.col(side).alias("vec"))


def link_prediction(parts: Split, vectors: DataFrame, proximity: str = "dot", personas: DataFrame | None = None, aggregate: Column | str | None = None) -> DataFrame:
    """One row (auc): held-out edges told from non-edges by their scores.

    With ``personas(id, persona)`` a pair's score is ``aggregate`` of ``s``
    over its persona pairs, the maximum by default.
    """
    pairs = parts.test.select("src", "dst", F.lit(1).alias("y")).unionByName(parts.negative.select("src", "dst", F.lit(0).alias("y")))
    if personas is None:
        return evaluate.auc(evaluate.edge_scores(pairs, vectors, proximity))
    scored = evaluate.persona_scores(pairs.select("src", "dst"), personas, vectors, aggregate)
    return evaluate.auc(pairs.join(scored, ["src", "dst"]))


def link_prediction_grid(parts: Split, models: dict[str, Model], dims: list[int], proximity: str = "dot") -> DataFrame:
    """(model, dim, auc) of every model at every dimension on the train graph."""
    out = None
    for name, model in models.items():
        fitted = Fitted(model, parts.train)
        for dim in dims:
            row = link_prediction(parts, fitted.transform(dim), proximity).select(F.lit(name).alias("model"), F.lit(dim).alias("dim"), "auc")
            out = row if out is None else out.unionByName(row)
    return out


#: How a model's pairs are scored beside the inner product, by the start of its name; others by the product alone.
FAMILIES = {"residual": evaluate.RESIDUAL, "lndeg": evaluate.RESIDUAL, "glove": evaluate.BIASED}
#: Models that are scored a second time by the product alone.
ALSO_BY_DOT = ("residual", "glove")


def link_prediction_by_model(parts: Split, vectors: dict[str, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """(model, auc) for named vectors (id, vec), each in its family's own terms;
    ``residual`` and ``glove`` have a second row ``<name>-dotsim`` without them.

    Degrees and biases are those of ``edges``, by default the train graph."""
    graph = cut_lineage(parts.train if edges is None else edges)
    pairs = cut_lineage(parts.test.select("src", "dst", F.lit(1).alias("y")).unionByName(parts.negative.select("src", "dst", F.lit(0).alias("y"))))
    out = None
    for name, own in vectors.items():
        family = FAMILIES.get(name.split("-")[0], evaluate.PLAIN)
        wanted = [(name, family)] + [(f"{name}-dotsim", evaluate.PLAIN)] * (name in ALSO_BY_DOT)
        for said, how in wanted:
            offsets = bias_fit(graph, own) if how == evaluate.BIASED else None
            row = evaluate.auc(evaluate.modelled_scores(pairs, own, graph, how, offsets)).select(F.lit(said).alias("model"), "auc")
            out = row if out is None else out.unionByName(row)
    return out


def community_precision(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (average_precision): all ordered pairs of nodes, a node with
    itself included, ranked by inner product; a hit is a pair within a group.

    No pair is a row; see ``evaluate.pair_precision``.
    """
    return evaluate.pair_precision(vectors.select("id", "vec").join(groups.select("id", "grp"), "id"))


def community_benchmark(networks: list[tuple[dict, DataFrame, DataFrame]], models: dict[str, Model], dim: int = 64) -> DataFrame:
    """(q, model_name, sim_type, parameters): for networks given as
    (parameters, edges, groups), each model's average precision by in-vectors
    and by out-vectors."""
    out = None
    for parameters, edges, groups in networks:
        said = F.create_map(*(F.lit(str(x)) for kv in parameters.items() for x in kv)) if parameters else F.create_map().cast("map<string,string>")
        for name, model in models.items():
            fitted = Fitted(model, edges)
            for kind, is_out in (("in-vector", False), ("out-vector", True)):
                q = community_precision(fitted.transform(dim, is_out), groups)
                row = q.select(F.col("average_precision").alias("q"), F.lit(name).alias("model_name"), F.lit(kind).alias("sim_type"), said.alias("parameters"))
                out = row if out is None else out.unionByName(row)
    return out


def reconstruction_against_null(edges: DataFrame, groups: DataFrame, model: Model, dim: int, m: int, randomizer: Randomizer | None = None) -> DataFrame:
    """(kind, overlap): the share of ``m`` reconstructed pairs that are edges,
    for the graph and for what ``randomizer`` makes of it (by default the
    degree-corrected shuffle within pairs of groups)."""
    make = randomizer or (lambda e: block_shuffled(e, groups))
    out = None
    for kind, graph in (("graph", edges), ("random", make(edges))):
        graph = cut_lineage(graph)
        pairs = evaluate.top_pairs(model(graph, dim).select("id", "vec"), m)
        own = graph.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1).alias("hit")).distinct()
        row = pairs.join(own, ["src", "dst"], "left").agg(F.lit(kind).alias("kind"), F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"))
        out = row if out is None else out.unionByName(row)
    return out
