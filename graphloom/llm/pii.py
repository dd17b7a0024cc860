"""Personal data by candidate gradient boosting, in DataFrame functions only.

Exact patterns with validators give the base spans.  Generators of high
recall propose further, overlapping spans, parts of digit runs (each group
of 16 to 19 digits, each start of 8 to 15 digits after a plus) among them;
boosted trees over format and context features score them, and a threshold
calibrated for precision decides which are added where no base span is.
The trees are fitted on counts per feature cell of all texts and applied as
CASE expressions, so texts never leave the JVM.

Positions come from splitting a text at the matches of a pattern: pieces
and matches alternate, and their lengths in code points add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import spare

# The possessive forms match what the plain patterns match, without
# backtracking or recursion on very long texts: a run of the first class
# is tried from its start only, or from the end of the match before (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators: loose addresses, runs of digits with separators, long tokens.
LOOSE_MAIL = r"(?:\G|(?<![^\s@<>,;|]))[^\s@<>,;|]++@[^\s@<>,;|]++"
LOOSE_NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
LOOSE_TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{24,}+"
GENERATORS = ("contact", "number", "secret")

PRECISION = 0.98
FEATURES = ("gen", "digits", "size", "gaps", "lead", "dots", "word", "phone_word", "quoted", "shape", "luhn")

#: Elements that one fold appends to its result; an append copies what is there.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(xs: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold over an array before each of its elements.

    Elements are folded in chunks: first over whole chunks, for the state at
    the start of each, then inside each, so that the work stays in proportion
    to the elements (an array grown one by one would be copied each time).
    """
    nothing = F.slice(F.array(zero), 1, 0)

    def before_each(items: Column, first: Column, onward: Callable[[Column, Column], Column]) -> Column:
        start = F.struct(first.alias("at"), nothing.alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(onward(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def over(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
        chunks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(values), 1, 0))
        firsts = lambda cs: before_each(cs, zero, lambda at, c: F.aggregate(c, at, step))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, firsts(cs), lambda c, first: before_each(c, first, step))))

    return let(xs, over)


def located(text: Column, pattern: str, kind: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as spans in code points.

    ``gap`` is what stands between a match and the one before it, ``before``
    the last of it in lower case, ``matched`` the length of all matches before."""
    found = F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(gate, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
    pairs = let(found, lambda ms: F.zip_with(ms, F.slice(between, F.lit(1), F.size(ms)), lambda m, p: F.struct(m.alias("m"), p.alias("p"), F.length(m).cast("long").alias("lm"), F.length(p).cast("long").alias("lp"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("matched"))
    onward = lambda at, x: F.struct((at["end"] + x["lp"] + x["lm"]).alias("end"), (at["matched"] + x["lm"]).alias("matched"))

    def span(x: Column, at: Column) -> Column:
        first = at["end"] + x["lp"]
        return F.struct(F.lit(kind).alias("kind"), first.alias("start"), (first + x["lm"]).alias("end"), x["m"].alias("text"), F.lower(F.right(x["p"], F.lit(16))).alias("before"), x["p"].alias("gap"), at["matched"].alias("matched"))

    return let(pairs, lambda ps: F.zip_with(ps, scanned(ps, zero, onward), span))


def plain(spans: Column) -> Column:
    """Spans with the fields that results have."""
    return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "text", "before"))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """True if the digits of a string pass the Luhn check."""
    d = _digits(s)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when((F.length(d) - i) % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)

    return (F.length(d) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def valid(kind: str, s: Column) -> Column:
    """The further conditions on a match of a base pattern."""
    n = F.length(_digits(s))
    if kind == "ip":
        bare = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(F.when(F.length(bare(x)) <= 3, bare(x)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Validated spans of all kinds, by kind as listed, then start."""
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+"))}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    keep = lambda k: F.filter(located(text, patterns[k], k, gates[k]), lambda s: valid(k, s["text"]))
    return F.concat(*(plain(keep(k)) for k in KINDS))


def parts_of(span: Column) -> Column:
    """The parts of a number's span, from the start of one group of digits to
    the end of another, that have the digits of a card (16 to 19) or, after
    a plus, of a phone (8 to 15).

    Groups are chosen by running counts of digits, and texts are put together
    from a group's neighbours, so that a part costs the same wherever it stands.
    """
    s = span["text"]

    def part(gs: Column, g: Column, i: Column, h: Column, plus: Column) -> Column:
        within = F.slice(gs, i + 1, F.lit(19))
        text = F.array_join(F.transform(F.filter(within, lambda x: x["start"] <= h["start"]), lambda x: F.when(x["start"] == g["start"], F.when(plus, F.concat(x["gap"], x["text"])).otherwise(x["text"])).otherwise(F.concat(x["gap"], x["text"]))), "")
        near = F.array_join(F.transform(F.slice(gs, F.greatest(i - 15, F.lit(1)), F.least(i, F.lit(16))), lambda x: F.concat(x["gap"], F.right(x["text"], F.lit(16)))), "")
        before = F.concat(F.when(i <= 16, span["before"]).otherwise(F.lit("")), F.when(plus, F.lit("")).otherwise(F.concat(F.when(i > 0, near).otherwise(F.lit("")), g["gap"])))
        first = F.when(plus, F.lit(0).cast("long")).otherwise(g["start"])
        return F.struct(span["kind"].alias("kind"), (span["start"] + first).alias("start"), (span["start"] + h["end"]).alias("end"), text.alias("text"), F.lower(F.right(before, F.lit(16))).alias("before"))

    def from_group(gs: Column, g: Column, i: Column) -> Column:
        plus = (i == 0) & F.startswith(s, F.lit("+"))
        digits = lambda h: h["matched"] + h["end"] - h["start"] - g["matched"]
        low, high = F.when(plus, 8).otherwise(16), F.when(plus, 15).otherwise(19)
        whole = lambda h: (h["end"] - F.when(plus, F.lit(0).cast("long")).otherwise(g["start"])) == F.length(s)
        chosen = F.filter(F.slice(gs, i + 1, F.lit(19)), lambda h: (digits(h) >= low) & (digits(h) <= high) & ~whole(h))
        return F.transform(chosen, lambda h: part(gs, g, i, h, plus))

    return let(located(s, "[0-9]+", "", F.lit(True)), lambda gs: F.flatten(F.transform(gs, lambda g, i: from_group(gs, g, i))))


def candidates(text: Column) -> Column:
    """Spans proposed by the generators; they may overlap anything."""
    digit = text.rlike("[0-9]")
    numbers = plain(located(text, LOOSE_NUMBER, "number", digit))
    return F.concat(
        plain(located(text, LOOSE_MAIL, "contact", F.contains(text, F.lit("@")))),
        F.flatten(F.transform(numbers, lambda s: F.concat(F.array(s), parts_of(s)))),
        plain(located(text, LOOSE_TOKEN, "secret", digit)),
    )


def clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``, in order of their ends.

    Base spans stand at their starts and spans at their ends; the farthest
    end of the base spans that start before a span ends tells."""
    empty = F.struct(*(F.lit("" if c in ("kind", "text", "before") else 0).cast("string" if c in ("kind", "text", "before") else "long").alias(c) for c in ("kind", "start", "end", "text", "before")))
    events = F.array_sort(
        F.concat(
            F.transform(spans, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("what"), c["start"].alias("far"), c.alias("span"))),
            F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("what"), b["end"].alias("far"), empty.alias("span"))),
        )
    )
    farthest = lambda at, e: F.when(e["what"] == 1, F.greatest(at, e["far"])).otherwise(at)
    seen = let(events, lambda es: F.zip_with(es, scanned(es, F.lit(-1).cast("long"), farthest), lambda e, far: F.struct(e.alias("e"), far.alias("far"))))
    return F.transform(F.filter(seen, lambda x: (x["e"]["what"] == 0) & (x["far"] <= x["e"]["far"])), lambda x: x["e"]["span"])


def outermost(spans: Column) -> Column:
    """The spans that lie in no longer one.

    Sorted by start, longer first, a span lies in a longer one if one with
    other bounds before it reaches its end."""
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c.alias("span"))))
    zero = F.struct(F.lit(-1).cast("long").alias("reach"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("back"), F.lit(-1).cast("long").alias("all"))
    again = lambda at, x: (at["start"] == x["start"]) & (at["back"] == x["back"])
    reach = lambda at, x: F.when(again(at, x), at["reach"]).otherwise(at["all"])
    onward = lambda at, x: F.struct(reach(at, x).alias("reach"), x["start"].alias("start"), x["back"].alias("back"), F.greatest(at["all"], -x["back"]).alias("all"))
    seen = let(ordered, lambda xs: F.zip_with(xs, scanned(xs, zero, onward), lambda x, at: F.struct(x.alias("x"), reach(at, x).alias("reach"))))
    return F.transform(F.filter(seen, lambda y: y["reach"] < -y["x"]["back"]), lambda y: y["x"]["span"])


def features(span: Column) -> list[Column]:
    """Small whole numbers describing a candidate, in the order of ``FEATURES``."""
    s, before = span["text"], span["before"]
    n = F.length(_digits(s))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [
        F.array_position(F.array(*map(F.lit, GENERATORS)), span["kind"]).cast("int"),
        F.least(n, F.lit(20)),
        F.least((F.length(s) / 4).cast("int"), F.lit(16)),
        F.least(F.length(F.regexp_replace(s, r"[^\x20()-]", "")), F.lit(4)),
        flag(s.rlike("^[+]")) * 2 + flag(s.rlike("^[(]")),
        F.least(F.length(F.regexp_replace(s, r"[^.]", "")), F.lit(4)),
        flag(before.rlike("token|secret|passw|api|key")),
        flag(before.rlike("tel|phone|mobile|call|fax")),
        flag(before.rlike("[=:]\\s*[\"']?$")),
        F.when(s.rlike("^[0-9a-f]+$"), 2).when(s.rlike("^[0-9A-Za-z]+$"), 1).otherwise(0),
        flag(F.when((n >= 16) & (n <= 19), luhn(s))),
    ]


def weak_label(span: Column) -> Column:
    """1 where a rule of the base kinds, or an assignment to a secret's name,
    confirms the whole candidate."""
    s, before = span["text"], span["before"]
    whole = lambda p, k: s.rlike(f"^(?:{p})$") & valid(k, s)
    number = whole(IP, "ip") | whole(CARD, "card") | whole(PHONE, "phone")
    secret = s.rlike("[0-9]") & before.rlike("(token|secret|passw|api|key)[a-z_]*\\s*[=:]\\s*[\"']?$")
    return F.when(span["kind"] == "contact", s.rlike(f"^(?:{EMAIL})$")).when(span["kind"] == "number", number).otherwise(secret).cast("int")


def _leaf_value(node: object, row: np.ndarray) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


@dataclass(frozen=True)
class Boosted:
    """Depth-two trees ``(feature, cut, left, right)`` with nested leaves, and
    a score threshold for each generator."""

    start: float
    trees: list
    thresholds: list[float]

    def score(self, values: list[Column]) -> Column:
        def leaf(node: object) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, left, right = node
            return F.when(values[f] <= cut, leaf(left)).otherwise(leaf(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + leaf(tree)
        return total

    def score_row(self, row: np.ndarray) -> float:
        return self.start + sum(_leaf_value(tree, row) for tree in self.trees)

    def accepts(self, values: list[Column]) -> Column:
        limit = F.element_at(F.array(*(F.lit(float(t)) for t in self.thresholds)), values[0])
        return self.score(values) >= limit


def boost(cells: np.ndarray, pos: np.ndarray, n: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 40, rate: float = 0.3, depth: int = 2, precision: float = PRECISION) -> Boosted:
    """Newton boosting of the logistic loss on cells with ``pos`` of ``n`` rows
    labelled 1.  The threshold of a generator is the lowest score above which
    the share of label 1 stays at ``precision`` or more among the rows
    ``held`` = (pos, n) of the same cells, which the trees have not seen (the
    fitted ones where none are given); infinite if there is none."""
    if not len(cells) or n.sum() == 0:
        return Boosted(0.0, [], [math.inf] * len(GENERATORS))
    p0 = min(max(pos.sum() / n.sum(), 1e-3), 1 - 1e-3)
    start = math.log(p0 / (1 - p0))
    score = np.full(len(cells), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> object:
        top = (g[rows].sum() ** 2) / (h[rows].sum() + 1)
        choice = None
        for f in range(cells.shape[1]) if level else ():
            for cut in np.unique(cells[rows, f])[:-1]:
                left = rows[cells[rows, f] <= cut]
                right = rows[cells[rows, f] > cut]
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - top
                if gain > 1e-6 and (choice is None or gain > choice[0]):
                    choice = (gain, f, int(cut), left, right)
        if choice is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1))
        _, f, cut, left, right = choice
        return (f, cut, grow(left, g, h, level - 1), grow(right, g, h, level - 1))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(cells)), pos - n * p, n * p * (1 - p), depth)
        trees.append(tree)
        score += np.array([_leaf_value(tree, row) for row in cells])
    seen_pos, seen_n = held if held is not None and held[1].sum() else (pos, n)
    thresholds = []
    for gen in range(1, len(GENERATORS) + 1):
        own = np.flatnonzero(cells[:, 0] == gen)
        own = own[np.argsort(-score[own], kind="stable")]
        share = np.cumsum(seen_pos[own]) / np.maximum(np.cumsum(seen_n[own]), 1)
        last = np.append(np.abs(np.diff(score[own])) > 1e-9, True) if len(own) else np.zeros(0, bool)  # cells of one score go together
        good = np.flatnonzero((share >= precision) & last)
        thresholds.append(float(score[own[good[-1]]]) - 1e-9 if len(good) else math.inf)
    return Boosted(start, trees, thresholds)


def fit(docs: DataFrame, text_col: str = "text") -> Boosted:
    """Fit and calibrate on the candidates of all documents.

    Documents are dealt to two halves by a hash of their text, so that copies
    stay together: trees grow on one half, thresholds are set on the other.
    Only counts per feature cell reach the driver; their number is bounded
    by the features' ranges.
    """
    x, (pos, n), held = cell_counts(docs, text_col)
    return boost(x, pos, n, held)


def cell_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Feature cells and, for either half, their labelled and all candidates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = docs.select(F.pmod(F.xxhash64(text), F.lit(2)).alias("half"), F.explode(candidates(text)).alias("s"))
    cells = spans.select("half", *(c.alias(k) for k, c in zip(FEATURES, features(F.col("s")))), weak_label(F.col("s")).alias("y"))
    counted = cells.groupBy(*FEATURES).agg(*(F.sum(F.when(F.col("half") == k, c).otherwise(0)).alias(name) for name, k, c in (("p0", 0, F.col("y")), ("n0", 0, F.lit(1)), ("p1", 1, F.col("y")), ("n1", 1, F.lit(1))))).orderBy(*FEATURES).collect()
    x = np.array([[r[k] for k in FEATURES] for r in counted], int).reshape(-1, len(FEATURES))
    column = lambda name: np.array([float(r[name] or 0) for r in counted])
    return x, (column("p0"), column("n0")), (column("p1"), column("n1"))


def quality(model: Boosted, x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each generator's accepted candidates on counted
    cells; precision is 1 where nothing is accepted, recall 1 where nothing is
    labelled."""
    out = {}
    for gen, name in enumerate(GENERATORS, 1):
        own = x[:, 0] == gen if len(x) else np.zeros(0, bool)
        taken = np.array([bool(o) and model.score_row(row) >= model.thresholds[gen - 1] for o, row in zip(own, x)], bool)
        hit, all_, labelled = pos[taken].sum(), n[taken].sum(), pos[own].sum()
        out[name] = (float(hit / all_) if all_ else 1.0, float(hit / labelled) if labelled else 1.0)
    return out


def detect(docs: DataFrame, model: Boosted | None = None, text_col: str = "text", base_col: str = "base", added_col: str = "added") -> DataFrame:
    """``docs`` with ``base`` and ``added``, arrays of (kind, start, end, text,
    before) in code points; ``ValueError`` if ``docs`` has columns so named.

    Added spans are the accepted candidates that touch no base span and lie in
    no larger accepted one.  A null
    or empty text has none; every row, repeated ones too, keeps its place.
    Other columns pass through.
    """
    model = model or fit(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if {base_col.lower(), added_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"name other columns than {base_col} and {added_col} for the result")
    proposed, accepted = spare(docs.columns, "proposed"), spare(docs.columns, "accepted")
    found = docs.withColumns({base_col: base_spans(text), proposed: candidates(text)})
    taken = found.withColumn(accepted, F.filter(clear_of(F.col(proposed), F.col(base_col)), lambda c: let(F.array(*features(c)), lambda v: model.accepts([v[k] for k in range(len(FEATURES))]))))
    added = outermost(F.col(accepted))
    return taken.select(*docs.columns, base_col, added.alias(added_col))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Boosted | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the kind of the first.  A
    null text stays null.  Columns and their order are kept.
    """
    base, added = spare(docs.columns, "base"), spare(docs.columns, "added")
    found = detect(docs, model, text_col, base, added)
    text = F.col(text_col).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        word = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], word).alias("out"))

    spans = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(text)
    return found.withColumn(text_col, clean).select(docs.columns)
