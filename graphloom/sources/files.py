"""Readers and writers of edge lists, matrices, embeddings and results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.splits import Split


def read_edge_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``src,dst`` lines as edges of weight 1."""
    df = spark.read.option("header", header).schema("src bigint, dst bigint").csv(path)
    return df.where("src is not null and dst is not null").withColumn("w", F.lit(1.0))


def read_edge_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated pairs, # comments, plain or compressed."""
    df = spark.read.option("sep", "\t").option("comment", "#").schema("src bigint, dst bigint").csv(path)
    return df.where("src is not null and dst is not null").withColumn("w", F.lit(1.0))


def read_one_based(spark: SparkSession, path: str, what: str = "edges") -> DataFrame:
    """Files of a benchmark generator: node ids from 1, group ids as they are."""
    if what == "edges":
        return read_edge_tsv(spark, path).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), "w")
    df = spark.read.option("sep", "\t").option("comment", "#").schema("id bigint, grp bigint").csv(path)
    return df.select((F.col("id") - 1).alias("id"), "grp")


def write_one_based(edges: DataFrame, groups: DataFrame, folder: str, **parameters: str | int | float) -> None:
    """A benchmark network as ``read_one_based`` reads it: edges and groups with
    node ids from 1, and the generator's parameters as one JSON line."""
    edges.select(F.col("src") + 1, F.col("dst") + 1).write.mode("overwrite").option("sep", "\t").csv(f"{folder}/network")
    groups.select(F.col("id") + 1, "grp").write.mode("overwrite").option("sep", "\t").csv(f"{folder}/community")
    write_parameters(edges.sparkSession, [parameters], f"{folder}/parameters")


def write_parameters(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Parameter sets or results as JSON lines, one object each."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(parameters map<string, string>) of JSON lines."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("parameters"))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label, value), edges(src, dst, w)) of a GML file, read whole
    per file; blocks are cut by their brackets."""
    text = spark.read.option("wholetext", True).text(path)
    blocks = lambda kind: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[([^\]]*)\]"), F.lit(1))).alias("b"))
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract("b", rf"\b{k}\s+(-?\d+)", 1), F.lit("")), F.lit("S999999999999999999")).cast("long")
    words = lambda k: F.nullif(F.regexp_extract("b", rf"\b{k}\s+\"([^\"]*)\"", 1), F.lit(""))
    nodes = blocks("node").select(number("id").alias("id"), words("label").alias("label"), words("value").alias("value"))
    edges = blocks("edge").select(number("source").alias("src"), number("target").alias("dst"), F.lit(1.0).alias("w"))
    return nodes, edges


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str = "src bigint, dst bigint, w double") -> DataFrame:
    """What ``write_table`` wrote: a sparse matrix unless ``schema`` says otherwise."""
    return spark.read.option("header", True).schema(schema).csv(path) if kind == "csv" else spark.read.schema(schema).parquet(path)


def write_embedding(vectors: DataFrame, path: str, **metadata: str | int | float | bool) -> None:
    """Vectors with their parameters as columns."""
    df = vectors
    for name, value in metadata.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").parquet(path)


def read_embedding(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vectors(id, vec[, grp]), metadata) of a written embedding; the
    parameters, equal in all rows, are read from one."""
    df = spark.read.parquet(path)
    own = [c for c in ("id", "vec", "grp") if c in df.columns]
    first = df.drop(*own).first()
    return df.select(own), first.asDict() if first is not None else {}


def write_split(parts: Split, folder: str) -> None:
    """The train graph, the held-out edges and the non-edges as three tables."""
    parts.train.write.mode("overwrite").option("sep", "\t").csv(f"{folder}/network")
    parts.test.write.mode("overwrite").option("sep", "\t").csv(f"{folder}/test_edges")
    parts.negative.write.mode("overwrite").option("sep", "\t").csv(f"{folder}/negative_edges")


def read_split(spark: SparkSession, folder: str) -> Split:
    """What ``write_split`` wrote."""
    read = lambda name, schema: spark.read.option("sep", "\t").schema(schema).csv(f"{folder}/{name}")
    pair = "src bigint, dst bigint"
    return Split(read("network", f"{pair}, w double"), read("test_edges", pair), read("negative_edges", pair))


def append_result(df: DataFrame, path: str) -> None:
    """Add (name, value) rows to a tab-separated result table."""
    df.write.mode("append").option("sep", "\t").csv(path)


def file_parameters(path: Column) -> Column:
    """map of ``k=v`` parts of a file's stem, parts divided by _; others dropped."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    pairs = F.filter(F.split(stem, "_"), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value"))))
