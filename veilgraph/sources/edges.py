"""Graph files: edge lists, published graphs, the binary format."""

from __future__ import annotations

import struct
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators.graph import Graph, load, multiplicity, original_ids


def edge_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(u, v) of lines (value) of two integers between white space. Blank
    lines are skipped; any other line is an error if strict, else skipped."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(F.trim("value") != "").withColumn("p", parts)
    good = (F.size("p") == 2) & F.col("p")[0].rlike(r"^-?\d+$") & F.col("p")[1].rlike(r"^-?\d+$")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    if strict:
        rows = rows.where(F.when(good, F.lit(True)).otherwise(bad.cast("boolean")))
    else:
        rows = rows.where(good)
    return rows.select(F.col("p")[0].cast("long").alias("u"), F.col("p")[1].cast("long").alias("v"))


def read_edges(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The simple undirected graph of an edge list, and (vid, orig_id)."""
    return load(edge_lines(spark.read.text(path)))


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, weight): undirected pairs with how often they are listed."""
    return multiplicity(edge_lines(spark.read.text(path)))


def count_lines(lines: DataFrame) -> DataFrame:
    """One row, nodes and edges of lines (value) as they stand: ids are
    strings, no line is merged with another, those of less than two tokens
    don't count."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    nodes = rows.select("a").union(rows.select("b")).agg(F.countDistinct("a").alias("nodes"))
    return nodes.crossJoin(rows.agg(F.count("*").alias("edges")))


def count_graph(spark: SparkSession, path: str) -> DataFrame:
    return count_lines(spark.read.text(path))


def write_edges(graph: Graph, ids: DataFrame, path: str) -> None:
    """Tab-separated original ids, both directions of every edge."""
    original_ids(graph.edges, ids).write.option("sep", "\t").csv(path)


def decode_binary(content: bytes) -> pd.DataFrame:
    """(src, dst) of a binary graph: the number n of vertices, n running
    totals of degrees, then all neighbours; unsigned 32-bit, native order."""
    order = "<" if sys.byteorder == "little" else ">"
    n = struct.unpack_from(f"{order}I", content)[0]
    ends = struct.unpack_from(f"{order}{n}I", content, 4)
    links = struct.unpack_from(f"{order}{ends[-1] if n else 0}I", content, 4 + 4 * n)
    src = [v for v in range(n) for _ in range(ends[v] - (ends[v - 1] if v else 0))]
    return pd.DataFrame({"src": src, "dst": list(links)}, dtype="int64")


def read_binary(spark: SparkSession, path: str) -> Graph:
    """A graph file in the binary format (one file is read by one task)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches):
        for pdf in batches:
            for content in pdf.content:
                yield decode_binary(content)

    arcs = files.mapInPandas(decode, "src long, dst long")
    n = files.select(F.explode(F.sequence(F.lit(0).cast("long"), F.conv(F.hex(F.reverse(F.substring("content", 1, 4)) if sys.byteorder == "little" else F.substring("content", 1, 4)), 16, 10).cast("long") - 1)).alias("vid"))
    edges = arcs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(n, edges)


def csr_arcs(cumulative: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst) from (idx, cum), running totals of degrees, and (pos, dst),
    neighbours in order: the relational form of the decoding."""
    before = cumulative.select((F.col("idx") + 1).alias("idx"), F.col("cum").alias("last"))
    spans = cumulative.join(before, "idx", "left").withColumn("first", F.coalesce("last", F.lit(0))).where("cum > first")
    at = spans.select(F.col("idx").alias("src"), F.explode(F.sequence(F.col("first"), F.col("cum") - 1)).alias("pos"))
    return at.join(links, "pos").select("src", "dst")
