"""Connected components by alternating large-star and small-star rounds.

For a graph's components each task first reduces its edges to a row for each
of their vertices. Every round is two aggregates and two joins over the edge table; the number
of rounds grows with the logarithm of the vertices.  No neighbourhood is ever
gathered into one row: the minimum of each is a map-side combined aggregate,
and its join back can be split where one vertex has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.plans.staging import drop, staged


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "least"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = _star(both).where("v > u")
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    star = _star(down)
    own = star.select("u", F.col("m").alias("v"))
    rest = star.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).where("u <> v").distinct()


#: Edges that a task looks at together, and vertices of partitions of edges,
#: repeats included, that one task brings together without rounds.
FOREST, TASK_VERTICES = 1 << 20, 1 << 22


def _forest(ends: DataFrame, whole: bool = False) -> DataFrame:
    """(u, v), u > v: for the vertices of each partition the smallest one that
    its edges lead to, a row for a vertex of a partition and not for an edge.
    A task holds FOREST edges or vertices, then begins anew; with whole, all
    its vertices."""

    def least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while (root != (up := root[root])).any():
                root = up
        own = root < np.arange(len(ids))
        return ids[own], ids[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts, size, most = [none], 0, FOREST
        packed = lambda found: pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])
        for batch in batches:
            parts.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size >= most:
                parts = [least(*map(np.concatenate, zip(*parts, strict=True)))]
                size = len(parts[0][0])
                if whole:
                    most = max(FOREST, 2 * size)
                elif 2 * size > FOREST:
                    yield packed(parts[0])
                    parts, size = [none], 0
        yield packed(least(*map(np.concatenate, zip(*parts, strict=True))))

    return ends.mapInArrow(run, "u long, v long")


def component_links(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vid, component) for every vertex that isn't the smallest of its
    component; component is that smallest vertex.  Self-loops, repeated and
    reversed edges change nothing; rows with a null end are left out."""
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = staged(ends.distinct(), "components")
    seen = None
    while True:
        before = now
        now = staged(_small(_large(before)), "components")
        drop(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("vid"), F.col("v").alias("component"))
        seen = state


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "vid", src: str = "src", dst: str = "dst") -> DataFrame:
    """(vid, component) for every vertex; an isolated one is its own. Tasks
    first bring their own edges together; rounds go on if one task can't hold
    what is left."""
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    if all(kind == "bigint" for _, kind in ends.dtypes):
        ends = staged(_forest(ends), "forest")
        if ends.count() <= TASK_VERTICES:
            found = staged(_forest(ends.repartition(1), whole=True), "components")
            return _labelled(vertices, found.select(F.col("u").alias("_u"), F.col("v").alias("component")), vid)
    return _labelled(vertices, component_links(ends, "u", "v").withColumnRenamed("vid", "_u"), vid)


def _labelled(vertices: DataFrame, links: DataFrame, vid: str) -> DataFrame:
    rows = vertices.select(F.col(vid).alias("vid"))
    joined = rows.join(links, rows["vid"] == links["_u"], "left")
    return joined.select("vid", F.coalesce("component", "vid").alias("component"))
