"""Graphs as vertex and edge tables, and community aggregates over them.

A graph is a table of vertices (vid) and one of canonical edges (src < dst,
distinct).  Vertices are explicit, or isolated ones would vanish.  A
partition is a table (vid, com).  Nothing is ever densified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.operators.ranking import ranked


@dataclass
class Graph:
    vertices: DataFrame  # vid
    edges: DataFrame  # src, dst


def canonical(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Undirected simple edges: ends in order, no self-loops, each once."""
    return pairs.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")).distinct()


def vertex_ids(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vid, orig_id): every id of either column, numbered from 0 in order.
    A vertex whose only edge is a self-loop is one too."""
    ids = pairs.select(F.col(u).alias("orig_id")).union(pairs.select(F.col(v))).where("orig_id is not null").distinct()
    return ranked(ids, F.col("orig_id"), name="vid").select("vid", "orig_id")


def load(pairs: DataFrame) -> tuple[Graph, DataFrame]:
    """The simple graph of (u, v) rows under dense ids, and (vid, orig_id)."""
    ids = vertex_ids(pairs)
    a = ids.select(F.col("orig_id").alias("src"), F.col("vid").alias("a"))
    b = ids.select(F.col("orig_id").alias("dst"), F.col("vid").alias("b"))
    edges = canonical(pairs).join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return Graph(ids.select("vid"), edges), ids


def multiplicity(pairs: DataFrame) -> DataFrame:
    """(u, v, weight): how often each undirected pair is listed; self-loops
    stay."""
    return pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; further columns go along."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def original_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges back under their original ids, in both directions."""
    a = ids.select(F.col("vid").alias("src"), F.col("orig_id").alias("u"))
    b = ids.select(F.col("vid").alias("dst"), F.col("orig_id").alias("v"))
    return both_ways(edges).join(a, "src").join(b, "dst").select("u", "v")


def degrees(graph: Graph) -> DataFrame:
    """(vid, deg); isolated vertices have 0."""
    found = both_ways(graph.edges).groupBy("src").agg(F.count("*").alias("deg"))
    return graph.vertices.join(found, F.col("vid") == F.col("src"), "left").select("vid", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def degree_histogram(degs: DataFrame, column: str = "deg") -> DataFrame:
    """(deg, n) for every degree from 0 to the largest, empty bins included."""
    counts = degs.groupBy(F.col(column).alias("deg")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("deg").alias("most"))
    bins = most.where("most is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("deg"))
    return bins.join(counts, "deg", "left").select("deg", F.coalesce("n", F.lit(0)).alias("n"))


def members(partition: DataFrame) -> DataFrame:
    """(com, size, members): each community's vertices in order."""
    return partition.groupBy("com").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("vid")).alias("members"))


def sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("com").agg(F.count("*").alias("size"))


def edge_communities(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges with the communities cu, cv of their ends."""
    u = partition.select(F.col("vid").alias("src"), F.col("com").alias("cu"))
    v = partition.select(F.col("vid").alias("dst"), F.col("com").alias("cv"))
    return edges.join(u, "src").join(v, "dst")


def induced(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, w), ci <= cj: edges summed by the communities they join."""
    w = F.sum("weight") if "weight" in edges.columns else F.count("*")
    pairs = edge_communities(edges, partition)
    return pairs.groupBy(F.least("cu", "cv").alias("ci"), F.greatest("cu", "cv").alias("cj")).agg(w.cast("long").alias("w"))


def community_pairs(partition: DataFrame, diagonal: bool = True) -> DataFrame:
    """(ci, cj) for all communities ci <= cj (or <): the cells of the
    community matrix, as many as the release has numbers."""
    c = partition.select("com").distinct()
    over = F.col("ci") <= F.col("cj") if diagonal else F.col("ci") < F.col("cj")
    return c.select(F.col("com").alias("ci")).join(c.select(F.col("com").alias("cj")), over)


def community_matrix(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(ci, cj, w) for every pair ci <= cj, empty cells included; on the
    diagonal twice the edges within, as a symmetric matrix sums to."""
    counts = induced(edges, partition).withColumnRenamed("w", "n")
    cells = community_pairs(partition).join(counts, ["ci", "cj"], "left")
    n = F.coalesce("n", F.lit(0))
    return cells.select("ci", "cj", F.when(F.col("ci") == F.col("cj"), 2 * n).otherwise(n).cast("long").alias("w"))


def neighbour_weights(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(vid, com, w): edges of each vertex into each community it touches."""
    there = partition.select(F.col("vid").alias("dst"), "com")
    return both_ways(edges.select("src", "dst")).join(there, "dst").groupBy(F.col("src").alias("vid"), "com").agg(F.count("*").alias("w"))


def all_weights(graph: Graph, partition: DataFrame) -> DataFrame:
    """(vid, com, w) for every vertex and every community, 0 included: as
    many rows as the product, so for small graphs."""
    coms = partition.select("com").distinct()
    found = neighbour_weights(graph.edges, partition).withColumnRenamed("w", "found")
    return graph.vertices.crossJoin(coms).join(found, ["vid", "com"], "left").select("vid", "com", F.coalesce("found", F.lit(0)).alias("w"))


def intra_degrees(graph: Graph, partition: DataFrame) -> DataFrame:
    """(com, vid, deg): edges of each vertex within its own community."""
    within = edge_communities(graph.edges, partition).where("cu = cv").select("src", "dst")
    ends = within.select(F.explode(F.array("src", "dst")).alias("src"))  # joined once, as a union of both ways would not be
    found = ends.groupBy("src").agg(F.count("*").alias("d"))
    return partition.join(found, F.col("vid") == F.col("src"), "left").select("com", "vid", F.coalesce("d", F.lit(0)).alias("deg"))


def status(graph: Graph, partition: DataFrame) -> DataFrame:
    """(com, size, degree, internal, total): per community its vertices, the
    sum of their degrees and its inner edges; total is the graph's edges."""
    degs = degrees(graph).join(partition, "vid").groupBy("com").agg(F.count("*").alias("size"), F.sum("deg").alias("degree"))
    inner = edge_communities(graph.edges, partition).where("cu = cv").groupBy(F.col("cu").alias("com")).agg(F.count("*").alias("n"))
    total = graph.edges.agg(F.count("*").alias("total"))
    return degs.join(inner, "com", "left").crossJoin(total).select("com", "size", "degree", F.coalesce("n", F.lit(0)).alias("internal"), "total")


def modularity(graph: Graph, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: the sum over communities of
    resolution * internal / m - (degree / 2m)**2. A graph without edges has
    none: an error, when it is asked for."""
    parts = status(graph, partition)
    none = F.raise_error(F.lit("a graph without edges has no modularity")).cast("double")
    term = F.lit(float(resolution)) * F.col("internal") / F.col("total") - F.pow(F.col("degree") / (2 * F.col("total")), 2)
    return parts.agg(F.sum(F.when(F.col("total") > 0, term).otherwise(none)).alias("modularity"))


def counts(graph: Graph) -> DataFrame:
    """One row, nodes and edges."""
    return graph.vertices.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))


def at_level(dendrogram: DataFrame, level: int) -> DataFrame:
    """Partition (vid, com) at a level of (level, node, com): the levels
    below joined, community to node."""
    now = dendrogram.where("level = 0").select(F.col("node").alias("vid"), "com")
    for k in range(1, level + 1):
        step = dendrogram.where(F.col("level") == k).select("node", F.col("com").alias("up"))
        now = now.join(step, now["com"] == step["node"]).select("vid", F.col("up").alias("com"))
    return now


def renumbered(partition: DataFrame) -> DataFrame:
    """Communities numbered 0, 1, ... in the order of their labels."""
    labels = ranked(partition.select("com").distinct(), F.col("com"), name="number")
    return partition.join(labels, "com").select("vid", F.col("number").alias("com"))
