"""Influence maximisation: seeds by degree discount, spread by independent
cascades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.keyed import Keys
from veilgraph.functions.scalars import activation
from veilgraph.operators.graph import both_ways
from veilgraph.plans.staging import drop, staged


def degree_discount(edges: DataFrame, k: int, p: float = 0.01) -> DataFrame:
    """(rank, vid, score) of k seeds over weighted edges (src, dst, weight).

    Each round takes the vertex with the largest discounted degree and
    discounts its neighbours that aren't seeds. Of equal ones that whose
    value changed longest ago comes first, then the smallest id. Only the
    seeds come to the driver; the rest is a stored table of degrees and one of
    the vertices touched so far, which alone is written anew each round.
    """
    paths = staged(both_ways(edges.select("src", "dst", "weight")), "discount-edges")
    base = staged(paths.groupBy(F.col("src").alias("vid")).agg(F.sum("weight").cast("double").alias("d")), "discount-degrees")
    touched = staged(base.where("false").select("vid", F.lit(0.0).alias("t"), F.lit(0).alias("stamp")), "discount")
    seeds: list[tuple[int, int, float]] = []
    for rank in range(1, k + 1):
        t, gone = F.coalesce("t", F.lit(0.0)), [v for _, v, _ in seeds]
        rows = base.join(touched, "vid", "left").where(~F.col("vid").isin(gone)) if gone else base.join(touched, "vid", "left")
        best = rows.select("vid", (F.col("d") - 2 * t - (F.col("d") - t) * t * p).alias("score"), F.coalesce("stamp", F.lit(0)).alias("stamp")).orderBy(F.desc("score"), "stamp", "vid").first()
        if best is None:
            break
        seeds.append((rank, best.vid, best.score))
        hit = paths.where((F.col("src") == best.vid) & (F.col("dst") != best.vid)).select(F.col("dst").alias("vid"), F.col("weight").cast("double").alias("t"), F.lit(rank).alias("stamp"))
        after = staged(touched.unionByName(hit).groupBy("vid").agg(F.sum("t").alias("t"), F.max("stamp").alias("stamp")), "discount")
        drop(touched)
        touched = after
    return edges.sparkSession.createDataFrame(seeds, "rank int, vid long, score double")


def live_edges(edges: DataFrame, trials: int, p: float, seed: int) -> DataFrame:
    """(trial, src, dst): each edge is kept in each trial with the chance
    that one of its parallel edges passes a cascade on. As a cascade tries an
    edge once at most, what it reaches is what live edges join to the seeds.
    The draws are keyed by u and v if edges has these, else by src and dst. A
    batch of edges draws for one trial after the other."""
    key = ("u", "v") if "u" in edges.columns else ("src", "dst")
    rows = edges.select("src", "dst", F.col(key[0]).alias("u"), F.col(key[1]).alias("v"), activation(p, F.col("weight")).alias("chance"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, u, v, chance = (batch.column(k).to_numpy() for k in range(5))
            keys = Keys(u, v)
            for trial in range(trials):
                at = np.flatnonzero(keys.uniform(f"{seed}|cascade|{trial}") < chance)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), trial, np.int32)), pa.array(src[at]), pa.array(dst[at])], ["trial", "src", "dst"])

    return rows.mapInArrow(drawn, "trial int, src long, dst long")


def cascades(edges: DataFrame, seeds: DataFrame, trials: int = 100, p: float = 0.01, seed: int = 0) -> DataFrame:
    """(trial, size): vertices that each trial's cascade activates, seeds
    included. A seed that the graph lacks counts as an isolated vertex. An
    edge draws, for all trials, when one of its ends is first reached in any:
    what no cascade comes to costs nothing."""
    paths = both_ways(edges.select("src", "dst", F.col("src").alias("u"), F.col("dst").alias("v"), "weight"))
    seen = seeds.select("vid").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "vid")
    seen = frontier = staged(seen, "cascade")
    live = known = None
    while not frontier.isEmpty():
        first = frontier.select(F.col("vid").alias("src")).distinct()
        first = staged(first if known is None else first.join(known, "src", "left_anti"), "cascade-reached")
        if not first.isEmpty():
            more = staged(live_edges(paths.join(first, "src", "left_semi"), trials, p, seed), "live-edges")
            live, known = (more, first) if known is None else (live.unionByName(more), known.unionByName(first))
        step = frontier.select("trial", F.col("vid").alias("src")).join(live, ["trial", "src"]).select("trial", F.col("dst").alias("vid")).distinct()
        frontier = staged(step.join(seen, ["trial", "vid"], "left_anti"), "cascade")
        seen = seen.unionByName(frontier)
    return seen.groupBy("trial").agg(F.count("*").alias("size"))


def spread(edges: DataFrame, seeds: DataFrame, trials: int = 100, p: float = 0.01, seed: int = 0, seed_size: int | None = None) -> DataFrame:
    """One row, spread: the mean cascade, rounded half to even. seeds (rank,
    vid) are cut to seed_size."""
    if seed_size is not None:
        seeds = seeds.where(F.col("rank") <= seed_size)
    return cascades(edges, seeds, trials, p, seed).agg(F.rint(F.avg("size")).cast("long").alias("spread"))


def influence(synthetic: DataFrame, original: DataFrame, seed_size: int = 20, trials: int = 100, p: float = 0.01, seed: int = 0) -> DataFrame:
    """Seeds from the synthetic graph, their spread on the original; both as
    weighted edges (src, dst, weight) over the original's ids."""
    return spread(original, degree_discount(synthetic, seed_size, p), trials, p, seed)
