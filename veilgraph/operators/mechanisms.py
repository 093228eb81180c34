"""Differential-privacy mechanisms over graph tables.

Noise is keyed (see functions.noise).  Post-processing keeps released counts
non-negative without moving their sum much.  What is released comes from
noisy tables only; cells that are empty get noise like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.keyed import Keys
from veilgraph.functions.noise import gumbel, laplace, uniform
from veilgraph.functions.scalars import clip_bound
from veilgraph.operators.graph import Graph, both_ways, community_matrix, community_pairs, degrees, induced, intra_degrees
from veilgraph.operators.louvain import louvain, louvain_rounds
from veilgraph.operators.ranking import ranked, running_total
from veilgraph.plans.staging import drop, staged

#: A shift is taken only if it brings the sum nearer than this (fixed value).
FARTHEST = 100_000_000


def norm_sub(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Adds out: value truncated, then, if a group (keys) holds negatives,
    less the first shift i in 0 .. -min-1 for which the sum of max(x - i, 0)
    is nearest the sum of all, floored at 0.

    The sum over what is kept falls with the shift, and between two values
    in steps of the number of rows above; so it is nearest at the first shift
    whose sum is no more than wanted or at the one before.  Values are counted
    first: rows are never paired with shifts, and a group of any size is as
    many rows as it has values.
    """
    x = F.col(value).cast("int").cast("long")
    rows = df.withColumn(out, x)
    by = keys or [F.lit(0).alias("_all")]
    names = keys or ["_all"]
    best = _shifts(rows.groupBy(*by, F.col(out).alias("at")).agg(F.count("*").alias("n")), names)
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    joined = rows.join(best, names, "left")
    kept = F.when(F.col("_none"), F.lit(0)).when(F.col("_shift").isNotNull(), F.greatest(F.col(out) - F.col("_shift"), F.lit(0))).otherwise(F.col(out))
    return joined.withColumn(out, kept.cast("long")).drop("_shift", "_none", "_all")


def _shifts(hist: DataFrame, names: list[str]) -> DataFrame:
    """(names, _shift, _none) of groups that hold negatives, from the counts n
    of their values at: the shift of norm_sub, and whether none is near."""
    span = hist.groupBy(*names).agg(F.min("at").alias("low"), F.sum(F.col("at") * F.col("n")).alias("total"))
    # what lies above each value: totals of runs of values from the largest down
    line = hist.join(span.where("low < 0"), names).where("at >= 0").withColumn("down", -F.col("at"))
    line = running_total(line, names, "down", F.col("n"), "count")
    line = running_total(line, names, "down", F.col("n") * F.col("at"), "mass")
    after = Window.partitionBy(*names, "_run").orderBy(F.desc("at"))
    line = line.withColumn("_run", F.shiftright("down", 16))
    edge = line.groupBy(*names, "_run").agg(F.max("at").alias("_first"))
    below = edge.withColumn("_next", F.lead("_first").over(Window.partitionBy(*names).orderBy("_run"))).drop("_first")
    line = line.join(below, [*names, "_run"]).withColumn("to", F.coalesce(F.lead("at").over(after), "_next", F.lit(0)))
    # shifts from the value below up to this one keep mass - shift * count
    cross = F.floor((F.col("mass") - F.col("total")) / F.col("count"))
    shift = lambda c: F.least(F.greatest(c, F.col("to")), F.col("at"))
    tried = F.array(F.col("to"), F.col("at"), shift(cross), shift(cross + 1), shift(-F.col("low") - 1))
    sums = line.select(*names, "low", "total", "count", "mass", F.explode(tried).alias("i"))
    top = hist.groupBy(*names).agg(F.max("at").alias("most"))  # from the largest value on nothing is kept
    ends = span.where("low < 0").join(top, names).select(*names, "low", "total", F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("mass"), F.greatest("most", F.lit(0).cast("long")).alias("i"))
    sums = sums.select(*names, "low", "total", "count", "mass", F.col("i").cast("long").alias("i")).unionByName(ends).where("i < -low")
    gap = F.abs(F.col("mass") - F.col("i") * F.col("count") - F.col("total"))
    best = sums.groupBy(*names).agg(F.min(F.struct(gap.alias("gap"), F.col("i").alias("shift"))).alias("b"))
    return best.select(*names, F.col("b.shift").alias("_shift"), (F.col("b.gap") >= FARTHEST).alias("_none"))


METHODS = {"norm_sub": norm_sub}


def post_process(df: DataFrame, value: str, keys: list[str], out: str, method: str = "norm_sub") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no post-processing {method!r}; there is {', '.join(METHODS)}")
    return METHODS[method](df, value, keys, out)


def noisy_edge_vector(edges: DataFrame, partition: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """(ci, cj, raw, noisy, ev): edges between each two communities ci < cj,
    empty pairs included, with Lap(1/epsilon) and made consistent."""
    counts = induced(edges, partition).withColumnRenamed("w", "n")
    cells = community_pairs(partition, diagonal=False).join(counts, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("n", F.lit(0)).cast("long").alias("raw"))
    noisy = cells.withColumn("noisy", F.col("raw") + laplace(1 / epsilon, uniform(seed, "edge-vector", F.col("ci"), F.col("cj"))))
    return norm_sub(noisy, "noisy", [], "ev")


def noisy_degrees(graph: Graph, partition: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """(com, vid, noisy, target): inner degrees with Lap(2/epsilon), truncated
    and made consistent per community, at most its size less one."""
    rows = intra_degrees(graph, partition)
    noisy = rows.withColumn("noisy", F.col("deg") + laplace(2 / epsilon, uniform(seed, "degree-sequence", F.col("vid"))))
    fitted = norm_sub(noisy, "noisy", ["com"], "fit")
    size = partition.groupBy("com").agg(F.count("*").alias("size"))
    return fitted.join(size, "com").select("com", "vid", "noisy", F.greatest(F.lit(0), F.least(F.col("fit"), F.col("size") - 1)).cast("long").alias("target"))


def laplace_degrees(graph: Graph, scale: float, seed: int) -> DataFrame:
    """(vid, deg, noisy)."""
    return degrees(graph).withColumn("noisy", F.col("deg") + laplace(scale, uniform(seed, "degree", F.col("vid"))))


def random_groups(vertices: DataFrame, size: int, seed: int) -> DataFrame:
    """(vid, com): groups of size vertices in keyed random order."""
    u = uniform(seed, "groups", F.col("vid"))
    order = ranked(vertices.select("vid", u.alias("u")), F.col("u"), F.col("vid"))
    return order.select("vid", F.floor(F.col("rank") / size).cast("long").alias("com"))


def score_groups(scores: DataFrame, score: str, size: int) -> DataFrame:
    """(vid, com): groups of size vertices by falling score."""
    order = ranked(scores.select("vid", score), F.desc(score), F.col("vid"))
    return order.select("vid", F.floor(F.col("rank") / size).cast("long").alias("com"))


def noisy_super_graph(edges: DataFrame, groups: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """(ci, cj, w): the groups' noisy weights: Lap(1/epsilon) off the
    diagonal, Lap(2/epsilon) on it (twice the inner edges), each part made
    consistent by itself."""
    cells = community_matrix(edges, groups)
    scale = F.when(F.col("ci") == F.col("cj"), F.lit(2 / epsilon)).otherwise(F.lit(1 / epsilon))
    noisy = cells.withColumn("noisy", F.col("w") + laplace(scale, uniform(seed, "super-graph", F.col("ci"), F.col("cj"))))
    noisy = noisy.withColumn("inner", F.col("ci") == F.col("cj"))
    return norm_sub(noisy, "noisy", ["inner"], "fit").select("ci", "cj", F.col("fit").alias("w"))


#: Groups of a block whose cells are made in one task, at most and at least.
SIDE, LEAST_SIDE = 8192, 64


def _noise(keys: Keys, prefix: str, scale: float) -> np.ndarray:
    """laplace(scale, uniform(...)) of the keys under a prefix."""
    u = keys.uniform(prefix)
    return np.where(u < 0.5, scale * np.log(2 * u), -scale * np.log(2 * (1 - u)))


def _least_shift(groups: int, total: int, scale: float) -> int:
    """About the shift at which noise alone brings the total."""
    above = groups * (groups - 1) / 4 * math.exp(-1 / scale) / (1 - math.exp(-1 / scale))  # 0
    return max(0, math.floor(scale * math.log(max(1.0, above / total))))


def noisy_links(edges: DataFrame, groups: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """(src, dst, weight): the cells of noisy_super_graph that are not 0.
    Groups are numbered from 0 without gaps. Every cell gets its noise, block
    against block of groups, and is counted by its value; those above a guess
    at the shift are kept, and should the shift be below it, all cells are made
    again. Only the edges between groups travel, never a cell."""
    spark, scale = edges.sparkSession, 1 / epsilon
    low, high, many = groups.agg(F.min("com"), F.max("com"), F.countDistinct("com")).first()
    if not many or low != 0 or high + 1 != many:
        cells = staged(noisy_super_graph(edges, groups, epsilon, seed), "super-graph")
        return cells.where("w > 0").select(F.col("ci").alias("src"), F.col("cj").alias("dst"), F.col("w").alias("weight"))
    side = max(LEAST_SIDE, min(SIDE, -(-many // 4)))
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    counts = staged(induced(edges, groups).select(at("ci").alias("p"), at("cj").alias("q"), "ci", "cj", "w"), "super-counts")
    block = spark.range(-(-many // side)).select(F.col("id").cast("int").alias("p"))
    pairs = block.join(block.withColumnRenamed("p", "q"), F.col("p") <= F.col("q"))
    none = F.lit(None).cast("long")
    rows = counts.unionByName(pairs.select("p", "q", none.alias("ci"), none.alias("cj"), none.alias("w")))

    def made(table: pa.Table) -> Iterator[tuple[bool, np.ndarray | int, np.ndarray, np.ndarray]]:
        """(inner, ci, cj, value) for runs of cells; a value is truncated."""
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        table = table.filter(pc.is_valid(table.column("ci"))).sort_by("ci")
        ci, cj, w = (table.column(c).to_numpy() for c in ("ci", "cj", "w"))
        there = np.arange(q * side, min((q + 1) * side, many))
        if p == q:
            loops = np.zeros(len(there))
            loops[ci[ci == cj] - there[0]] = 2 * w[ci == cj]
            yield True, there, there, np.trunc(loops + _noise(Keys(there, there), f"{seed}|super-graph", 2 / epsilon)).astype(np.int64)
            ci, cj, w = ci[ci < cj], cj[ci < cj], w[ci < cj]
        for i in range(p * side, min((p + 1) * side, many)):
            if i == p * side or p == q and i % 512 == 0:  # within a block only the later groups
                begin = i if p == q else there[0]
                keys = Keys(there[there >= begin])
            value = _noise(keys, f"{seed}|super-graph|{i}", 1 / epsilon)
            a, b = np.searchsorted(ci, (i, i + 1))
            value[cj[a:b] - begin] += w[a:b]
            skip = i + 1 - begin if p == q else 0
            yield False, i, there[begin - there[0] + skip :], np.trunc(value[skip:]).astype(np.int64)

    m = counts.where("ci < cj").agg(F.sum("w")).first()[0] or 1
    guess = {True: 0, False: _least_shift(many, m, scale)}

    def above(least: dict[bool, int | None], count: bool) -> Callable[[pa.Table], pa.Table]:
        """Makes a block's cells above the least value of their kind, then, to
        be counted, how many of all have each value."""

        def run(table: pa.Table) -> pa.Table:
            found: list[tuple[np.ndarray, ...]] = []
            values: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for inner, i, j, value in made(table):
                hit = np.flatnonzero(value > least[inner]) if least[inner] is not None else []
                if len(hit):
                    found.append((np.broadcast_to(i, j.shape)[hit], j[hit], value[hit]))
                if count and len(value):
                    low = int(value.min())
                    if int(value.max()) - low < 1 << 20:
                        n = np.bincount(value - low)
                        x, n = np.flatnonzero(n) + low, n[n > 0]
                    else:
                        x, n = np.unique(value, return_counts=True)
                    values[inner].update(dict(zip(x.tolist(), n.tolist(), strict=True)))
            cells = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), (), ()))]
            rest = [(inner, x, n) for inner, all_of in values.items() for x, n in all_of.items()]
            own = (cells[0] == cells[1]).tolist()
            gone = [None] * len(rest)
            columns = [
                pa.array(own + [r[0] for r in rest], pa.bool_()), pa.array(np.concatenate([cells[2], np.array([r[1] for r in rest], np.int64)])), pa.array([None] * len(own) + [r[2] for r in rest], pa.int64()),
                pa.chunked_array([pa.array(cells[0], pa.int64()), pa.array(gone, pa.int64())]), pa.chunked_array([pa.array(cells[1], pa.int64()), pa.array(gone, pa.int64())]),
            ]
            return pa.table(columns, ["inner", "at", "n", "src", "dst"])

        return run

    schema = "inner boolean, at long, n long, src long, dst long"
    first = staged(rows.groupBy("p", "q").applyInArrow(above(guess, True), schema), "super-values")
    hist = first.where("n is not null").groupBy("inner", "at").agg(F.sum("n").alias("n"))
    shifts = {True: 0, False: 0} | {r.inner: None if r["_none"] else r["_shift"] for r in _shifts(staged(hist, "super-counted"), ["inner"]).collect()}
    cells = first.where("src is not null")
    if any(x is not None and x < guess[inner] for inner, x in shifts.items()):  # the guess was too high
        cells = rows.groupBy("p", "q").applyInArrow(above(shifts, False), schema)
    shift = F.when(F.col("inner"), F.lit(shifts[True])).otherwise(F.lit(shifts[False]))
    return cells.where(F.col("at") > shift).select("src", "dst", (F.col("at") - shift).cast("long").alias("weight"))


def group_communities(edges: DataFrame, groups: DataFrame, epsilon: float, seed: int, resolution: float = 1.0, exact: bool = False) -> DataFrame:
    """(vid, com): Louvain over the noisy super-graph, groups expanded to
    their vertices.  The weight of a group's loop is its diagonal cell.  In
    rounds; with exact, vertex after vertex in one task."""
    links = staged(noisy_links(edges, groups, epsilon, seed), "super-graph")
    nodes = groups.select(F.col("com").alias("vid")).distinct()
    found = (louvain if exact else louvain_rounds)(nodes, links, resolution, seed).select(F.col("vid").alias("g"), F.col("com").alias("c"))
    return groups.join(found, F.col("com") == F.col("g")).select("vid", F.col("c").alias("com"))


def init_random(graph: Graph, epsilon: float, size: int, seed: int, resolution: float = 1.0, exact: bool = False) -> DataFrame:
    return group_communities(graph.edges, staged(random_groups(graph.vertices, size, seed), "groups"), epsilon, seed, resolution, exact)


def degree_scores(graph: Graph, epsilon: float, seed: int, alpha: float = 0.3) -> DataFrame:
    """(vid, score): degrees with Lap(2 / (alpha epsilon)); one edge changes
    two of them."""
    return laplace_degrees(graph, 2 / (alpha * epsilon), seed).select("vid", F.col("noisy").alias("score"))


def neighbour_scores(graph: Graph, epsilon: float, seed: int, alpha: float = 0.3, beta: float = 0.5, bound: int | None = None) -> DataFrame:
    """(vid, score): noisy degree plus beta times the noisy sum of the
    neighbours' noisy degrees, clipped to [0, bound]."""
    n = graph.vertices.count()
    c = clip_bound(n, epsilon) if bound is None else bound
    part = alpha * epsilon / 2
    degs = staged(laplace_degrees(graph, 2 / part, seed).select("vid", F.col("noisy").alias("d")), "noisy-degrees")
    cut = degs.select(F.col("vid").alias("dst"), F.greatest(F.lit(0.0), F.least("d", F.lit(float(c)))).alias("cut"))
    sums = both_ways(graph.edges).join(cut, "dst").groupBy(F.col("src").alias("s")).agg(F.sum("cut").alias("sum"))
    joined = degs.join(sums, F.col("vid") == F.col("s"), "left")
    near = F.coalesce("sum", F.lit(0.0)) + laplace(2 * c / part, uniform(seed, "neighbour-sum", F.col("vid")))
    return joined.select("vid", (F.col("d") + beta * near).alias("score"))


def init_degree(graph: Graph, epsilon: float, seed: int, resolution: float = 1.0, alpha: float = 0.3) -> DataFrame:
    size = max(1, math.isqrt(graph.vertices.count()))
    groups = score_groups(degree_scores(graph, epsilon, seed, alpha), "score", size)
    return group_communities(graph.edges, staged(groups, "groups"), (1 - alpha) * epsilon, seed, resolution)


def init_neighbour(graph: Graph, epsilon: float, seed: int, size: int | None = None, resolution: float = 1.0, alpha: float = 0.3, beta: float = 0.5, bound: int | None = None) -> DataFrame:
    size = size or max(1, math.isqrt(graph.vertices.count()))
    groups = score_groups(neighbour_scores(graph, epsilon, seed, alpha, beta, bound), "score", size)
    return group_communities(graph.edges, staged(groups, "groups"), (1 - alpha) * epsilon, seed, resolution)


def _nth_absent(present: Column, n: Column) -> Column:
    """The n-th number from 0 that the sorted array present lacks."""
    return F.aggregate(present, n, lambda acc, x: F.when(x <= acc, acc + 1).otherwise(acc))


def _dealt(seed: int, vid: Column, batches: int) -> Column:
    """The keyed batch of a vertex."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("em-deal"), vid.cast("string"))), 1, 13), 16, 10).cast("long"), F.lit(batches))


def em_batch(graph: Graph, partition: DataFrame, epsilon: float, seed: int, resolution: float = 1.0, batch: int = 0, batches: int = 1, arcs: DataFrame | None = None) -> DataFrame:
    """(vid, com) with the vertices of one keyed batch of several moved by the
    Exponential Mechanism, all on the same snapshot.

    A community's chance is proportional to exp(epsilon / 4 * resolution *
    edges into it); the largest of those exponents plus Gumbel noise is such
    a draw.  Only communities that a vertex touches are scored one by one;
    the others share the exponent 0, so the largest of their noises is one
    Gumbel draw plus the logarithm of their number, and which of them has it
    is uniform.  Communities are dense numbers from 0.  Only arcs of the
    batch's vertices are joined to communities; arcs are these, if at hand.
    """
    c1 = epsilon / 4 * resolution
    k = partition.agg((F.max("com") + 1).alias("k"))
    if arcs is None:
        arcs = both_ways(graph.edges.select("src", "dst")).where(_dealt(seed, F.col("src"), batches) == batch)
    near = arcs.join(partition.select(F.col("vid").alias("dst"), "com"), "dst").groupBy(F.col("src").alias("vid"), "com").agg(F.count("*").alias("w"))
    noise = gumbel(uniform(seed, f"em-batch-{batch}", F.col("vid"), F.col("com")))
    touched = near.withColumn("score", c1 * F.col("w") + noise)
    best = touched.groupBy("vid").agg(F.max(F.struct("score", -F.col("com"))).alias("b"), F.array_sort(F.collect_list("com")).alias("near"))
    rows = partition.join(best.withColumnRenamed("vid", "v"), F.col("vid") == F.col("v"), "left").crossJoin(k)
    present = F.coalesce("near", F.array().cast("array<long>"))
    rest = F.col("k") - F.size(present)
    flat = F.log(rest.cast("double")) + gumbel(uniform(seed, f"em-rest-{batch}", F.col("vid")))
    pick = _nth_absent(present, F.floor(uniform(seed, f"em-which-{batch}", F.col("vid")) * rest).cast("long"))
    use_rest = (rest > 0) & (F.col("b").isNull() | (flat > F.col("b.score")))
    drawn = F.when(use_rest, pick).otherwise(-F.col("b.col2"))
    mine = _dealt(seed, F.col("vid"), batches) == batch
    return rows.select("vid", F.when(mine, drawn).otherwise(F.col("com")).cast("long").alias("com"))


def adjust_communities(graph: Graph, partition: DataFrame, epsilon: float, seed: int, batches: int = 4) -> DataFrame:
    """One Exponential-Mechanism pass in keyed batches: each vertex moves
    once, seeing the moves of earlier batches.  An edge still bears on the
    draws of its two ends alone, as in the sequential pass; the output
    distribution isn't the sequential one's."""
    from veilgraph.operators.graph import renumbered

    turns = graph.vertices.select(F.col("vid").alias("src"), _dealt(seed, F.col("vid"), batches).alias("turn"))
    arcs = staged(both_ways(graph.edges.select("src", "dst")).join(turns, "src"), "em-arcs", ["turn"])
    for batch in range(batches):
        own = arcs.where(F.col("turn") == batch).select("src", "dst")
        partition = staged(em_batch(graph, renumbered(partition), epsilon, seed, batch=batch, batches=batches, arcs=own), "em")
    drop(arcs)
    return renumbered(partition)
