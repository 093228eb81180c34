"""Graph metrics, and comparisons of two graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions.scalars import DOUBLE_EPS, relative_error
from veilgraph.operators.components import connected_components
from veilgraph.operators.graph import Graph, both_ways, degrees, edge_communities
from veilgraph.operators.ranking import ranked, running_total
from veilgraph.plans.staging import drop, staged


def later_neighbours(graph: Graph) -> DataFrame:
    """(vid, later): each vertex's neighbours that follow it in the order of
    (degree, id). However large a vertex's degree, its list has no more than
    the square root of twice the edges."""
    order = degrees(graph).select("vid", F.struct("deg", "vid").alias("place"))
    a = order.select(F.col("vid").alias("src"), F.col("place").alias("pa"))
    b = order.select(F.col("vid").alias("dst"), F.col("place").alias("pb"))
    placed = graph.edges.join(a, "src").join(b, "dst")
    first = F.when(F.col("pa") < F.col("pb"), F.col("src")).otherwise(F.col("dst"))
    second = F.when(F.col("pa") < F.col("pb"), F.col("dst")).otherwise(F.col("src"))
    return placed.groupBy(first.alias("vid")).agg(F.collect_list(second).alias("later"))


def triangle_counts(graph: Graph) -> DataFrame:
    """One row: triangles, wedges (paths of two edges) and transitivity,
    three times their quotient (0 without wedges). Each triangle is found
    once, as a common later neighbour of its first edge."""
    lists = staged(later_neighbours(graph), "later-neighbours")
    edges = lists.select("vid", F.explode("later").alias("other"), "later")
    there = lists.select(F.col("vid").alias("o"), F.col("later").alias("beyond"))
    common = edges.join(there, F.col("other") == F.col("o")).select(F.size(F.array_intersect("later", "beyond")).alias("n"))
    triangles = common.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))
    wedges = degrees(graph).agg(F.coalesce(F.sum(F.col("deg") * (F.col("deg") - 1) / 2), F.lit(0)).cast("long").alias("wedges"))
    share = F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0)
    return triangles.crossJoin(wedges).withColumn("transitivity", share)


#: Arcs of a block of vertices whose pairs with another block's a task counts,
#: and pairs that it returns at once.
BLOCK_ARCS, PAIRS = 1 << 21, 1 << 17


def _vertex_blocks(arcs: DataFrame) -> np.ndarray:
    """The first vertex of every block: vertices in order, of about as many
    arcs, so that there are some tasks for each core."""
    deg = staged(arcs.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("deg")), "block-degrees")
    total = deg.agg(F.sum("deg")).first()[0] or 0
    share = max(1, min(BLOCK_ARCS, total // 8))
    block = F.floor((F.col("upto") - F.col("deg")) / share)
    first = running_total(deg, [], "vid", F.col("deg"), "upto").groupBy(block.alias("block")).agg(F.min("vid").alias("vid"))
    return np.sort(np.array([r.vid for r in first.select("vid").collect()], np.int64))


def _numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each one's place among them: without
    a sort where they lie near each other."""
    low = int(x.min()) if len(x) else 0
    width = int(x.max()) - low + 1 if len(x) else 0
    if width > 4 * len(x) + SOURCES:
        vs, at = np.unique(x, return_inverse=True)
        return vs, at.astype(np.int32)
    there = np.zeros(width, bool)
    there[x - low] = True
    place = np.cumsum(there, dtype=np.int32) - 1
    return np.flatnonzero(there) + low, place[x - low]


def _shared(i: int, j: int, a: pa.ListArray, b: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(u, v, n): for each vertex of block i those of block j, later ones if it
    is the same, with which it is in n lists: a has the lists' vertices of
    block i and b those of block j. Of an arc it holds some words of 32 bits,
    and Python's numbers for one vertex only."""
    flat, other = a.flatten().to_numpy(), (a if i == j else b).flatten().to_numpy()
    size = a.value_lengths().to_numpy()
    vs, local = _numbers(other)
    ends = np.cumsum(size if i == j else b.value_lengths().to_numpy(), dtype=np.int32)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    us, turn = _numbers(flat)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(turn, minlength=len(us)))]).tolist()
    order = np.argsort(turn, kind="stable").astype(np.int32)
    del turn
    end = ends[row[order]]
    begin = order + 1 if i == j else np.concatenate([[0], ends[:-1]]).astype(np.int32)[row[order]]
    del order, row
    for u, x, y in zip(us.tolist(), cuts, cuts[1:], strict=False):
        n = np.bincount(np.concatenate([local[p:q] for p, q in zip(begin[x:y].tolist(), end[x:y].tolist(), strict=True)]), minlength=1)
        v = np.flatnonzero(n)
        if len(v):
            yield u, vs[v], n[v]


def common_neighbours(graph: Graph) -> DataFrame:
    """(u, v, n), u < v: neighbours that two vertices share, if any. Each
    vertex sends the neighbours that it has in two blocks to the task that
    counts the pairs of these, so that arcs travel, as often as blocks meet,
    but no wedges and no counts. Wedges are enumerated, so this is for graphs
    of bounded degree."""
    arcs = both_ways(graph.edges.select("src", "dst"))
    bounds = _vertex_blocks(arcs)
    lists = staged(arcs.groupBy("src").agg(F.sort_array(F.collect_list(F.col("dst").cast("long"))).alias("near")).select("near"), "neighbour-lists")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            flat = near.flatten()
            row, block = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy()), np.searchsorted(bounds, flat.to_numpy(), side="right")
            if not len(flat):
                continue
            first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(block) != 0)]))
            parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), flat)
            row, block, k = row[first], block[first], np.arange(len(first))
            many = np.searchsorted(row, row, side="right") - k
            i = np.repeat(k, many)
            j = i + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            b = parts.take(pa.array(j, mask=i == j))  # a block's pairs with itself need one list
            yield pa.RecordBatch.from_arrays([pa.array(block[i], pa.int32()), pa.array(block[j], pa.int32()), parts.take(pa.array(i)), b], ["i", "j", "a", "b"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        a, b = (table.column(c).combine_chunks() for c in "ab")
        out, size = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat([u for u, _, _ in out], [len(v) for _, v, _ in out])), *(pa.array(np.concatenate([x[c] for x in out])) for c in (1, 2))], ["u", "v", "n"])
        for found in _shared(table.column("i")[0].as_py(), table.column("j")[0].as_py(), a, b):
            out.append(found)
            size += len(found[1])
            if size >= PAIRS:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    tiles = lists.mapInArrow(dealt, "i int, j int, a array<long>, b array<long>")
    tiles = tiles.repartition(max(1, min(len(bounds) * (len(bounds) + 1), 20_000)), "i", "j")
    return tiles.groupBy("i", "j").applyInArrow(counted, "u long, v long, n long")


def non_neighbours(graph: Graph, partition: DataFrame) -> DataFrame:
    """(com, u, v), u < v: pairs of a community that no edge joins. Each
    vertex brings its later neighbours of its community along to the blocks of
    this, so that pairs are made where they are returned and never travel."""
    from veilgraph.operators.synthesis import block_pairs

    inner = edge_communities(graph.edges, partition).where("cu = cv")
    joined = inner.groupBy(F.col("src").alias("s")).agg(F.collect_list("dst").alias("near"))
    rows = partition.join(joined, F.col("vid") == F.col("s"), "left").select("com", "vid", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    each = block_pairs(rows, "near").select("com", "same", F.col("b.vid").alias("v"), F.explode("a").alias("a"))
    later = F.when(F.col("same"), F.filter("v", lambda x: x > F.col("a.vid"))).otherwise(F.col("v"))
    return each.select("com", F.col("a.vid").alias("u"), F.explode(F.array_except(later, F.col("a.near"))).alias("v"))


def bfs_levels(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, vid, depth) of every vertex that each source reaches; all
    vertices are sources if none are given (then as many rows as pairs)."""
    start = (sources or graph.vertices).select(F.col("vid").alias("source"), "vid")
    paths = staged(both_ways(graph.edges), "bfs-edges")
    seen = staged(start.withColumn("depth", F.lit(0)), "bfs-0")
    frontier, depth = seen, 0
    while True:
        depth += 1
        reached = frontier.join(paths, frontier["vid"] == paths["src"]).select("source", F.col("dst").alias("vid")).distinct()
        frontier = staged(reached.join(seen, ["source", "vid"], "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def components(graph: Graph) -> DataFrame:
    return connected_components(graph.vertices, graph.edges)


#: Vertices from which a task of the diameter searches at once, arcs that it
#: follows at once, neighbours that a level looks at one by one before the rest.
SOURCES, ARCS, NEAR = 512, 1 << 18, 32
#: Edges of a component that a task can hold, those below which components
#: share a task, and searches at once in a component that no task can hold.
TASK_EDGES, FEW_EDGES, SEARCHES = 1 << 23, 1 << 12, 16


def _depth(first: np.ndarray, other: np.ndarray, sources: np.ndarray, far: np.ndarray | None = None, least: int = 2, radius: int | None = None) -> np.ndarray:
    """The largest distance from each source in a connected graph whose vertex
    v has the neighbours other[first[v]:first[v + 1]], vertices by falling
    degree. Each has a bit for every source that reaches it; a vertex that has
    them all looks at no more neighbours. Marks in far the vertices at least
    (2 or more) steps from a source. With a radius, the bits after so many steps
    are returned instead."""
    deg, k = np.diff(first), np.arange(len(sources))
    seen = np.zeros((len(deg), -(-len(sources) // 64)), np.uint64)
    word, bits = k >> 6, np.uint64(1) << (k & 63).astype(np.uint64)
    seen[sources, word] = bits
    every = np.bitwise_or.reduce(seen[sources], axis=0)
    short = lambda rows, have: rows[(have != every).any(axis=1)]
    depths = np.minimum(deg[sources], 1)
    for s, at, bit in zip(sources.tolist(), word.tolist(), bits, strict=True):  # the first level from the sources' side
        seen[other[first[s] : first[s + 1]], at] |= bit
    levels, left = 1, short(np.arange(len(deg)), seen)
    while len(left) and levels != radius:
        now, rows = seen.copy(), left
        for begin in range(0, NEAR, 8):
            rows = rows[: np.searchsorted(-deg[rows], -begin, side="left")]
            got = now[rows]
            for j in range(begin, begin + 8):
                n = np.searchsorted(-deg[rows], -j, side="left")
                got[:n] |= seen[other[first[rows[:n]] + j]]
            now[rows] = got
            rows = short(rows, got)
        rows = rows[: np.searchsorted(-deg[rows], -NEAR, side="left")]
        cuts = np.concatenate([[0], np.cumsum(deg[rows] - NEAR)])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + ARCS, side="right")) - 1)
            starts = cuts[a:b] - cuts[a]
            at = np.arange(cuts[b] - cuts[a]) + np.repeat(first[rows[a:b]] + NEAR - starts, deg[rows[a:b]] - NEAR)
            now[rows[a:b]] |= np.bitwise_or.reduceat(seen[other[at]], starts, axis=0)
            a = b
        levels += 1
        grown = now[left] ^ seen[left]
        reached = np.bitwise_or.reduce(grown, axis=0)
        if far is not None and levels >= least:
            far[left[grown.any(axis=1)]] = True
        depths[reached[word] & bits != 0] = levels
        seen, left = now, short(left, now[left])
    return depths if radius is None else seen


#: Vertices of a component from which on a cover pays, and bytes of one, at most.
COVER_VERTICES, COVER_BYTES = 1 << 11, 1 << 26


def _uncovered(first: np.ndarray, other: np.ndarray, left: np.ndarray, found: int) -> np.ndarray:
    """Of left those that may have a vertex more than found steps away: the
    quarter of the vertices that has most edges is searched from, for one step
    less, and what its neighbours in that quarter reach is within found of a
    vertex. Their searches cost a quarter of those from all vertices."""
    n = len(first) - 1
    few = n // 4
    if n < COVER_VERTICES or few * n // 8 > COVER_BYTES or found < 2 or len(left) <= 2 * few:
        return left
    words = -(-n // 64)
    reach, last = np.zeros((few, words), np.uint64), np.full(words, ~np.uint64(0))
    last[-1] >>= np.uint64(64 * words - n)
    for k in range(0, few, SOURCES):
        sources = np.arange(k, min(k + SOURCES, few))
        bits = np.unpackbits(_depth(first, other, sources, radius=found - 1).view(np.uint8), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits[:, : len(sources)].T), axis=1, bitorder="little")
        reach.view(np.uint8).reshape(few, -1)[k : k + len(sources), : packed.shape[1]] = packed
    near = np.add.reduceat(other < few, first[:-1], dtype=np.int64)  # neighbours of most edges come first
    out = []
    for k in range(0, len(left), 1024):
        rows = left[k : k + 1024]
        rows = rows[np.argsort(-near[rows], kind="stable")]
        got = np.zeros((len(rows), words), np.uint64)
        for j in range(int(near[rows].max())):
            m = np.searchsorted(-near[rows], -j, side="left")
            if not m:
                break
            got[:m] |= reach[other[first[rows[:m]] + j]]
            if j % 8 == 7:
                open_ = (got != last).any(axis=1)
                rows, got = rows[open_], got[open_]
        out.append(rows[(got != last).any(axis=1)])
    return np.sort(np.concatenate(out))


def _component_depth(src: np.ndarray, dst: np.ndarray, shard: int, shards: int) -> int:
    """The largest distance from a shard of a component's vertices. A vertex is
    no farther from any other than its neighbour of most edges, its hub, and
    one step: hubs come first, and those are passed over that can be no farther
    than what is found. What is farther from one of the rest is at least what
    is found from its hub: the searches go on from those, if they are fewer. The
    vertices of a hub share a shard, unless they are
    many."""
    low, width = min(src.min(), dst.min()), int(max(src.max(), dst.max())) - int(min(src.min(), dst.min())) + 1
    if width <= 4 * len(src) + SOURCES:
        a, b = src - low, dst - low
    else:
        ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
        a, b, width = np.searchsorted(ids, src), np.searchsorted(ids, dst), len(ids)
    deg = np.bincount(a, minlength=width) + np.bincount(b, minlength=width)
    there = np.flatnonzero(deg)
    there = there[np.argsort(-deg[there], kind="stable")]
    n, place = len(there), np.empty(width, np.int64)
    place[there] = np.arange(n)
    a, b = place[a], place[b]
    keys = np.concatenate([a << 32 | b, b << 32 | a])
    del a, b
    keys.sort()
    other = (keys & 0xFFFFFFFF).astype(np.int32)
    del keys
    first = np.concatenate([[0], np.cumsum(deg[there])])
    named, turn, many = np.unique(other[first[:-1]], return_inverse=True, return_counts=True)
    own = np.where(many[turn] * 4 * shards > n, np.arange(n), turn) % shards == shard
    found = int(_depth(first, other, np.arange(max(0, n - 64), n)).max())  # of fewest edges: likely far away
    hubs, bound, far = np.unique(turn[own]), np.zeros(len(named), np.int64), np.full(n, found < 2)
    for k in range(0, len(hubs), SOURCES):
        bound[hubs[k : k + SOURCES]] = 1 + _depth(first, other, named[hubs[k : k + SOURCES]].astype(np.int64), far, found)
        found = max(found, int(bound.max()) - 1)
    own[named] = False
    left, far = _uncovered(first, other, np.flatnonzero(own & (bound[turn] > found)), found), np.flatnonzero(far)
    if len(far) < len(left):
        return max([found, *(int(_depth(first, other, far[k : k + SOURCES]).max()) for k in range(0, len(far), SOURCES))])
    while len(left := left[bound[turn[left]] > found]):
        found = max(found, int(_depth(first, other, left[:SOURCES]).max()))
        left = left[SOURCES:]
    return found


def _packed(edges: DataFrame, kind: str) -> DataFrame:
    """(component, src, dst): the edges of a component in an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, src, dst = (batch.column(c).to_numpy() for c in ("component", "src", "dst"))
            order = np.argsort(component, kind="stable")
            found, cuts = np.unique(component[order], return_index=True)
            cuts = pa.array(np.append(cuts, len(order)), pa.int32())
            lists = (pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (src, dst))
            yield pa.RecordBatch.from_arrays([pa.array(found), *lists], ["component", "src", "dst"])

    ends = edges.select(F.col("component").cast("long").alias("component"), F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    return ends.mapInArrow(run, f"component long, src array<{kind}>, dst array<{kind}>")


def _searched(rows: DataFrame) -> DataFrame:
    """(depth) of (bin, shard, shards, component, src, dst), edges in lists: one
    task for each bin and shard."""

    def search(table: pa.Table) -> pa.Table:
        component, shard, shards = (table.column(c).to_numpy() for c in ("component", "shard", "shards"))
        order = np.argsort(component, kind="stable")
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            ends = (table.column(c).take(pa.array(at)).combine_chunks().flatten().to_numpy() if len(at) < len(order) else np.concatenate([x.flatten().to_numpy() for x in table.column(c).chunks]) for c in ("src", "dst"))
            found.append(_component_depth(*ends, int(shard[0]), int(shards[at[0]])))
        return pa.table({"depth": pa.array([max(found)], pa.int32())})

    return rows.groupBy("bin", "shard").applyInArrow(search, "depth int")


def _wide_diameter(edges: DataFrame) -> int:
    """The diameter of a component that no task can hold: searches from one
    vertex after the other bound the eccentricity of all the others, until no
    bound is above the largest distance found."""
    vertices = both_ways(edges).groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("deg"))
    open_ = staged(vertices.withColumn("most", F.lit(1 << 30)), "diameter-open")
    found = 0
    while True:
        sources = staged(open_.orderBy(F.desc("most"), F.desc("deg"), "vid").limit(SEARCHES).select("vid"), "diameter-sources")
        levels = bfs_levels(Graph(vertices, edges), sources)
        far = staged(levels.groupBy("source").agg(F.max("depth").alias("far")), "diameter-far")
        found = max(found, far.agg(F.max("far")).first()[0])
        reach = levels.join(far, "source").groupBy("vid").agg(F.min(F.col("far") + F.col("depth")).alias("reach"))
        after = open_.join(sources, "vid", "left_anti").join(reach, "vid").withColumn("most", F.least("most", "reach")).drop("reach")
        after = staged(after.where(F.col("most") > found), "diameter-open")
        drop(open_)
        if after.isEmpty():
            return found
        open_ = after


def diameter(graph: Graph) -> DataFrame:
    """One row: the largest distance of two vertices of one component, by
    breadth-first search from everywhere. A component's edges go to the tasks
    that search from its vertices, packed, a block of these at a time, a level
    of it being one pass over its edges; nothing is gathered by the driver.
    Small components share tasks. One that no task can hold is searched by joins,
    from as many vertices as bounds leave open."""
    spark = graph.edges.sparkSession
    part = staged(components(graph), "diameter-components")
    edges = staged(graph.edges.join(part.select(F.col("vid").alias("src"), "component"), "src"), "diameter-edges")
    size = staged(edges.groupBy("component").agg(F.count("*").alias("m")).join(part.groupBy("component").agg(F.count("*").alias("n")), "component"), "diameter-sizes")
    total = size.agg(F.sum("n"), F.sum(F.when(F.col("m") < FEW_EDGES, F.col("m")))).first()
    least, most = part.agg(F.min("vid"), F.max("vid")).first()
    kind = "int" if most is not None and -(1 << 30) <= least and most < 1 << 30 else "long"
    share = spark.sparkContext.defaultParallelism / (total[0] or 1)
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / SOURCES), F.ceil(F.col("n") * F.lit(share)))).cast("int")
    few = F.col("m") < FEW_EDGES
    bins = F.lit(1 + (total[1] or 0) // (16 * FEW_EDGES))
    dealt = size.where(F.col("m") <= TASK_EDGES).select("component", F.when(few, -1 - F.pmod(F.xxhash64("component"), bins)).otherwise(F.col("component")).alias("bin"), F.when(few, 1).otherwise(shards).alias("shards"))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    found = staged(_searched(_packed(edges, kind).join(dealt, "component")).agg(F.max("depth").alias("depth")), "diameter-found")
    wide = [r.component for r in size.where(F.col("m") > TASK_EDGES).select("component").collect()]
    depths = [_wide_diameter(edges.where(F.col("component") == c).select("src", "dst")) for c in wide]
    return found.select(F.greatest(F.coalesce("depth", F.lit(0)), F.lit(max(depths, default=0))).alias("diameter"))


def diameter_bound(graph: Graph) -> int:
    """A lower bound of the diameter by a double sweep in every component:
    from its smallest vertex, then from the farthest of those found."""
    roots = components(graph).select(F.col("component").alias("vid")).distinct()
    first = bfs_levels(graph, roots)
    far = first.groupBy("source").agg(F.max(F.struct("depth", "vid")).alias("x")).select(F.col("x.vid").alias("vid"))
    return bfs_levels(graph, far).agg(F.max("depth")).first()[0] or 0


#: Iterations between two looks at convergence, and edges that a task can hold
#: to iterate by itself.
CHECK_EVERY, TASK_PATHS = 5, 1 << 23


def _iterated(graph: Graph, n: int, tolerance: float, max_iterations: int) -> DataFrame:
    """(vid, evc) of eigenvector_centrality until it converges, in one task;
    no row if it doesn't."""
    rows = graph.edges.select("src", "dst").unionByName(graph.vertices.select(F.col("vid").alias("src"), F.lit(None).cast("long").alias("dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, src, dst = ([np.zeros(0, np.int64)] for _ in range(3))
        for batch in batches:
            linked = batch.filter(batch.column("dst").is_valid())
            alone.append(batch.filter(batch.column("dst").is_null()).column("src").to_numpy())
            src.append(linked.column("src").to_numpy())
            dst.append(linked.column("dst").to_numpy())
        own = np.concatenate(alone)
        ids = np.unique(np.concatenate([own, *map(np.unique, src), *map(np.unique, dst)]))
        src, dst = (np.concatenate([np.searchsorted(ids, x).astype(np.int32) for x in parts]) for parts in (src, dst))
        loop = np.isin(ids, own).astype(float)
        now = loop / n
        step = lambda x: loop * x + np.bincount(dst, x[src], len(ids)) + np.bincount(src, x[dst], len(ids))
        for _ in range(0, max_iterations, CHECK_EVERY):
            was = now
            for _ in range(CHECK_EVERY - 1):
                was = step(was)
            after = step(was)
            size = np.sqrt(np.sum(after * after))
            if size:
                now = after / size
            if not size or np.abs(now - was / np.sqrt(np.sum(was * was))).sum() < n * tolerance:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(now)], ["vid", "evc"])
                return

    return staged(rows.repartition(1).mapInArrow(run, "vid long, evc double"), "evc")


def eigenvector_centrality(graph: Graph, iterations: int | None = None, tolerance: float = 1e-6, max_iterations: int = 10_000) -> DataFrame:
    """(vid, evc): power iteration with the graph plus one loop on every
    vertex, from equal values, scaled to unit length.

    With iterations, exactly that many; else until one iteration changes the
    values by less than tolerance times the vertices in sum, looked at every
    CHECK_EVERY iterations, an error if it never does.  Scaling commutes with
    the iteration, so it is done as rarely.  Until it converges, a graph of at
    most TASK_PATHS edges is one task.
    """
    if iterations is None and graph.edges.count() <= TASK_PATHS and (n := graph.vertices.count()):
        found = _iterated(graph, n, tolerance, max_iterations)
        if found.isEmpty():
            raise ArithmeticError(f"no convergence in {max_iterations} iterations")
        return found
    loops = graph.vertices.select(F.col("vid").alias("src"), F.col("vid").alias("dst"))
    paths = staged(both_ways(graph.edges.select("src", "dst")).unionByName(loops), "evc-edges")
    n = graph.vertices.count()
    now = graph.vertices.withColumn("x", F.lit(1.0 / max(n, 1)))

    def step(x: DataFrame) -> DataFrame:
        return paths.join(x, paths["src"] == x["vid"]).groupBy(F.col("dst").alias("vid")).agg(F.sum("x").alias("x"))

    def scaled(x: DataFrame, name: str) -> DataFrame:
        norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        return x.select("vid", (F.col("x") / F.lit(norm)).alias(name))

    if iterations is not None:
        for k in range(iterations):
            now = step(now)
            if k % 3 == 2:
                now = staged(now, "evc")
        return scaled(staged(now, "evc"), "evc")
    for _ in range(0, max_iterations, CHECK_EVERY):
        before = now
        for _ in range(CHECK_EVERY - 1):
            before = step(before)
        before = staged(before, "evc")
        pair = step(before).join(before.withColumnRenamed("x", "was"), "vid")
        pair = staged(pair, "evc")
        size = pair.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("x"), F.sqrt(F.sum(F.col("was") * F.col("was"))).alias("was")).first()
        if not size.x:
            return now.withColumnRenamed("x", "evc")
        now = pair.select("vid", (F.col("x") / F.lit(size.x)).alias("x"))
        change = pair.agg(F.sum(F.abs(F.col("x") / F.lit(size.x) - F.col("was") / F.lit(size.was)))).first()[0]
        if change < n * tolerance:
            return now.withColumnRenamed("x", "evc")
    raise ArithmeticError(f"no convergence in {max_iterations} iterations")


def top_share(df: DataFrame, score: str, share: float = 0.01, key: str = "vid") -> DataFrame:
    """The floor(share * n) rows of largest score, ties to the smaller key,
    with their rank from 1."""
    k = int(share * df.count())
    return ranked(df, F.desc(score), F.col(key)).where(F.col("rank") < k).withColumn("rank", (F.col("rank") + 1).cast("int"))


def top_k(df: DataFrame, score: str, k: int, key: str = "vid") -> DataFrame:
    rows = df.orderBy(F.desc(score), key).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def kl_divergence(p: DataFrame, q: DataFrame, bin_col: str = "deg", count_col: str = "n") -> DataFrame:
    """One row, kl: divergence of two histograms after each is scaled to sum
    1, missing bins 0, a double's epsilon added above and below."""
    scaled = lambda h, name, to: h.crossJoin(h.agg(F.sum(count_col).alias("_all"))).select(F.col(bin_col).alias(to), (F.col(count_col) / F.col("_all")).alias(name))
    a, b = scaled(p, "p", "bin"), scaled(q, "q", "bin_q")
    both = a.join(b, F.col("bin") == F.col("bin_q"), "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    eps = F.lit(DOUBLE_EPS)
    return both.agg(F.sum(F.col("p") * F.log((F.col("p") + eps) / (F.col("q") + eps))).alias("kl"))


def nmi(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row, nmi: mutual information of two labelings of the same rows
    over the mean of their entropies; 1 if both have one label."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    entropy = lambda df, c: df.crossJoin(total).agg(F.coalesce(-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))), F.lit(0.0)).alias(f"h_{c}"))
    shared = cells.join(rows, "a").join(columns, "b").crossJoin(total)
    mutual = shared.agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"))
    both = mutual.crossJoin(entropy(rows, "na")).crossJoin(entropy(columns, "nb"))
    mean = (F.col("h_na") + F.col("h_nb")) / 2
    return both.select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def overlap(a: DataFrame, b: DataFrame, key: str = "vid") -> DataFrame:
    """One row, overlap: shared keys over the number in a; null if a is
    empty."""
    shared = a.select(key).join(b.select(key), key, "left_semi").agg(F.count("*").alias("s"))
    return shared.crossJoin(a.agg(F.count("*").alias("k"))).select(F.when(F.col("k") > 0, F.col("s") / F.col("k")).alias("overlap"))


def aligned_errors(a: DataFrame, b: DataFrame, score: str) -> DataFrame:
    """One row, mae and mse, of scores that have the same rank in both."""
    x, y = a.select("rank", F.col(score).alias("x")), b.select("rank", F.col(score).alias("y"))
    gap = F.col("x") - F.col("y")
    return x.join(y, "rank").agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


def rank_all(df: DataFrame, score: str, key: str = "vid") -> DataFrame:
    """All rows with their rank from 0 by falling score, at any size."""
    return ranked(df, F.desc(score), F.col(key))


def relative(a: Column, b: Column) -> Column:
    return relative_error(a, b)
