"""Exact top-k by integer inner product with a dual-tree search over cover
trees.

The vectors are dealt into tiles by the nearest of a few pivots, and every
tile becomes a cover tree: a node's centre covers all its points within its
radius; its children's centres are points further apart than the radius that
they cover with, half their parent's or less.  Points that no child would
share a group with stay in the node's own bag and are compared in one block.
The queries are indexed in the same way, into blocks.

A pair of a query node and a data node can score no more than

    <q, r> + rad(q) |r| + rad(r) |q| + rad(q) rad(r)

for centres q, r.  The pair is dropped if that is below the worst k-th score
found so far in the query node's group.  This holds for the roots too, so a
first round searches only the most promising tiles of each block; what it
finds is the least that any other tile must be able to reach for its block to
be sent there at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.blocks import pack, unpack
from veilgraph.plans.staging import shuffle_width, staged

#: Numbers in a tile of data and in a block of queries, about (rows times
#: dimensions), so that either is a few MB at any dimension.
TILE_NUMBERS, BLOCK_NUMBERS = 1 << 18, 1 << 18
#: Vectors that pivots are chosen from, and pivots of one dimension, at most.
SAMPLE, PIVOTS = 2048, 256
#: Tiles that the first round searches for each block; roots whose bounds are
#: computed together.
FIRST, CHUNK = 2, 1024
#: Points that are compared in one block; the most that aren't split further;
#: the fewest that make a child; picks in a row that cover fewer, after which
#: the rest stays in the bag.
BAG, LEAF, LEAST, PATIENCE = 512, 16, 4, 16
_LOW = -np.iinfo(np.int64).max  # its negative is an integer too


@dataclass
class Tree:
    """A cover tree over integer vectors, its points in node order: a node's
    points are lo:hi, its bag lo:bag, its children first:first+children."""

    ids: np.ndarray
    values: np.ndarray
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lo: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bag: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hi: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    children: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Tree:
        points = values.astype(np.float64)
        nodes: list[list] = [[np.arange(len(ids)), 0, 0.0, [], []]]  # points, centre, radius, bag, children
        at = 0
        while at < len(nodes):
            members, centre = nodes[at][0], nodes[at][1]
            away = np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1))
            nodes[at][2] = radius = float(away.max(initial=0.0))
            if len(members) <= LEAF or not radius:
                nodes[at][3] = members
                at += 1
                continue
            left, bag, misses, own = members[np.argsort(away, kind="stable")], [], 0, radius / 2
            while len(left) and misses < PATIENCE:
                near = ((points[left] - points[left[0]]) ** 2).sum(axis=1) <= own * own
                if near.sum() < LEAST:
                    bag.append(left[near])
                    misses += 1
                else:
                    nodes[at][4].append(len(nodes))
                    nodes.append([left[near], int(left[0]), 0.0, [], []])
                    misses = 0
                left = left[~near]
            nodes[at][3] = np.concatenate([*bag, left]) if bag or len(left) else []
            at += 1
        order, spans = [], [[0, 0, 0] for _ in nodes]

        def lay(start: int) -> None:  # depth first, so that a node's points are one run
            stack = [(start, False)]
            while stack:
                k, done = stack.pop()
                if done:
                    spans[k][2] = sum(map(len, order))
                    continue
                spans[k][0] = sum(map(len, order))
                order.append(np.sort(np.asarray(nodes[k][3], np.int64)))
                spans[k][1] = spans[k][0] + len(order[-1])
                stack.append((k, True))
                stack.extend((c, False) for c in reversed(nodes[k][4]))

        lay(0)
        index = np.concatenate(order)
        where = np.empty(len(ids), np.int64)
        where[index] = np.arange(len(ids))
        lo, bag_end, hi = np.array(spans, np.int64).T
        return cls(
            ids[index], values[index], where[[n[1] for n in nodes]], np.array([n[2] for n in nodes]), lo, bag_end, hi,
            np.array([n[4][0] if n[4] else 0 for n in nodes]), np.array([len(n[4]) for n in nodes]),
        )

    def dump(self) -> bytes:
        span = int(np.abs(self.values).max(initial=0))
        small = np.int16 if span < 1 << 15 else np.int32 if span < 1 << 31 else np.int64
        return pack(self.ids, self.values.astype(small).ravel(), self.centre, self.radius, self.lo, self.bag, self.hi, self.first, self.children)

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        ids, values, *rest = unpack(blob)
        return cls(ids, values.reshape(len(ids), -1).astype(np.int64), *rest)


def bounds(qc: np.ndarray, q_radius: np.ndarray, rc: np.ndarray, r_radius: np.ndarray) -> np.ndarray:
    """What any pair under two nodes scores at most, for all pairs of nodes
    with centres qc, rc; rounding is allowed for by the size of the terms."""
    qn, rn = np.sqrt((qc**2).sum(axis=1))[:, None], np.sqrt((rc**2).sum(axis=1))[None, :]
    q_radius, r_radius = q_radius[:, None], r_radius[None, :]
    around = q_radius * rn + r_radius * qn + q_radius * r_radius
    return qc @ rc.T + around + 1e-6 + 1e-9 * (qn * rn + around)


class Search:
    """The best k of one block of queries over the trees met so far. least:
    for each query a score that its k best, in all, are known to reach."""

    def __init__(self, queries: Tree, k: int, least: np.ndarray | None = None):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.scores = np.full((n, k), _LOW)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, _LOW) if least is None else least.copy()
        self.pairs_compared = 0

    def meet(self, data: Tree) -> None:
        q, r = self.queries, data
        bound = bounds(q.values[q.centre].astype(np.float64), q.radius, r.values[r.centre].astype(np.float64), r.radius)
        most = int(np.abs(q.values).max(initial=0)) * int(np.abs(r.values).max(initial=0)) * max(1, q.values.shape[1])
        kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 63 else object  # exact in any case
        qv, rv = q.values.astype(kind), r.values.astype(kind)
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if bound[a, b] < self.least[q.lo[a] : q.hi[a]].min():
                continue
            for x in range(q.lo[a], q.bag[a], BAG):  # bag against bag
                for y in range(r.lo[b], r.bag[b], BAG):
                    self._compare(slice(x, min(x + BAG, q.bag[a])), qv, slice(y, min(y + BAG, r.bag[b])), rv, r.ids)
            qs = [(c, q.lo[c], q.hi[c]) for c in range(q.first[a], q.first[a] + q.children[a])]
            rs = list(range(r.first[b], r.first[b] + r.children[b]))
            if q.bag[a] > q.lo[a]:  # the query bag meets the data children, one group each
                for c in rs:
                    self._bag_below(slice(q.lo[a], q.bag[a]), qv, a, c, bound, r, rv)
            if r.bag[b] > r.lo[b]:
                for c, lo, hi in qs:
                    if bound[c, b] >= self.least[lo:hi].min():
                        for y in range(r.lo[b], r.bag[b], BAG):
                            self._compare(slice(lo, hi), qv, slice(y, min(y + BAG, r.bag[b])), rv, r.ids)
            below = [(c, d) for c, _, _ in qs for d in rs]
            below.sort(key=lambda p: bound[p])  # the most promising is popped first
            stack.extend(below)

    def _bag_below(self, group: slice, qv: np.ndarray, a: int, b: int, bound: np.ndarray, r: Tree, rv: np.ndarray) -> None:
        if bound[a, b] < self.least[group].min():
            return
        for y in range(r.lo[b], r.hi[b], BAG):
            self._compare(group, qv, slice(y, min(y + BAG, r.hi[b])), rv, r.ids)

    def _compare(self, group: slice, qv: np.ndarray, part: slice, rv: np.ndarray, ids: np.ndarray) -> None:
        found, other = qv[group] @ rv[part].T, ids[part]
        if found.dtype == object and found.size and max(map(abs, found.ravel())) >= 1 << 63:
            raise OverflowError("an inner product exceeds 63 bits")
        found = found.astype(np.int64)
        self.pairs_compared += found.size
        rows = np.flatnonzero((found >= self.least[group][:, None]).any(axis=1))
        if not len(rows):
            return
        found, at = found[rows], rows + group.start
        if found.shape[1] > self.k:  # all that can be among the best k, ties included
            least = np.partition(found, found.shape[1] - self.k, axis=1)[:, -self.k]
            width = int((found >= least[:, None]).sum(axis=1).max())
            order = np.argsort(-found, axis=1, kind="stable")[:, :width] if width > 2 * self.k else np.argpartition(-found, width - 1, axis=1)[:, :width]
            found, other = np.take_along_axis(found, order, axis=1), other[order]
        else:
            other = np.broadcast_to(other, found.shape)
        scores = np.concatenate([self.scores[at], found], axis=1)
        names = np.concatenate([self.ids[at], other], axis=1)
        best = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(scores, best, axis=1), np.take_along_axis(names, best, axis=1)
        self.least[at] = np.maximum(self.least[at], self.scores[at, -1])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, salt, v) with v the integers floor(scale * x), salt a number that
    spreads equal rows; rows with a null id, a null vector or a null or
    non-finite component are left out.  Integers beyond 63 bits are an error."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    too_large = F.raise_error(F.lit("a component exceeds 63 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x * float(scale)) < 2.0**62, F.floor(x * float(scale))).otherwise(too_large)
    return rows.select("id", F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"), F.transform("x", whole).alias("v"))


def choose_pivots(rows: DataFrame, numbers: int) -> dict[int, np.ndarray]:
    """By dimension some vectors that lie far apart: of a bounded sample each
    time the one farthest from those chosen, as many as there are tiles."""
    sized = rows.select(F.size("v").alias("dim"), "v", "id")
    total = {r.dim: r.n for r in sized.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(PIVOTS).collect()}
    sample = sized.where(F.col("dim") > 0).orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("dim", "v").collect()
    out = {}
    for dim in sorted({r.dim for r in sample} & set(total)):
        points = np.array([r.v for r in sample if r.dim == dim], np.float64)
        wanted = min(PIVOTS, len(points), -(-total[dim] * dim // numbers))
        chosen, away = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < wanted and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = points[chosen]
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column's rows (without nulls) as integers."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def place(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim and cell, the number of the nearest pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _lists(batch.column("v"))
            dims = np.array(list(map(len, vectors)), np.int32)
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in sent.value and len(sent.value[dim]) > 1:
                    mine, p = np.flatnonzero(dims == dim), sent.value[dim]
                    for at in range(0, len(mine), CHUNK):
                        some = mine[at : at + CHUNK]
                        points = np.stack([vectors[k] for k in some]).astype(np.float64)
                        cell[some] = (points @ p.T - (p**2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), *batch.columns], ["dim", "cell", "id", "salt", "v"])

    return staged(rows.mapInArrow(nearest, "dim int, cell int, id long, salt long, v array<long>"), "placed-vectors")


_TILES = "dim int, tile long, blob binary, centre binary, radius double"


def index_tiles(placed: DataFrame, numbers: int) -> DataFrame:
    """Stored table (dim, tile, blob, centre, radius): cover trees over
    (id, v), vectors of one length and cell in each, and what each covers."""
    crowd = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(1)) / numbers).cast("int").alias("tiles"))
    crowd = staged(crowd, "tile-counts").select(F.col("dim").alias("d"), F.col("cell").alias("c"), "tiles")
    dealt = placed.join(crowd, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    tile = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod("salt", F.col("tiles"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        tree = Tree.build(ids[order], values[order])
        centre = tree.values[tree.centre[0]].astype(np.float64)
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
        row = [values.shape[1], table.column("tile")[0].as_py(), tree.dump(), centre.tobytes(), float(tree.radius[0])]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["dim", "tile", "blob", "centre", "radius"])

    return staged(dealt.select("dim", tile.alias("tile"), "id", "v").groupBy("dim", "tile").applyInArrow(build, _TILES), "cover-trees")


def _roots(tiles: DataFrame, least: Column) -> DataFrame:
    """(dim, blob): the roots of up to about CHUNK tiles in each row."""
    n = tiles.count()
    rows = tiles.select("dim", "tile", "centre", "radius", least.alias("least"), F.pmod(F.xxhash64("tile"), F.lit(1 + n // CHUNK)).alias("chunk"))

    def join(table: pa.Table) -> pa.Table:
        centres = np.frombuffer(b"".join(table.column("centre").to_pylist()), np.float64)
        blob = pack(table.column("tile").to_numpy(), centres, table.column("radius").to_numpy(), table.column("least").to_numpy())
        return pa.table({"dim": table.column("dim").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    return rows.groupBy("dim", "chunk").applyInArrow(join, "dim int, blob binary")


def block_tile_pairs(blocks: DataFrame, tiles: DataFrame, least: Column, most: int | None) -> DataFrame:
    """(dim, block, tile, bound) of the pairs whose bound reaches least of the
    block; with most, about the best so many of a block. Only roots meet."""
    a, b = _roots(blocks, least), _roots(tiles, F.lit(_LOW)).select(F.col("dim").alias("d"), F.col("blob").alias("other"))
    met = a.join(b, F.col("dim") == F.col("d")).select("dim", "blob", "other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, q, q_radius, floor = unpack(x)
                tile, r, r_radius, _ = unpack(y)
                bound = bounds(q.reshape(len(block), -1), q_radius, r.reshape(len(tile), -1), r_radius)
                keep = bound >= floor[:, None]
                if most is not None and len(tile) > most:
                    keep &= bound >= np.partition(bound, len(tile) - most, axis=1)[:, -most][:, None]
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(block[i]), pa.array(tile[j]), pa.array(bound[i, j])], ["dim", "block", "tile", "bound"])

    pairs = met.mapInArrow(meet, "dim int, block long, tile long, bound double")
    if most is None:
        return pairs
    turn = F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.desc("bound"), "tile"))
    return pairs.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")


_FOUND = "dim int, block long, row int, query_id long, own long, vec_id long, score long, least binary"


def search_pairs(pairs: DataFrame, blocks: DataFrame, tiles: DataFrame, k: int, stripes: int) -> DataFrame:
    """The k best of each query over the tiles that its block is paired with,
    and a row per block and stripe with what its queries reached (least)."""
    stripe = F.pmod(F.xxhash64("tile"), F.lit(stripes)).cast("int")
    sent = pairs.join(tiles.select("dim", "tile", "blob"), ["dim", "tile"]).select("dim", "block", stripe.alias("stripe"), (-F.col("bound")).alias("at"), "tile", "blob", F.lit(None).cast("binary").alias("least"))
    asked = pairs.select("dim", "block", stripe.alias("stripe")).distinct().join(blocks.select("dim", F.col("tile").alias("block"), "blob", "least"), ["dim", "block"])
    # a block of queries stands before its tiles of a stripe, the most promising first; a task reads them one after the other
    rows = sent.unionByName(asked.withColumn("at", F.lit(float("-inf"))).withColumn("tile", F.lit(None).cast("long")))
    rows = rows.repartition("dim", "block", "stripe").sortWithinPartitions("dim", "block", "stripe", "at", F.asc_nulls_first("tile"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result() -> pa.RecordBatch:
            row, rank = np.nonzero(state.scores > _LOW)
            q = state.queries
            own = (q.values.astype(object) ** 2).sum(axis=1) if len(q.values) and int(np.abs(q.values).max(initial=0)) ** 2 * q.values.shape[1] >= 1 << 63 else (q.values**2).sum(axis=1)
            own = np.array([min(int(x), np.iinfo(np.int64).max) for x in own], np.int64)
            n = len(row)
            columns = [[now[0]] * (n + 1), [now[1]] * (n + 1), [*row.tolist(), None], [*q.ids[row].tolist(), None], [*own[row].tolist(), None], [*state.ids[row, rank].tolist(), None], [*state.scores[row, rank].tolist(), None], [None] * n + [pack(state.least)]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["dim", "block", "row", "query_id", "own", "vec_id", "score", "least"])

        for batch in batches:
            for at in range(batch.num_rows):
                dim, block, tile, blob, least = (batch.column(c)[at].as_py() for c in range(5))
                if tile is None:
                    if state is not None:
                        yield result()
                    now, state = (dim, block), Search(Tree.load(blob), k, unpack(least)[0] if least else None)
                else:
                    state.meet(Tree.load(blob))
        if state is not None:
            yield result()

    return rows.select("dim", "block", "tile", "blob", "least").mapInArrow(search, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of
    vectors with the largest integer inner product (all, if fewer), ties to
    the smaller id.

    Defined results: ids are integers; rows with a null id, a null vector or a
    null or non-finite component take no part; a query meets vectors of its
    own length only; one row with the query's own id and its score with itself
    is the query and not its candidate, further rows of that id are;
    repeated rows of vectors are candidates each, repeated query rows are
    answered each; empty tables give an empty result; extra columns are
    ignored.  Products are exact; one beyond 63 bits, or a component beyond
    62, is an error.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    pivots = choose_pivots(rows, TILE_NUMBERS)
    tiles = index_tiles(place(rows, pivots), TILE_NUMBERS)
    blocks = index_tiles(place(quantised(queries, id_col, vector_col, scale), pivots), BLOCK_NUMBERS)
    blocks = blocks.withColumn("least", F.lit(None).cast("binary"))
    stripes, more = shuffle_width(vectors), k + 1  # the query itself may be among the best
    near = staged(block_tile_pairs(blocks, tiles, F.lit(_LOW), FIRST), "first-pairs")
    first = staged(search_pairs(near, blocks, tiles, more, 1), "first-found")
    floors = first.where("least is not null").select(F.col("dim").alias("d"), F.col("block").alias("b"), F.col("least").alias("floor"))

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(unpack(x.as_py())[0].min()) for x in batch.column("floor")], pa.int64())], ["d", "b", "floor", "worst"])

    floors = floors.mapInArrow(worst, "d int, b long, floor binary, worst long")
    known = staged(blocks.drop("least").join(floors, (F.col("dim") == F.col("d")) & (F.col("tile") == F.col("b"))).drop("d", "b").withColumnRenamed("floor", "least"), "known-blocks")
    rest = block_tile_pairs(known, tiles, F.col("worst"), None).join(near.drop("bound"), ["dim", "block", "tile"], "left_anti")
    found = first.unionByName(search_pairs(staged(rest, "pairs"), known, tiles, more, stripes)).where("row is not null")
    of = Window.partitionBy("query_id", "dim", "block", "row")
    ranked = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= more)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(of)
    ranked = ranked.withColumn("itself", F.coalesce(itself, F.lit(more + 1))).where(F.col("rank") != F.col("itself"))
    ranked = ranked.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("itself"), 1).otherwise(0)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
