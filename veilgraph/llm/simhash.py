"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Documents become 64-bit fingerprints; distinct fingerprints are grouped into
tiles by the population counts of their four 16-bit parts.  Two fingerprints
within the radius have population counts that differ by no more than the
radius over all parts, so only pairs of tiles that near are compared: exactly,
every fingerprint of one with every one of the other, by numpy exclusive-or
and bit counts.

Tiles travel in stripes of one total population count, some hundred thousand
fingerprints each, of which a class has as many as it needs.  A task compares
one pair of stripes whose totals are within the radius, so a fingerprint moves
once for each stripe near its own, not once for each tile, and however crowded
a class is, no task holds more than two stripes.

Each comparison returns a spanning forest of the links that it found, which
joins the same fingerprints with at most one link per fingerprint; connected
components run over those.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.blocks import LOWER, pack, split_words, text_blocks, unpack
from veilgraph.llm.textops import fresh, quoted
from veilgraph.operators.components import component_links
from veilgraph.plans.staging import staged, stored

#: Fingerprints in a stripe, about, and links that are held before they are
#: reduced to a forest.
STRIPE, LINKS = 1 << 17, 1 << 20
#: Comparisons of a pair of tiles up to which many pairs are taken together.
TOGETHER = 1 << 11
#: Parts of a fingerprint, and the base in which their counts are written:
#: larger than a count plus twice any radius, so that neighbours never alias.
PARTS, PART_BITS, BASE = 4, 16, 64


def _shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a word sequence, as a signed 64-bit integer: a bit
    is set if it is in over half the hashes of the shingles."""
    hashes = _shingle_hashes(words, width, seed)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, tag: Column | None = None) -> DataFrame:
    """(doc_id, tag, fp) per row of docs; tag is a long that goes along.
    Null and empty texts get fingerprint 0; ids may be of any type."""

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            words, at = split_words(block.column("text"), LOWER)
            words, at = words.cast(pa.large_binary()), at.tolist()
            found = [fingerprint(words.slice(a, b - a).to_pylist(), width, seed) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("tag"), pa.array(found, pa.int64())], ["doc_id", "tag", "fp"])

    tag = F.lit(None) if tag is None else tag
    rows = docs.select(F.col(id_col).alias("doc_id"), tag.cast("long").alias("tag"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(per_block, f"doc_id {kind}, tag long, fp long")


def _part_counts(fp: Column) -> list[Column]:
    mask = F.lit((1 << PART_BITS) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(mask)) for k in range(PARTS)]


@functools.cache
def _near(radius: int) -> list[int]:
    """Differences of the cell number to the cells within the radius."""
    steps = range(-radius, radius + 1)
    ball = [d for d in itertools.product(steps, repeat=PARTS) if sum(map(abs, d)) <= radius]
    numbers = [sum(x * BASE**k for k, x in enumerate(d)) for d in ball]
    return sorted(numbers)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of links (a[i], b[i]) between small integers a subset that joins the
    same: labels sink to the smallest until none changes."""
    n = int(max(a.max(), b.max())) + 1
    label = np.arange(n)
    kept = []
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        hi, lo = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
        roots, first = np.unique(hi, return_index=True)  # one link hooks each root under a smaller one
        label[roots] = lo[first]
        kept.append(open_[first])
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, rows: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of a tile's fingerprints with another's (or its
    own) that differ in at most radius bits, some rows' comparisons at once."""
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, rows // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        x, y = np.concatenate([x, i]), np.concatenate([y, j])
        if len(x) > LINKS:
            kept = forest(x, y if same else y + len(a))
            x, y = x[kept], y[kept]
    if len(x) > 1:
        kept = forest(x, y if same else y + len(a))
        x, y = x[kept], y[kept]
    return a[x], b[y]


def _tiles(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of sorted cells, where each begins, and its size."""
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[first], first, np.diff(first, append=len(cells))


def stripe_links(a: list[np.ndarray], b: list[np.ndarray] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two stripes (cells, fingerprints), in
    order of cells, or within one. Small tiles are compared many pairs at a
    time, large ones pair by pair."""
    same, b = b is None, b or a
    (name, a_first, a_size), (other, b_first, b_size) = _tiles(a[0]), _tiles(b[0])
    src, dst, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for step in _near(radius):
        if (same and step < 0) or not len(other):
            continue
        at = np.minimum(np.searchsorted(other, name + step), len(other) - 1)
        i = np.flatnonzero(other[at] == name + step)
        j = at[i]
        work = a_size[i] * b_size[j]
        found = [tile_links(a[1][a_first[x] : a_first[x] + a_size[x]], b[1][b_first[y] : b_first[y] + b_size[y]], same and not step, radius) for x, y in zip(i[work > TOGETHER], j[work > TOGETHER], strict=True)]
        i, j, work = i[work <= TOGETHER], j[work <= TOGETHER], work[work <= TOGETHER]
        upto = np.cumsum(work)
        cuts = np.unique([0, *np.searchsorted(upto, np.arange(1 << 22, int(upto[-1]) if len(upto) else 0, 1 << 22)).tolist(), len(work)])
        for begin, end in zip(cuts, cuts[1:], strict=False):
            n = work[begin:end]
            pair = np.repeat(np.arange(begin, end), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            width = b_size[j[pair]]
            x, y = a_first[i[pair]] + place // width, b_first[j[pair]] + place % width
            near = np.bitwise_count(a[1][x] ^ b[1][y]) <= radius
            if same and not step:
                near &= x < y
            found.append((a[1][x[near]], b[1][y[near]]))
        for x, y in found:
            src.append(x)
            dst.append(y)
            held += len(x)
            if held > LINKS:
                x, y = _forest_of(src, dst)
                src, dst, held = [x], [y], 0
    return _forest_of(src, dst)


def _forest_of(src: list[np.ndarray], dst: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.concatenate(src), np.concatenate(dst)
    if not len(x):
        return x, y
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    kept = forest(at[: len(x)], at[len(x) :])
    return x[kept], y[kept]


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp): enough links to
    join all that a chain of differences of at most radius bits joins. Null
    fingerprints are left out; an empty table gives no link."""
    if not 0 <= radius < (BASE - PART_BITS) // 2:
        raise ValueError("radius out of range")
    cell = sum((c.cast("long") * BASE**k for k, c in enumerate(_part_counts(F.col("fp")))), F.lit(0).cast("long"))
    rows = fps.where("fp is not null").select("fp", F.bit_count("fp").cast("int").alias("total"), cell.alias("cell"))
    # at most 65 classes, whatever the input: small enough to broadcast
    crowd = staged(rows.groupBy("total").agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes")), "simhash-classes")
    placed = rows.join(F.broadcast(crowd), "total").withColumn("stripe", F.pmod(F.xxhash64("fp"), F.col("stripes")).cast("int"))

    def gather(table: pa.Table) -> pa.Table:
        cells, values = table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((values, cells))
        return pa.table({"total": table.column("total").slice(0, 1), "stripe": table.column("stripe").slice(0, 1), "blob": pa.array([pack(cells[order], values[order])], pa.binary())})

    stripes = staged(placed.groupBy("total", "stripe").applyInArrow(gather, "total int, stripe int, blob binary"), "simhash-stripes")
    # every stripe goes to its pairs with those of its own and the next radius totals
    other = crowd.select(F.col("total").alias("total_b"), F.col("stripes").alias("stripes_b"))
    names = crowd.select(F.col("total").alias("total_a"), F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe_a"))
    pairs = names.join(F.broadcast(other), (F.col("total_b") >= F.col("total_a")) & (F.col("total_b") <= F.col("total_a") + radius))
    first = F.when(F.col("total_a") == F.col("total_b"), F.col("stripe_a")).otherwise(0)
    pairs = pairs.where(first <= F.col("stripes_b") - 1).withColumn("stripe_b", F.explode(F.sequence(first, F.col("stripes_b") - 1)))
    name = F.struct("total_a", "stripe_a", "total_b", "stripe_b")
    end = lambda side, k: F.struct(F.lit(k).alias("side"), F.col(f"total_{side}").alias("total"), F.col(f"stripe_{side}").alias("stripe"))
    ends = pairs.select(name.alias("pair"), F.explode(F.array(end("a", 0), end("b", 1))).alias("x"))
    same = (F.col("pair.total_a") == F.col("pair.total_b")) & (F.col("pair.stripe_a") == F.col("pair.stripe_b"))
    ends = ends.select(F.to_json("pair").alias("pair"), "x.*", same.alias("same")).where("side = 0 or not same")
    dealt = ends.join(stripes, ["total", "stripe"]).select("pair", "side", "blob")

    def compare(table: pa.Table) -> pa.Table:
        sides = dict(zip(table.column("side").to_pylist(), table.column("blob").to_pylist(), strict=True))
        x, y = stripe_links(unpack(sides[0]), unpack(sides[1]) if 1 in sides else None, radius)
        return pa.table({"src": pa.array(x.view(np.int64)), "dst": pa.array(y.view(np.int64))})

    return dealt.groupBy("pair").applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """(doc_id, tag, fp, root, component_id) for every row of docs:
    component_id is the smallest id among the documents that a chain of
    fingerprints, each within radius bits of the next, reaches; root is the
    component's smallest fingerprint.

    Defined results: null and empty texts have fingerprint 0 and link like
    any other; repeated rows each get a row; a null id never becomes a
    component_id unless the component has no other (then it is null); very
    long texts are read whole; an empty table gives an empty result; extra
    columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col, width, seed, tag), "simhash-rows")
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-groups")
    links = component_links(near_links(groups, radius)).select(F.col("vid").alias("fp"), F.col("component").alias("root"))
    rooted = groups.join(links, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "tag", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that with the
    smallest id (null last), of equal ids the first in the table.

    Defined results: as near_duplicates; rows are known by their number in the
    table, so rows equal throughout are one group of which one stays, and
    columns may have any name.  docs is read twice; unless it is a stored table, a
    copy is staged.
    """
    docs = stored(docs)
    number = F.monotonically_increasing_id()
    found = near_duplicates(docs, radius=radius, width=width, seed=seed, id_col=id_col, text_col=text_col, tag=number)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    own, kept = fresh(docs, "number", "kept")
    first = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.tag").alias(kept))
    # as many rows stay as there are groups, so this is a merge join at any size
    numbered = docs.withColumn(own, number)
    chosen = numbered.join(staged(first, "simhash-first").hint("merge"), F.col(own) == F.col(kept), "left_semi")
    return chosen.select(*[quoted(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
