"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in shards: for every term of a shard the
sorted list of the positions at which it occurs.  Documents follow each other
in a shard's position space with a free position between them, which no phrase
bridges.  The index is a stored table, one row per shard; it can be searched
any number of times.

A phrase is looked up from its rarest term: that term's positions, less the
term's offset in the phrase, are candidate starts, and each further term, by
rising frequency, keeps those candidates for which its own offset-adjusted
list has the same start.

A benchmark of up to QUERY_BYTES of text is sent to all shards.  A larger one
stays a table: its windows go, by a join on their term that is rarest in the
whole index, to the shards that have that term and no others.  Either way the
postings are read once, and the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilgraph.llm.blocks import ALNUM, encode, pack, split_words, text_blocks, unpack
from veilgraph.llm.textops import fresh, quoted
from veilgraph.plans.staging import staged, stored

#: Positions left free between two documents of a shard.
GAP = 1
#: Bytes of benchmark text up to which it is sent to all shards.
QUERY_BYTES = 8 << 20
#: Decoded postings that a search keeps, in positions.
KEPT = 1 << 24

_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
_INDEX = "shard long, rids array<long>, ids array<long>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of docs: a row per shard with its rows' numbers, ids
    and lengths, its terms in code order with their frequencies, and all
    positions, term after term.  shard is the number of its first row.

    Defined results: null and empty texts are documents without a word; ids
    are integers, null included; repeated rows are documents each; a very long
    text is a shard of its own; an empty table has no shard; extra columns are
    ignored.  Rows are numbered as monotonically_increasing_id() numbers them.
    """

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            words, at = split_words(block.column("text"), ALNUM)
            codes, terms = encode(words)
            lengths = np.diff(at)
            place = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
            keyed = np.sort((codes.astype(np.uint64) << np.uint64(40)) | place.astype(np.uint64))
            place = (keyed & np.uint64((1 << 40) - 1)).astype(np.int64)
            counts = np.bincount(codes, minlength=len(terms))
            gaps = np.diff(place, prepend=0)
            gaps[np.cumsum(counts)[:-1]] = place[np.cumsum(counts)[:-1]]  # each term's list starts anew
            wide = gaps.astype(np.uint32) if len(gaps) and gaps.max() < 1 << 32 else gaps.astype(np.uint64)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)  # noqa: E731  a list in one row
            lists = [block.column("rid"), block.column("doc_id"), pa.array(lengths, pa.int32()), terms.cast(pa.binary()), pa.array(counts, pa.int32())]
            columns = [block.column("rid").slice(0, 1), *map(one, lists), pa.array([pack(wide)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "rids", "ids", "lengths", "terms", "counts", "postings"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(per_block, _INDEX), "positional-index")


@dataclass
class Shard:
    """A row of the index, opened for search."""

    rids: np.ndarray
    ids: list
    lengths: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    gaps: np.ndarray
    terms: pa.Array
    mask: np.ndarray | None = None  # of covered positions, where a search keeps one

    @property
    def size(self) -> int:
        return int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0

    @classmethod
    def open(cls, batch: pa.RecordBatch, row: int) -> Shard:
        get = lambda name: batch.column(name)[row].values
        lengths = get("lengths").to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths + np.arange(len(lengths)) * GAP
        counts = get("counts").to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(get("rids").to_numpy(zero_copy_only=False), get("ids").to_pylist(), lengths, starts, counts, np.cumsum(counts), unpack(batch.column("postings")[row].as_py())[0], get("terms"))

    def postings(self, term: int) -> np.ndarray:
        """Positions of a term, by its code; -1 has none."""
        if term < 0:
            return np.zeros(0, np.int64)
        end = self.ends[term]
        return np.cumsum(self.gaps[end - self.counts[term] : end], dtype=np.int64)

    def codes(self, words: pa.Array) -> np.ndarray:
        """Codes of words (binary) in this shard, -1 for those it lacks."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def of_document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


class Lists:
    """A shard's postings by query term, decoded once."""

    def __init__(self, shard: Shard, codes: np.ndarray):
        self.shard, self.codes, self.seen, self.kept = shard, codes, {}, 0
        self.sizes = np.where(codes >= 0, shard.counts[np.maximum(codes, 0)], 0) if len(shard.counts) else np.zeros(len(codes), np.int64)

    def __getitem__(self, term: int) -> np.ndarray:
        if term not in self.seen:
            if self.kept > KEPT:
                self.seen, self.kept = {}, 0
            self.seen[term] = self.shard.postings(int(self.codes[term]))
            self.kept += len(self.seen[term])
        return self.seen[term]


def phrase_starts(lists: Lists, phrase: np.ndarray) -> np.ndarray:
    """Positions where the phrase (query term numbers) starts."""
    order = np.argsort(lists.sizes[phrase], kind="stable").tolist()
    found = lists[int(phrase[order[0]])] - order[0]
    for offset in order[1:]:
        if not len(found):
            break
        there = lists[int(phrase[offset])]
        at = np.searchsorted(there, found + offset)
        found = found[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == found + offset)]
    return found


def spans(lists: Lists, terms: np.ndarray, width: int) -> np.ndarray:
    """Rows (first, last) of the smallest spans of at most width positions
    that hold all the distinct terms, in any order and in one document, looked
    up around the rarest."""
    terms = np.unique(terms)
    if not len(terms) or not lists.sizes[terms].all():
        return np.zeros((0, 2), np.int64)
    places = [lists[int(t)] for t in terms]
    rare, shard, best = min(places, key=len), lists.shard, []
    at = shard.of_document(rare)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        doc = int(at[begin])
        anchors, start = rare[begin:end], shard.starts[doc]
        low, high = max(start, anchors[0] - width + 1), min(start + shard.lengths[doc], anchors[-1] + width)
        near = [p[np.searchsorted(p, low) : np.searchsorted(p, high)] for p in places]
        if not all(map(len, near)):
            continue
        where, which = np.concatenate(near), np.repeat(np.arange(len(near)), [len(p) for p in near])
        order = np.argsort(where)
        latest: dict[int, int] = {}  # by term, the one seen longest ago first
        before = -1
        for last, term in zip(where[order].tolist(), which[order].tolist(), strict=True):
            latest.pop(term, None)
            latest[term] = last
            if len(latest) < len(near):
                continue
            first = next(iter(latest.values()))
            if first > before and last - first < width:
                best.append((first, last))
            before = first
    return np.array(best, np.int64).reshape(-1, 2)


def runs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as disjoint ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])]


@dataclass
class Queries:
    """A small benchmark's items: the terms, and each item as term numbers."""

    terms: list[bytes]
    ids: list[str]
    items: list[np.ndarray]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all words, the terms, and where each text's words start."""
    words, at = split_words(texts, ALNUM)
    codes, terms = encode(words)
    return codes, terms.cast(pa.binary()).to_pylist(), at


def small_queries(items: DataFrame) -> Queries | None:
    """The items, if their texts are within QUERY_BYTES: only then do they
    come to the driver."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > QUERY_BYTES:
        return None
    found = items.toArrow().combine_chunks()
    texts = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
    codes, terms, at = _words(texts)
    return Queries(terms, found.column("item_id").to_pylist(), [codes[a:b] for a, b in zip(at, at[1:], strict=False)])


def _route(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, key) for keys with their distinct words (key, words): the
    shards that have the one of the words that is rarest in the index. Keys
    with a word that no shard has are nowhere."""
    asked = wanted.select("key", F.explode("words").alias("term"), F.size("words").alias("n"))
    there = index.select("shard", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("shard", F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("count"))
    there = staged(there.join(asked.select("term").distinct(), "term", "left_semi"), "term-shards")
    often = there.groupBy("term").agg(F.sum("count").alias("often"))
    rarest = asked.join(often, "term").groupBy("key").agg(F.min(F.struct("often", "term")).alias("x"), F.count("*").alias("found"), F.max("n").alias("n"))
    return rarest.where("found = n").select("key", F.col("x.term").alias("term")).join(there.select("term", "shard"), "term").select("shard", "key")


def _at_shards(index: DataFrame, routed: DataFrame, search: Callable[[Shard, list[str]], Iterator[list]], schema: str, finish: Callable[[Shard], list] | None = None) -> DataFrame:
    """Rows of search(shard, keys), with the keys that are routed to a shard
    as they come, and of finish(shard) after the last. A shard's row stands
    before its keys in one sorted run, so the keys are never gathered."""
    keys = routed.select("shard", F.lit(1).alias("turn"), "key")
    shards = index.join(routed.select("shard").distinct(), "shard", "left_semi").withColumn("turn", F.lit(0))
    rows = keys.unionByName(shards, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "turn", "key")
    declared = StructType.fromDDL(schema)
    fields, kinds = declared.names, [_ARROW[f.dataType.typeName()] for f in declared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], fields)

        for batch in batches:
            turns = batch.column("turn").to_pylist()
            at = 0
            while at < len(turns):
                if turns[at] == 0:
                    if now is not None and finish is not None:
                        yield batch_of(finish(now))
                    now, at = Shard.open(batch, at), at + 1
                    continue
                end = at
                while end < len(turns) and turns[end] == 1:
                    end += 1
                for part in range(at, end, 4096):
                    yield batch_of(list(search(now, batch.column("key").slice(part, min(4096, end - part)).to_pylist())))
                at = end
        if now is not None and finish is not None:
            yield batch_of(finish(now))

    return rows.select("turn", "key", "rids", "ids", "lengths", "terms", "counts", "postings").mapInArrow(run, schema)


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, key): the distinct windows of width words of each item, its
    words space-joined (so width times the text); an item of fewer words, but
    not none, is one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            codes, terms, at = _words(block.column("text"))
            for name, a, b in zip(block.column("item_id").to_pylist(), at, at[1:], strict=False):
                words, size = [terms[c] for c in codes[a:b]], min(width, int(b - a))
                for begin in range(0, len(words) - size + 1 if size else 0, 1 << 16):
                    found = sorted({b" ".join(words[o : o + size]) for o in range(begin, min(begin + (1 << 16), len(words) - size + 1))})
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "key"])

    return items.mapInArrow(cut, "item_id string, key string").distinct()


def phrase_matches(index: DataFrame, benchmark: DataFrame, width: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(rid, item_id, first, stop): where, in words from 0, document rid has
    one of the item's windows of width words; overlapping ones are one row as
    far as an item's go together in a small benchmark, else a row each.

    Defined results: an item of fewer words, but not none, is one window; an
    empty or null one matches nothing; a null item_id stands as 'null'; items
    that share an id are one; an empty index or benchmark gives no row; extra
    columns are ignored.
    """
    items = _items(benchmark, id_col, text_col)
    queries = small_queries(items)
    if queries is not None:
        return _matches_everywhere(index, queries, width)
    windows = staged(windows_of(items, width), "benchmark-windows")
    routed = _route(index, windows.select("key", F.array_distinct(F.split("key", " ")).cast("array<binary>").alias("words")).distinct())
    found = _at_shards(index, routed, _windows_in, "rid long, key string, first int, stop int")
    return found.join(windows, "key").select("rid", "item_id", "first", "stop").distinct()


def _windows_in(shard: Shard, keys: list[str]) -> Iterator[tuple]:
    for key, starts, size in _starts_in(shard, keys):
        for start, doc in zip(starts.tolist(), shard.of_document(starts).tolist(), strict=True):
            first = int(start - shard.starts[doc])
            yield int(shard.rids[doc]), key, first, first + size


def _starts_in(shard: Shard, keys: list[str]) -> Iterator[tuple[str, np.ndarray, int]]:
    codes, terms, at = _words(pa.array(keys, pa.string()))
    lists = Lists(shard, shard.codes(pa.array(terms, pa.binary())))
    for key, a, b in zip(keys, at, at[1:], strict=False):
        phrase = codes[a:b]
        if (lists.sizes[phrase] > 0).all() and len(starts := phrase_starts(lists, phrase)):
            yield key, starts, len(phrase)


def _item_runs(shard: Shard, queries: Queries, width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Of each item with any the runs of positions that its windows cover."""
    lists = Lists(shard, shard.codes(pa.array(queries.terms, pa.binary())))
    for name, item in zip(queries.ids, queries.items, strict=True):
        size = min(width, len(item))
        if not size:
            continue
        held = np.convolve(lists.sizes[item] > 0, np.ones(size, np.int64), "valid")
        found = [phrase_starts(lists, item[o : o + size]) for o in np.flatnonzero(held == size).tolist()]
        starts = np.concatenate([*found, np.zeros(0, np.int64)])
        if len(starts):
            yield name, *runs(starts, starts + size)


def _matches_everywhere(index: DataFrame, queries: Queries, width: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, out = Shard.open(batch, row), [[], [], [], []]
                for name, first, stop in _item_runs(shard, sent.value, width):
                    doc = shard.of_document(first)
                    for column, values in zip(out, (shard.rids[doc], [name] * len(doc), first - shard.starts[doc], stop - shard.starts[doc]), strict=True):
                        column.extend(values)
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["rid", "item_id", "first", "stop"])

    return index.select("rids", "ids", "lengths", "terms", "counts", "postings").mapInArrow(search, "rid long, item_id string, first int, stop int")


def hits(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(rid, item_id, n_hit): a row with item_id for each item that has a
    window in document rid, and one with n_hit, the words that any of them
    covers. A shard's covered positions are marked in the task that has it."""
    queries = small_queries(items)
    if queries is not None:
        sent = index.sparkSession.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    shard, names, docs = Shard.open(batch, row), [], []
                    mask = np.zeros(shard.size + 1, np.int32)
                    for name, first, stop in _item_runs(shard, sent.value, width):
                        np.add.at(mask, first, 1)
                        np.add.at(mask, stop, -1)
                        of = np.unique(shard.of_document(first))
                        docs.append(of)
                        names += [name] * len(of)
                    doc, n = _covered(shard, mask)
                    rids = np.concatenate([shard.rids[np.concatenate([*docs, np.zeros(0, np.int64)])], shard.rids[doc]])
                    columns = [pa.array(rids, pa.int64()), pa.array([*names, *[None] * len(doc)], pa.string()), pa.array([*[None] * len(names), *n.tolist()], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["rid", "item_id", "n_hit"])

        return index.select("rids", "ids", "lengths", "terms", "counts", "postings").mapInArrow(search, "rid long, item_id string, n_hit long")

    windows = staged(windows_of(items, width), "benchmark-windows")
    routed = _route(index, windows.select("key", F.array_distinct(F.split("key", " ")).cast("array<binary>").alias("words")).distinct())

    def found(shard: Shard, keys: list[str]) -> Iterator[tuple]:
        if shard.mask is None:
            shard.mask = np.zeros(shard.size + 1, np.int32)
        for key, starts, size in _starts_in(shard, keys):
            np.add.at(shard.mask, starts, 1)
            np.add.at(shard.mask, starts + size, -1)
            for doc in np.unique(shard.of_document(starts)).tolist():
                yield int(shard.rids[doc]), key, None

    def last(shard: Shard) -> list:
        if shard.mask is None:
            return []
        doc, n = _covered(shard, shard.mask)
        return [(int(shard.rids[d]), None, int(k)) for d, k in zip(doc, n, strict=True)]

    rows = staged(_at_shards(index, routed, found, "rid long, key string, n_hit long", last), "window-hits")
    named = rows.where("key is not null").join(windows, "key").select("rid", "item_id", F.lit(None).cast("long").alias("n_hit")).distinct()
    return named.unionByName(rows.where("key is null").select("rid", F.lit(None).cast("string").alias("item_id"), "n_hit"))


def _covered(shard: Shard, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with covered positions, and how many each has; mask has +1
    where a run starts and -1 where it ends."""
    at = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
    return np.unique(shard.of_document(at), return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def proximity_matches(index: DataFrame, benchmark: DataFrame, slop: int, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first, stop): smallest spans that hold all distinct
    words of an item, in any order, and at most slop words more.

    Defined results: an item without a word matches nothing; a null item_id
    stands as 'null'; items of any length are found; repeated documents each
    get their rows, repeated items too; an empty index or benchmark gives no
    row; extra columns are ignored.
    """
    items = _items(benchmark, id_col, text_col)
    schema = "doc_id long, item_id string, first int, stop int"

    def near(shard: Shard, lists: Lists, name: str, item: np.ndarray) -> Iterator[tuple]:
        found = spans(lists, item, len(np.unique(item)) + slop)
        for doc, (a, b) in zip(shard.of_document(found[:, 0]).tolist(), found, strict=True):
            yield shard.ids[doc], name, int(a - shard.starts[doc]), int(b + 1 - shard.starts[doc])

    queries = small_queries(items)
    if queries is not None:
        sent = index.sparkSession.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = Shard.open(batch, row)
                    lists = Lists(shard, shard.codes(pa.array(q.terms, pa.binary())))
                    out = [x for name, item in zip(q.ids, q.items, strict=True) for x in near(shard, lists, name, item)]
                    columns = list(zip(*out, strict=True)) or [[], [], [], []]
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first", "stop"])

        return index.select("rids", "ids", "lengths", "terms", "counts", "postings").mapInArrow(search, schema)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            codes, terms, at = _words(block.column("text"))
            sets = [[terms[c] for c in np.unique(codes[a:b])] for a, b in zip(at, at[1:], strict=False)]
            keys = pa.array([f"{name}\n{b' '.join(words).decode()}" for name, words in zip(block.column("item_id").to_pylist(), sets, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.list_(pa.binary()))], ["key", "words"])

    wanted = staged(items.mapInArrow(distinct_words, "key string, words array<binary>").where(F.size("words") > 0), "benchmark-items")

    def found(shard: Shard, keys: list[str]) -> Iterator[tuple]:
        split = [k.rsplit("\n", 1) for k in keys]
        codes, terms, at = _words(pa.array([text for _, text in split], pa.string()))
        lists = Lists(shard, shard.codes(pa.array(terms, pa.binary())))
        for (name, _), a, b in zip(split, at, at[1:], strict=False):
            yield from near(shard, lists, name, codes[a:b])

    routed = _route(index, wanted.distinct()).join(wanted.select("key"), "key")  # repeated items as often as they are
    return _at_shards(index, routed.select("shard", "key"), found, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row of docs: rid (the row's number in the index), doc_id, n_words,
    n_hit, n_items, item_ids and contaminated (n_hit > 0 and share * n_hit >=
    n_words).

    A word is hit if any occurrence of any window of an item covers it.

    Defined results: null and empty texts have no words, hit nothing and are
    clean; an empty item matches nothing; repeated items count once by id; a
    null item_id stands as 'null'; repeated rows each get a row; ids are
    integers; very long texts are read whole; an empty table gives an empty
    result, an empty benchmark leaves all clean; extra columns are ignored.
    """
    index = build_index(docs, id_col, text_col)
    base = index.select(F.explode(F.arrays_zip("rids", "ids", "lengths")).alias("x")).select(F.col("x.rids").alias("rid"), F.col("x.ids").alias("doc_id"), F.col("x.lengths").cast("long").alias("n_words"))
    rows = base.unionByName(hits(index, _items(benchmark, item_col, item_text_col), width), allowMissingColumns=True)
    grouped = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.max("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    return grouped.select(
        "rid", "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated.

    Defined results: as contamination; rows are known by their number in the
    table and columns may have any name.  docs is read twice; unless it is a
    stored table, a copy is staged.
    """
    docs = stored(docs)
    own, bad = fresh(docs, "number", "bad")
    found = contamination(docs, benchmark, width=width, share=share, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    gone = staged(found.where("contaminated").select(F.col("rid").alias(bad)), "contaminated")
    return docs.withColumn(own, F.monotonically_increasing_id()).join(gone, F.col(own) == F.col(bad), "left_anti").select(*[quoted(c) for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_SPLIT = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), {_SPLIT}) AS ws FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), {_SPLIT}) AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(ws[o : o + size - 1], ' ') AS phrase
  FROM (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS o FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT r, size, o, array_to_string(ws[o : o + size - 1], ' ') AS phrase
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS o FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
m AS (
  SELECT r, item, o, dw.size FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.size = bw.size),
h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(o, o + size)) AS p FROM m) GROUP BY r),
i AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r
"""
