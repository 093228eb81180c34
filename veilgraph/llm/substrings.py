"""Removal of passages that repeat across documents, with a count-min
prefilter.

Windows of consecutive words are hashed.  First pass: every chunk of
documents makes a sketch, the sorted cells of its windows in each row of a
count-min table.  The sketches meet by range of cells and are merged there;
each chunk learns which of its cells were counted twice or more.  As a cell
can only be counted too often, a window of which any row's cell was counted
once occurs once.  Second pass: only windows estimated repeated in every row
go, under a 96-bit key, to where equal keys meet and their smallest document
is found.

Both the table and the keys are dealt out by range, so neither is held in one
place, and a chunk sends a window once however often it has it.  Answers are
aligned with what was asked, in order, so they are a bit or a few bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.blocks import deltas, encode, hash128, narrow, pack, split_words, undelta, unpack
from veilgraph.plans.staging import input_bytes, shuffle_width, staged, stored

#: Documents in a chunk; a text of LONG bytes or more is a chunk of its own.
CHUNK_ROWS, LONG = 2048, 64 << 10
#: Rows of the count-min table.
DEPTH = 2
#: Id that stands for a null one: larger than any other.
NO_ID = np.iinfo(np.int64).max

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one chunk together, also across batches."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = batch.column("chunk").to_numpy()
        for k in np.flatnonzero(chunks < 0).tolist():
            yield pa.Table.from_batches([batch.slice(k, 1)])
        batch = batch.filter(pa.array(chunks >= 0))
        chunks = chunks[chunks >= 0]
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if pending and pending[0].column("chunk")[0].as_py() != chunks[a]:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
    if pending:
        yield pa.Table.from_batches(pending)


def window_keys(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (index into codes), 64-bit and 32-bit key of every window of
    width words that lies in one document."""
    ends = np.repeat(at[1:], np.diff(at))
    starts = np.flatnonzero(np.arange(len(codes)) + width <= ends)
    keys = []
    for side in range(2):
        base = _MULTIPLIERS[side] | np.uint64(1)
        powers = np.full(len(codes) + 1, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(hashes[codes, side] * powers[:-1], out=sums[1:])
        inverse = np.full(len(codes) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        key = (sums[starts + width] - sums[starts]) * inverse[starts]
        key ^= key >> np.uint64(31)
        keys.append(key * _MULTIPLIERS[3])
    return starts, keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32)


class Windows:
    """A chunk's words and window keys."""

    def __init__(self, table: pa.Table, width: int):
        texts = table.column("text").combine_chunks()
        self.words, self.at = split_words(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
        codes, dictionary = encode(self.words)
        self.starts, self.key, self.more = window_keys(codes, self.at, hash128(dictionary), width)
        self.ids = pc.fill_null(table.column("doc_id"), NO_ID).to_numpy()
        self.doc = np.searchsorted(self.at, self.starts, side="right") - 1

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.key * _MULTIPLIERS[row]) >> np.uint64(64 - bits)


def _edges(parts: int, bits: int) -> np.ndarray:
    """First number of each part of an even division of 0 to 2**bits - 1."""
    return np.array([(k << bits) // parts for k in range(parts)], np.uint64)


def _sketch(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and whether each was counted twice or more."""
    cells = np.sort(cells)
    first = np.flatnonzero(np.diff(cells, prepend=cells[:1] + np.uint64(1)))
    return cells[first], np.diff(np.append(first, len(cells))) > 1


def _members(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among chosen (sorted): a table over their low bits
    settles most, a binary search the rest."""
    out, low = np.zeros(len(values), bool), np.uint64((1 << 22) - 1)
    if len(chosen):
        table = np.zeros(1 << 22, bool)
        table[chosen & low] = True
        maybe = np.flatnonzero(table[values & low])
        at = np.minimum(np.searchsorted(chosen, values[maybe]), len(chosen) - 1)
        out[maybe[chosen[at] == values[maybe]]] = True
    return out


def _blob_table(buckets: list[int], chunk: int, blobs: list[bytes]) -> dict:
    return {"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array([chunk] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())}


def _merge_sketches(edges: np.ndarray, parts: int):
    """Sketches of one range of cells, merged; to each chunk a bit per cell
    that it sent: counted twice or more."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        part = bucket % parts
        counts = np.zeros(int(edges[part + 1] - edges[part]), np.uint8)
        asked = []
        for blob in table.column("blob").to_pylist():
            gaps, twice = unpack(blob)
            cells = undelta(gaps)
            asked.append(cells)
            counts[cells] = np.minimum(counts[cells], 1) + 1 + np.unpackbits(twice)[: len(cells)]
        said = [np.packbits(counts[cells] > 1) for cells in asked]
        keep = [k for k, bits in enumerate(said) if bits.any()]
        chunks = table.column("chunk").to_numpy()
        return pa.table({"bucket": pa.array([bucket] * len(keep), pa.int32()), "chunk": pa.array(chunks[keep]), "blob": pa.array([pack(said[k]) for k in keep], pa.binary())})

    return merge


def _least_ids(table: pa.Table) -> pa.Table:
    """Requests of one range of keys, (key, id) each; to each chunk, for
    those of its keys that a smaller id has elsewhere, a bit and that id."""
    asked, keys, more, ids = [], [], [], []
    for blob in table.column("blob").to_pylist():
        gaps, low, own = unpack(blob)
        keys.append(undelta(gaps))
        more.append(low)
        ids.append(own)
        asked.append(len(low))
    flat, low, own = np.concatenate(keys), np.concatenate(more), np.concatenate(ids)
    order = np.lexsort((low, flat))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(flat[order]) != 0) | (np.diff(low[order].astype(np.int64)) != 0)]))
    least = np.empty(len(flat), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(flat))))
    rows, blobs, at = [], [], 0
    for k, n in enumerate(asked):
        smaller = least[at : at + n] < own[at : at + n]
        if smaller.any():
            rows.append(k)
            blobs.append(pack(np.packbits(smaller), least[at : at + n][smaller]))
        at += n
    chunks = table.column("chunk").to_numpy()
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int32()), "chunk": pa.array(chunks[rows]), "blob": pa.array(blobs, pa.binary())})


_REQUEST = "bucket int, chunk long, blob binary"
_STATE = "kind int, doc_id long, n_words long, kept string, bucket int, chunk long, blob binary, ids array<long>, texts array<string>"
_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text", output: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of docs. kept: the words
    that stay, joined by one space; with output='digest' its SHA-256.

    A word is removed if a window of width words that covers it also starts
    in a document with a smaller id.  Windows are judged on the input.

    Defined results: null and empty texts have no words; rows with equal ids
    don't remove each other's words; a null id counts as larger than any
    other (and null ids as equal); other ids are integers; repeated rows each
    get a row; a very long text is a chunk of its own; an empty table gives an
    empty result; extra columns are ignored.  docs is read twice; unless it is
    a stored table, a copy is staged.
    """
    docs = stored(docs)
    if output not in ("text", "digest"):
        raise ValueError("output is 'text' or 'digest'")
    digest = output == "digest"
    rid = F.monotonically_increasing_id()
    long = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) >= LONG
    source = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), long.alias("long"))
    source = source.select("doc_id", "text", F.when(F.col("long"), -F.col("rid") - 1).otherwise(F.shiftright("rid", CHUNK_ROWS.bit_length() - 1)).alias("chunk"))
    parts = 2 * shuffle_width(docs)
    bits = min(60, max(20, input_bytes(docs).bit_length()))  # some four cells a window
    cell_edges = np.append(_edges(parts, bits), np.uint64(1 << bits))
    key_edges = _edges(parts, 64)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_chunk(batches):
            windows, buckets, blobs = Windows(table, width), [], []
            for row in range(DEPTH):
                cells, twice = _sketch(windows.cells(row, bits))
                at = np.searchsorted(cells, cell_edges)
                for part in np.flatnonzero(np.diff(at)).tolist():
                    piece = slice(at[part], at[part + 1])
                    buckets.append(row * parts + part)
                    blobs.append(pack(deltas(cells[piece] - cell_edges[part]), np.packbits(twice[piece])))
            if blobs:
                yield from pa.table(_blob_table(buckets, table.column("chunk")[0].as_py(), blobs)).to_batches()

    answers = source.mapInArrow(sketches, _REQUEST).groupBy("bucket").applyInArrow(_merge_sketches(cell_edges, parts), _REQUEST)

    def kept_text(words: list[bytes]) -> str:
        joined = b" ".join(words)
        return hashlib.sha256(joined).hexdigest() if digest else joined.decode()

    def suspects(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        windows = Windows(left, width)
        said = {b: unpack(x)[0] for b, x in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True)}
        repeated = np.ones(len(windows.key), bool)
        for row in range(DEPTH):
            own = windows.cells(row, bits)
            cells, _ = _sketch(own)
            at, flags = np.searchsorted(cells, cell_edges), np.zeros(len(cells), bool)
            for part in np.flatnonzero(np.diff(at)).tolist():
                if (answer := said.get(row * parts + part)) is not None:
                    flags[at[part] : at[part + 1]] = np.unpackbits(answer)[: at[part + 1] - at[part]]
            repeated &= _members(own, cells[flags])
        chosen = np.flatnonzero(repeated)
        doc, hit = windows.doc[chosen], np.zeros(len(windows.ids), bool)
        hit[doc] = True
        words, at = windows.words.cast(pa.large_binary()), windows.at
        ids, lengths = left.column("doc_id").to_pylist(), np.diff(at)
        calm = np.flatnonzero(~hit).tolist()
        empty = {"kind": [], "doc_id": [], "n_words": [], "kept": [], "bucket": [], "chunk": [], "blob": [], "ids": [], "texts": []}
        out = dict(empty)
        out |= {"kind": [0] * len(calm), "doc_id": [ids[k] for k in calm], "n_words": lengths[calm].tolist()}
        out |= {"kept": [kept_text(words.slice(at[k], at[k + 1] - at[k]).to_pylist()) for k in calm]}
        out |= {name: [None] * len(calm) for name in ("bucket", "chunk", "blob", "ids", "texts")}

        def add(**values) -> None:
            for name in empty:
                out[name].append(values.get(name))

        if len(chosen):
            k1, k2, own = windows.key[chosen], windows.more[chosen], windows.ids[doc]
            order = np.lexsort((k2, k1))
            new = np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order].astype(np.int64)) != 0)])
            first = np.flatnonzero(new)
            unique, low, least = k1[order][first], k2[order][first], np.minimum.reduceat(own[order], first)
            number = np.empty(len(chosen), np.int64)
            number[order] = np.cumsum(new) - 1
            cuts = np.append(np.searchsorted(unique, key_edges), len(unique))
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                piece = slice(cuts[part], cuts[part + 1])
                add(kind=1, bucket=part, chunk=chunk, blob=pack(deltas(unique[piece]), low[piece], least[piece]))
            rows = np.flatnonzero(hit)
            place = np.cumsum(hit) - 1
            add(
                kind=2, chunk=chunk, ids=[ids[k] for k in rows.tolist()], texts=[x or "" for x in left.column("text").take(pa.array(rows)).to_pylist()],
                blob=pack(narrow(place[doc]), narrow(windows.starts[chosen] - at[doc]), narrow(number), cuts.astype(np.int64), least),
            )
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.table({name: pa.array(out[name], kind) for name, kind in zip(empty, kinds, strict=True)})

    state = source.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(suspects, _STATE)
    state = staged(state, "substring-state", partition_by=["kind"])
    least = state.where("kind = 1").select("bucket", "chunk", "blob").groupBy("bucket").applyInArrow(_least_ids, _REQUEST)

    def strip(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for k in range(left.num_rows):
            doc, start, number, cuts, floor = unpack(left.column("blob")[k].as_py())
            for part, blob in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True):
                smaller, ids = unpack(blob)
                piece = floor[cuts[part] : cuts[part + 1]]
                piece[np.flatnonzero(np.unpackbits(smaller)[: len(piece)])] = ids
            ids = left.column("ids")[k].as_py()
            own = np.array([NO_ID if x is None else x for x in ids], np.int64)
            words, at = split_words(pa.array(left.column("texts")[k].as_py(), pa.large_string()))
            words, start, doc = words.cast(pa.large_binary()), start.astype(np.int64), doc.astype(np.int64)
            gone = floor[number.astype(np.int64)] < own[doc]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at[doc[gone]] + start[gone], 1)
            np.add.at(cover, at[doc[gone]] + start[gone] + width, -1)
            stays = np.cumsum(cover)[:-1] == 0
            for i, doc_id in enumerate(ids):
                keep = stays[at[i] : at[i + 1]]
                text = words.slice(at[i], at[i + 1] - at[i]).filter(pa.array(keep)).to_pylist()
                rows.append((doc_id, len(keep), int(len(keep) - keep.sum()), kept_text(text)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(list(v), t) for n, v, t in zip(("doc_id", "n_words", "n_removed", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    touched = state.where("kind = 2").select("chunk", "ids", "texts", "blob").groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(strip, _RESULT)
    calm = state.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return calm.unionByName(touched)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, width=50, output="digest").withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT r, doc_id, o, array_to_string(ws[o : o + 49], ' ') AS seq FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS o FROM d WHERE len(ws) >= 50)),
f AS (
  SELECT seq, min(doc_id) AS least FROM w GROUP BY seq HAVING count(*) > 1),
g AS (
  SELECT DISTINCT r, unnest(range(o, o + 50)) AS p FROM w JOIN f ON w.seq = f.seq WHERE f.least < coalesce(w.doc_id, 9223372036854775807)),
k AS (
  SELECT r, list(p) AS gone FROM g GROUP BY r),
x AS (
  SELECT d.r, doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
s AS (
  SELECT x.r, string_agg(ws[x.p], ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.r = g.r AND x.p = g.p WHERE g.r IS NULL GROUP BY x.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN s ON d.r = s.r
"""
