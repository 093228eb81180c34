"""Arrow and numpy helpers for operators that work on blocks of documents.

A block is a run of consecutive rows with a bounded amount of text (one very
long document may exceed it alone).  Tokenising happens in Arrow's compiled
kernels; words become integer codes into the block's dictionary, so that what
follows are array operations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; ASCII that is neither letter nor digit to a space.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that column has about limit bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def raw_text(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts end to end as UTF-8, and where each starts and the last ends. Null is empty."""
    arr = texts.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None else b""
    return raw, at - at[0]


def split_words(texts: pa.Array, table: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, end to end, and where each text's words start
    (one more entry: where the last's end).  Words are runs of anything but
    ASCII white space; table maps bytes first."""
    if table is None:
        arr = texts.cast(pa.large_string()).fill_null("")
    else:
        raw, at = raw_text(texts)
        arr = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.translate(table)))
    lists = pc.ascii_split_whitespace(arr)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    if pc.all(keep).as_py() is False:
        of = np.repeat(np.arange(len(counts)), counts)[keep.to_numpy(zero_copy_only=False)]
        counts = np.bincount(of, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(keep)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the dictionary (binary) that they point into."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary())


def hash64(dictionary: pa.Array) -> np.ndarray:
    """64-bit hash of each entry."""
    digests = b"".join(map(xxhash.xxh3_64_digest, dictionary.to_pylist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def hash128(dictionary: pa.Array) -> np.ndarray:
    """Two 64-bit halves of a 128-bit hash of each entry, as columns."""
    digests = b"".join(map(xxhash.xxh3_128_digest, dictionary.to_pylist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting, which suits integers best."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string.  Bytes of equal weight stand together,
    which suits sorted or small numbers."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(b"".join(head + body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count, at, out = raw[0], 1, []
    kinds = []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype("<" + kind.decode()), n))
        at += 10
    for kind, n in kinds:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.array(planes.T, order="C").view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def deltas(a: np.ndarray) -> np.ndarray:
    """Sorted uint64 as narrow differences."""
    return narrow(np.diff(a, prepend=np.uint64(0))) if len(a) else a.astype(np.uint8)


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)
