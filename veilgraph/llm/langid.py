"""Language identification by a bidirectional gated recurrent network over
bytes, trained here in numpy by backpropagation through time.

A text is read whole, in windows of WINDOW bytes.  In each window one gated
recurrent layer runs forwards and one backwards; both states label every
position with a probability for each language.  A document's probabilities
are the mean over all its positions.

Arrays are laid out (units, lanes): a lane is a window, so that every gate is
one long contiguous row and one step of many windows is a few array calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.blocks import LOWER, raw_text, text_blocks
from veilgraph.llm.textops import fresh, quoted, without
from veilgraph.plans.staging import staged

WINDOW = 64
UNITS = 8
#: Windows that are computed together: their gates stay in a core's cache.
LANES = 2048

#: Bounds of the training sample: documents per language, bytes of their
#: texts in all, and languages (those with most documents).
DOCS_PER_LANGUAGE, SAMPLE_BYTES, LANGUAGES = 600, 8 << 20, 256
#: Windows that training goes over, about; each sampled one once at least.
STEPS = 100_000

UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    inputs: list[np.ndarray]  # per direction (3 units, 256): update, reset, candidate
    states: list[np.ndarray]  # per direction (3 units, units)
    out: np.ndarray  # (languages, 2 units)
    bias: np.ndarray  # (languages, 1)

    @classmethod
    def fresh(cls, languages: list[str], units: int = UNITS, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(languages, [draw(3 * units, 256) for _ in range(2)], [draw(3 * units, units) for _ in range(2)], draw(len(languages), 2 * units), np.zeros((len(languages), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _layer(wx: np.ndarray, u: np.ndarray, steps: np.ndarray, mask: np.ndarray | None, trace: list | None = None) -> np.ndarray:
    """States (time, units, lanes) of one direction over bytes (time, lanes)."""
    units, (time, lanes) = u.shape[1], steps.shape
    h = np.zeros((units, lanes), np.float32)
    states = np.empty((time, units, lanes), np.float32)
    gx, gh = np.empty((3 * units, lanes), np.float32), np.empty((3 * units, lanes), np.float32)
    for t in range(time):
        np.take(wx, steps[t], axis=1, out=gx, mode="clip")
        np.matmul(u, h, out=gh)
        gates = gx[: 2 * units]
        gates += gh[: 2 * units]
        _sigmoid(gates)
        z, r = gates[:units], gates[units:]
        n = gx[2 * units :]
        if trace is None:
            r *= gh[2 * units :]
            n += r
        else:
            n += r * gh[2 * units :]
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if mask is not None:
            new *= mask[t]
        if trace is not None:
            trace.append((h, z.copy(), r.copy(), n.copy(), gh[2 * units :].copy()))
        h = new
    return states


def _probabilities(net: Network, steps: np.ndarray, mask: np.ndarray | None) -> Iterator[np.ndarray]:
    """Per step the probabilities (languages, lanes)."""
    units = net.states[0].shape[1]
    ahead = _layer(net.inputs[0], net.states[0], steps, mask)
    back = _layer(net.inputs[1], net.states[1], steps[::-1], None if mask is None else mask[::-1])
    last = len(steps) - 1
    for t in range(len(steps)):
        p = net.out[:, :units] @ ahead[t]
        p += net.out[:, units:] @ back[last - t]
        p += net.bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        yield p


def train(net: Network, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, *, epochs: int = 4, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on the mean cross-entropy of all positions. windows: bytes
    (windows, WINDOW), lengths of them in use."""
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    units, step, total = net.states[0].shape[1], 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            steps = np.ascontiguousarray(windows[pick].T)
            mask = (np.arange(windows.shape[1])[:, None] < lengths[pick]).astype(np.float32)
            grads = _gradients(net, steps, mask, labels[pick], units)
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: Network, steps: np.ndarray, mask: np.ndarray, labels: np.ndarray, units: int) -> list[np.ndarray]:
    traces: list[list] = [[], []]
    ahead = _layer(net.inputs[0], net.states[0], steps, mask, traces[0])
    back = _layer(net.inputs[1], net.states[1], steps[::-1], mask[::-1], traces[1])[::-1]
    both = np.concatenate([ahead, back], axis=1)  # time, 2 units, lanes
    p = np.einsum("ku,tun->tkn", net.out, both) + net.bias
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    p[:, labels, np.arange(len(labels))] -= 1
    p *= mask[:, None, :] / mask.sum()
    d_out = np.einsum("tkn,tun->ku", p, both)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_both = np.einsum("ku,tkn->tun", net.out, p)
    d_inputs, d_states = [], []
    for side in range(2):
        flip = slice(None, None, -1 if side else 1)
        idx, m, outer = steps[flip], mask[flip], d_both[flip, side * units : (side + 1) * units]
        u, du = net.states[side], np.zeros_like(net.states[side])
        dx = np.empty((len(idx), 3 * units, idx.shape[1]), np.float32)
        dh = np.zeros((units, idx.shape[1]), np.float32)
        for t in range(len(idx) - 1, -1, -1):
            h, z, r, n, g = traces[side][t]
            d = (dh + outer[t]) * m[t]
            dn = d * (1 - z) * (1 - n * n)
            dx[t, :units] = d * (h - n) * z * (1 - z)
            dx[t, units : 2 * units] = dn * g * r * (1 - r)
            dx[t, 2 * units :] = dn
            through = dx[t].copy()
            through[2 * units :] *= r
            du += through @ h.T
            dh = d * z + u.T @ through
        flat = np.ascontiguousarray(dx.transpose(1, 0, 2)).reshape(3 * units, -1)
        at = idx.ravel()
        d_inputs.append(np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32))
        d_states.append(du)
    return [*d_inputs, *d_states, d_out.astype(np.float32), d_bias.astype(np.float32)]


def pooled(net: Network, raw: bytes, at: np.ndarray) -> np.ndarray:
    """Mean probabilities (texts, languages) over every byte of texts that lie
    end to end in raw, text k in at[k]:at[k+1]. A text of no bytes gets zeros."""
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    lengths = np.diff(at)
    pieces = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(lengths)), pieces)
    first = at[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
    filled = np.minimum(WINDOW, at[1:][of] - first)
    sums = np.zeros((len(of), len(net.languages)))
    for full in (True, False):
        chosen = np.flatnonzero((filled == WINDOW) == full)
        for k in range(0, len(chosen), LANES):
            lanes = chosen[k : k + LANES]
            where = first[lanes][None, :] + np.arange(WINDOW)[:, None]
            mask = None
            if not full:
                mask = (np.arange(WINDOW)[:, None] < filled[lanes]).astype(np.float32)
                np.minimum(where, len(data) - 1, out=where)
            total = np.zeros((len(net.languages), len(lanes)), np.float32)
            for t, p in enumerate(_probabilities(net, data[where], mask)):
                total += p if mask is None else p * mask[t]
            sums[lanes] = total.T
    out = np.zeros((len(lengths), len(net.languages)))
    np.add.at(out, of, sums)
    return out / np.maximum(lengths, 1)[:, None]


def label_positions(net: Network, text: str) -> list[tuple[str, float]]:
    """Language and probability at every byte of a text."""
    data = np.frombuffer(text.encode().translate(LOWER), np.uint8)
    out = []
    for at in range(0, len(data), WINDOW):
        for p in _probabilities(net, data[at : at + WINDOW, None], None):
            out.append((net.languages[int(p[:, 0].argmax())], float(p[:, 0].max())))
    return out


def sample_windows(labelled: DataFrame, docs_per_language: int, sample_bytes: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and all windows, their lengths and labels, of the whole
    texts of some docs_per_language rows (doc_id, text, lang) of each language,
    those with the smallest hashes of id and text; of fewer where the texts
    are so long that all languages' would exceed sample_bytes."""
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = staged(sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES), "langid-sizes")
    # hashes are even, so a cut-off at the wanted share of their range bounds the sample without ordering any rows
    share = F.least(F.lit(float(docs_per_language)) / F.col("n"), F.lit(sample_bytes / max(sizes.count(), 1)) / F.col("bytes"), F.lit(1.0))
    cuts = sizes.select(F.col("lang").alias("of"), (share * 2.0**64 - 2.0**63).cast("long").alias("cut"))
    chosen = rows.join(cuts, F.col("lang") == F.col("of")).where("key <= cut")
    # rows that share id and text would all come: one of them does
    found = sorted(map(tuple, chosen.groupBy("lang", "key").agg(F.max("text").alias("text")).collect()))
    languages = sorted({x[0] for x in found})
    number = {name: k for k, name in enumerate(languages)}
    raws = [x[2].encode().translate(LOWER) for x in found]
    sizes_ = np.array([len(r) for r in raws], np.int64)
    pieces = -(-sizes_ // WINDOW)
    padded = b"".join(r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raws, pieces, strict=True))
    last = np.cumsum(pieces) - 1
    lengths = np.full(int(pieces.sum()), WINDOW)
    lengths[last] = sizes_ - (pieces - 1) * WINDOW
    labels = np.repeat(np.array([number[x[0]] for x in found], np.int64), pieces)
    return languages, np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), lengths, labels


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network trained on a bounded sample of (doc_id, text, lang).

    Defined results: None if no row has a text and a language; rows without
    either are left out; sampled texts are read whole; rows that share id and
    text count once; where there are more than LANGUAGES languages, those with
    most rows are learned (ties to the smaller name); reruns agree; extra
    columns are ignored.
    """
    languages, windows, lengths, labels = sample_windows(labelled, docs_per_language, sample_bytes)
    if not languages:
        return None
    epochs = int(np.clip(round(STEPS / len(windows)), 1, 40))
    return train(Network.fresh(languages), windows, lengths, labels, epochs=epochs)


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Every row of docs with lang_pred and score (the mean probability of
    that language over all positions).

    Defined results: null texts and texts without a letter get 'und' and
    score 0, as does every text if there is no network; repeated rows get
    equal results; very long texts are read whole; of equal probabilities the
    first language's counts; an empty table stays empty; input columns named
    lang_pred or score, in any letter case, are replaced, others may have any
    name.
    """
    kept = without(docs, ("lang_pred", "score"))
    (own,) = fresh(docs, "text")
    rows = docs.select(*[quoted(c) for c in kept.columns], docs[text_col].alias(own))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in text_blocks(batches, own):
            texts = block.column(own)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model is not None and len(texts):
                p = pooled(model, *raw_text(texts))
                best = p.argmax(axis=1)
                names[lettered] = np.array(model.languages, object)[best[lettered]]
                scores[lettered] = np.clip(p.max(axis=1), 0, 1)[lettered]
            columns = [c for name, c in zip(block.schema.names, block.columns, strict=True) if name != own]
            fields = [n for n in block.schema.names if n != own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], [*fields, "lang_pred", "score"])

    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(per_block, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")
