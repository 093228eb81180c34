"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold[k] - w . x), with one weight vector w for
all grades and thresholds in rising order.  x tells which hashed features a
text has: its words, how they begin, and how its white-space tokens end, each
as large as it is telling: a feature that in the sample goes with the grades
no more than chance would have it is 0, a clear one 1.  Otherwise the many
words of a text would be learned by heart instead of the few that matter.  The
expected grade and the probability of a grade in the upper tail rank and
select documents.

The regression is fitted on a bounded sample of rated documents, whose hashed
features (not texts) come to the driver; sampled texts, like those scored, are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.blocks import ALNUM, deltas, distinct, encode, pack, split_words, text_blocks, undelta, unpack
from veilgraph.llm.textops import fresh, quoted, without

#: Hashed features: 2 to this power.
BITS = 17
#: Bounds of the training sample: rated documents, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 8000, 32 << 20
#: Letters of a word's beginnings, bytes of a token's end.
HEADS, TAIL = (3, 4, 5), 3
#: Standard deviations from chance at which a feature begins to count, and
#: over which it comes to count fully.
CHANCE, CLEAR = 3.0, 8.0


def _hash_features(kind: bytes, values: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(kind + v) for v in values), np.uint64, len(values)).astype(np.uint64) >> np.uint64(64 - BITS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature), sorted, of all texts. Null and empty
    texts have none."""
    parts = []
    for words, kinds in (
        (split_words(texts, ALNUM), [(b"w", lambda w: w), *((b"h%d" % n, lambda w, n=n: w.decode()[:n].encode()) for n in HEADS)]),
        (split_words(texts), [(b"t", lambda w: w[-TAIL:])]),
    ):
        codes, dictionary = encode(words[0])
        plain, n = dictionary.to_pylist(), max(len(dictionary), 1)
        of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(words[1]))
        once = distinct(of * n + codes)
        doc, code = once // n << BITS, once % n
        for kind, part in kinds:
            parts.append(distinct(doc | _hash_features(kind, list(map(part, plain))).astype(np.int64)[code]))
    keys = distinct(np.concatenate(parts))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def telling(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """How much each feature counts, 0 to 1: by how many standard deviations
    the number of documents with it and a grade up to k, for the k where that
    is most, is away from what chance would give."""
    has, n = np.bincount(feature, minlength=1 << BITS).astype(np.float64), len(grade)
    away = np.zeros(1 << BITS)
    for k in range(grades - 1):
        low = grade <= k
        p = low.mean()
        expected = has * p
        spread = np.sqrt(expected * (1 - p) * (1 - has / n) + 0.5)
        away = np.maximum(away, np.abs(np.bincount(feature, weights=low[doc].astype(np.float64), minlength=1 << BITS) - expected) / spread)
    return np.clip(away - CHANCE, 0, CLEAR) / CLEAR


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one less than grades

    def tails(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for every k below the highest grade: (texts, grades - 1)."""
        score = np.bincount(doc, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """A first one and positive steps, so they are in order."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def gradients(score: np.ndarray, free: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of grades y at scores w . x, and its
    derivatives by the scores and by what the thresholds are made of."""
    theta, top, n = thresholds(free), len(free), len(y)
    upper = np.where(y < top, _logistic(theta[np.minimum(y, top - 1)] - score), 1.0)
    lower = np.where(y > 0, _logistic(theta[np.maximum(y - 1, 0)] - score), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
    d_theta = np.zeros(top)
    np.add.at(d_theta, np.minimum(y, top - 1), np.where(y < top, -du, 0))
    np.add.at(d_theta, np.maximum(y - 1, 0), np.where(y > 0, dl, 0))
    d_free = np.concatenate([[d_theta.sum()], np.cumsum(d_theta[:0:-1])[::-1] * np.exp(free[1:])])
    return float(-np.log(p).mean()), du - dl, d_free


def train(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, *, epochs: int = 20, rate: float = 0.5, decay: float = 2e-3, batch: int = 128, seed: int = 5) -> Model:
    """Adagrad on the negative log-likelihood of the grades."""
    size = telling(doc, feature, grade, grades)
    counts = size[feature] > 0
    doc, feature = doc[counts], feature[counts]
    x = size[feature]
    rng = np.random.default_rng(seed)
    w, sums = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    theta = np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    free_sums = np.full(len(free), 1e-2)
    at = np.searchsorted(doc, np.arange(len(grade) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            index = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick])
            row = np.repeat(np.arange(len(pick)), at[pick + 1] - at[pick])
            score = np.bincount(row, weights=w[feature[index]] * x[index], minlength=len(pick))
            _, d_score, d_free = gradients(score, free, grade[pick])
            used, where = np.unique(feature[index], return_inverse=True)
            g = np.bincount(where, weights=d_score[row] * x[index], minlength=len(used)) + decay * w[used] / len(pick)
            sums[used] += g * g
            w[used] -= rate * g / np.sqrt(sums[used])
            free_sums += d_free * d_free
            free -= 0.2 * rate * d_free / np.sqrt(free_sums)
    return Model(w * size, thresholds(free))


def sample_rated(rated: DataFrame, grades: int, limit: int, most_bytes: int, ratings: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features and the grades of about limit rows of (doc_id, text,
    grade), or of fewer with about most_bytes of text: those with the smallest
    hashes of id and text. With ratings (doc_id, grade) rated is (doc_id,
    text): sizes and hashes are taken before the join, so that of the texts
    only the sampled ones travel."""
    held = ("grade",) if ratings is None else ()
    rows = rated.select("doc_id", "text", *held, F.xxhash64("doc_id", "text").alias("key"), F.octet_length("text").alias("size"))
    rows = rows if ratings is None else rows.join(ratings.select("doc_id", "grade"), "doc_id")
    rows = rows.where(F.col("grade").between(0, grades - 1)).select("text", F.col("grade").cast("int").alias("grade"), "key", "size")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(limit / max(n, 1), most_bytes / max(size, 1))
    cut_off = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))  # hashes are even
    # rows that share id and text share a hash: one of them, with the lowest of their grades
    rows = rows.where(F.col("key") <= cut_off).groupBy("key").agg(F.min("grade").alias("grade"), F.max("text").alias("text"))

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            doc, feature = features(block.column("text"))
            at = np.searchsorted(doc, np.arange(block.num_rows + 1))
            packed = [pack(deltas(feature[a:b].astype(np.uint64))) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("grade"), pa.array(packed, pa.binary())], ["key", "grade", "features"])

    found = sorted(map(tuple, rows.mapInArrow(per_block, "key long, grade int, features binary").collect()))
    lists = [undelta(unpack(x[2])[0]).astype(np.int64) for x in found]
    doc = np.repeat(np.arange(len(found)), list(map(len, lists))).astype(np.int64)
    return doc, np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([x[1] for x in found], np.int64)


def fit(rated: DataFrame, grades: int = 3, limit: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, ratings: DataFrame | None = None) -> Model | None:
    """A model trained on a bounded sample of (doc_id, text, grade), or of
    (doc_id, text) joined with ratings (doc_id, grade).

    Defined results: None without a rated row; rows with a null grade or one
    out of range are left out; rows that share id and text count once, with
    the lowest of their grades; null and empty texts have no features; sampled
    texts are read whole, however long; reruns agree; extra columns are
    ignored.
    """
    doc, feature, grade = sample_rated(rated, grades, limit, most_bytes, ratings)
    return train(doc, feature, grade, grades) if len(grade) else None


def grade_documents(docs: DataFrame, model: Model | None, *, text_col: str = "text", select_tail: float = 0.1) -> DataFrame:
    """Every row of docs with expected_grade, p_low (the probability of the
    lowest grade), p_top (that of the highest), grade (the median grade) and
    selected (the lowest grade is less likely than select_tail).

    Defined results: null and empty texts have no features and are graded by
    the thresholds alone; without a model every column is null and nothing is
    selected; repeated rows get equal results; very long texts are read whole;
    an empty table stays empty; input columns named like an output column, in
    any letter case, are replaced, others may have any name.
    """
    added = ("expected_grade", "p_low", "p_top", "grade", "selected")
    kept = without(docs, added)
    (own,) = fresh(docs, "text")
    rows = docs.select(*[quoted(c) for c in kept.columns], docs[text_col].alias(own))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in text_blocks(batches, own):
            n = block.num_rows
            columns = [c for name, c in zip(block.schema.names, block.columns, strict=True) if name != own]
            names = [x for x in block.schema.names if x != own]
            if model is None:
                values = [pa.nulls(n, pa.float64())] * 3 + [pa.nulls(n, pa.int32()), pa.array([False] * n)]
            else:
                tails = model.tails(*features(block.column(own)), n)
                low = 1 - tails[:, 0]
                values = [pa.array(tails.sum(axis=1)), pa.array(low), pa.array(tails[:, -1]), pa.array((tails > 0.5).sum(axis=1).astype(np.int32)), pa.array(low < select_tail)]
            yield pa.RecordBatch.from_arrays([*columns, *values], [*names, *added])

    schema = kept.schema.add("expected_grade", "double").add("p_low", "double").add("p_top", "double").add("grade", "integer").add("selected", "boolean")
    return rows.mapInArrow(per_block, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good. Learns from the rated documents whose
    crc32(doc_id) mod 5 is not 0; grades every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    ratings = labels.select("doc_id", grade.alias("grade"))
    return grade_documents(docs, fit(docs.where(~F.col("held_out")), ratings=ratings)).drop("text")
