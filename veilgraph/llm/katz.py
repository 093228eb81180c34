"""Scoring texts with a Katz backoff bigram model learned from the corpus.

A seen bigram has its Good-Turing discounted share of its context; an unseen
one gets the context's backoff weight times the word's unigram probability,
itself discounted; an unknown word gets what the discounts left over.  The
weights are normalised exactly: for every context the probabilities of all
known words and of the unknown one sum to 1.

Counts live in tables that are dealt out by hash of the word (unigrams) and
of the context (bigrams); a context so frequent that it would crowd its
bucket is spread by the word that follows it, and the most frequent words'
probabilities are known in every bucket, so that none is asked for in one
place.  The estimator is the same at every count.  Texts come to the tables:
each block of documents sends its tokens, as small integers, to the buckets
of their contexts, and gets a few numbers per document back.  As a text's
score is a sum over its tokens, the parts add up wherever they are made:

    seen      log r - log c(h), and the number of tokens with r = 1..K, whose
              discounts are known only when all buckets have counted
    unseen    log alpha(h), in the context's bucket, and log P(w), there too
              if the word is among the most frequent, else in the word's
              bucket, where also each context's seen unigram mass is summed,
              of which alpha needs the complement

Words are known by a 64-bit hash; two words that share one count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.blocks import LOWER, deltas, encode, hash64, narrow, pack, split_words, text_blocks, undelta, unpack
from veilgraph.plans.staging import shuffle_width, staged, stored

#: Counts up to K are discounted.
K = 5
#: Contexts seen more often may be spread over buckets.
BIG = 50_000
#: Words seen in more than one of so many tokens are known in every bucket;
#: there are fewer of them than this.
KNOWN = 1 << 14
BLOCK_BYTES = 12 << 20

_START, _END = b" ", b"\n"  # no word contains either
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Katz's factor for each count 1..K from the numbers of things seen
    1..K+1 times.  Where Good-Turing gives none between 0 and 1, absolute
    discounting stands in, which always does."""
    n = [0, *map(float, counts_of_counts)]
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = []
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(good if 0 < good < 1 else (r - flat) / r)
    return out


def _factors(d: list[float]) -> np.ndarray:
    """Discount by count, the last for all larger counts; 0 stays 0."""
    return np.array([0.0, *d, 1.0])


class Tokens:
    """A block's tokens: each text's words and one end, with the token before
    each.  Codes are in the order of the words' hashes."""

    def __init__(self, block: pa.RecordBatch):
        words, at = split_words(block.column("text"), LOWER)
        codes, dictionary = encode(words)
        plain = dictionary.to_pylist()
        hashes = hash64(pa.array([*plain, _START, _END], pa.large_binary()))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.hashes = hashes[order]
        codes = rank[codes]
        self.context = np.insert(codes, at[:-1], rank[-2])
        self.word = np.insert(codes, at[1:], rank[-1])
        self.start, self.n_docs = int(rank[-2]), len(at) - 1
        self.lengths = np.diff(at) + 1
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), self.lengths)
        self.held = block.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def bucket_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _pieces(sorted_hashes: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """Runs of sorted hashes that share a bucket."""
    if not len(sorted_hashes):
        return []
    bucket = bucket_of(sorted_hashes, parts)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _table(columns: dict[str, pa.DataType], rows: list[dict]) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in columns.items()})


_UNIGRAMS = "bucket int, tokens long, words long, seen array<long>, blob binary"
_UNIGRAM_TYPES = {"bucket": pa.int32(), "tokens": pa.int64(), "words": pa.int64(), "seen": pa.list_(pa.int64()), "blob": pa.binary()}
_MIXED = "kind int, bucket int, peer long, seen array<long>, hot array<long>, hot_stats array<double>, blob binary"
_MIXED_TYPES = {"kind": pa.int32(), "bucket": pa.int32(), "peer": pa.int64(), "seen": pa.list_(pa.int64()), "hot": pa.list_(pa.int64()), "hot_stats": pa.list_(pa.float64()), "blob": pa.binary()}
#: Kinds of rows that the stages pass on. PARTIAL: sums per document of block
#: peer. BIGRAMS: the pairs of context bucket peer with words of bucket.
#: UNSEEN: words of bucket without a seen bigram, from context bucket peer; in
#: answers, logarithms summed per document of block peer. CONTEXTS: a context
#: bucket's totals and its unseen tokens. MASS: seen unigram mass of contexts
#: of bucket. COUNTS: numbers of bigrams by count. PENDING: of block peer the
#: seen tokens per document after spread contexts that, as far as the bucket
#: knows, have no discounted successor.
PARTIAL, BIGRAMS, UNSEEN, CONTEXTS, MASS, COUNTS, PENDING = range(1, 8)


def _unigram_parts(parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            t = Tokens(block)
            counts = np.bincount(t.word[~t.held[t.doc]], minlength=len(t.hashes))
            used = np.flatnonzero(counts)
            hashes, counts = t.hashes[used], counts[used]
            rows = [{"bucket": b, "blob": pack(deltas(hashes[s]), narrow(counts[s]))} for b, s in _pieces(hashes, parts)]
            if rows:
                yield from _table({"bucket": pa.int32(), "blob": pa.binary()}, rows).to_batches()

    return count


def _merge_unigrams(table: pa.Table) -> pa.Table:
    pairs = [unpack(b) for b in table.column("blob").to_pylist()]
    hashes = np.concatenate([undelta(g) for g, _ in pairs])
    counts = np.concatenate([n.astype(np.int64) for _, n in pairs])
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(hashes) != 0]))
    hashes, counts = hashes[first], np.add.reduceat(counts, first)
    row = {
        "bucket": table.column("bucket")[0].as_py(), "tokens": int(counts.sum()), "words": len(hashes),
        "seen": np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist(),
        "blob": pack(deltas(hashes), narrow(counts)),
    }
    return _table(_UNIGRAM_TYPES, [row])


def _often(least: int):
    """Words (hash, count) of the unigram table seen more than least times."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                gaps, counts = unpack(blob)
                chosen = counts > least
                yield pa.RecordBatch.from_arrays([pa.array(undelta(gaps)[chosen].view(np.int64)), pa.array(counts[chosen].astype(np.int64))], ["hash", "count"])

    return look


def _token_parts(parts: int, hot: np.ndarray):
    """Each block's tokens by bucket (kind 0 rows: the documents)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            t = Tokens(block)
            peer = block.column("rid")[0].as_py()
            bucket = bucket_of(t.hashes, parts)[t.context]
            spread = np.flatnonzero(np.isin(t.hashes, hot)[t.context])
            mixed = (t.hashes[t.context[spread]] ^ (t.hashes[t.word[spread]] >> np.uint64(7))) * _SPREAD
            bucket[spread] = bucket_of(mixed, parts)
            order = np.argsort(bucket.astype(np.uint16) if parts < 1 << 16 else bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            held, rows = np.packbits(t.held), []
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[part] : cuts[part + 1]]
                used, local = np.unique(np.concatenate([t.context[at], t.word[at]]), return_inverse=True)
                blob = pack(deltas(t.doc[at].astype(np.uint64)), narrow(local[: len(at)]), narrow(local[len(at) :]), deltas(t.hashes[used]), held)
                rows.append({"kind": 0, "bucket": part, "peer": peer, "blob": blob})
            yield from _table({"kind": pa.int32(), "bucket": pa.int32(), "peer": pa.int64(), "blob": pa.binary()}, rows).to_batches()

    return deal


def _per_doc(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct documents (doc is sorted) and the sums of values over each."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return [doc[first], *(np.add.reduceat(v, first) if len(first) else v for v in values)]


def _found(sorted_hashes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of asked are among sorted_hashes, and where."""
    at = np.searchsorted(sorted_hashes, asked)
    inside = at < len(sorted_hashes)
    inside[inside] = sorted_hashes[at[inside]] == asked[inside]
    return inside, at


def _count_bigrams(parts: int, hot: dict[int, int], known: dict[int, float]):
    """One bucket of contexts: counts its bigrams over training documents and
    looks every token up in them. known: unigram probabilities of the most
    frequent words."""
    hot_hash = np.array(sorted(hot), np.uint64)
    hot_count = np.array([hot[h] for h in sorted(hot)], np.int64)
    known_hash = np.array(sorted(known), np.uint64)
    known_p = np.array([known[h] for h in sorted(known)])
    start = hash64(pa.array([_START], pa.large_binary()))[0]

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        peers = table.column("peer").to_pylist()
        blobs = [unpack(b) for b in table.column("blob").to_pylist()]
        vocabulary, where = np.unique(np.concatenate([undelta(x[3]) for x in blobs]), return_inverse=True)
        where = where.astype(np.int32)
        sizes = np.cumsum([0, *(len(x[3]) for x in blobs)])
        docs = [undelta(x[0]).astype(np.int32) for x in blobs]
        contexts, words, train = [], [], []
        for k, (_, c, w, _, held) in enumerate(blobs):
            local = where[sizes[k] : sizes[k + 1]]
            contexts.append(local[c])
            words.append(local[w])
            train.append(np.unpackbits(held)[docs[k]] == 0)
        cuts = np.cumsum([0, *map(len, docs)])
        context, word, train = np.concatenate(contexts), np.concatenate(words), np.concatenate(train)
        del contexts, words, blobs, where
        pairs, pair = np.unique(context.astype(np.int64) * len(vocabulary) + word, return_inverse=True)
        pair = pair.astype(np.int32)
        r = np.bincount(pair[train], minlength=len(pairs))
        pair_context, pair_word = pairs // len(vocabulary), pairs % len(vocabulary)
        seen = r > 0
        # per context: occurrences, successors by count, and the mass of the undiscounted
        total = np.bincount(context[train], minlength=len(vocabulary))
        is_hot, at = _found(hot_hash, vocabulary)
        total[is_hot] = hot_count[at[is_hot]]
        is_known, at = _found(known_hash, vocabulary)
        p_word = np.zeros(len(vocabulary))
        p_word[is_known] = known_p[at[is_known]]
        by_count = np.zeros((K, len(vocabulary)))
        for n in range(K):
            by_count[n] = np.bincount(pair_context[r == n + 1], minlength=len(vocabulary))
        rest = np.bincount(pair_context, weights=np.where(r > K, r, 0), minlength=len(vocabulary))
        lone = by_count.sum(axis=0) == 0  # without discounted successors; of a spread context only here
        over = total + (lone & ~is_hot)

        rows = [{"kind": COUNTS, "bucket": bucket, "seen": np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].tolist()}]
        got = seen[pair]
        here = ~got & is_known[word]
        share = np.where(got, np.log10(np.maximum(r[pair], 1)) - np.log10(np.maximum(over[context], 1)), 0.0)
        share[here] = np.log10(p_word[word[here]])
        is_word = vocabulary[context] != start
        known = is_word & (total[context] > 0)
        pending = got & (is_hot & lone)[context]
        plain = np.where(is_word, np.log10(total[context] + 0.1), 0.0)
        for k, peer in enumerate(peers):
            s = slice(cuts[k], cuts[k + 1])
            sums = _per_doc(docs[k], share[s], plain[s], known[s].astype(np.int64), *((r[pair[s]] == n + 1).astype(np.int64) for n in range(K)))
            rows.append({"kind": PARTIAL, "bucket": bucket, "peer": peer, "blob": pack(deltas(sums[0].astype(np.uint64)), *sums[1:3], *map(narrow, sums[3:]))})
            if pending[s].any():
                at = cuts[k] + np.flatnonzero(pending[s])
                both, n = np.unique(np.stack([docs[k][at - cuts[k]].astype(np.int64), context[at].astype(np.int64)]), axis=1, return_counts=True)
                rows.append({"kind": PENDING, "bucket": bucket, "peer": peer, "blob": pack(deltas(both[0].astype(np.uint64)), vocabulary[both[1]], narrow(n))})

        del share, plain, known, pending
        missed = np.flatnonzero(~got)
        at_block = np.searchsorted(cuts, missed, side="right") - 1
        doc = np.concatenate(docs)[missed]
        order = np.argsort(word[missed], kind="stable")  # vocabulary is sorted by hash
        order = order[~is_known[word[missed[order]]]]
        hashes, of_block, of_doc = vocabulary[word[missed[order]]], narrow(at_block[order]), narrow(doc[order])
        for part, s in _pieces(hashes, parts):
            blob = pack(deltas(hashes[s]), of_block[s], of_doc[s], np.array(peers, np.int64))
            rows.append({"kind": UNSEEN, "bucket": part, "peer": bucket, "blob": blob})

        # contexts of this bucket by number: those that are spread, then the others
        mine = np.flatnonzero(np.bincount(context, minlength=len(vocabulary)) > 0)
        mine = np.concatenate([mine[is_hot[mine]], mine[~is_hot[mine]]])
        n_hot = int(is_hot[mine].sum())
        number = np.zeros(len(vocabulary), np.int64)
        number[mine] = np.arange(len(mine))
        mass = np.bincount(pair_context[seen], weights=p_word[pair_word[seen]], minlength=len(vocabulary))
        state = [vocabulary[mine], total[mine], over[mine], rest[mine], mass[mine], *(narrow(by_count[n][mine].astype(np.int64)) for n in range(K))]
        rows.append({
            "kind": CONTEXTS, "bucket": bucket, "hot": vocabulary[mine[:n_hot]].view(np.int64).tolist(),
            "hot_stats": np.concatenate([total[None, mine[:n_hot]], mass[None, mine[:n_hot]], by_count[:, mine[:n_hot]]]).T.ravel().tolist(),
            "blob": pack(*state, np.array(peers, np.int64), narrow(at_block), narrow(doc), narrow(number[context[missed]])),
        })
        chosen = np.flatnonzero(seen & ~is_known[pair_word])
        order = chosen[np.argsort(pair_word[chosen], kind="stable")]
        hashes = vocabulary[pair_word[order]]
        for part, s in _pieces(hashes, parts):
            distinct, times = np.unique(hashes[s], return_counts=True)
            blob = pack(deltas(distinct), narrow(times), narrow(number[pair_context[order[s]]]), narrow(r[order[s]]), vocabulary[mine[:n_hot]])
            rows.append({"kind": BIGRAMS, "bucket": part, "peer": bucket, "blob": blob})
        return _table(_MIXED_TYPES, rows)

    return count


def _word_side(p_known: np.ndarray, p_unknown: float, over: float):
    """One bucket of words: unigram mass that each context has seen here, and
    unigram probabilities of unseen tokens."""

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        gaps, counts = (np.zeros(0, np.uint8),) * 2
        if right.num_rows:
            gaps, counts = unpack(right.column("blob")[0].as_py())
        hashes = undelta(gaps)
        probability = p_known[np.minimum(counts, K + 1)] * counts / over

        def p(asked: np.ndarray) -> np.ndarray:
            at = np.searchsorted(hashes, asked)
            inside = np.minimum(at, max(len(hashes) - 1, 0))
            if not len(hashes):
                return np.full(len(asked), p_unknown)
            return np.where((at < len(hashes)) & (hashes[inside] == asked), probability[inside], p_unknown)

        rows, unseen = [], []
        for kind, peer, blob in zip(*(left.column(c).to_pylist() for c in ("kind", "peer", "blob")), strict=True):
            x = unpack(blob)
            if kind == BIGRAMS:
                mass = np.bincount(x[2], weights=np.repeat(p(undelta(x[0])), x[1]))
                n_hot = len(x[4])
                used = np.flatnonzero(mass)
                cold = used[used >= n_hot]
                warm = used[used < n_hot]
                row = {"kind": MASS, "bucket": peer, "blob": pack(deltas(cold.astype(np.uint64)), mass[cold])}
                if len(warm):
                    row |= {"hot": x[4][warm].view(np.int64).tolist(), "hot_stats": mass[warm].tolist()}
                rows.append(row)
            else:
                unseen.append((x[3][x[1]], x[2].astype(np.int64), np.log10(p(undelta(x[0])))))
        if unseen:
            block, doc, logs = (np.concatenate(c) for c in zip(*unseen, strict=True))
            order = np.lexsort((doc, block))
            block, doc, logs = block[order], doc[order], logs[order]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                sums = _per_doc(doc[a:b], logs[a:b])
                rows.append({"kind": UNSEEN, "peer": int(block[a]), "blob": pack(deltas(sums[0].astype(np.uint64)), sums[1])})
        return _table(_MIXED_TYPES, rows)

    return look


def _alpha(d: list[float], by_count: list, spare, over, mass, p_unknown: float):
    """A context's backoff weight: what the discounts leave of it (and the
    part set aside, spare) over what unigrams give its unseen words, which is
    never less than what they give the unknown one."""
    left = sum(((1 - d[n]) * (n + 1) * by_count[n] for n in range(K)), spare)
    return left / over / np.maximum(1 - mass, p_unknown)


def _context_side(d: list[float], hot_alpha: dict[int, float], p_unknown: float):
    """One bucket of contexts: backoff weights, and their logarithms summed
    over each document's unseen tokens."""

    def weigh(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for blob in left.column("blob").to_pylist():
            hashes, total, over, rest, mass, *x = unpack(blob)
            by_count, (peers, at_block, doc, number) = [c.astype(np.float64) for c in x[:K]], x[K:]
            for said in right.column("blob").to_pylist():
                gaps, part = unpack(said)
                mass[undelta(gaps)] += part
            alpha = _alpha(d, by_count, (over - total).astype(np.float64), np.maximum(over, 1), mass, p_unknown)
            alpha[(rest == 0) & (sum(by_count) == 0)] = 1.0  # never a context in training
            for k, h in enumerate(hashes.tolist()):
                if h not in hot_alpha:
                    break  # those that are spread come first
                alpha[k] = hot_alpha[h]
            logs = np.log10(alpha)
            for k in np.unique(at_block).tolist():
                mine = np.flatnonzero(at_block == k)
                of = doc[mine].astype(np.int64)
                order = np.argsort(of, kind="stable")
                sums = _per_doc(of[order], logs[number[mine]][order])
                rows.append({"kind": UNSEEN, "peer": int(peers[k]), "blob": pack(deltas(sums[0].astype(np.uint64)), sums[1])})
            rows.append({"kind": CONTEXTS, "bucket": key[0].as_py(), "blob": pack(hashes, alpha)})
        return _table(_MIXED_TYPES, rows)

    return weigh


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """Scores every row of docs with a model learned from the rows whose
    held_col is false.

    Returns doc_id, held_out, n_tokens, n_known (words and end seen in
    training), train_tokens, base_score (add-one-tenth unigrams) and score
    (the model's log10 probability of the text with its end).

    Defined results: null and empty texts are an end alone; a null held_col
    is false; repeated rows count and are scored each; without training rows
    every token has probability 1 (there is only the unknown one); an empty
    table gives an empty result; extra columns are ignored.  docs is read
    three times; unless it is a stored table, a copy is staged.
    """
    docs = stored(docs)
    return _scores(docs, id_col, text_col, held_col)


def _scores(docs: DataFrame, id_col: str, text_col: str, held_col: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    parts = shuffle_width(docs)
    unigrams = rows.mapInArrow(_unigram_parts(parts), "bucket int, blob binary").groupBy("bucket").applyInArrow(_merge_unigrams, _UNIGRAMS)
    unigrams = staged(unigrams, "katz-unigrams")
    seen = [F.coalesce(F.sum(F.col("seen")[n]), F.lit(0)) for n in range(K + 1)]
    total, vocabulary, *of_counts = unigrams.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), *seen).first()
    hot_least = max(BIG, total // (4 * parts))  # so there are 4 * parts at most
    often = unigrams.select("blob").mapInArrow(_often(min(hot_least, total // KNOWN)), "hash long, count long").collect()  # fewer than KNOWN, or 4 * parts
    often = {h & (1 << 64) - 1: n for h, n in often}
    hot = {h: n for h, n in often.items() if n > hot_least}
    end_count = rows.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]  # a training document has one end, and one start, which is no word
    if end_count > hot_least:
        hot[int(hash64(pa.array([_START], pa.large_binary()))[0])] = end_count

    d1 = discounts(of_counts)
    over = total + (0 if sum(of_counts[:K]) else 1)
    p_known = _factors(d1)
    held_back = sum((1 - d1[n]) * (n + 1) * of_counts[n] for n in range(K)) + (over - total)
    p_unknown = held_back / over
    known = {h: float(p_known[min(n, K + 1)] * n / over) for h, n in often.items()}

    hot_hashes = np.array(sorted(hot), np.uint64)
    tokens = rows.mapInArrow(_token_parts(parts, hot_hashes), "kind int, bucket int, peer long, blob binary").select("bucket", "peer", "blob")
    counted = staged(tokens.groupBy("bucket").applyInArrow(_count_bigrams(parts, hot, known), _MIXED), "katz-bigrams", partition_by=["kind"])
    of_counts2 = counted.where(F.col("kind") == COUNTS).agg(*seen).first()
    d2 = discounts(list(of_counts2))

    asked = counted.where(F.col("kind").isin(BIGRAMS, UNSEEN)).select("kind", "bucket", "peer", "blob")
    words = asked.groupBy("bucket").cogroup(unigrams.select("bucket", "blob").groupBy("bucket")).applyInArrow(_word_side(p_known, p_unknown, float(over)), _MIXED)
    words = staged(words, "katz-words", partition_by=["kind"])

    width = K + 2
    stats = counted.where((F.col("kind") == CONTEXTS) & (F.size("hot") > 0)).select(F.explode(F.transform("hot", lambda h, i: F.struct(h.alias("h"), F.slice("hot_stats", i * width + 1, width).alias("s")))).alias("x"))
    stats = stats.groupBy("x.h").agg(F.max(F.col("x.s")[0]).alias("total"), F.sum(F.col("x.s")[1]).alias("known"), *[F.sum(F.col("x.s")[n + 2]).alias(f"n{n}") for n in range(K)])
    mass = words.where(F.col("kind") == MASS).select(F.explode(F.arrays_zip("hot", "hot_stats")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_stats").alias("mass"))
    hot_alpha, lone = {}, {}
    for row in stats.join(mass, stats["h"] == mass["hot"], "left").collect():  # at most 4 * parts
        by_count = [row[f"n{n}"] for n in range(K)]
        spare, name = float(not sum(by_count)), row.h & (1 << 64) - 1
        hot_alpha[name] = float(_alpha(d2, by_count, spare, row.total + spare, row.known + (row.mass or 0.0), p_unknown))
        if spare:
            lone[name] = np.log10(row.total) - np.log10(row.total + 1)

    contexts = counted.where(F.col("kind") == CONTEXTS).select("bucket", "blob")
    masses = words.where(F.col("kind") == MASS).select("bucket", "blob")
    weighed = contexts.groupBy("bucket").cogroup(masses.groupBy("bucket")).applyInArrow(_context_side(d2, hot_alpha, p_unknown), _MIXED)
    weighed = staged(weighed, "katz-weights", partition_by=["kind"])

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            _, at = split_words(block.column("text"), LOWER)
            ids = block.column("doc_id")
            blob = pack(np.diff(at) + 1, block.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8), np.asarray(ids.is_null()).astype(np.uint8), ids.fill_null(0).to_numpy())
            yield from _table({"kind": pa.int32(), "peer": pa.int64(), "blob": pa.binary()}, [{"kind": 0, "peer": block.column("rid")[0].as_py(), "blob": blob}]).to_batches()

    logs = np.log10(np.array(d2))
    lone_hash, lone_gap = np.array(sorted(lone), np.uint64), np.array([lone[h] for h in sorted(lone)])
    log_over = np.log10(total + 0.1 * (vocabulary + 1))
    parts_of = (
        staged(rows.mapInArrow(headers, "kind int, peer long, blob binary"), "katz-documents")
        .unionByName(counted.where(F.col("kind").isin(PARTIAL, PENDING)).select("kind", "peer", "blob"))
        .unionByName(words.where(F.col("kind") == UNSEEN).select("kind", "peer", "blob"))
        .unionByName(weighed.where(F.col("kind") == UNSEEN).select("kind", "peer", "blob"))
    )

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        lengths, held, null, ids = unpack(blobs[kinds.index(0)])
        score, base, known = np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind == 0:
                continue
            gaps, *x = unpack(blob)
            doc = undelta(gaps)
            if kind == PENDING:
                here, at = _found(lone_hash, x[0])
                np.add.at(score, doc[here], x[1][here] * lone_gap[at[here]])
                continue
            score[doc] += x[0]
            if kind == PARTIAL:
                base[doc] += x[1]
                known[doc] += x[2].astype(np.int64)
                for n in range(K):
                    score[doc] += x[3 + n] * logs[n]
        base += np.log10(end_count + 0.1) - lengths * log_over
        known += end_count > 0
        n = len(lengths)
        columns = [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths, pa.int64()), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts_of.groupBy("peer").applyInArrow(add_up, _SCORES)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return katz_scores(docs.select("doc_id", "text", held.alias("held_out")))
