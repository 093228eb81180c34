"""The Katz model against a plain computation, token by token."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veilgraph.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
START, END = " ", "\n"


class Plain:
    def __init__(self, texts):
        self.one, self.two, self.after = Counter(), Counter(), defaultdict(set)
        for text in texts:
            before = START
            for w in [*WORD.findall((text or "").translate(LOWER)), END]:
                self.one[w] += 1
                self.two[before, w] += 1
                self.after[before].add(w)
                before = w
        self.c = Counter()
        for (h, _), n in self.two.items():
            self.c[h] += n
        self.total = sum(self.one.values())
        of = lambda counter: [sum(n == r for n in counter.values()) for r in range(1, katz.K + 2)]
        self.d1 = [0, *katz.discounts(of(self.one))]
        self.d2 = [0, *katz.discounts(of(self.two))]
        self.over = self.total + (not any(n <= katz.K for n in self.one.values()))
        self.unknown = 1 - sum(self.p1(w) for w in self.one)

    def p1(self, w):
        n = self.one[w]
        return self.unknown if not n else (self.d1[n] if n <= katz.K else 1) * n / self.over

    def share(self, h, w):
        n, c = self.two[h, w], self.c[h]
        low = any(self.two[h, x] <= katz.K for x in self.after[h])
        return (self.d2[n] if n <= katz.K else 1) * n / (c + (not low))

    def p(self, h, w):
        if self.two[h, w]:
            return self.share(h, w)
        if not self.c[h]:
            return self.p1(w)
        left = 1 - sum(self.share(h, x) for x in self.after[h])
        return left / (1 - sum(self.p1(x) for x in self.after[h])) * self.p1(w)

    def score(self, text):
        out, before = 0.0, START
        for w in [*WORD.findall((text or "").translate(LOWER)), END]:
            out += math.log10(self.p(before, w))
            before = w
        return out


def rows_of(docs):
    return [(i, t, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in docs]


def compare(spark, docs):
    rows = rows_of(docs)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3, "doc_id")
    from veilgraph.plans.staging import staged

    got = sorted(map(tuple, katz.katz_scores(staged(df)).collect()), key=str)
    model = Plain([t for _, t, held in rows if not held])
    want = []
    vocabulary = len(model.one)
    for i, t, held in rows:
        tokens = [*WORD.findall((t or "").translate(LOWER)), END]
        base = sum(math.log10((model.one[w] + 0.1) / (model.total + 0.1 * (vocabulary + 1))) for w in tokens)
        want.append((i, held, len(tokens), sum(model.one[w] > 0 for w in tokens), model.total, base, model.score(t)))
    want.sort(key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def corpus():
    words = "the a cat dog ran sat on mat Big red fox éa ñu".split()
    docs, state = [], 1
    for i in range(300):
        picked = []
        for _ in range(1 + i % 17):
            state = (state * 1103515245 + 12345) % (1 << 31)
            picked.append(words[min((state >> 8) % 40, (state >> 16) % 13) % 13] + ("" if state % 5 else str(state % 97)))
        docs.append((i, " ".join(picked)))
    return docs


def test_against_plain(spark):
    docs = corpus() + [(None, "the cat"), (1000, None), (1001, ""), (1002, " \t"), (5, "the cat sat"), (5, "the cat sat"), (1003, "the " * 3000)]
    model = compare(spark, docs)
    for h in [START, "the", "cat", "zebra"]:
        known = sum(model.p(h, w) for w in model.one)
        unknown = model.p(h, "never seen")
        assert known + unknown == pytest.approx(1, abs=1e-9)


def test_spread_contexts(spark, monkeypatch):
    monkeypatch.setattr(katz, "BIG", 3)
    compare(spark, corpus())


def test_spread_start(spark, monkeypatch):
    """The start marker, a context of every document, is spread as frequent
    words are."""
    monkeypatch.setattr(katz, "BIG", 3)
    real, hot = katz._count_bigrams, {}
    monkeypatch.setattr(katz, "_count_bigrams", lambda parts, found, known: (hot.update(found), real(parts, found, known))[1])
    docs = [(i, f"w{i % 50} tail" if i % 3 else None) for i in range(600)]
    model = compare(spark, docs)
    start = int(katz.hash64(katz.pa.array([katz._START], katz.pa.large_binary()))[0])
    assert hot[start] == model.one[END]


@pytest.mark.parametrize("known", [1, 1 << 14])
def test_same_estimator_at_every_count(spark, monkeypatch, known):
    """Contexts with one frequent successor only, or none that is discounted,
    and a context followed by every word, spread or not; frequent words known
    everywhere or asked for."""
    monkeypatch.setattr(katz, "KNOWN", known)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, "only ever this " * 12 + " ".join(f"any {w}" for w in words) + (" odd end" if i % 9 == 0 else "")) for i in range(40)]
    docs += [(1000 + i, f"only {w} any new{i} ever {w}") for i, w in enumerate(words)]
    scores = []
    for big in (3, 10_000):
        monkeypatch.setattr(katz, "BIG", big)
        compare(spark, docs)
        df = spark.createDataFrame(rows_of(docs), "doc_id long, text string, held_out boolean")
        scores.append({r.doc_id: r.score for r in katz.katz_scores(df).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_clashing_columns_and_long_text(spark):
    rows = [(1, "a b " * 60_000, False, 1, 2, "x"), (2, "b a c", True, 1, 2, "x"), (3, None, None, 1, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, rid long, bucket int, score string")
    got = {r.doc_id: r for r in katz.katz_scores(df).collect()}
    assert {k: (r.n_tokens, r.held_out) for k, r in got.items()} == {1: (120_001, False), 2: (4, True), 3: (1, False)}
    model = Plain(["a b " * 60_000, None])
    assert got[1].score == pytest.approx(model.score("a b " * 60_000), rel=1e-9) and got[2].score == pytest.approx(model.score("b a c"), rel=1e-9)


def test_few(spark):
    compare(spark, [(1, "a a a a")])
    compare(spark, [(None, None)])
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert katz.katz_scores(empty).collect() == []


def test_discounts():
    assert katz.discounts([0] * 6) == pytest.approx([(r - 0.5) / r for r in range(1, 6)])
    assert all(0 < d < 1 for d in katz.discounts([100, 50, 30, 20, 15, 11]))
