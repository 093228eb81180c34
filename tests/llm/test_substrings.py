import hashlib

import pytest

from veilgraph.llm import substrings
from veilgraph.plans.staging import staged

from . import plain


def removed(rows, width):
    """Kept words of each row."""
    first = {}
    for doc_id, text in rows:
        ws = plain.words(text)
        for o in range(len(ws) - width + 1):
            key = tuple(ws[o : o + width])
            first[key] = min(first.get(key, float("inf")), float("inf") if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        ws, gone = plain.words(text), set()
        for o in range(len(ws) - width + 1):
            if first[tuple(ws[o : o + width])] < (float("inf") if doc_id is None else doc_id):
                gone.update(range(o, o + width))
        out.append((doc_id, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3, "doc_id")
    return sorted(map(tuple, substrings.remove_repeats(staged(df), **options).collect()), key=str)


def corpus():
    words = lambda seed, n: " ".join(str(seed * 7919 % 1009 + k * k % 37 + k) for k in range(n))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{words(i, 30 + i)} {passage if i % 3 == 0 else ''} {words(i + 5000, 20)}") for i in range(60)]
    rows += [(i + 100, rows[i][1]) for i in range(10)] + [(3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (300, None), (301, ""), (302, " \n"), (303, "one")]
    rows += [(304, "again " * 200), (305, "again " * 55), (-5, passage + " tail"), (306, " ".join(f"L{k % 5000}" for k in range(30_000))), (307, " ".join(f"L{k}" for k in range(4000, 4100)))]
    return rows


@pytest.mark.parametrize("width", [50, 5])
def test_against_plain(spark, width):
    assert run(spark, corpus(), width=width) == removed(corpus(), width)


def test_digest(spark):
    rows = corpus()[:30]
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in removed(rows, 50)]
    assert run(spark, rows, output="digest") == sorted(want, key=str)


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_ROWS", 4)
    monkeypatch.setattr(substrings, "LONG", 300)
    assert run(spark, corpus(), width=20) == removed(corpus(), 20)


def test_empty_and_bad(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, output="no")
