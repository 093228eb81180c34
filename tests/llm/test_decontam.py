import numpy as np
import pytest

from veilgraph.llm import decontam

from . import plain

ITEM = "The quick-brown fox42 jumps over the lazy dog while Élan waits by the old mill stream at dawn"


def docs():
    tail = " ".join(f"z{k}" for k in range(100))
    return [
        (1, f"intro {ITEM} outro"), (2, ITEM.upper().replace("É", "É").replace("-", " , ")), (3, " ".join(ITEM.split()[:13])), (4, " ".join(ITEM.split()[:12])), (5, f"{ITEM} {tail * 1} {tail} {tail} {tail}"),
        (6, None), (7, ""), (8, "..."), (None, ITEM), (1, f"intro {ITEM} outro"), (9, "tiny item here"), (10, "tiny item"), (11, f"{ITEM} {ITEM}"), (12, "the " * 5000), (13, ITEM.split()[-1] + " " + ITEM),
    ]


ITEMS = [(100, ITEM), (101, "tiny item here"), (102, None), (103, ""), (None, ITEM + " again"), (104, "the the the"), (100, "tiny item here"), (20, "nothing of this is there at all in any of them, is it, no never ever")]


def frames(spark, d, i):
    return spark.createDataFrame([(*r, "x") for r in d], "doc_id long, text string, n_words string").repartition(3), spark.createDataFrame([(*r, "x") for r in i], "item_id long, text string, rid string")


@pytest.fixture(params=[1 << 20, 1], ids=["small", "table"])
def limit(request, monkeypatch):
    """A benchmark that is sent to all shards, and one that stays a table."""
    monkeypatch.setattr(decontam, "QUERY_BYTES", request.param)


def test_against_plain(spark, limit):
    d, i = frames(spark, docs(), ITEMS)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontam.contamination(d, i).collect()), key=str)
    found = plain.contamination([t for _, t in docs()], ITEMS)
    assert got == sorted(((k, n, hit, ids, hit > 0 and 20 * hit >= n) for (k, _), (n, hit, ids) in zip(docs(), found, strict=True)), key=str)


def test_empty(spark, limit):
    d, i = frames(spark, docs(), ITEMS)
    assert decontam.contamination(d.where("1 = 0"), i).collect() == []
    clean = decontam.contamination(d, i.where("1 = 0")).collect()
    assert len(clean) == len(docs()) and not any(r.n_hit or r.contaminated for r in clean)


def test_proximity(spark):
    d, i = frames(spark, [(1, "alpha x beta y gamma"), (2, "gamma beta q alpha"), (3, "alpha beta"), (4, "alpha x x x x x x x beta gamma"), (5, None)], [(1, "alpha beta gamma"), (2, "missing word")])
    index = decontam.build_index(d)
    got = sorted((r.doc_id, r.item_id, r["first"], r.stop) for r in decontam.proximity_matches(index, i, 2).collect())
    assert got == [(1, "1", 0, 5), (2, "1", 0, 4)]
    assert decontam.proximity_matches(index, i.where("1 = 0"), 2).collect() == []


def test_proximity_of_long_items(spark, limit):
    """Items and slop wider than the gap between documents, which spans must
    not cross."""
    words = [f"w{k}" for k in range(5000)]
    text = " ".join(words)
    far = "alpha " + "x " * 4500 + "omega"
    d, i = frames(spark, [(1, " ".join(words[:2500])), (2, " ".join(words[2500:])), (3, f"intro {text} outro"), (4, far), (5, "alpha"), (6, "omega")], [(1, text), (2, "omega alpha")])
    index = decontam.build_index(d.coalesce(1))
    found = lambda slop: sorted((r.doc_id, r.item_id, r["first"], r.stop) for r in decontam.proximity_matches(index, i, slop).collect())
    assert found(0) == [(3, "1", 1, 5001)]
    assert found(4499) == [(3, "1", 1, 5001)]
    assert found(10000) == [(3, "1", 1, 5001), (4, "2", 0, 4502)]


def test_spans_are_the_smallest():
    dice = np.random.default_rng(2)
    for _ in range(100):
        lengths = dice.integers(0, 15, 4)
        starts = np.cumsum(lengths) - lengths + np.arange(4) * 3
        at = np.concatenate([s + np.arange(n) for s, n in zip(starts, lengths, strict=True)])
        said = dice.integers(0, 4, len(at))
        lists = [at[said == t] for t in range(3)]
        width = int(dice.integers(1, 12))

        class Fake:
            sizes = np.array([len(p) for p in lists])  # noqa: B023
            shard = decontam.Shard(None, [], lengths, starts, None, None, None, None)  # noqa: B023
            __getitem__ = lambda self, t: lists[t]  # noqa: B023, E731

        spans = {(int(a), int(b)) for a in at for b in at if a <= b < a + width and len({int(np.searchsorted(starts, x, "right")) for x in (a, b)}) == 1 and {0, 1, 2} <= set(said[(at >= a) & (at <= b)].tolist())}
        want = sorted(x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans))
        assert list(map(tuple, decontam.spans(Fake(), np.arange(3), width).tolist())) == want


def test_phrases(spark, limit):
    d, i = frames(spark, [(1, "a b c d e x a b c"), (2, "c d"), (3, None), (4, "e " * 6)], [(1, "a b c d e"), (None, "c d"), (2, ""), (3, "e e")])
    index = decontam.build_index(d.coalesce(1))
    rids = dict(index.selectExpr("explode(arrays_zip(ids, rids)) AS x").selectExpr("x.rids", "x.ids").collect())
    words = {1: "abcdexabc", 2: "cd", 4: "eeeeee"}
    covered = {}
    for r in decontam.phrase_matches(index, i, 3).collect():
        covered.setdefault((rids[r.rid], r.item_id), set()).update(range(r["first"], r.stop))
    want = {(1, "1"): {0, 1, 2, 3, 4, 6, 7, 8}, (1, "null"): {2, 3}, (2, "null"): {0, 1}, (4, "3"): set(range(6))}
    assert covered == want and all(max(v) < len(words[k]) for (k, _), v in covered.items())


def test_long_windows_do_not_bridge_documents(spark):
    words = [f"w{k}" for k in range(1300)]
    d, i = frames(spark, [(1, " ".join(words[:650])), (2, " ".join(words[650:])), (3, " ".join(words))], [(1, " ".join(words))])
    got = {r.doc_id: r.n_hit for r in decontam.contamination(d.coalesce(1), i, width=700).collect()}
    assert got == {1: 0, 2: 0, 3: 1300}


def test_clean(spark):
    rows = [(1, ITEM, 1), (1, ITEM, 1), (1, "fine words only", 1), (None, None, 1), (None, ITEM, 1), (2, "tiny item", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _number long").repartition(2)
    _, i = frames(spark, [], ITEMS)
    got = decontam.clean(df, i)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[2], rows[3], rows[5]], key=str)


def test_one_scan_of_the_index(spark, limit):
    """Whatever the benchmark's size, postings are read once."""
    d, i = frames(spark, docs(), ITEMS)
    index = decontam.build_index(d)
    plan = decontam.hits(index, decontam._items(i, "item_id", "text"), 13)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("postings") <= 4
    assert decontam.phrase_matches(index, i, 13)._jdf.queryExecution().executedPlan().toString().count("postings:binary") <= 1
