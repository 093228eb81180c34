import numpy as np

from veilgraph.llm import simhash

from . import plain

SCHEMA = "doc_id long, text string, fp string"


def test_fingerprints(spark):
    texts = ["", None, "One", "one two", "A b c", "a b c a b c a b c", "éa ñ\x0bx \x1c y", "w " * 5000, "a  b\n\tc d"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain.fingerprint(t) for i, t in enumerate(texts)}


def links_of(spark, values, radius):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    return simhash.near_links(df, radius).collect()


def test_links_join_what_they_should(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIPE", 16)
    monkeypatch.setattr(simhash, "LINKS", 20)
    rng = np.random.default_rng(3)
    values = set(rng.integers(0, 1 << 63, 300).tolist()) | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for v in list(values)[:40]:
        for _ in range(6):
            v ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            values.add(v)
    for radius in (0, 2, 3):
        root = plain.components(values, radius)
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for r in links_of(spark, values, radius):
            a, b = (x & (1 << 64) - 1 for x in r)
            assert 0 < (a ^ b).bit_count() <= radius
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == root


def test_dense_groups_stay_small():
    base = np.uint64(0x0F0F0F0F0F0F0F0F)
    ball = np.array([base ^ np.uint64((1 << i) | (1 << j)) for i in range(64) for j in range(i)], np.uint64)
    a, b = simhash.tile_links(ball, ball, True, 2)
    assert len(a) == len(ball) - 1


def test_keep_one_knows_rows_by_number(spark, monkeypatch):
    """Rows of one id, or equal throughout, and columns of any name."""
    rows = [(1, "one two three four", 0, 5), (1, "one two three four", 0, 5), (1, "other words in this", 0, 5), (None, None, 0, 5), (None, "", 0, 5), (2, "ONE two three four", 0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _number long, `kept.x` long").repartition(2)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(1, "one two three four"), (1, "other words in this"), (None, "")], key=str)
    assert simhash.keep_one(df.where("1 = 0")).collect() == []


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", "q")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_near_duplicates(spark):
    long = " ".join(f"w{k}" for k in range(400))
    texts = [long, long + " more", "unlike " * 3, None, "", "x y z", "X Y Z", long, None]
    rows = [(i * 3 - 5, t, "c") for i, t in enumerate(texts)] + [(None, long, "c"), (-5, long, "c"), (None, "only here alone now", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain.fingerprint(t) for _, t, _ in rows]
    root = plain.components(fps, 2)
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert got == sorted(((i, f, least.get(root[f])) for (i, _, _), f in zip(rows, fps, strict=True)), key=str)
    assert simhash.near_duplicates(df.where("1 = 0")).collect() == []
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(root.values())) and kept[0].__fields__ == ["doc_id", "text", "fp"]


def test_query_against_plain(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = {r.doc_id: plain.fingerprint(r.text) for r in docs}
    root = plain.components(fps.values(), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}
