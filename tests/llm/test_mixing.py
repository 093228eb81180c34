import duckdb
import pytest
from pyspark.sql import functions as F

from veilgraph.llm import mixing

from . import plain

SCHEMA = "doc_id long, text string, source string, size string"


def docs(spark, n=400):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 60)), None if i % 9 == 0 else f"s{i % 3 if i % 2 else 3}", "clash") for i in range(n)]
    rows += [(None, None, "s1", "x"), (None, "", "s1", "x"), (7, "a b c", "empty?", "x"), (7, "a b c", "empty?", "x"), (8, " \t", "hollow", "x")]
    return spark.createDataFrame(rows, SCHEMA)


def filled(sizes, weights, total, cap):
    """Clamp, share what is over, again, until none is."""
    clamped, level = set(), 0.0
    while True:
        open_ = {s: w for s, w in weights.items() if s not in clamped}
        level = (total - sum(cap * sizes[s] for s in clamped)) / sum(open_.values()) if open_ else 0
        over = {s for s, w in open_.items() if w * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else w * level for s, w in weights.items()}
        clamped |= over


def test_targets_and_counts(spark):
    df = docs(spark)
    got = mixing.mix_sources(df, [5.0, 2.0, 1.0]).collect()
    assert len(got) == df.count()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(plain.words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.repeats * r.size and r.repeats <= 2
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_and_layout_agree(spark):
    df = docs(spark)
    key = lambda d: sorted(((r.doc_id, r.text, r.repeats) for r in mixing.mix_sources(d, [5.0, 2.0, 1.0]).collect()), key=str)
    assert key(df) == key(df.repartition(7, "text"))


def test_given_weights_and_materialize(spark):
    df = docs(spark)
    weights = spark.createDataFrame([("s1", 1.0), (None, 1.0)], "source string, weight double")
    mixed = mixing.mix_sources(df, weights, total_ratio=0.2)
    rows = mixed.collect()
    assert all(r.repeats == 0 for r in rows if r.source not in ("s1", None) and r.size)
    copies = mixing.materialize(mixed)
    assert copies.columns == ["doc_id", "text", "source"]
    assert copies.count() == sum(r.repeats for r in rows)


def test_all_clamped_and_empty(spark):
    df = docs(spark)
    rows = mixing.mix_sources(df, [1.0], total_ratio=5.0).collect()
    assert all(r.repeats == 2 for r in rows if r.size)
    assert mixing.mix_sources(df.where("1 = 0"), [1.0]).collect() == []


@pytest.mark.parametrize("texts", [["a b c d e f g h i j"] * 2, ["a b c d e f g h i j"] * 40, ["a b"] * 30 + ["", " ", None] * 30])
def test_fraction_on_a_boundary(spark, tmp_path, texts):
    """Documents of one length, half of which make up the fraction."""
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op1_mix(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(found)
    assert sum(r.taken for r in got.collect()) == 1.5 * sum(len(plain.words(t)) for t in texts)


@pytest.mark.parametrize("copies", [100, 7])
def test_repeated_rows_are_taken_one_by_one(spark, tmp_path, copies):
    """Rows that share id and text fill a target to within half a row."""
    rows = [(1, "a b c d", "hot")] * copies + [(None, "x y z", "hot")] * copies + [(k, "q " * (k % 5), "cold") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op1_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.execute(f"SELECT doc_id, size, source_size, target, taken, repeats FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(found, key=str)


def test_clashing_columns_and_listed_weights(spark):
    rows = [(k, "w " * (k % 7), f"s{k % 2}", k, k, k, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long, _BY long, taken long, `odd.name` long")
    weights = spark.createDataFrame([("s0", 1.0), ("s0", 2.0), ("s1", 3.0), ("s1", None), ("s1", -4.0)], "source string, weight double")
    got = mixing.mix_sources(df, weights)
    assert got.columns == ["doc_id", "text", "source", "_key", "_BY", "odd.name", *mixing.OUTPUT]
    found = got.collect()
    assert len(found) == 60 and all(r._key == r.doc_id for r in found)
    assert len({r.target for r in found}) == 1
    copies = mixing.materialize(got.withColumn("_copy", F.lit(5)))
    assert copies.count() == sum(r.repeats for r in found) and "_copy" in copies.columns


def test_very_long_text(spark):
    rows = [(1, "w " * 400_000, "s"), (2, "x " * 100_000, "s"), (3, None, "s")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0]).collect()
    assert {r.doc_id: r.size for r in got} == {1: 400_000, 2: 100_000, 3: 0}
    assert abs(sum(r.taken for r in got) - 750_000) <= 200_000
