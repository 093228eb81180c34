from collections import Counter

import pytest

from veilgraph.llm import sharding


def naive(names, size):
    """The fill with whole preference lists."""
    prefer = []
    for n in names:
        start, step = sharding._hash("start", n) % size, sharding._hash("step", n) % (size - 1) + 1
        prefer.append([(start + j * step) % size for j in range(size)])
    table = {}
    while True:
        for k, order in enumerate(prefer):
            slot = next(s for s in order if s not in table)
            table[slot] = k
            if len(table) == size:
                return [table[s] for s in range(size)]


def test_fill():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 211)
    assert table == naive(names, 211)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_few_slots_move():
    names = [f"n{i}" for i in range(10)]
    a, b = sharding.fill_table(names, 5003), sharding.fill_table(names[:-1], 5003)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved / 5003 < 0.15


def test_bad_arguments():
    for names, size in ([], 211), (["a", "a"], 211), (["a"], 210), ([str(i) for i in range(300)], 211):
        with pytest.raises(ValueError):
            sharding.fill_table(names, size)


def test_table_frame(spark):
    table = sharding.fill_table(["a", "b", "c"], 101)
    got = {r.slot: r.shard for r in sharding.table_frame(spark, table).collect()}
    assert got == dict(enumerate(table))


def test_assignment(spark, tmp_path):
    rows = [(i, f"t{i}", 1, "x") for i in range(2000)] + [(None, f"n{i}", 1, "x") for i in range(500)] + [(None, None, 1, "x"), (5, "other", 1, "x"), (5, "t5", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SLOT int, Shard string")
    out = sharding.assign_shards(df, sharding.NAMES[:4])
    assert out.columns == ["doc_id", "text", "slot", "shard"]
    got = out.collect()
    assert len(got) == len(rows)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    nulls = Counter(r.shard for r in got if r.doc_id is None)
    assert len(nulls) == 4 and max(nulls.values()) < 250
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "ExistingRDD[slot" not in plan
    assert sharding.assign_shards(df.where("1 = 0"), ["a"]).collect() == []
    sharding.write_shards(out, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
