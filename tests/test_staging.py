"""Staged tables: where they go and how they are removed."""

import os
import threading

import pytest

from veilgraph.plans import staging


def test_scope_and_drop(spark):
    kept = staging.staged(spark.range(3), "kept")
    with staging.staging_scope() as paths:
        a = staging.staged(spark.range(5), "a")
        with staging.staging_scope() as inner:
            staging.staged(spark.range(7), "b")
    assert len(paths) == 2 and len(inner) == 1 and a.count() == 5
    staging.drop_staged(spark, paths)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    assert kept.count() == 3
    staging.drop(kept)
    assert not os.path.exists(kept._staged_at.removeprefix("file:"))
    staging.drop(spark.range(1))


def test_the_session_keeps_its_setting(spark):
    before = spark.conf.get(staging._CLEAN, "false")
    threads = [threading.Thread(target=staging.staged, args=(spark.range(1000).repartition(3), "t")) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(staging._CLEAN) == before


def test_stored(spark):
    table = staging.staged(spark.range(100).selectExpr("id", "id % 7 AS k", "'x' AS `+ odd`"), "table")
    plain = table.where("k > 2").select("id", "+ odd")
    assert staging.stored(plain) is plain and staging.stored(table) is table
    for moved in (plain.repartition(3), table.distinct(), table.join(plain.select("id"), "id"), spark.range(3), table.limit(3), plain.union(plain)):
        assert staging.stored(moved) is not moved


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://head:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)
