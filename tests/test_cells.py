"""Steps dealt out by communities, against the form in which rows travel."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgraph.operators import graph as G
from veilgraph.operators import mechanisms, metrics, synthesis


def rows(df):
    return sorted(map(tuple, df.collect()))


def release(spark, size=24, coms=5, dense=1):
    """Communities of which one is dense, so that targets collide."""
    vertices = [(v % coms, v * 2, 1 + v * 7 % 9) for v in range(size * coms)]
    counts = [(a, b, dense * (30 + 17 * a + 40 * b)) for a in range(coms) for b in range(a + 1, coms)]
    return synthesis.Release(spark.createDataFrame(vertices, "com long, vid long, target long"), spark.createDataFrame(counts, "ci long, cj long, ev long"))


@pytest.mark.parametrize(("sizes", "bin_size", "cell_draws", "few"), [((24, 5, 1), 1 << 14, 1 << 23, 1 << 9), ((90, 3, 30), 30, 1 << 23, 20), ((24, 5, 1), 1, 250, 0)])
def test_new_edges_of_cells_are_those_of_tables(spark, monkeypatch, sizes, bin_size, cell_draws, few):
    """Many targets in a bin; more draws than one block; cells left to tables."""
    r = release(spark, *sizes)
    n = F.floor(F.col("ev") * 0.7)
    targets = synthesis._targets(r.edge_counts, n, F.col("ev") - n)
    draws = F.when(F.col("part") < 2, synthesis._intra_draws()).otherwise(synthesis._inter_draws())
    base = synthesis.staged(synthesis.chung_lu(r.degrees, 3))
    weight = F.greatest("target", F.lit(1))
    table = synthesis.staged(synthesis.slots(r.degrees, weight))
    want = rows(synthesis.accept_new(synthesis._samples(targets, r.degrees, table, draws, 3, "free"), base))
    for name, value in (("BIN", bin_size), ("CELL_DRAWS", cell_draws), ("FEW_DRAWS", few)):
        monkeypatch.setattr(synthesis, name, value)
    assert rows(synthesis._new_edges(targets, r.degrees, weight, draws, base, 3, "free")) == want


def test_samples_of_cells_do_not_travel(spark, monkeypatch):
    """No table of samples is made by the methods that take new edges only."""
    monkeypatch.setattr(synthesis, "_samples", lambda *a: pytest.fail("samples in a table"))
    r = release(spark, size=8, coms=3)
    for method in (synthesis.v2, synthesis.v3, synthesis.v3_convert, synthesis.v4):
        assert method(r, 3, repair=None).count() > 0


@pytest.mark.parametrize(("sizes", "bin_size", "cell_draws", "few"), [((24, 5, 1), 1 << 14, 1 << 23, 1 << 9), ((90, 3, 30), 30, 1 << 23, 20), ((24, 5, 1), 1, 150, 0)])
def test_uniform_pairs_are_drawn_in_cells(spark, monkeypatch, sizes, bin_size, cell_draws, few):
    """The same pairs as by tables; no row for a draw, whose number nothing
    knows beforehand, comes to a join that may gather it."""
    r = release(spark, *sizes)
    want = rows(synthesis._wide_uniform(r.edge_counts.withColumnRenamed("ev", "want"), r.degrees, 3))
    for name, value in (("BIN", bin_size), ("CELL_DRAWS", cell_draws), ("FEW_DRAWS", few)):
        monkeypatch.setattr(synthesis, name, value)
    if cell_draws > 1000:
        monkeypatch.setattr(synthesis, "pick", lambda *a: pytest.fail("draws in a table"))
    assert rows(synthesis.inter_uniform(r, 3)) == want
    both = rows(synthesis.original(r, 3))
    assert both == sorted({*rows(synthesis.chung_lu(r.degrees, 3)), *want}) and len(set(both)) == len(both)


def test_sequential_repair_fills_communities_apart(spark):
    """A task has the vertices of one community only, and what it draws doesn't
    depend on which others there are."""
    degrees = spark.createDataFrame([(v % 4, v, 3 + v % 5) for v in range(80)], "com long, vid long, target long")
    edges = spark.createDataFrame([(v, v + 1) for v in range(79)], "src long, dst long")
    wanted = synthesis._repair_targets(degrees, 0.3)
    all_made = rows(synthesis._fill_in_order(edges, wanted, 3))
    assert {a % 4 for a, _ in all_made} == {0, 1, 2, 3} and all(a < b and a % 4 == b % 4 for a, b in all_made)
    alone = rows(synthesis._fill_in_order(edges, wanted.where("com = 2"), 3))
    assert alone == [(a, b) for a, b in all_made if a % 4 == 2]


@pytest.mark.parametrize("arcs", [1 << 22, 60, 1])
def test_common_neighbours_in_blocks(spark, monkeypatch, arcs):
    """No exchange of wedges or counts: what the last tasks return is the result."""
    pairs = [(a * 3, b * 3) for a in range(40) for b in range(a + 1, 40) if (a * 7 + b * 5) % 6 == 0 or a == 4]
    graph = G.Graph(spark.range(0, 120, 3).withColumnRenamed("id", "vid"), spark.createDataFrame(pairs, "src long, dst long"))
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(0, 120, 3)}
    want = [(u, v, len(near[u] & near[v])) for u in near for v in near if u < v and near[u] & near[v]]
    monkeypatch.setattr(metrics, "BLOCK_ARCS", arcs)
    monkeypatch.setattr(metrics, "PAIRS", 100)
    got = metrics.common_neighbours(graph)
    assert rows(got) == sorted(want) and dict(got.dtypes) == dict.fromkeys("uvn", "bigint")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert metrics.common_neighbours(G.Graph(graph.vertices, graph.edges.limit(0))).count() == 0


@pytest.mark.parametrize("spread", [1, 1 << 40])
def test_counting_holds_few_words_of_an_arc(spread):
    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(2000, 100, replace=False)) * spread for _ in range(2000)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    a = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(lists)))
    flat = np.zeros((2000, 2000), np.int64)
    for x in lists:
        flat[np.ix_(x // spread, x // spread)] += 1
    tracemalloc.start()
    found = sum(int((n == flat[u // spread, v // spread]).sum()) for u, v, n in metrics._shared(0, 1, a, a))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == np.count_nonzero(flat) and most < (50 if spread == 1 else 80) * cuts[-1], most / cuts[-1]


def test_non_neighbours_leave_edges_between_communities_where_they_are(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(synthesis, "block_pairs", lambda df, *c, f=synthesis.block_pairs: (sent.append(df), f(df, *c))[1])
    vertices = spark.createDataFrame([(v % 3, v) for v in range(30)], "com long, vid long")
    pairs = [(u, v) for u in range(30) for v in range(u + 1, 30)]
    edges = [p for p in pairs if sum(p) % 4]
    made = metrics.non_neighbours(G.Graph(vertices.select("vid"), spark.createDataFrame(edges, "src long, dst long")), vertices)
    assert rows(made) == sorted((u % 3, u, v) for u, v in set(pairs) - set(edges) if u % 3 == v % 3)
    assert all((r.vid - x) % 3 == 0 for r in sent[0].collect() for x in r.near)


def test_a_batch_needs_the_arcs_of_its_own_vertices_only(spark):
    edges = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40) if (a * 7 + b * 5) % 6 == 0], "src long, dst long")
    graph = G.Graph(spark.range(40).withColumnRenamed("id", "vid"), edges)
    partition = graph.vertices.select("vid", (F.col("vid") % 5).alias("com"))
    turn = mechanisms._dealt(3, F.col("src"), 4)
    for batch in (0, 3):
        own = G.both_ways(edges).where(turn == batch)
        want = rows(mechanisms.em_batch(graph, partition, 2.0, 3, batch=batch, batches=4))
        moved = mechanisms.em_batch(graph, partition, 2.0, 3, batch=batch, batches=4, arcs=own)
        assert rows(moved) == want and any(v % 5 != c for v, c in want)
    by_batches = partition
    for batch in range(4):
        by_batches = mechanisms.staged(mechanisms.em_batch(graph, G.renumbered(by_batches), 2.0, 3, batch=batch, batches=4))
    assert rows(mechanisms.adjust_communities(graph, partition, 2.0, 3)) == rows(G.renumbered(by_batches))
