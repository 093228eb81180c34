"""Steps that work on blocks of keys or vertices, against their plain form."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.functions.keyed import CHUNK, Keys
from veilgraph.functions.noise import uniform
from veilgraph.functions.scalars import activation
from veilgraph.operators import graph as G
from veilgraph.operators import influence, metrics, synthesis


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("columns", "prefix"),
    [([[0, 5, -3, 12345, 99, 10**17]], "7|x"), ([range(CHUNK + 5), range(9, CHUNK + 14)], "7|cascade|12"), ([[3, 44]], "7|" + "y" * 60), ([[]], "7")],
)
def test_bits_are_those_of_md5(columns, prefix):
    want = [int(hashlib.md5("|".join([prefix, *map(str, k)]).encode()).hexdigest()[:13], 16) for k in zip(*columns, strict=True)]
    assert Keys(*[np.array(c, np.int64) for c in columns]).bits(prefix).tolist() == want


def test_cascades_draw_only_where_they_can_come(spark, monkeypatch):
    """Two copies of a graph, seeds in one: no draws for the other, and the
    sizes of draws for all."""
    pairs = [(a, b, 1 + (a + b) % 3) for a in range(30) for b in range(a + 1, 30) if (a * 7 + b * 5) % 6 == 0]
    edges = spark.createDataFrame(pairs + [(a + 100, b + 100, w) for a, b, w in pairs], "src long, dst long, weight long")
    seeds = spark.createDataFrame([(1,), (7,), (999,)], "vid long")
    live = edges.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(5))))
    live = live.where(uniform(5, "cascade", F.col("trial"), F.col("src"), F.col("dst")) < activation(0.3, F.col("weight")))
    assert rows(influence.live_edges(edges, 6, 0.3, 5)) == rows(live.select("trial", "src", "dst"))
    drawn, real = [], influence.live_edges
    monkeypatch.setattr(influence, "live_edges", lambda edges, *a: drawn.append(edges.agg(F.max("dst")).first()[0]) or real(edges, *a))
    got = dict(influence.cascades(edges, seeds, 6, 0.3, 5).collect())
    assert max(x for x in drawn if x is not None) < 100
    joined = rows(live.select("trial", "src", "dst"))
    for trial in range(6):
        reached = {1, 7, 999}
        while more := {x for t, a, b in joined if t == trial for x in (a, b) if reached & {a, b}} - reached:
            reached |= more
        assert got[trial] == len(reached)


@pytest.mark.parametrize(("block", "step"), [(4, 3), (8192, 5)])
def test_pairs_of_a_community_in_blocks(spark, monkeypatch, block, step):
    monkeypatch.setattr(synthesis, "BLOCK", block)
    monkeypatch.setattr(synthesis, "STEP", step)
    degrees = spark.createDataFrame([(v % 3, v * 3, v % 7) for v in range(60)], "com long, vid long, target long")
    u, v = degrees.where("target > 0").alias("u"), degrees.where("target > 0").alias("v")
    both = u.join(v, F.expr("u.com = v.com and u.vid < v.vid"))
    total = degrees.groupBy(F.col("com").alias("c")).agg(F.sum("target").alias("s"))
    both = both.join(total, F.col("u.com") == F.col("c"))
    want = both.where(uniform(4, "chung-lu", F.col("u.vid"), F.col("v.vid")) * F.col("s") < F.col("u.target") * F.col("v.target"))
    made = synthesis.chung_lu_pairs(degrees, 4)
    assert rows(made) == rows(want.select("u.vid", "v.vid"))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # no pair travels
    edges = made.unionByName(spark.createDataFrame([(0, 1)], "src long, dst long"))
    part = degrees.select("vid", "com")
    free = metrics.non_neighbours(G.Graph(part.select("vid"), edges), part)
    near = {tuple(r) for r in edges.collect()}
    vids = {r.vid: r.com for r in part.collect()}
    assert rows(free) == sorted((c, a, b) for a, c in vids.items() for b, k in vids.items() if a < b and c == k and (a, b) not in near)
    assert "LeftAnti" not in free._jdf.queryExecution().optimizedPlan().toString()


def test_slots_are_never_broadcast(spark):
    degrees = spark.createDataFrame([(0, v, 3) for v in range(9)], "com long, vid long, target long")
    asked = spark.range(50).select(F.lit(0).cast("long").alias("com"), "id")
    got = synthesis.pick(asked, synthesis.slots(degrees, F.col("target")), "com", uniform(1, "t", F.col("id")), "v")
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()


def _longest(pairs):
    """The largest distance in a graph, by a search from every vertex."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    most = 0
    for v in near:
        seen, edge, depth = {v}, {v}, 0
        while edge := {x for y in edge for x in near[y]} - seen:
            seen, depth = seen | edge, depth + 1
        most = max(most, depth)
    return most


def _lumps():
    """A ring with chords, a wheel, a path and many pairs, all apart."""
    ring = [(v, (v + 1) % 300) for v in range(300)] + [(v, (v * 7) % 300) for v in range(0, 300, 9)]
    wheel = [(1000, 1001 + v) for v in range(90)] + [(1001 + v, 1001 + (v + 1) % 90) for v in range(90)]
    path = [(2000 + v, 2001 + v) for v in range(9)]
    apart = [(3000 + 2 * v, 3001 + 2 * v) for v in range(40)]
    tidy = [sorted({(min(e), max(e)) for e in part if e[0] != e[1]}) for part in (ring, wheel, path)]
    return [*tidy, apart]


@pytest.mark.parametrize(("sources", "arcs", "near"), [(512, 1 << 18, 32), (64, 3, 8), (7, 50, 8)])
def test_distances_within_a_component(monkeypatch, sources, arcs, near):
    monkeypatch.setattr(metrics, "SOURCES", sources)
    monkeypatch.setattr(metrics, "ARCS", arcs)
    monkeypatch.setattr(metrics, "NEAR", near)
    for part in _lumps()[:3]:
        src, dst = np.array(part).T
        assert metrics._component_depth(src, dst, 0, 1) == max(metrics._component_depth(src, dst, k, 3) for k in range(3)) == _longest(part)


@pytest.mark.parametrize("limits", [{}, {"FEW_EDGES": 100, "SOURCES": 64}])
def test_diameter_gathers_no_edges(spark, monkeypatch, limits):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("edges on the driver")

    monkeypatch.setattr(DataFrame, "toArrow", refuse)
    for name, value in limits.items():
        monkeypatch.setattr(metrics, name, value)
    edges = [e for part in _lumps() for e in part]
    ring = _longest(_lumps()[0])
    frame = spark.createDataFrame(edges, "src long, dst long")
    vertices = spark.createDataFrame([(v,) for v in {x for e in edges for x in e} | {9999}], "vid long")
    got = metrics.diameter(G.Graph(vertices, frame))
    assert rows(got) == [(max(ring, 9),)] and got.schema["diameter"].dataType.simpleString() == "int"
    assert rows(metrics.diameter(G.Graph(vertices, frame.limit(0)))) == [(0,)]


def test_diameter_of_what_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_EDGES", 6)
    monkeypatch.setattr(metrics, "SEARCHES", 3)
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3), (2, 4), (4, 5), (10, 11)]
    vertices = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 10, 11)], "vid long")
    assert rows(metrics.diameter(G.Graph(vertices, spark.createDataFrame(edges, "src long, dst long")))) == [(_longest(edges),)]


@pytest.mark.parametrize("scale", [1, 10**14])
def test_a_round_of_louvain_moves_in_blocks(spark, scale):
    """Dense and scattered numbers, weights, and labels that are taken: each
    half moves as one after the other on a snapshot would, and arcs stay packed."""
    from veilgraph.operators import louvain

    pairs = {(a, b): float(1 + (a + b) % 3) for a in range(60) for b in range(a + 1, 60) if (a * 7 + b * 5) % 9 == 0}
    total, com = sum(pairs.values()), {v: v // 2 * 2 for v in range(60)}
    strength = {v: sum(w for e, w in pairs.items() if v in e) for v in com}
    near = spark.createDataFrame([(a * scale, b * scale, w) for (a, b), w in pairs.items()], "src long, dst long, w double")
    labels = spark.createDataFrame([(v * scale, c * scale, strength[v]) for v, c in com.items()], "vid long, com long, strength double")
    block = louvain._blocks(labels, 2 * len(pairs))
    labels = labels.withColumn("block", block("vid"))
    assert labels.select("block").distinct().count() > 3
    arcs = louvain._packed(near, block, 5)
    ends = arcs.select("block", F.explode("there").alias("there")).distinct()
    need = ends.unionByName(ends.select("block", F.col("block").alias("there"))).distinct()
    got, want = {}, {}
    for half in range(2):
        moved = louvain._moved(arcs.where(F.col("half") == half), need, labels, total, 0.9)
        assert "dst#" not in "".join(x for x in moved._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
        got |= dict(moved.collect())
    for v in com:
        into = {com[v]: 0.0}
        for (a, b), w in pairs.items():
            if v in (a, b):
                c = com[b if a == v else a]
                into[c] = into.get(c, 0.0) + w
        rest = {c: sum(strength[x] for x in com if com[x] == c and x != v) for c in into}
        gain = {c: 0.9 * n - rest[c] * strength[v] / (2 * total) for c, n in into.items()}
        best = max(gain, key=lambda c: (gain[c], -c))
        if gain[best] > gain[com[v]] + 1e-12:
            want[v * scale] = best * scale
    assert got == want and want


@pytest.mark.parametrize(("epsilon", "guess"), [(0.8, None), (0.3, 50), (3.0, None)])
def test_cells_between_groups_are_made_in_blocks(spark, monkeypatch, epsilon, guess):
    from veilgraph.operators import mechanisms

    monkeypatch.setattr(mechanisms, "LEAST_SIDE", 6)
    edges = spark.createDataFrame([(a, b) for a in range(80) for b in range(a + 1, 80) if (a * 7 + b * 5) % 9 == 0], "src long, dst long")
    groups = spark.range(80).select(F.col("id").alias("vid"), F.floor(F.col("id") * 7 % 80 / 2).cast("long").alias("com"))
    want = rows(mechanisms.noisy_super_graph(edges, groups, epsilon, 5).where("w > 0").select("ci", "cj", "w"))

    def refuse(*_, **__):
        raise AssertionError("cells that travel")

    monkeypatch.setattr(mechanisms, "noisy_super_graph", refuse)
    if guess:  # too high
        monkeypatch.setattr(mechanisms, "_least_shift", lambda *_: guess)
    assert rows(mechanisms.noisy_links(edges, groups, epsilon, 5)) == want and len(want) > 9
    monkeypatch.setattr(mechanisms, "louvain_rounds", lambda nodes, links, *_: nodes.select("vid", (F.col("vid") * links.count()).alias("com")))
    assert mechanisms.group_communities(edges, groups, epsilon, 5).agg(F.max("com")).first()[0] == 39 * len(want)


def test_a_quarter_of_the_vertices_covers_the_rest(monkeypatch):
    """In a graph where hubs bound nothing few searches remain; odd graphs keep
    their diameter, whatever a cover leaves open."""
    rng = np.random.default_rng(3)
    made = sorted({(min(e), max(e)) for e in rng.integers(0, 600, (9000, 2)).tolist() if e[0] != e[1]})
    tail = [*made, *((600 + k, 601 + k) for k in range(4)), (17, 600)]
    asked = []
    monkeypatch.setattr(metrics, "SOURCES", 64)
    monkeypatch.setattr(metrics, "COVER_VERTICES", 16, raising=False)
    monkeypatch.setattr(metrics, "_depth", lambda *a, f=metrics._depth, **k: (asked.append(len(a[2])), f(*a, **k))[1])
    assert metrics._component_depth(*np.array(made).T, 0, 1) == _longest(made) == 3 and sum(asked) < 450
    for part in [*_lumps()[:3], tail]:
        src, dst = np.array(part).T
        assert metrics._component_depth(src, dst, 0, 1) == max(metrics._component_depth(src, dst, k, 3) for k in range(3)) == _longest(part)


def test_hubs_spare_searches(monkeypatch):
    """Vertices that can be no farther than what is found aren't searched from."""
    dice = np.random.default_rng(3)
    ends = np.sort(dice.integers(0, 900, (18_000, 2)), axis=1)
    ends = np.unique(np.concatenate([ends[ends[:, 0] < ends[:, 1]], [[0, 900], [900, 901], [1, 902], [902, 903]]]), axis=0)
    searched, plain = [], metrics._depth

    def counted(first, other, sources, *rest):
        searched.append(len(sources))
        return plain(first, other, sources, *rest)

    monkeypatch.setattr(metrics, "_depth", counted)
    monkeypatch.setattr(metrics, "SOURCES", 64)
    assert max(metrics._component_depth(*ends.T, k, 2) for k in range(2)) == _longest([tuple(e) for e in ends.tolist()])
    assert sum(searched) < 700


def test_searches_go_on_from_few_far_vertices(monkeypatch):
    """A vertex at the rim is as far from its hubs as any two are."""
    dice = np.random.default_rng(5)
    ends = [(a, b) for a in range(200) for b in range(a + 1, 200) if dice.random() < 0.4]
    ends = np.array([*ends, (7, 200)])
    searched, plain = [], metrics._depth

    def counted(first, other, sources, *rest):
        searched.append(len(sources))
        return plain(first, other, sources, *rest)

    monkeypatch.setattr(metrics, "_depth", counted)
    assert max(metrics._component_depth(*ends.T, k, 2) for k in range(2)) == _longest([tuple(e) for e in ends.tolist()]) == 3
    assert sum(searched) < 150  # 128 of them for the vertices of fewest edges


@pytest.mark.parametrize("weighted", [False, True])
def test_a_small_level_is_one_task_with_the_same_moves(spark, monkeypatch, weighted):
    from veilgraph.operators import louvain

    pairs = [(a * 3, b * 3, float(1 + (a + b) % 3)) for a in range(50) for b in range(a, 50) if (a * 7 + b * 5) % (4 if a % 5 == b % 5 else 19) == 0 and (weighted or a < b)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double").select("src", "dst", *["weight"] * weighted)
    vertices = spark.range(51).select((F.col("id") * 3).alias("vid"))
    rounds, found = louvain._moved, []

    def counted(*args):
        found.append(1)
        return rounds(*args)

    monkeypatch.setattr(louvain, "_moved", counted)
    one = rows(louvain.louvain_rounds(vertices, edges, 0.9, seed=4))
    assert not found and len({c for _, c in one}) > 2
    monkeypatch.setattr(louvain, "TASK_LINKS", -1)
    monkeypatch.setattr(louvain, "TASK_WEIGHTS", -1)
    assert rows(louvain.louvain_rounds(vertices, edges, 0.9, seed=4)) == one and found


@pytest.mark.parametrize("limits", [{}, {"FOREST": 8}, {"FOREST": 8, "TASK_VERTICES": 0}])
def test_components_begin_with_what_tasks_know(spark, monkeypatch, limits):
    from veilgraph.operators import components

    for name, value in limits.items():
        monkeypatch.setattr(components, name, value)
    edges = [(v, v + 3) for v in range(0, 60) if v % 17] + [(7, 7), (40, 2)]
    want = {v: v for v in range(70)}
    for _ in range(70):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    frame = spark.createDataFrame(edges + [(None, 3)], "src long, dst long").repartition(3)
    assert dict(components.connected_components(spark.range(70).withColumnRenamed("id", "vid"), frame).collect()) == want


def test_centrality_in_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, 30) if (a * 7 + b * 5) % 9 == 0], "src long, dst long")
    graph = G.Graph(spark.range(31).withColumnRenamed("id", "vid"), edges)
    one = dict(rows(metrics.eigenvector_centrality(graph)))
    with pytest.raises(ArithmeticError):
        metrics.eigenvector_centrality(graph, tolerance=0.0, max_iterations=5)
    monkeypatch.setattr(metrics, "TASK_PATHS", -1)
    assert one == pytest.approx(dict(rows(metrics.eigenvector_centrality(graph))), abs=1e-12) and len(one) == 31


def test_runs_of_a_table_are_made_at_once(spark, monkeypatch):
    import threading

    from veilgraph.plans import experiment, staging

    meet, left = threading.Barrier(3), []

    def measure(graph, **_):
        meet.wait(60)  # the original's and both runs' are under way
        left.append(staging.staged(spark.range(2), "left")._staged_at)
        return graph

    monkeypatch.setattr(experiment, "measure", measure)
    monkeypatch.setattr(experiment, "publish", lambda graph, epsilon, seed: epsilon)
    monkeypatch.setattr(experiment, "compare", lambda a, b: dict.fromkeys(experiment.METRICS, b))
    with staging.staging_scope() as paths:
        table = experiment.run_table(spark, 0.5, experiment.sweep(epsilon=[1.0, 3.0]), 1).collect()
    assert [(r.eps, r.nmi, r.error) for r in table] == [(1.0, 1.0, None), (3.0, 3.0, None)]
    assert sorted(paths) == sorted(left) and sum(p in staging._STAGED for p in left) == 1
