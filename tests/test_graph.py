"""Graph tables on hand-made graphs: a triangle with a tail, a repeated edge
and a self-loop (T1); two cliques of four and a bridge (T2); a star (T3)."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilgraph.operators import graph as G
from veilgraph.operators import influence, louvain, metrics
from veilgraph.operators.components import connected_components
from veilgraph.operators.ranking import ranked
from veilgraph.sources import edges as E
from veilgraph.sources import results as R

T1 = ["10 20", "20\t30", "", " 30 10 ", "30 40", "20 10", "50 50"]


@pytest.fixture(scope="module")
def t1(spark):
    return G.load(E.edge_lines(spark.createDataFrame([(x,) for x in T1], "value string")))


@pytest.fixture(scope="module")
def t2(spark):
    pairs = [(a + o, b + o) for o in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(3, 4)]
    return G.Graph(spark.range(8).withColumnRenamed("id", "vid"), spark.createDataFrame(pairs, "src long, dst long"))


def cliques(spark):
    return spark.createDataFrame([(v, v // 4) for v in range(8)], "vid long, com long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_loading(t1):
    graph, ids = t1
    assert rows(ids.select("vid", "orig_id")) == [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50)]
    assert rows(graph.edges) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert rows(G.degrees(graph)) == [(0, 2), (1, 2), (2, 3), (3, 1), (4, 0)]
    assert rows(G.degree_histogram(G.degrees(graph))) == [(0, 1), (1, 1), (2, 2), (3, 1)]
    assert rows(G.counts(graph)) == [(5, 4)]
    assert (10, 20) in rows(G.original_ids(graph.edges, ids)) and (20, 10) in rows(G.original_ids(graph.edges, ids))


def test_multiplicity_and_line_counts(spark):
    lines = spark.createDataFrame([(x,) for x in [*T1, "lonely"]], "value string")
    assert rows(G.multiplicity(E.edge_lines(lines, strict=False))) == [(10, 20, 2), (10, 30, 1), (20, 30, 1), (30, 40, 1), (50, 50, 1)]
    assert rows(E.count_lines(lines)) == [(5, 6)]
    with pytest.raises(PySparkException):
        E.edge_lines(lines).collect()


def test_files(spark, tmp_path, t1):
    graph, ids = t1
    E.write_edges(graph, ids, str(tmp_path / "out"))
    again = E.read_weighted(spark, str(tmp_path / "out"))
    assert rows(again) == [(10, 20, 2), (10, 30, 2), (20, 30, 2), (30, 40, 2)]
    assert rows(E.count_graph(spark, str(tmp_path / "out"))) == [(4, 8)]
    assert rows(E.read_edges(spark, str(tmp_path / "out"))[0].edges) == rows(graph.edges)
    import array

    near = {v: [] for v in range(5)}
    for a, b in rows(graph.edges):
        near[a].append(b)
        near[b].append(a)
    ends, total = [], 0
    for v in range(5):
        total += len(near[v])
        ends.append(total)
    (tmp_path / "g.bin").write_bytes(array.array("I", [5, *ends, *(x for v in range(5) for x in near[v])]).tobytes())
    binary = E.read_binary(spark, str(tmp_path / "g.bin"))
    assert rows(binary.edges) == rows(graph.edges) and rows(binary.vertices) == [(v,) for v in range(5)]


def test_metrics_t1(spark, t1):
    graph, _ = t1
    found = metrics.triangle_counts(graph).first()
    assert (found.triangles, found.wedges) == (1, 5) and found.transitivity == pytest.approx(0.6)
    assert rows(metrics.components(graph)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert metrics.diameter(graph).first()[0] == 2
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "vid long, com long")
    assert G.modularity(graph, part).first()[0] == pytest.approx(-0.03125)


def test_metrics_t2(spark, t2):
    found = metrics.triangle_counts(t2).first()
    assert (found.triangles, found.wedges) == (8, 30) and found.transitivity == pytest.approx(0.8)
    assert G.modularity(t2, cliques(spark)).first()[0] == pytest.approx(12 / 13 - 0.5)
    assert metrics.diameter(t2).first()[0] == 3 == metrics.diameter_bound(t2)
    assert rows(G.community_matrix(t2.edges, cliques(spark))) == [(0, 0, 12), (0, 1, 1), (1, 1, 12)]
    assert rows(louvain.louvain(t2.vertices, t2.edges)) == rows(cliques(spark))
    evc = {r.vid: r.evc for r in metrics.eigenvector_centrality(t2).collect()}
    assert evc[3] == pytest.approx(evc[4], abs=1e-4) and evc[3] > evc[0] and sum(x * x for x in evc.values()) == pytest.approx(1)


def test_star(spark):
    edges = spark.createDataFrame([(0, v, 1) for v in range(1, 5)], "src long, dst long, weight long")
    assert [r.vid for r in influence.degree_discount(edges, 2).orderBy("rank").collect()] == [0, 1]
    graph = G.Graph(spark.range(5).withColumnRenamed("id", "vid"), edges.select("src", "dst"))
    assert metrics.triangle_counts(graph).first().transitivity == 0
    sure = influence.spread(edges, spark.createDataFrame([(1, 2), (2, 99)], "rank int, vid long"), 5, p=1 - 1e-12)
    assert sure.first()[0] == 6  # the star and the seed that it lacks


def test_cascade_matches_sequential(spark):
    """The mean cascade of a path of three is 1 + p + p**2."""
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "src long, dst long, weight long")
    found = influence.cascades(edges, spark.createDataFrame([(0,)], "vid long"), 3000, 0.5, 5)
    mean = sum(r["size"] for r in found.collect()) / 3000
    assert mean == pytest.approx(1.75, abs=0.06)


def test_empty_graph(spark):
    empty = G.Graph(spark.range(0).withColumnRenamed("id", "vid"), spark.createDataFrame([], "src long, dst long"))
    assert rows(G.degree_histogram(G.degrees(empty))) == []
    assert metrics.triangle_counts(empty).first().transitivity == 0
    assert rows(metrics.components(empty)) == []
    alone = G.Graph(spark.range(3).withColumnRenamed("id", "vid"), spark.createDataFrame([], "src long, dst long"))
    with pytest.raises(PySparkException):
        G.modularity(alone, cliques(spark)).collect()
    assert metrics.top_share(G.degrees(alone), "deg").count() == 0


def test_chains_of_components(spark):
    n = 400
    pairs = [(v, v + 1) for v in range(n) if v % 100 != 99] + [(5, 5), (7, 3)]
    got = dict(rows(connected_components(spark.range(n).withColumnRenamed("id", "vid"), spark.createDataFrame(pairs, "src long, dst long"))))
    assert got == {v: v // 100 * 100 for v in range(n)}


def test_ranks(spark):
    df = spark.createDataFrame([(k * 37 % 101, str(k)) for k in range(101)], "x int, y string").repartition(5)
    assert rows(ranked(df, F.col("x")).select("rank", "x")) == [(k, k) for k in range(101)]


def test_comparisons(spark):
    hist = lambda values: spark.createDataFrame(list(enumerate(values)), "deg int, n int")
    assert metrics.kl_divergence(hist([0, 1, 1]), hist([0, 2])).first()[0] == pytest.approx(17.328680, abs=1e-6)
    labels = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1)], "a int, b int")
    assert metrics.nmi(labels).first()[0] == pytest.approx(0.343711, abs=1e-6)
    one = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int")
    assert metrics.nmi(one).first()[0] == 1.0
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "vid int")
    assert metrics.overlap(ids([1, 2]), ids([3, 2])).first()[0] == 0.5
    assert metrics.overlap(ids([]), ids([3])).first()[0] is None


def test_levels_and_labels(spark):
    rows_ = [(0, v, v // 2) for v in range(8)] + [(1, c, c // 2) for c in range(4)]
    d = spark.createDataFrame(rows_, "level int, node long, com long")
    assert rows(G.at_level(d, 1)) == [(v, v // 4) for v in range(8)]
    part = spark.createDataFrame([(0, 40), (1, 7), (2, 40)], "vid long, com long")
    assert rows(G.renumbered(part)) == [(0, 1), (1, 0), (2, 1)]


def test_log_lists(spark):
    lines = spark.createDataFrame([("all_nmi_arr= [0.5, 1]",), ("x=[np.float64(0.25)]",), ("x=[]",), ("x= 3",)], "line string")
    got = [(r[0], r[1]) for r in lines.select(R.first_of_list(lines["line"]), R.first_of_list(lines["line"], True)).collect()]
    assert got == [(0.5, 0.5), (None, 0.25), (None, None), (None, None)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1.0, *[0.1] * 7)], R.run_schema())
    R.write_table(df, str(tmp_path / R.table_name("set", 5, eps=2.0)))
    assert rows(R.read_runs(spark, str(tmp_path / "set_eps2_5"))) == rows(df)
    (tmp_path / "log.txt").write_text("-epsilon=1,e1_r=.1,e2_r=.2,exper=1/5-\ndataset: a\nall_nmi_arr= [0.5]\nAll time: 1s\n")
    assert [(r.dataset, r.epsilon, r.nmi) for r in R.read_log(spark, str(tmp_path / "log.txt")).collect()] == [("a", 1.0, 0.5)]


def test_running_total(spark):
    from veilgraph.operators.ranking import running_total

    df = spark.createDataFrame([(k % 2, k * 3, k) for k in range(50)], "g int, at long, n int").repartition(4)
    got = {(r.g, r.at): r.sum for r in running_total(df, ["g"], "at", F.col("n"), "sum", bits=4).collect()}
    assert got == {(k % 2, k * 3): sum(j for j in range(k + 1) if j % 2 == k % 2) for k in range(50)}
