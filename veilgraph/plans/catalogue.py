"""The registered queries of the graph engine.

The star-schema tables hold no graph; the queries derive one: parts that
share an order are joined (G_part), and the parts' brand, type and size are
public partitions.  Every query works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import scalars
from veilgraph.functions.noise import geometric, gumbel, laplace, uniform
from veilgraph.operators import graph as G
from veilgraph.operators import influence, louvain, mechanisms, metrics, synthesis
from veilgraph.operators.ranking import ranked, running_total
from veilgraph.plans import experiment
from veilgraph.plans.staging import staged
from veilgraph.sources import edges as edge_sources
from veilgraph.sources import results

SEED = 7
EPSILON = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): parts of each two lines of an order, as often as that is so."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("u"), F.col("l_linenumber").alias("i"))
    b = lines.select(F.col("l_orderkey").alias("p"), F.col("l_partkey").alias("v"), F.col("l_linenumber").alias("j"))
    return a.join(b, (F.col("o") == F.col("p")) & (F.col("i") < F.col("j"))).select("u", "v")


def part_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"))
    return G.Graph(vertices, G.canonical(listed_pairs(spark, sf_dir)))


def stored_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    """G_part with its edges staged."""
    g = part_graph(spark, sf_dir)
    return G.Graph(g.vertices, staged(g.edges, "graph"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("vid"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("com"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def brand_release(spark: SparkSession, sf_dir: str) -> synthesis.Release:
    return experiment.release(stored_graph(spark, sf_dir), brands(spark, sf_dir), EPSILON, SEED)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


# -- loading ---------------------------------------------------------------


@query
def q_vertices_dense(spark, d):
    return G.vertex_ids(listed_pairs(spark, d))


@query
def q_edges_canonical(spark, d):
    return G.load(listed_pairs(spark, d))[0].edges


@query
def q_edge_multiplicity(spark, d):
    return G.multiplicity(listed_pairs(spark, d))


@query
def q_graph_counts(spark, d):
    return G.counts(part_graph(spark, d))


@query
def q_line_counts(spark, d):
    pairs = listed_pairs(spark, d)
    return edge_sources.count_lines(pairs.select(F.concat_ws(" ", "u", "v").alias("value")))


@query
def q_edge_lines(spark, d):
    """Edges as a published file would list them, parsed again."""
    g, ids = G.load(listed_pairs(spark, d))
    text = G.original_ids(g.edges, ids).select(F.concat_ws("\t", "u", "v").alias("value"))
    return G.multiplicity(edge_sources.edge_lines(text))


@query
def q_csr_decode(spark, d):
    """The binary format's arrays, decoded."""
    g = stored_graph(spark, d)
    arcs = G.both_ways(g.edges)
    links = ranked(arcs, F.col("src"), F.col("dst"), name="pos").select("pos", "dst")
    cum = running_total(G.degrees(g), [], "vid", F.col("deg"), "cum").select(F.col("vid").alias("idx"), "cum")
    return edge_sources.csr_arcs(cum, links)


# -- degrees and communities -------------------------------------------------


@query
def q_degree(spark, d):
    return G.degrees(part_graph(spark, d))


@query
def q_degree_hist(spark, d):
    return G.degree_histogram(G.degrees(part_graph(spark, d)))


@query
def q_degree_topk(spark, d):
    return metrics.top_k(G.degrees(part_graph(spark, d)), "deg", 20)


@query
def q_comm_members(spark, d):
    return G.members(brands(spark, d)).select("com", "size", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


@query
def q_comm_size(spark, d):
    return G.sizes(brands(spark, d))


@query
def q_comm_edge_matrix(spark, d):
    return G.community_matrix(part_graph(spark, d).edges, brands(spark, d))


@query
def q_induced_graph(spark, d):
    return G.induced(part_graph(spark, d).edges, brands(spark, d))


@query
def q_neighbor_comm_weights(spark, d):
    return G.neighbour_weights(part_graph(spark, d).edges, brands(spark, d))


@query
def q_all_comm_weights(spark, d):
    return G.all_weights(stored_graph(spark, d), brands(spark, d))


@query
def q_modularity(spark, d):
    return G.modularity(part_graph(spark, d), brands(spark, d))


@query
def q_modularity_res(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("long").alias("com"))
    return G.modularity(part_graph(spark, d), sizes, 0.5)


@query
def q_intra_degree(spark, d):
    return G.intra_degrees(part_graph(spark, d), brands(spark, d))


@query
def q_status(spark, d):
    return G.status(part_graph(spark, d), brands(spark, d))


@query
def q_renumber(spark, d):
    return G.renumbered(brands(spark, d))


@query
def q_dendrogram_level(spark, d):
    """Vertex to brand, brand to its tens, tens to their parity."""
    p = brands(spark, d)
    rows = p.select(F.lit(0).alias("level"), F.col("vid").alias("node"), "com")
    tens = p.select(F.lit(1).alias("level"), F.col("com").alias("node"), F.floor(F.col("com") / 10).alias("com")).distinct()
    odd = tens.select(F.lit(2).alias("level"), F.col("com").alias("node"), (F.col("com") % 2).alias("com")).distinct()
    return G.at_level(rows.unionByName(tens).unionByName(odd), 2)


# -- metrics -----------------------------------------------------------------


@query
def q_triangles(spark, d):
    return metrics.triangle_counts(part_graph(spark, d)).select("triangles", "wedges")


@query
def q_transitivity(spark, d):
    return metrics.triangle_counts(part_graph(spark, d)).select("transitivity")


@query
def q_common_neighbors(spark, d):
    return metrics.common_neighbours(stored_graph(spark, d))


@query
def q_non_neighbors(spark, d):
    return metrics.non_neighbours(stored_graph(spark, d), brands(spark, d))


@query
def q_components(spark, d):
    return metrics.components(stored_graph(spark, d))


@query
def q_bfs_levels(spark, d):
    return metrics.bfs_levels(stored_graph(spark, d), spark.range(1, 4).select(F.col("id").alias("vid")))


@query
def q_diameter(spark, d):
    return metrics.diameter(stored_graph(spark, d))


@query
def q_evc_10iter(spark, d):
    return metrics.eigenvector_centrality(stored_graph(spark, d), 10)


@query
def q_evc_converged(spark, d):
    """Until it no longer changes."""
    rows = metrics.eigenvector_centrality(stored_graph(spark, d), tolerance=1e-11)
    return rows.select("vid", F.round("evc", 5).alias("evc"))


@query
def q_evc_topk(spark, d):
    rows = rounded(metrics.eigenvector_centrality(stored_graph(spark, d), 10))
    return metrics.top_share(staged(rows, "evc"), "evc", 0.05).select("vid", "evc", "rank")


@query
def q_deg_kl(spark, d):
    g = part_graph(spark, d)
    inner = G.intra_degrees(g, brands(spark, d)).withColumn("deg", F.col("deg") * 10)
    return metrics.kl_divergence(G.degree_histogram(G.degrees(g)), G.degree_histogram(inner))


@query
def q_nmi(spark, d):
    return metrics.nmi(table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")))


def _two_rankings(spark, d):
    rows = staged(rounded(mechanisms.laplace_degrees(part_graph(spark, d), 5.0, SEED)), "rankings")
    return metrics.top_share(rows.select("vid", F.col("deg").cast("double").alias("x")), "x", 0.05), metrics.top_share(rows.select("vid", F.col("noisy").alias("x")), "x", 0.05)


@query
def q_overlap_topk(spark, d):
    return metrics.overlap(*_two_rankings(spark, d))


@query
def q_mae_rank(spark, d):
    return metrics.aligned_errors(*_two_rankings(spark, d), "x").select("mae")


@query
def q_mse(spark, d):
    return metrics.aligned_errors(*_two_rankings(spark, d), "x").select("mse")


@query
def q_rel_err(spark, d):
    both = G.degrees(part_graph(spark, d)).join(G.intra_degrees(part_graph(spark, d), brands(spark, d)).select("vid", F.col("deg").alias("inner")), "vid")
    return both.select("vid", scalars.relative_error(F.col("deg"), F.col("inner")).alias("rel_err"))


@query
def q_rank_all(spark, d):
    return metrics.rank_all(G.degrees(part_graph(spark, d)), "deg").select("vid", "deg", "rank")


# -- mechanisms ----------------------------------------------------------------


@query
def q_noise(spark, d):
    u = uniform(SEED, "noise", F.col("id"))
    return spark.range(2000).select("id", u.alias("u"), laplace(2.0, u).alias("laplace"), gumbel(u).alias("gumbel"), geometric(2.0, u).alias("geometric"))


@query
def q_laplace_degree(spark, d):
    return mechanisms.laplace_degrees(part_graph(spark, d), 2 / EPSILON, SEED)


@query
def q_norm_sub(spark, d):
    noisy = rounded(mechanisms.laplace_degrees(stored_graph(spark, d), 20.0, SEED)).withColumn("noisy", F.col("noisy") - 15)
    noisy = noisy.join(brands(spark, d), "vid")
    return mechanisms.norm_sub(noisy, "noisy", ["com"], "fit").select("com", "vid", "noisy", "fit")


@query
def q_noisy_edge_matrix(spark, d):
    return mechanisms.noisy_edge_vector(part_graph(spark, d).edges, brands(spark, d), EPSILON / 20, SEED)


@query
def q_noisy_degree_seq(spark, d):
    return mechanisms.noisy_degrees(part_graph(spark, d), brands(spark, d), EPSILON, SEED)


@query
def q_random_groups(spark, d):
    return mechanisms.random_groups(part_graph(spark, d).vertices, 20, SEED)


@query
def q_init_supergraph(spark, d):
    g = part_graph(spark, d)
    return mechanisms.noisy_super_graph(g.edges, staged(mechanisms.random_groups(g.vertices, 50, SEED), "groups"), EPSILON, SEED)


@query
def q_init_degree_groups(spark, d):
    return mechanisms.score_groups(rounded(mechanisms.degree_scores(part_graph(spark, d), EPSILON, SEED)), "score", 44)


@query
def q_init_neighbor_groups(spark, d):
    return mechanisms.score_groups(rounded(mechanisms.neighbour_scores(part_graph(spark, d), EPSILON, SEED, bound=60)), "score", 20)


@query
def q_em_batch(spark, d):
    return mechanisms.em_batch(stored_graph(spark, d), G.renumbered(brands(spark, d)), 4 * EPSILON, SEED, batch=1, batches=3)


@query
def q_em_exact(spark, d):
    g = stored_graph(spark, d)
    return louvain.em_exact(g.vertices, g.edges, brands(spark, d), EPSILON, seed=SEED)


@query
def q_louvain(spark, d):
    g = stored_graph(spark, d)
    return louvain.louvain_rounds(g.vertices, g.edges, seed=SEED)


@query
def q_louvain_exact(spark, d):
    """Vertex after vertex, on the graph that the brands collapse it to."""
    g = stored_graph(spark, d)
    cells = G.induced(g.edges, brands(spark, d)).select(F.col("ci").alias("src"), F.col("cj").alias("dst"), F.col("w").alias("weight"))
    return louvain.louvain(brands(spark, d).select(F.col("com").alias("vid")).distinct(), cells, seed=SEED)


@query
def q_adjust_communities(spark, d):
    """The whole pass: each vertex moves once, in keyed batches."""
    return mechanisms.adjust_communities(stored_graph(spark, d), brands(spark, d), EPSILON, SEED)


@query
def q_init_random(spark, d):
    return mechanisms.init_random(stored_graph(spark, d), EPSILON, 10, SEED)


@query
def q_init_degree(spark, d):
    return mechanisms.init_degree(stored_graph(spark, d), EPSILON, SEED)


@query
def q_init_neighbor(spark, d):
    return mechanisms.init_neighbour(stored_graph(spark, d), EPSILON, SEED, size=10)


# -- synthesis -----------------------------------------------------------------


@query
def q_chung_lu(spark, d):
    return synthesis.chung_lu(brand_release(spark, d).degrees, SEED)


@query
def q_chung_lu_pairs(spark, d):
    return synthesis.chung_lu_pairs(brand_release(spark, d).degrees, SEED)


@query
def q_inter_uniform(spark, d):
    return synthesis.inter_uniform(brand_release(spark, d), SEED)


@query
def q_synth_original(spark, d):
    return synthesis.original(brand_release(spark, d), SEED)


@query
def q_weighted_sample(spark, d):
    rows = brands(spark, d).join(G.degrees(part_graph(spark, d)), "vid")
    return synthesis.sample_without_replacement(rows, ["com"], "deg", F.lit(5), SEED, "sample").select("com", "vid")


@query
def q_weighted_pick(spark, d):
    rows = brand_release(spark, d).degrees
    asked = rows.select("com").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return synthesis.pick(asked, synthesis.slots(rows, F.greatest("target", F.lit(1))), "com", uniform(SEED, "pick", F.col("com"), F.col("k")), "vid").select("com", "k", "vid")


@query
def q_collision_free_accept(spark, d):
    r = brand_release(spark, d)
    base = staged(synthesis.chung_lu(r.degrees, SEED), "chung-lu")
    return synthesis.v3(r, SEED, repair=None).join(base, ["src", "dst"], "left_anti")


@query
def q_synth_v3(spark, d):
    return synthesis.v3(brand_release(spark, d), SEED)


@query
def q_synth_v3_convert(spark, d):
    return synthesis.v3_convert(brand_release(spark, d), SEED)


@query
def q_synth_convert_oversample(spark, d):
    return synthesis.convert_oversample(brand_release(spark, d), SEED)


@query
def q_synth_v2(spark, d):
    return synthesis.v2(brand_release(spark, d), SEED)


@query
def q_synth_v4(spark, d):
    return synthesis.v4(brand_release(spark, d), SEED)


@query
def q_degree_repair(spark, d):
    r = brand_release(spark, d)
    return synthesis.repair_degrees(synthesis.v3(r, SEED, repair=None), r.degrees, SEED)


@query
def q_repair_rounds(spark, d):
    r = brand_release(spark, d)
    return synthesis.repair_rounds(stored_graph(spark, d).edges, r.degrees, SEED)


@query
def q_prune_inter(spark, d):
    r = brand_release(spark, d)
    half = r.edge_counts.withColumn("ev", F.floor(F.col("ev") / 2))
    return synthesis.excess_inter(stored_graph(spark, d).edges, brands(spark, d), half, SEED)


@query
def q_prune(spark, d):
    return synthesis.prune(stored_graph(spark, d).edges, brand_release(spark, d), SEED)


@query
def q_edge_swap(spark, d):
    return synthesis.edge_swap(stored_graph(spark, d).edges, brands(spark, d), SEED)


@query
def q_cross_cleanup(spark, d):
    return synthesis.cross_cleanup(stored_graph(spark, d).edges, brands(spark, d), SEED)


# -- influence -------------------------------------------------------------------


def _weighted(spark, d):
    pairs = listed_pairs(spark, d).where(F.col("u") != F.col("v"))
    return staged(G.multiplicity(pairs).select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"), "weighted")


@query
def q_degree_discount(spark, d):
    return influence.degree_discount(_weighted(spark, d), 20)


@query
def q_ic_spread(spark, d):
    seeds = spark.range(1, 6).select(F.col("id").alias("vid"))
    return influence.cascades(_weighted(spark, d), seeds, 50, 0.02, SEED)


@query
def q_spread_mean(spark, d):
    seeds = spark.range(1, 6).select(F.col("id").alias("vid"), F.col("id").cast("int").alias("rank"))
    return influence.spread(_weighted(spark, d), seeds, 50, 0.02, SEED, seed_size=3)


@query
def q_influence(spark, d):
    """Seeds from a synthetic graph, their spread on the original."""
    made = synthesis.chung_lu(brand_release(spark, d).degrees, SEED)
    made = staged(made.withColumn("weight", F.lit(2).cast("long")), "synthetic")
    return influence.influence(made, _weighted(spark, d), seed_size=5, trials=20, p=0.02, seed=SEED)


# -- experiments -----------------------------------------------------------------


@query
def q_budget_auto(spark, d):
    cells = [(n, float(deg), eps) for n in (1000, 20000) for deg in (5, 20, 80) for eps in (0.5, 1.0, 2.0, 3.5)]
    rows = []
    for n, deg, eps in cells:
        s = scalars.auto_split(n, deg, eps)
        c = scalars.corrected_split(s, n, deg, eps, 30, n / 30)
        rows.append((n, deg, eps, s.e1, s.e2, s.e3, c.e2, c.e3))
    return spark.createDataFrame(rows, "n int, deg double, eps double, e1 double, e2 double, e3 double, c2 double, c3 double")


@query
def q_budget_grid(spark, d):
    return experiment.budget_grid(spark)


def _runs(spark):
    """Five runs for each of seven budgets and two methods, made by hashing."""
    rows = spark.range(70).select((0.5 * (1 + F.col("id") % 7)).alias("eps"), (F.floor(F.col("id") / 7) % 5).alias("exper"), F.when(F.col("id") < 35, "a").otherwise("b").alias("method"), "id")
    return rows.select("eps", "exper", "method", *[F.round(uniform(SEED, m, F.col("id")), 4).alias(m) for m in results.METRICS])


@query
def q_run_means(spark, d):
    return experiment.run_means(_runs(spark), ["method", "eps"])


@query
def q_summary(spark, d):
    return experiment.summary(_runs(spark), ["method"])


def _grid_rows(spark):
    """The budget grid twice over, numbered, each row with a score."""
    rows = spark.range(128).select(F.col("id").alias("seq"), ((F.floor(F.col("id") / 8) % 8 + 1) / 10).alias("e1_r"), ((F.col("id") % 8 + 1) / 10).alias("e2_r"))
    return rows.where("e1_r + e2_r < 0.95").withColumn("nmi", F.round(uniform(SEED, "grid", F.col("seq")), 4))


@query
def q_dedupe_keep_last(spark, d):
    return experiment.keep_last(_grid_rows(spark), ["e1_r", "e2_r"], "seq")


@query
def q_pivot(spark, d):
    last = experiment.keep_last(_grid_rows(spark), ["e1_r", "e2_r"], "seq")
    return experiment.pivoted(last, "nmi", values=[k / 10 for k in range(1, 9)])


#: A log of three complete blocks, one without a header value and one open.
LOG = """
dataset: early
all_nmi_arr= [0.9]
All time: 1s
----------epsilon=2.0,e1_r=0.1,e2_r=0.2,exper=1/5----------
dataset: one
epsilon= 2.0
all_nmi_arr= [0.41, 0.42]
all_evc_overlap= [0.21]
all_evc_MAE= [0.101]
all_deg_kl= [0.55]
all_diam_rel= [0.2]
all_cc_rel= [0.11]
all_mod_rel= [0.3]
All time: 10.1s
----------epsilon=3.0,e1_r=0.3,e2_r=0.4,exper=2/5----------
dataset: two
epsilon= 3.5
all_nmi_arr= [5e-1]
all_cc_rel= [np.float64(0.25)]
noise between
All time: 9s
all_mod_rel= [0.7]
dataset: three
all_nmi_arr= [0.6]
All time: 8s
dataset: lost
all_nmi_arr= []
All time: 8s
dataset: open
all_nmi_arr= [0.8]
""".strip("\n")


@query
def q_log_parse(spark, d):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(LOG.split("\n"))], "n int, value string")
    return results.parse_log(lines).drop("seq")


@query
def q_compound_interest(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rows.select("c_custkey", scalars.compound(F.col("c_acctbal"), F.lit(0.03), F.lit(5)).alias("value"))


@query
def q_publish(spark, d):
    """The whole pipeline once: edges of the published graph."""
    return experiment.publish(stored_graph(spark, d), 2.0, SEED, group_size=10).edges


@query
def q_run_table(spark, d):
    """Two cells of a sweep, measured against the graph."""
    return experiment.run_table(spark, stored_graph(spark, d), experiment.sweep(epsilon=[1.0, 3.0], method=["original"], group_size=[10]), 1, SEED)
