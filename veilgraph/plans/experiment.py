"""The publication pipeline end to end, sweeps over its parameters, and the
tables that summarise runs."""

from __future__ import annotations

from concurrent.futures import Future
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions.scalars import Split, auto_split, corrected_split, manual_split
from veilgraph.operators import mechanisms, metrics, synthesis
from veilgraph.operators.graph import Graph, degree_histogram, degrees, modularity
from veilgraph.operators.louvain import louvain, louvain_rounds
from veilgraph.plans.staging import staged, tidied, together
from veilgraph.sources.results import METRICS


@dataclass
class Baseline:
    """What the original graph is compared by; computed once for a sweep.
    Never part of a release."""

    labels: DataFrame
    histogram: DataFrame
    centrality: DataFrame  # vid, evc, rank: the top hundredth
    diameter: int
    transitivity: float
    modularity: float


def measure(graph: Graph, seed: int = 0, exact: bool = False, bounded: bool = False) -> Baseline:
    """exact: Louvain vertex after vertex in one task instead of in rounds;
    bounded: a lower bound of the diameter by two searches instead of searches
    from every vertex."""
    def labelled() -> tuple[DataFrame, float]:
        labels = staged((louvain if exact else louvain_rounds)(graph.vertices, graph.edges, seed=seed), "labels")
        return labels, modularity(graph, labels).first()[0]

    with tidied(graph.edges.sparkSession) as kept:
        (labels, value), far, top, closed, histogram = together(
            labelled,
            lambda: metrics.diameter_bound(graph) if bounded else metrics.diameter(graph).first()[0],
            lambda: staged(metrics.top_share(staged(metrics.eigenvector_centrality(graph), "evc"), "evc"), "top"),
            lambda: metrics.triangle_counts(graph).first().transitivity,
            lambda: staged(degree_histogram(degrees(graph)), "histogram"),
        )
        kept += [labels, histogram, top]
    return Baseline(labels, histogram, top, far, closed, value)


def compare(a: Baseline, b: Baseline) -> dict[str, float | None]:
    """The seven metrics of a synthetic graph b against the original a."""
    relative = lambda x, y: abs((x - y) / (x + 1e-15))
    both = a.labels.withColumnRenamed("com", "a").join(b.labels.withColumnRenamed("com", "b"), "vid")
    nmi, overlap, errors, kl = together(
        metrics.nmi(both).first, metrics.overlap(a.centrality, b.centrality).first, metrics.aligned_errors(a.centrality, b.centrality, "evc").first, metrics.kl_divergence(a.histogram, b.histogram).first
    )
    values = (nmi[0], overlap[0], errors.mae, kl[0], relative(a.diameter, b.diameter), relative(a.transitivity, b.transitivity), relative(a.modularity, b.modularity))
    return dict(zip(METRICS, values, strict=True))


def communities(graph: Graph, split: Split, group_size: int, resolution: float, seed: int, exact: bool = False) -> DataFrame:
    """Initial groups and their adjustment, as renumbered (vid, com). exact:
    both by the sequential kernels, in one task each."""
    from veilgraph.operators.graph import renumbered
    from veilgraph.operators.louvain import em_exact

    start = staged(mechanisms.init_random(graph, split.e1, group_size, seed, resolution, exact), "initial")
    if exact:
        return staged(renumbered(em_exact(graph.vertices, graph.edges, start, split.e2, seed=seed)), "adjusted")
    return staged(mechanisms.adjust_communities(graph, start, split.e2, seed), "adjusted")


def release(graph: Graph, partition: DataFrame, epsilon: float, seed: int) -> synthesis.Release:
    """The noisy tables that leave. Different edges bear on the counts
    between communities and on the degrees within, so each has all of
    epsilon."""
    ev = mechanisms.noisy_edge_vector(graph.edges, partition, epsilon, seed).select("ci", "cj", "ev")
    d = mechanisms.noisy_degrees(graph, partition, epsilon, seed).select("com", "vid", "target")
    return synthesis.Release(staged(d, "release-degrees"), staged(ev, "release-counts"))


def publish(graph: Graph, epsilon: float, seed: int, *, e1_r: float = 1 / 3, e2_r: float = 1 / 3, group_size: int = 20, resolution: float = 1.0, method: str = "v3", auto: bool = False, exact: bool = False, **options) -> Graph:
    """A synthetic graph over the same vertices. With auto, the split of the
    budget follows from the public size and mean degree, corrected once the
    number of initial communities is known. options go to the method
    (convert_ratio, oversample, intra_ratio, repair, ...); repair runs in
    rounds unless exact is asked for. No step gathers the graph in one task
    unless exact does."""
    if method not in synthesis.METHODS:
        raise ValueError(f"no method {method!r}; there is {', '.join(synthesis.METHODS)}")
    split = manual_split(epsilon, e1_r, e2_r)
    if auto:
        n, m = graph.vertices.count(), graph.edges.count()
        shares = auto_split(n, 2 * m / n, epsilon)
        k, mean = mechanisms.init_random(graph, shares.e1 * epsilon, group_size, seed, resolution).groupBy("com").count().agg(F.count("*"), F.avg("count")).first()
        shares = corrected_split(shares, n, 2 * m / n, epsilon, k, mean)
        split = Split(shares.e1 * epsilon, shares.e2 * epsilon, shares.e3 * epsilon)
    if exact and method in ("v2", "v3", "v3_convert", "v4"):
        options = {"repair": "sequential"} | options
    with tidied(graph.edges.sparkSession) as kept:
        partition = communities(graph, split, group_size, resolution, seed, exact)
        out = release(graph, partition, split.e3, seed)
        kept.append(staged(synthesis.synthesize(out, seed, method, **options), "synthetic"))
    return Graph(graph.vertices, kept[0])


#: The original's measure and runs that are under way at once.
AT_ONCE = 3


def run_table(spark: SparkSession, graph: Graph, cells: list[dict], runs: int, seed: int = 0) -> DataFrame:
    """One row per cell and run: the cell's parameters, exper and the seven
    metrics. A cell is keyword arguments of publish and of its method, epsilon
    among them; a cell that fails is skipped, its error kept in column error.
    AT_ONCE of them are made at a time, the original's measure first; draws are
    keyed, so that changes no result. Tables of a run go when it ends."""
    base: Future = Future()

    def original() -> None:
        try:
            base.set_result(measure(graph))
        except BaseException as e:
            base.set_exception(e)

    def made(cell: dict, run: int) -> dict:
        row = {("eps" if k == "epsilon" else k): v for k, v in cell.items()} | {"exper": float(run)}
        try:
            with tidied(spark):
                found = measure(publish(graph, seed=seed + run, **cell))
                return row | compare(base.result(), found) | {"error": None}
        except (ArithmeticError, TypeError, ValueError) as e:
            return row | dict.fromkeys(METRICS) | {"error": str(e)}

    rows = together(original, *(lambda cell=cell, run=run: made(cell, run) for cell in cells for run in range(runs)), at_once=AT_ONCE)[1:]
    base.result()  # its error is that of all
    kind = lambda v: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "double"
    names = {k: kind(v) for cell in cells for k, v in cell.items()}
    schema = ", ".join([*(f"{'eps' if k == 'epsilon' else k} {t}" for k, t in names.items()), "exper double", *(f"{m} double" for m in METRICS), "error string"])
    columns = [*("eps" if k == "epsilon" else k for k in names), "exper", *METRICS, "error"]
    return spark.createDataFrame([tuple(float(r[c]) if isinstance(r.get(c), int) and not isinstance(r.get(c), bool) else r.get(c) for c in columns) for r in rows], schema)


def run_datasets(spark: SparkSession, graphs: dict[str, Graph], cells: list[dict], runs: int, seed: int = 0) -> DataFrame:
    """run_table for each of several graphs, with their names in dataset."""
    tables = [run_table(spark, graph, cells, runs, seed).withColumn("dataset", F.lit(name)) for name, graph in graphs.items()]
    return reduce(DataFrame.unionByName, tables)


def sweep(**lists: list) -> list[dict]:
    """All combinations of the parameters' values."""
    return reduce(lambda cells, kv: [c | {kv[0]: v} for c in cells for v in kv[1]], lists.items(), [{}])


def budget_grid(spark: SparkSession) -> DataFrame:
    """(e1_r, e2_r, e3_r): tenths for the first two, where over a hundredth
    is left for the third."""
    tenths = spark.range(1, 9).select((F.col("id") / 10).alias("x"))
    grid = tenths.withColumnRenamed("x", "e1_r").crossJoin(tenths.withColumnRenamed("x", "e2_r"))
    return grid.withColumn("e3_r", 1 - F.col("e1_r") - F.col("e2_r")).where("e3_r > 0.01")


def run_means(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of every metric over the runs of each cell."""
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def summary(runs: DataFrame, config: list[str], sweep_key: str = "eps") -> DataFrame:
    """Per configuration the mean over the swept values of their means."""
    means = run_means(runs, [*config, sweep_key])
    return means.groupBy(*config).agg(*[F.avg(m).alias(f"avg_{m}") for m in METRICS]) if config else means.agg(*[F.avg(m).alias(f"avg_{m}") for m in METRICS])


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def pivoted(rows: DataFrame, metric: str, index: str = "e1_r", columns: str = "e2_r", values: list[float] | None = None) -> DataFrame:
    """One row per index, one column per value of columns. Names are c_ and
    the value times ten."""
    named = rows.select(F.round(index, 2).alias(index), F.concat(F.lit("c_"), F.round(F.col(columns) * 10, 0).cast("int")).alias("_column"), metric)
    names = [f"c_{round(v * 10)}" for v in values] if values else None
    grouped = named.groupBy(index)
    return (grouped.pivot("_column", names) if names else grouped.pivot("_column")).agg(F.first(metric))


#: Values that the sweeps take (fixed values).
EPSILONS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5]
GROUP_SIZES = [5, 10, 15, 20, 25, 30, 35]
RESOLUTIONS = [0.2, 0.5, 0.8, 1.0, 1.2, 1.5]
OVERSAMPLES = [1.3, 1.4, 1.5, 1.6]


def vary_epsilon(spark: SparkSession, graph: Graph, runs: int = 10, epsilons: list[float] = EPSILONS, **fixed) -> DataFrame:
    """Runs over the budget; auto=True derives its split."""
    return run_table(spark, graph, [c | fixed for c in sweep(epsilon=epsilons)], runs)


def vary_group_size(spark: SparkSession, graph: Graph, runs: int = 10, sizes: list[int] = GROUP_SIZES, epsilon: float = 2.0, **fixed) -> DataFrame:
    return run_table(spark, graph, [c | {"method": "original"} | fixed for c in sweep(epsilon=[epsilon], group_size=sizes)], runs)


def vary_resolution(spark: SparkSession, graph: Graph, runs: int = 10, resolutions: list[float] = RESOLUTIONS, epsilon: float = 2.0, **fixed) -> DataFrame:
    return run_table(spark, graph, [c | {"method": "original"} | fixed for c in sweep(epsilon=[epsilon], resolution=resolutions)], runs)


def vary_split(spark: SparkSession, graph: Graph, runs: int = 10, epsilon: float = 2.0, **fixed) -> DataFrame:
    """Runs over the budget grid; the baseline is measured once for all its
    cells."""
    cells = [{"epsilon": epsilon, "e1_r": r.e1_r, "e2_r": r.e2_r} for r in budget_grid(spark).collect()]
    return run_table(spark, graph, [c | {"method": "original"} | fixed for c in cells], runs)


def vary_oversample(spark: SparkSession, graphs: dict[str, Graph], runs: int = 10, oversamples: list[float] = OVERSAMPLES, convert_ratio: float = 0.9, epsilons: list[float] = EPSILONS, **fixed) -> DataFrame:
    """Runs of convert_oversample over graphs, oversampling and the budget, at
    one convert_ratio; summary(rows, ["dataset", "oversample"]) sums them up."""
    cells = sweep(method=["convert_oversample"], oversample=oversamples, convert_ratio=[convert_ratio], epsilon=epsilons)
    return run_datasets(spark, graphs, [c | fixed for c in cells], runs)


def compare_methods(spark: SparkSession, graph: Graph, runs: int = 5, methods: list[str] | None = None, epsilons: list[float] = EPSILONS, **fixed) -> DataFrame:
    cells = sweep(method=methods or list(synthesis.METHODS), epsilon=epsilons)
    return run_table(spark, graph, [c | fixed for c in cells], runs)


def report(runs: DataFrame, keys: list[str]) -> str:
    """The means as text, a list per metric."""
    rows = run_means(runs, keys).orderBy(*keys).collect()
    lines = [f"{k}: {[r[k] for r in rows]}" for k in keys]
    return "\n".join([*lines, *(f"all_{m}= {[r[m] for r in rows]}" for m in METRICS)])
