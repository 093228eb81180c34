"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the mix in proportion to its weight, but may
be repeated at most ``max_epochs`` times.  Sources over that limit are clamped
to it and their excess is shared among the others by weight, until none is
above.  A source's target is then met by whole repetitions of all its
documents plus a seeded sample of them for the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm.textops import fresh, keyed_hash, n_words, quoted, without
from veilgraph.operators.ranking import ranked
from veilgraph.plans.staging import staged, stored

#: Bits of the sampling key that each of the two histogram levels resolves.
_LEVEL_BITS = 10

OUTPUT = ("size", "source_size", "target", "repeats", "taken")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Adds ``target`` to (source, weight, cap).

    Each round is one distributed aggregate that yields two scalars; a source
    is clamped in a round if weight * level exceeds its cap.  The level only
    rises, so the clamped set only grows and the rounds end.  Where total is
    more than all caps, every source with a weight gets its cap; a source
    without weight gets 0; an empty table stays empty.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row.n == clamped or not row.open:
            break
        clamped = row.n
        level = max(level, (total - row.held) / row.open)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    if row.open == 0:  # everything is clamped: the mix is smaller than asked
        target = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
    return sources.withColumn("target", target)


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """(source, weight) for distinct sources in code point order, null last,
    that take the given weights in turn."""
    order = ranked(sources.select("source").distinct(), F.col("source").asc_nulls_last(), name="turn")
    turn = F.col("turn") % len(weights) + 1
    return order.select("source", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")).alias("weight"))


def _at_source(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the columns of found for their source, null included."""
    other = found.withColumnRenamed("source", "_of")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def _thresholds(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source (upto, last): rows whose sampling key is below upto get one
    repetition more, and so do those of that key numbered up to last.

    Rows are taken in key order until the fraction's words are reached, the
    last one if that comes nearer.  Rows that share a key (they are equal) are
    counted together; two histogram levels over the key find the bucket in
    which the words are reached, and only its keys, a millionth of the
    source's, are ordered one by one.  Where a bucket ends just there, it is
    the next with words: what has none before its first row still fits.  Where
    some of the rows of one key fit, the number of the last is found from
    counts per partition and the rows of one partition.
    """
    keys = keys.withColumn("b1", F.shiftright("key", 60 - _LEVEL_BITS))
    keys = keys.withColumn("b2", F.shiftright("key", 60 - 2 * _LEVEL_BITS).bitwiseAND((1 << _LEVEL_BITS) - 1))
    found = plan.select("source", "part").withColumn("base", F.lit(0).cast("long"))
    scope = keys
    for level in ("b1", "b2"):
        sums = scope.groupBy("source", level).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy(level)
        here = _at_source(sums.withColumn("end", F.sum("words").over(run)), found).withColumn("end", F.col("end") + F.col("base"))
        here = here.where((F.col("end") > F.col("part")) & (F.col("end") - F.col("words") <= F.col("part")))
        found = here.groupBy("source").agg(
            F.min(F.struct(F.col(level).alias("at"), (F.col("end") - F.col("words")).alias("base"), "part")).alias("x")
        ).select("source", F.col("x.at").alias("at"), F.col("x.base").alias("base"), F.col("x.part").alias("part"))
        found = staged(found, "mix-buckets")
        scope = _at_source(scope, found.select("source", "at")).where(F.col(level) == F.col("at")).drop("at")
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    groups = scope.groupBy("source", "key").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    groups = groups.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(run), F.lit(0)))
    left = 2 * (F.col("part") - F.col("base") - F.col("before"))  # a row fits if half of it does
    fit = F.when(F.col("size") > 0, F.floor((left - F.col("size")) / (2 * F.col("size"))) + 1).when(left >= 0, F.col("n")).otherwise(0)
    groups = _at_source(groups, found.select("source", "base", "part")).withColumn("m", F.greatest(F.lit(0), F.least(fit, "n")).cast("long"))
    # the first key of which not all rows fit, or the one after the bucket's last
    cut = groups.groupBy("source").agg(F.min(F.when(F.col("m") < F.col("n"), F.struct("key", "m"))).alias("x"), F.max("key").alias("most"))
    cut = staged(cut.select("source", F.coalesce("x.key", F.col("most") + 1).alias("upto"), F.coalesce("x.m", F.lit(0)).alias("m")), "mix-cuts")
    partial = cut.where("m > 0").select("source", F.col("upto").alias("key"), "m")
    split = _at_source(scope, partial.withColumnRenamed("key", "cut")).where("key = cut").withColumn("place", F.shiftright("rid", 33))
    counts = split.groupBy("source", "m", "place").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
    there = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("n") < F.col("m")))
    there = there.select("source", F.col("place").alias("at"), (F.col("m") - F.col("upto") + F.col("n")).alias("nth"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("rid"))
    last = _at_source(split, there).where("place = at").withColumn("turn", turn).where("turn = nth").select(F.col("source").alias("s"), "rid")
    return cut.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "upto", F.coalesce("rid", F.lit(-1)).alias("last"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | list[float],
    *,
    total_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of docs with size, source_size, target, repeats and taken.

    weights: (source, weight), or a list that the sources take in turn, in
    code point order, null last.  A source without weight, or with a null or
    negative one, gets 0; weights of one source listed twice add up.  The mix
    has total_ratio times the words of docs; a source is repeated max_epochs
    times at most.

    Defined results: null or empty text has size 0 and is repeated like its
    source (it takes no words); a null source is a source of its own; null
    ids are told apart by their text; rows that share id and text stand next
    to each other in the sample's order and are taken one by one, in the order
    of the table; very long texts count whole, and a target is missed by half
    a row at most; an empty table gives an empty result; input columns named
    like an output column, in any letter case, are replaced, others may have
    any name.  Reruns agree: the sample is keyed by seed, id and text.  docs is
    read twice; unless it is a stored table, a copy is staged.
    """
    docs = stored(docs)
    return _mixed(docs, weights, total_ratio, max_epochs, seed, id_col, text_col, source_col)


def _mixed(docs: DataFrame, weights: DataFrame | list[float], total_ratio: float, max_epochs: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = n_words(F.col(text_col))
    key = keyed_hash(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rid = F.monotonically_increasing_id()
    keys = staged(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), rid.alias("rid")), "mix-keys")
    sums = staged(keys.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    if not isinstance(weights, DataFrame):
        weights = cyclic_weights(sums, weights)
    given = weights.groupBy(F.col("source").alias("given")).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("weight"))
    sources = sums.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")
    )
    sources = staged(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "mix-weights")
    total = total_ratio * (sources.agg(F.sum("source_size")).first()[0] or 0)
    plan = water_fill(sources, float(total))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = staged(plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    cuts = _thresholds(keys, plan.where("part > 0")).withColumnRenamed("source", "s")
    by, plan_size, plan_target, plan_whole, plan_upto, plan_last, row_by, row_size, row_key, row_rid = fresh(docs, "by", "source_size", "target", "whole", "upto", "last", "row_by", "size", "key", "rid")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias(by), F.col("source_size").alias(plan_size), F.col("target").alias(plan_target), F.col("whole").alias(plan_whole),
        F.coalesce("upto", F.lit(-1)).alias(plan_upto), F.coalesce("last", F.lit(-1)).alias(plan_last),
    )
    plan = staged(plan, "mix-thresholds")
    rows = docs.select("*", F.col(source_col).alias(row_by), size.alias(row_size), key.alias(row_key), rid.alias(row_rid))
    rows = rows.join(plan, F.col(row_by).eqNullSafe(F.col(by)))
    more = (F.col(row_key) < F.col(plan_upto)) | ((F.col(row_key) == F.col(plan_upto)) & (F.col(row_rid) <= F.col(plan_last)))
    repeats = F.col(plan_whole) + F.when(more, 1).otherwise(0)
    return rows.select(
        *[quoted(c) for c in without(docs, OUTPUT).columns],
        F.col(row_size).alias("size"),
        F.col(plan_size).alias("source_size"),
        F.col(plan_target).alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col(row_size)).alias("taken"),
    )


def materialize(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is to be repeated, without
    the operator's columns.  Rows with repeats 0 or null are left out; an
    empty table stays empty; other columns, whatever their names, go along."""
    (copy,) = fresh(mixed, "copy")
    kept = [quoted(c) for c in without(mixed, OUTPUT).columns]
    copies = F.explode(F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats").cast("long"))).otherwise(F.array().cast("array<long>")))
    return mixed.select(*kept, copies.alias(copy)).select(*kept)


#: op1: weights and ratio that the query fixes.
SEED = "mix-1"


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs.select("doc_id", "text", "source"), [5.0, 2.0, 1.0], total_ratio=1.5, max_epochs=2.0, seed=SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s),
lv AS (
  SELECT (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS total),
pick AS (
  SELECT (total - held) / open AS level FROM o, lv WHERE cap / w >= (total - held) / open ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, w * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, w * level) / source_size) ELSE 0 END::BIGINT AS whole
  FROM s, pick),
r AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS part,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, whole + CASE WHEN part > 0 AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END AS repeats FROM r)
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, repeats::BIGINT AS repeats FROM u
"""
