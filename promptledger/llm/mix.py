"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys, cut into ranges,
are its random order; prefix sums of word counts over the ranges, and over the
rows of the one range in which the budget ends, give the key at which the budget
is used up. So a document is taken by comparing its key with its source's cut:
the texts are never sorted or shuffled (but those of rows equal to a cut). A budget above the source's size repeats
the whole source first.

Empty tables give empty results. A null text has size 0, a null source is a
source of its own (last in order), a null id is allowed. Rows equal in id and
text share one key; where the budget ends among them, as many are taken as fit, so
repeated rows count like any others. Extra columns are kept by ``mixed``, whatever
their names, and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptledger.llm.common import WORD, n_words, staged, table
from promptledger.session import lookup_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20
#: Hex digits of the key that name its range: 4,096 ranges per source.
RANGE_DIGITS = 3


def key_of(doc_id: str, text: str, seed: int) -> Column:
    return F.md5(
        F.concat_ws(
            ":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
            F.coalesce(F.col(text), F.lit("")),
        )
    )


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source's target is ``min(most * size, level * weight)`` with the one level at
    which the targets add up to ``share`` of all sizes: what resharing the excess
    by weight ends in. The sources filled to their limit come first by ratio of
    limit to weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    limits = totals.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = limits.select(
        "*",
        (
            (F.lit(share) * F.sum("source_size").over(everything)
             - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
    )
    open_level = F.when(F.col("limit") / F.col("weight") > F.col("level"), F.col("level"))
    return levels.select("*", F.max(open_level).over(everything).alias("final")).select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("weight") * F.col("final"))).alias("target"),
    )


def sized(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key): all that planning needs, without the texts."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"), key_of(doc_id, text, seed).alias("key"),
    )


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: its target, whole ``epochs`` and the ``cut`` key up to
    which documents are taken once more."""
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    goals = targets(totals, weights, share, most).select(
        "*", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(1)).alias("epochs")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_range.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    g = goals.withColumnRenamed("source", "g_source")
    ends = placed.join(g, F.col("source").eqNullSafe(F.col("g_source"))).where(
        (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("range_size"))
    ).select("source", "range", (F.col("rest") - F.col("before")).alias("need"))
    e = ends.select(F.col("source").alias("e_source"), F.col("range").alias("e_range"), "need")
    last = rows.join(
        e, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range"))
    )
    # Equal keys are one row with their number; a document counts if at least half of it
    # lies within the budget, so of equal ones the first few may count.
    keys = last.groupBy("source", "range", "key", "size", "need").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("used", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    fits = lambda j: F.col("used") + F.col("size") * j - F.col("size") / 2 <= F.col("need")
    guess = F.floor(F.try_divide(F.col("need") - F.col("used"), F.col("size").cast("double")) + 0.5)
    near = F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(guess, F.lit(0)), F.col("copies")))
    # The quotient is rounded; the test is the one that a single row is put to.
    some = F.when(fits(F.col("near") + 1), F.col("near") + 1).when(fits(F.col("near")), F.col("near")).otherwise(F.col("near") - 1)
    keys = keys.withColumn("near", near).withColumn(
        "taken", F.when(fits(F.col("copies")), F.col("copies")).otherwise(F.greatest(some, F.lit(0)))
    )
    ends_at = F.max(F.when(F.col("taken") > 0, F.struct("key", "taken", "copies"))).alias("at")
    cuts = keys.groupBy("source").agg(ends_at, F.first("range").alias("range")).select(
        "source", F.coalesce("at.key", "range").alias("cut"), F.coalesce("at.taken", F.lit(0)).alias("cut_taken"),
        F.coalesce("at.copies", F.lit(0)).alias("cut_copies"),
    )
    c = cuts.withColumnRenamed("source", "c_source")
    return g.join(c, F.col("g_source").eqNullSafe(F.col("c_source")), "left").select(
        F.col("g_source").alias("p_source"), "source_size", "target", "epochs",
        F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("cut_taken", F.lit(0)).alias("cut_taken"),
        F.coalesce("cut_copies", F.lit(0)).alias("cut_copies"),
    )


def _taken(rows: DataFrame, source: str, sources: DataFrame, key: Column, spread: Column) -> DataFrame:
    """(row, plan, times): every row with its source's plan and how often the mix has it.

    Rows equal to a source's cut key are taken in part where the plan says so. Equal
    rows are counted first, whatever their number; rows that differ in other columns
    come in the order of those.
    """
    by = sources.select(F.struct(F.col("p_source").alias("source")).alias("by"), F.struct("*").alias("plan"))
    facts = rows.select(F.struct("*").alias("row"), F.struct(F.col(source).alias("source")).alias("by"), key.alias("key"), spread.alias("spread"))
    planned = lookup_join(facts, by, "by", F.col("spread"), "inner")
    epochs, cut = F.col("plan.epochs"), F.col("plan.cut")
    split = sources.where("cut_taken < cut_copies").select("cut").limit(1)
    partly = F.col("key").eqNullSafe(cut) & (F.col("plan.cut_taken") < F.col("plan.cut_copies"))
    whole = planned.withColumn("times", (epochs + (F.col("key") <= cut).cast("int")).cast("int"))
    if split.isEmpty():
        return whole.select("row", "plan", "times")
    # The cut keys of few sources: one group each, of rows that are equal or nearly so.
    some = planned.where(partly).groupBy("plan", "key", "row").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("plan", "key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("copies").over(before), F.lit(0))
    some = some.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least(F.col("copies"), F.col("plan.cut_taken") - earlier)))
    number = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    some = some.withColumn("nth", F.explode(number)).withColumn("times", (epochs + (F.col("nth") <= F.col("more")).cast("int")).cast("int"))
    return whole.where(~partly).select("row", "plan", "times").union(some.select("row", "plan", "times"))


def mixed(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, with their columns; one taken twice stands there twice."""
    sources = staged(plan(staged(sized(docs, doc_id, text, source, seed), "mix-sizes"), **options), "mix-plan")
    taken = _taken(docs, source, sources, key_of(doc_id, text, seed), F.xxhash64(doc_id))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    sources = staged(plan(rows), "mix-plan")
    return _taken(rows, "source", sources, F.col("key"), F.col("key")).select(
        "row.doc_id", "row.size", "plan.source_size", "plan.target",
        (F.col("row.size") * F.col("times")).cast("long").alias("taken"), "row.source",
    )


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight,
             {MOST} * source_size::DOUBLE AS lim FROM s),
l AS (SELECT *, ({SHARE} * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN lim / weight > level THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN lim ELSE least(lim, weight * final) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size) END AS epochs FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM r
"""
