"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight, which sets the words it shall give (its target), and a
schedule, which says how its weight runs over training time. The schedule is integrated
once, in closed form; the place of a document in its source's stream of words, as a
share of the target, is put through the inverse of that integral, which gives the
training position. The result is range-sorted by position.

Within a source documents stream in the order of a hash. Targets above the source's
size go through the source again, so a document may be taken twice, and the document at
the end of the target is taken in part: each source gives its target to the word.

Edge cases: a null text has no words and is never taken; a null source is a source of
its own, last in order; a source without words has target 0; repeated rows stream one by
one; an empty table gives an empty mix. Only the id, text and source are read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORD, bucket_bits, checkpointed, prefix_sums, row_hash, stored, table

#: By the rank of a source, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Knots (training time from 0 to 1, relative weight), by the rank of a source, repeating: falling, even, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))


def pick(values: list, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def inverse_integral(schedule: tuple, share: Column) -> Column:
    """The time at which the integral of a piecewise linear schedule has reached ``share`` of its total."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:]), areas, strict=True):
        rest = (share - done / total) * total
        slope = 2 * (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(w0 * w0 + slope * rest, F.lit(0.0)))
        time = t0 + 2 * rest / F.nullif(w0 + root, F.lit(0.0))
        done += area
        here = share <= done / total
        out = F.when(here, time) if out is None else out.when(here, time)
    return F.least(out.otherwise(F.lit(schedule[-1][0])), F.lit(schedule[-1][0]))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: rank, rows, source_size and target.

    Sharing the excess by weight again and again ends at one level: targets are the
    level times the weight, or the cap. Sources in the order of cap by weight reach
    their caps one after the other; the first that stays below sets the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", pick(list(weights), F.col("rank")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "_total": F.sum("source_size").over(every),
        "_weights": F.sum("weight").over(every),
        "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_weighed": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("_level", (F.col("_total") * share - F.col("_capped") * cap) / (F.col("_weights") - F.col("_weighed")))
    per = per.withColumn("_below", F.col("_level") * F.col("weight") <= F.col("source_size") * cap)
    level = F.min_by(F.when(F.col("_below"), F.col("_level")), F.when(F.col("_below"), F.col("_weighed"))).over(every)
    target = F.least(F.coalesce(level * F.col("weight"), (F.col("source_size") * cap).cast("double")), (F.col("source_size") * cap).cast("double"))
    return per.select("source", "rank", "n_rows", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """doc_id, row_hash, size, source_size, target, taken, position and position_again of every document.

    ``position`` (0 to 1) is the training time of the first copy, ``position_again`` that
    of the second; null where the document is not taken (again).
    """
    sized = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD)).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("row_hash")))
    per = checkpointed(source_targets(sized, weights, share, cap).withColumn("_bits", bucket_bits(F.col("n_rows"))))
    named = sized.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source", "n_rows")
    df = prefix_sums(named, "rank", "row_hash", "size", "_bits", "_before")
    demand = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap)
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), demand - F.col("source_size") * k - F.col("_before"))).cast("long") for k in range(math.ceil(cap))]
    times = []
    for k in range(2):
        at = (F.col("_before") + F.col("source_size") * k) / F.nullif(demand, F.lit(0))
        by_rank = [inverse_integral(s, at) for s in schedules]
        chosen = F.lit(None).cast("double")
        for j, t in enumerate(by_rank):
            chosen = F.when(F.pmod(F.col("rank") - 1, F.lit(len(schedules))) == j, t).otherwise(chosen)
        times.append(F.when(parts[k] > 0, chosen) if k < len(parts) else F.lit(None).cast("double"))
    taken = parts[0]
    for p in parts[1:]:
        taken = taken + p
    return df.select("doc_id", "row_hash", "size", "source_size", "target", taken.alias("taken"), times[0].alias("position"), times[1].alias("position_again"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The plan, range-sorted by position."""
    return plan(docs, **how).orderBy(F.col("position").asc_nulls_last(), "row_hash")


def training_stream(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with their own columns, once for each time they are taken, in training order.

    A document that is taken in part stays whole. Rows are matched to their plan by id and
    hash; of repeated rows the first gets the first plan, and so on, as they are all alike.
    Only repeated rows are numbered for that, so the texts of the others move once for the
    match and once for the order.
    """
    key = ["_doc_id", "_row_hash"]
    planned = plan(docs, **how).select(F.col("doc_id").alias("_doc_id"), F.col("row_hash").alias("_row_hash"), F.array_compact(F.array("position", "position_again")).alias("_at"))
    planned = stored(planned, "plan")
    again = stored(planned.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key), "again")
    keyed = docs.withColumns({"_doc_id": F.col("doc_id"), "_row_hash": row_hash(F.col("doc_id"), F.col("text"))})

    def same(keys: list[str]) -> Column:
        return reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])

    def among(rows: DataFrame, kind: str) -> DataFrame:
        return rows.alias("l").join(again.alias("r"), same(key), kind)

    def numbered(rows: DataFrame, order: str) -> DataFrame:
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))

    def found(rows: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
        columns = [F.col(f"l.{c}") for c in [*docs.columns, "_row_hash"]]
        return rows.alias("l").join(plans.filter(F.size("_at") > 0).alias("r"), same(keys)).select(*columns, F.explode("r._at").alias("_time"))

    if again.isEmpty():
        taken = found(keyed, planned, key)
    else:
        taken = found(among(keyed, "left_anti"), among(planned, "left_anti"), key)
        repeated = found(numbered(among(keyed, "left_semi"), "_row_hash"), numbered(among(planned, "left_semi"), "_at"), [*key, "_nth"])
        taken = taken.unionByName(repeated)
    return taken.orderBy("_time", "_row_hash").select(*docs.columns)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.round("position_again", 9).alias("position_again"))


QUERIES = {"op4_curriculum_mix": op4_curriculum_mix}

SQL = {
    "op4_curriculum_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(doc_id::VARCHAR || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight FROM p),
c AS (SELECT *, sum(s) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(s) OVER (ORDER BY s * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    coalesce(sum(weight) OVER (ORDER BY s * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weighed FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - capped * 2) / (weights - weighed) AS level FROM c),
v AS (SELECT *, min(level) FILTER (level * weight <= s * 2) OVER () AS lowest,
    arg_min(level, weighed) FILTER (level * weight <= s * 2) OVER () AS stands FROM l),
t AS (SELECT source, rank, s, least(coalesce(stands * weight, s * 2.0::DOUBLE), s * 2.0::DOUBLE) AS target FROM v),
e AS (SELECT d.doc_id, d.size, t.s, t.target, t.rank, least(floor(t.target + 0.5::DOUBLE)::BIGINT, t.s * 2) AS demand,
    coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, greatest(0, least(size, demand - before)) AS one, greatest(0, least(size, demand - s - before)) AS two,
    before / nullif(demand, 0)::DOUBLE AS y1, (before + s) / nullif(demand, 0)::DOUBLE AS y2 FROM e),
g AS (SELECT *, unnest([1, 2]) AS k FROM f),
h AS (SELECT *, CASE k WHEN 1 THEN y1 ELSE y2 END AS y FROM g),
i AS (SELECT *, CASE (rank - 1) % 3
    WHEN 0 THEN 2 * y / (1.5 + sqrt(2.25 - 2 * y))
    WHEN 1 THEN y
    ELSE CASE WHEN y <= 0.3 THEN 2 * y / (0.4 + sqrt(0.16 + 1.6 * y))
      ELSE 0.5 + 2 * (y - 0.3) / (0.8 + sqrt(0.64 + 4.8 * (y - 0.3))) END END AS x FROM h WHERE y <= 1 OR y IS NULL OR k = 1)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target, (one + two)::BIGINT AS taken,
  round(max(CASE WHEN k = 1 AND one > 0 THEN x END), 9) AS position, round(max(CASE WHEN k = 2 AND two > 0 THEN x END), 9) AS position_again
FROM i GROUP BY doc_id, size, s, target, one, two, before"""
}
