"""Mixing sources to target weights along a curriculum whose weights vary over training time.

Every source gets a share of all words by its weight, at most ``max_passes``
times its own size. Its weight follows a schedule over training time 0..1; the
integral of the schedule says how many of the source's words are due by a time,
and the inverse of that integral gives each document the time at which training
reads it. Sorting by that time by ranges is the mix.

DataFrame operations only. A source is summed in 4,096 buckets of hashed ids, so
a source with a third of all rows is spread like the rest; what meets in one task
is one row per source.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own, sorted last; every row of a repeated document
counts as a document; ties in the hashed order go by doc_id, then size; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, running_total
from plumbline.session import materialise

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3

# Shape of a source's weight over time, as (time, factor) knots, used in turn like
# the weights. Each is scaled to an integral of 1: early, even, and late sources.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.2), (1.0, 0.3)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.7, 1.1), (1.0, 1.6)),
)


def time_of_demand(schedule, y: str) -> str:
    """SQL for the time by which a share ``y`` (0..1) of a source's words is due.

    Inside a linear piece with weight w and slope a the demand is w d + a d^2 / 2,
    so d = 2 r / (w + sqrt(w^2 + 2 a r)) for the rest r.
    """
    pieces = [(t0, w0, t1, (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0))
              for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole = sum(p[4] for p in pieces)

    def lit(x: float) -> str:
        return f"CAST('{x!r}' AS DOUBLE)"

    cases, done = [], 0.0
    for t0, w, t1, a, area in pieces:
        w, a = w / whole, a / whole
        r = f"({y} - {lit(done)})"
        d = f"2 * {r} / ({lit(w)} + sqrt({lit(w * w)} + {lit(2 * a)} * {r}))"
        done += area / whole
        last = t1 == pieces[-1][2]
        cases.append(f"WHEN {r} <= 0 THEN {lit(t0)}")
        cases.append(f"ELSE {lit(t0)} + {d}" if last else f"WHEN {y} <= {lit(done)} THEN {lit(t0)} + {d}")
    return f"CASE {' '.join(cases)} END"


def position_sql(y: str, kind: str, schedules=SCHEDULES) -> str:
    """SQL for the training time of demand ``y`` of a source that uses schedule number ``kind``."""
    cases = " ".join(f"WHEN {kind} = {k} THEN {time_of_demand(s, y)}" for k, s in enumerate(schedules))
    return f"CASE {cases} END"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words. The only step that reads the texts."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source_size, target, the number of its schedule.

    Sources in order of what they can give per unit of weight: the ones before the
    first that can give its share are used up, the rest divide what is left by weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "kind", ((F.col("_rank") - 1) % len(weights)).cast("int")
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1).cast("long")
    per = per.withColumn("weight", weight).withColumn("_most", F.col("source_size") * max_passes)
    filled = Window.orderBy(F.col("_most").cast("double") / F.col("weight"), "_rank")
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (
        per.withColumn("_at", F.row_number().over(filled))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(after))
    )
    enough = F.col("_left") * F.col("weight") <= F.col("_most") * F.col("_weights")
    per = per.withColumn("_first", F.min(F.when(enough, F.col("_at"))).over(everything))
    at_first = F.col("_at") == F.col("_first")
    per = per.withColumn("_num", F.max(F.when(at_first, F.col("_left"))).over(everything)).withColumn(
        "_den", F.max(F.when(at_first, F.col("_weights"))).over(everything)
    )
    share = (F.col("weight") * F.col("_num")).cast("double") / F.col("_den").cast("double")
    target = F.when(F.col("_at") < F.col("_first"), F.col("_most").cast("double")).otherwise(share)
    return per.select("source", "source_size", "kind", target.alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and where it stands in its source.

    The source is read in hashed order again and again until its target is met;
    the last pass ends inside a document.
    """
    sized = materialise(sizes(docs), "mix-sizes").withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    hashed = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = sized.withColumn("_hash", hashed).withColumn("_bucket", F.substring("_hash", 1, 3))
    rows = running_total(rows, "_key", "_bucket", ["_hash", "doc_id", "size"], "size", "before")
    per = source_targets(sized, weights, max_passes).withColumn(
        "_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    ).drop("source")
    rows = rows.join(per, "_key").withColumn("due", F.floor("target"))
    passes = F.when(F.col("source_size") > 0, F.expr("due div source_size")).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    rest = F.col("due") - F.col("passes") * F.col("source_size") - F.col("before")
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "kind", "due", "before", "passes", "cut",
        (F.col("size") * F.col("passes") + F.col("cut")).alias("taken"),
    )


def training_order(planned: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row per reading of a document with the training time at which it happens, to sort by.

    Adds repeat (0, 1, ..), words (those read in this pass) and position (0..1).
    """
    readings = F.col("passes") + F.when(F.col("cut") > 0, 1).otherwise(0)
    rows = planned.filter((F.col("size") > 0) & (readings > 0)).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0).cast("long"), readings - 1))
    )
    rows = rows.withColumn("words", F.when(F.col("repeat") < F.col("passes"), F.col("size")).otherwise(F.col("cut")))
    middle = F.col("repeat") * F.col("source_size") + F.col("before") + F.col("words") / 2
    rows = rows.withColumn("_y", middle / F.col("due"))
    return rows.withColumn("position", F.expr(position_sql("_y", "kind", schedules))).drop("_y")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_passes: int = MAX_PASSES) -> DataFrame:
    """op1: every document with what the mix takes of it, sorted by when training first reads it.

    ``position`` is null for a document that is not taken.
    """
    planned = plan_mix(docs, weights, max_passes)
    words = F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("cut"))
    rows = planned.withColumn("_y", F.when(F.col("taken") > 0, (F.col("before") + words / 2) / F.col("due")))
    return rows.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("_y").isNotNull(), F.round(F.expr(position_sql("_y", "kind", schedules)), 6)).alias("position"),
    ).orderBy("position", "doc_id")


def mixed_readings(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_passes: int = MAX_PASSES) -> DataFrame:
    """Rows of ``docs``, one per reading, in training order; columns of any name are returned as they are.

    Rows of one doc_id, source and size are alike to the plan; a number tells them apart.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    alike = ["_id", "_source", "_size"]
    number = F.row_number().over(Window.partitionBy(*alike).orderBy("_size"))

    def numbered(rows, kept, size):
        named = [F.to_json(F.struct(F.col(c).cast("string"))).alias(n) for c, n in (("doc_id", "_id"), ("source", "_source"))]
        return rows.select(kept, *named, size.alias("_size")).withColumn("_row", number)

    whole = numbered(docs, F.struct(*docs.columns).alias("_doc"), size)
    planned = plan_mix(docs, weights, max_passes)
    order = training_order(numbered(planned, F.struct(*planned.columns).alias("_plan"), F.col("size")).select("_plan.*", *alike, "_row"), schedules)
    taken = whole.join(order.select(*alike, "_row", F.col("position").alias("_position")), [*alike, "_row"])
    return taken.orderBy("_position", *alike, "_row").select("_doc.*")


def mix_sql() -> str:
    """DuckDB SQL for op1."""
    weight = "CASE (rank - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, (rank - 1) % 3 AS kind, {weight} AS weight, source_size * {MAX_PASSES} AS most FROM ranked),
filled AS (
  SELECT *, row_number() OVER w AS at_row,
    (SELECT sum(size) FROM sized) - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, rank)),
first AS (SELECT at_row AS f, rest AS num, weights AS den FROM filled WHERE rest * weight <= most * weights ORDER BY at_row LIMIT 1),
targets AS (
  SELECT source, source_size, kind,
    CASE WHEN at_row < f THEN CAST(most AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM filled, first),
placed AS (
  SELECT doc_id, size, source_size, target, kind, CAST(floor(target) AS BIGINT) AS due,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_words
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS passes FROM placed),
cuts AS (SELECT *, greatest(0, least(size, due - passes * source_size - before_words)) AS cut FROM passed),
due AS (
  SELECT *, size * passes + cut AS taken,
    CASE WHEN size * passes + cut > 0 THEN (before_words + CAST(CASE WHEN passes > 0 THEN size ELSE cut END AS DOUBLE) / 2) / due END AS y
  FROM cuts)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN y IS NOT NULL THEN round({position_sql('y', 'kind')}, 6) END AS position
FROM due
"""
