"""As-of join of event streams whose keys may be very unevenly filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values, tie: str,
    bucket_seconds: int = 300,
) -> DataFrame:
    """Adds to each left row the ``values`` of the last right row at or before it.

    Both sides are cut into (key, time bucket) pieces, so a key that holds a third
    of all rows is spread over as many tasks as it has buckets. Into a piece only
    one row is carried: the last right row of any earlier bucket, found among the
    one-row-per-bucket maxima. ``bucket_seconds`` bounds the rows of a piece; pick it
    by the densest key, since buckets themselves are cheap.
    """
    def bucket(c):
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)

    payload = F.struct(F.col(right_ts).alias("_ts"), F.col(tie).alias("_tie"), *values)
    r = right.select(key, bucket(right_ts).alias("_b"), payload.alias("_right"))
    l = left.withColumn("_b", bucket(left_ts))
    last = r.groupBy(key, "_b").agg(F.max("_right").alias("_last"))
    wanted = l.select(key, "_b").distinct().join(last, [key, "_b"], "full")
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        wanted.withColumn("_right", F.max("_last").over(earlier))
        .where(F.col("_right").isNotNull())
        .select(key, "_b", "_right")
    )
    rows = [F.col(c) for c in left.columns if c != key]
    probes = l.select(
        key, "_b", F.col(left_ts).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows).alias("_left")
    )
    facts = r.unionByName(carried).select(
        key, "_b", F.col("_right._ts").alias("_at"), F.lit(0).alias("_kind"), "_right"
    )
    w = (
        Window.partitionBy(key, "_b")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = facts.unionByName(probes, allowMissingColumns=True).withColumn(
        "_right", F.max("_right").over(w)
    )
    return merged.where("_kind = 1").select(key, "_left.*", *[F.col(f"_right.{v}").alias(v) for v in values])
