"""Reading tables, batch sizes and prefix sums that the jobs here share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a job reads from each text: bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"

# Arrow batches sent to Python stay this small whatever the length of a text.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that a Python task's memory does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def hash_below(key, fraction: float):
    """True for about ``fraction`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(fraction * (1 << 30))


def running_total(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of ``group`` before each row, by ``bucket``, then ``order``.

    A group is summed bucket by bucket, so no task sees more of it than one
    bucket; only one row per (group, bucket) meets in a task. ``group`` and
    ``bucket`` must not be null.
    """
    def before(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    outer = before(Window.partitionBy(group).orderBy(bucket))
    inner = before(Window.partitionBy(group, bucket).orderBy(*order))
    offsets = (
        df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
        .select(group, bucket, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_offset"))
    )
    return (
        df.join(offsets.drop("_bucket_sum"), [group, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_offset")
    )

