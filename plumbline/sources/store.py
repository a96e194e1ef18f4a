"""Feature store and keyed tables on plain parquet.

The feature store is a table with versions (``versioned``): a source or some of its
tickers are reloaded in one step that readers see as a whole. The current state of a
keyed table is its latest version per key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.schemas import (
    FEATURE_BATCH,
    FEATURES_PIT,
    TERMINATION_REASONS,
    require_columns,
)
from plumbline.sources.versioned import VersionedTable

PX_COLUMNS = ("open", "high", "low", "close", "volume")


def stamp_features(batch: DataFrame, source: str, version: str = "v1") -> DataFrame:
    """A feature batch in storage form."""
    require_columns(batch, FEATURE_BATCH)
    return batch.select(
        *FEATURE_BATCH,
        F.lit(version).alias("feature_version"),
        F.lit(source).alias("source"),
        F.lit(True).alias("pit_verified"),
    ).select(*FEATURES_PIT.fieldNames())


def feature_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, FEATURES_PIT)


def write_features(batch: DataFrame, path: str, source: str, version: str = "v1") -> int:
    """Append a batch; returns the rows written, counted on the way."""
    return feature_table(batch.sparkSession, path).append(stamp_features(batch, source, version), source)


def read_features(spark: SparkSession, path: str, names=None, source: str | None = None, version: int | None = None) -> DataFrame:
    """The store as of its newest version, or of an earlier one."""
    df = feature_table(spark, path).read(None if source is None else [source], version)
    if names is not None:
        df = df.where(F.col("feature_name").isin(list(names)))
    return df


def replace_source(batch: DataFrame, path: str, source: str, version: str = "v1") -> int:
    """Idempotent reload of a source: all it held before goes, also if the batch is empty; other sources stay."""
    return feature_table(batch.sparkSession, path).replace(stamp_features(batch, source, version), source)


def replace_ticker_source(batch: DataFrame, path: str, source: str, version: str = "v1", tickers: DataFrame | None = None) -> int:
    """Reload of a source for ``tickers`` (those of the batch if not given); returns the rows written.

    A ticker that is reloaded without any row ends up empty. Only the batch is written.
    """
    asked = batch.select("ticker") if tickers is None else tickers
    return feature_table(batch.sparkSession, path).replace_tickers(stamp_features(batch, source, version), source, asked)


def without_ticker_source(stored: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored rows minus those of the (ticker, source) pairs being replaced."""
    return stored.join(replaced.select("ticker", "source").distinct(), ["ticker", "source"], "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, keys, version: str) -> DataFrame:
    """Latest version per key of the union; a tie goes to the batch."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_side"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def insert_absent(existing: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Batch rows whose key the table does not hold."""
    return batch.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def save_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def bars_to_features(bars: DataFrame) -> DataFrame:
    """Raw bars as px_* feature rows, NULLs dropped. Bars that are partitioned by ticker stay so."""
    each = F.array(*[F.struct(F.lit(f"px_{c}").alias("feature_name"), F.col(c).cast("double").alias("feature_value")) for c in PX_COLUMNS])
    long = bars.select("ticker", "effective_date", F.inline(each))
    return long.where(F.col("feature_value").isNotNull()).withColumn("knowledge_date", F.col("effective_date"))


def features_to_bars(features: DataFrame, lookback: int = 504, min_rows: int = 60) -> DataFrame:
    """Complete candles back from px_* rows: the last ``lookback`` per ticker, tickers
    with fewer than ``min_rows`` candles left out.

    The rows of a candle are merged before any exchange, and in buffers of fixed width,
    which keeps this a hash aggregate. Rows that are partitioned by ticker stay where they are.
    """
    name, value = F.col("feature_name"), F.col("feature_value")
    # The first row of a name decides, also if its value is NULL.
    merged = features.where(name.startswith("px_")).groupBy("ticker", "effective_date").agg(
        *[F.first(F.when(name == f"px_{c}", value), ignorenulls=True).alias(f"px_{c}") for c in PX_COLUMNS],
        *[F.first(F.when(name == f"px_{c}", value.isNull()), ignorenulls=True).alias(f"_null_{c}") for c in PX_COLUMNS],
    )
    wide = merged.select("ticker", "effective_date", *[F.when(~F.col(f"_null_{c}"), F.col(f"px_{c}")).alias(f"px_{c}") for c in PX_COLUMNS]).dropna()
    newest = Window.partitionBy("ticker").orderBy(F.desc("effective_date"))
    df = wide.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= lookback)
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_n") >= min_rows)
    return df.select("ticker", "effective_date", *[F.col(f"px_{c}").alias(c) for c in PX_COLUMNS])


def with_live_edge(archive: DataFrame, edge: DataFrame) -> DataFrame:
    """Archive plus the one newest edge bar per ticker that the archive lacks, flagged."""
    columns = ["ticker", "effective_date", *PX_COLUMNS]
    last = archive.groupBy("ticker").agg(F.max("effective_date").alias("_last"))
    newer = (
        edge.join(last, "ticker")
        .where(F.col("effective_date") > F.col("_last"))
        .groupBy("ticker")
        .agg(F.max_by(F.struct(*columns[1:]), "effective_date").alias("bar"))
        .select("ticker", "bar.*")
    )
    return archive.select(*columns).withColumn("live_edge", F.lit(False)).unionByName(
        newer.withColumn("live_edge", F.lit(True))
    )


def known_reason() -> Column:
    return F.coalesce(F.col("termination_reason").isin(*TERMINATION_REASONS), F.lit(False))


def split_delisted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by termination reason."""
    return rows.where(known_reason()), rows.where(~known_reason())


def drop_synthetic(rows: DataFrame, prefix: str = "DEL") -> DataFrame:
    return rows.where(~F.col("ticker").startswith(prefix))


def log_executions(runs: DataFrame, path: str, run: str | None = None) -> int:
    """Append execution records and return how many the log then holds.

    With ``run``, the name of an attempt, a record's id is a hash of it and of the
    record, so an attempt that is logged again after a failure counts once.
    """
    if run is None:
        execution = F.uuid()
    else:
        execution = F.sha1(F.to_json(F.struct(F.lit(run).alias("run"), F.struct(*runs.columns).alias("record")), {"ignoreNullFields": "false"}))
    runs.withColumns({"execution_id": execution, "executed_at": F.current_timestamp()}).write.mode("append").parquet(path)
    return trial_count(runs.sparkSession, path)


def trial_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).select("execution_id").distinct().count()


def store_window(features: DataFrame) -> DataFrame:
    """Rows, tickers, features and first and last date of the store, one row."""
    return features.groupBy().agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.countDistinct("feature_name").alias("n_features"),
        F.min("effective_date").alias("first_date"),
        F.max("effective_date").alias("last_date"),
    )
