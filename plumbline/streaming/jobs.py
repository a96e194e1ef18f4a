"""Structured Streaming jobs: live friction alerts and landing-folder bar ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import time_bucket
from plumbline.functions.stats import robust_z
from plumbline.operators import features as ft
from plumbline.operators import quality as ql
from plumbline.operators.friction import (
    ALERT_Z,
    MEASURES,
    MIN_BASELINE,
    _long,
    baseline_wide,
    robust_stats,
)
from plumbline.schemas import BARS
from plumbline.sources import store as st

WATERMARK = "10 minutes"
WINDOW = "15 minutes"


def windowed_quotes(quotes: DataFrame, window: str = WINDOW) -> DataFrame:
    """Per ticker and tumbling window: mean spread, total volume, mean volatility.

    The same reduction feeds the baseline (batch) and the alerts (stream). A window
    lies inside one time-of-day bucket because bucket borders are window borders.
    """
    return (
        quotes.groupBy("ticker", F.window("ts", window))
        .agg(
            F.avg("spread_bps").alias("spread_bps"),
            F.sum("volume").alias("volume"),
            F.avg("realized_vol").alias("realized_vol"),
            F.count("*").alias("n_quotes"),
        )
        .select(
            "ticker", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            time_bucket(F.col("window.start")).alias("bucket"), *MEASURES, "n_quotes",
        )
    )


def window_baseline(history: DataFrame, window: str = WINDOW) -> DataFrame:
    """One row per (ticker, bucket) with median and deviation of each measure."""
    rows = windowed_quotes(history, window)
    return baseline_wide(robust_stats(_long(rows, ["ticker", "bucket"]), ["ticker", "bucket", "measure"]))


def scored_windows(rows: DataFrame, baseline: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Windows with the z-scores of their measures; no alert on a day that the calendar holds back."""
    df = rows.join(baseline, ["ticker", "bucket"], "left").withColumn("_day", F.to_date("window_start"))
    if calendar is None:
        df = df.withColumns({"reason": F.lit(None).cast("string"), "suppressed": F.lit(False)})
    else:
        df = ql.suppression(df, calendar, "_day")
    enough = F.coalesce(F.col("n_baseline"), F.lit(0)) >= MIN_BASELINE
    for m in MEASURES:
        z = robust_z(F.col(m), F.col(f"median_{m}"), F.col(f"mad_{m}"))
        df = df.withColumn(f"{m}_z", F.when(enough, z))
    biggest = F.greatest(*[F.abs(f"{m}_z") for m in MEASURES])
    return df.select(
        "ticker", "window_start", "window_end", "bucket", "n_quotes",
        F.when(F.col("suppressed"), "SUPPRESSED").when(enough, "OK").otherwise("INSUFFICIENT_DATA").alias("status"), "reason",
        *[f"{m}_z" for m in MEASURES], biggest.alias("max_abs_z"),
        (F.coalesce(biggest >= ALERT_Z, F.lit(False)) & ~F.col("suppressed")).alias("alert"),
    )


def friction_alerts(
    quotes: DataFrame, baseline: DataFrame, calendar: DataFrame | None = None, window: str = WINDOW, watermark: str = WATERMARK,
) -> DataFrame:
    """Scored windows of a quote stream.

    State is one row per open (ticker, window); windows close and leave the state
    once the watermark passes, rows later than that are dropped and show up in the
    query's progress (``late_rows``). Baseline and calendar are static sides, re-read
    at every micro-batch.
    """
    return scored_windows(windowed_quotes(quotes.withWatermark("ts", watermark), window), baseline, calendar)


def start_alerts(quotes: DataFrame, baseline: DataFrame, out: str, checkpoint: str, calendar: DataFrame | None = None, **trigger):
    """Append the scored windows to a parquet folder."""
    return (
        friction_alerts(quotes, baseline, calendar)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def late_rows(query) -> int:
    """Rows that a finished or running query dropped as too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def open_windows(
    quotes: DataFrame, baseline: DataFrame, calendar: DataFrame | None = None, window: str = WINDOW, watermark: str = WATERMARK,
) -> DataFrame:
    """Scores of the windows that a stream over all of ``quotes`` has not closed, to be added when its input has ended.

    Only rows as new as an open window are aggregated.
    """
    newest = F.expr(f"max(ts) - INTERVAL {watermark}")
    mark = quotes.agg(newest).first()[0]
    if mark is None:
        return scored_windows(windowed_quotes(quotes, window), baseline, calendar)
    recent = quotes.where(F.col("ts") >= F.lit(mark) - F.expr(f"INTERVAL {window}"))
    rows = windowed_quotes(recent, window).where(F.col("window_end") > F.lit(mark))
    return scored_windows(rows, baseline, calendar)


class BarIngest:
    """Landing-folder ingest: bars in, features, audit and list status out.

    Every delivered bar is kept under its batch and a hash bucket of its ticker; of
    several bars of one (ticker, day) the one delivered last counts, however old the
    day is. A batch reads the buckets of its tickers only and writes features from
    the first day that its bars can change on.

    Every output row carries its batch id, and a batch writes each of its folders
    with overwrite, so a batch run again after a failure replaces itself.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str, watchlist: DataFrame | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.watchlist = watchlist

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("ticker"), F.lit(self.BUCKETS)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path(table)}/batch_id={batch_id}"
        )

    def read(self, table: str, columns=None) -> DataFrame | None:
        return st.load_snapshot(self.spark, self.path(table))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            good, bad = ql.split_bars(batch)
            self._write(good, "bars", batch_id)
            self._write(bad.drop("landed", "file"), "quarantine", batch_id)
            touched = good.groupBy("ticker").agg(F.min("effective_date").alias("_from"))
            asked = batch.select("ticker") if self.watchlist is None else self.watchlist.select("ticker").union(batch.select("ticker"))
            audit = ql.fetch_audit(asked, batch, self._day(batch)).withColumn(
                "list_status", F.when(F.col("status") == "MISSING", "error").otherwise("ready")
            )
            self._write(audit, "audit", batch_id)
            history = self.current_bars(touched)
            if history is None:
                return
            features = ft.known_features(ft.ohlcv_features(history))
            # A label looks ahead, so the rows before the first new day may change as well.
            place = ft.series()
            day = history.join(touched, "ticker").withColumn("_ahead", F.lead("effective_date", ft.FORWARD_ROWS).over(place))
            first = day.where(F.coalesce(F.col("_ahead") >= F.col("_from"), F.lit(True))).groupBy("ticker").agg(
                F.min("effective_date").alias("_first")
            )
            changed = features.join(first, "ticker").where(F.col("effective_date") >= F.col("_first")).drop("_first")
            self._write(changed, "features", batch_id)
        finally:
            batch.unpersist()

    @staticmethod
    def _day(batch: DataFrame):
        return batch.agg(F.max("effective_date")).first()[0]

    def current_bars(self, tickers: DataFrame | None = None) -> DataFrame | None:
        """The bar delivered last of each (ticker, day), of all tickers or of those given."""
        rows = self.read("bars")
        if rows is None:
            return None
        if tickers is not None:
            bucket = F.pmod(F.xxhash64("ticker"), F.lit(self.BUCKETS)).cast("int")
            wanted = [r[0] for r in tickers.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS numbers
            rows = rows.where(F.col("bucket").isin(wanted)).join(tickers.select("ticker"), "ticker", "left_semi")
        delivered = F.struct("batch_id", "landed", "file")
        return rows.groupBy("ticker", "effective_date").agg(
            F.max_by(F.struct("open", "high", "low", "close", "volume"), delivered).alias("bar")
        ).select("ticker", "effective_date", "bar.*")

    def start(self, landing: str, checkpoint: str, **trigger):
        bars = (
            self.spark.readStream.schema(BARS).parquet(landing)
            .withColumn("landed", F.col("_metadata.file_modification_time"))
            .withColumn("file", F.col("_metadata.file_name"))
        )
        return (
            bars.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def current_features(self) -> DataFrame:
        """Features of each (ticker, day) from the batch that wrote that day last."""
        rows = self.read("features")
        newest = rows.groupBy("ticker", "effective_date").agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, ["ticker", "effective_date", "batch_id"], "left_semi").drop("bucket")

    def current_status(self) -> DataFrame:
        """Per ticker: ready once any batch delivered it, error while none has; n_rows counts its days."""
        rows = self.read("audit")
        order = F.struct(F.col("list_status") == "ready", "batch_id")
        status = rows.groupBy("ticker").agg(
            F.max_by("list_status", order).alias("list_status"), F.max_by("status", order).alias("status"),
            F.sum("n_bad_rows").alias("n_bad_rows"),
        )
        bars = self.read("bars")
        days = bars.groupBy("ticker").agg(F.countDistinct("effective_date").alias("n_rows"))
        return status.join(days, "ticker", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
