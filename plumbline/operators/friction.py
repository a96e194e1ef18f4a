"""Intraday and daily friction z-scores and the composite stress gauge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.dates import time_bucket
from plumbline.functions.stats import exact_percentiles, robust_z
from plumbline.operators.features import amihud, corwin_schultz
from plumbline.operators.quality import suppression
from plumbline.session import materialise

# fixed values
ALERT_Z = 2.5
MIN_BASELINE = 10
MIN_BARS = 21
MIN_FINITE = 5
MEASURES = ("spread_bps", "volume", "realized_vol")
# fixed values: (feature, label, weight, inverted, already a percentile)
STRESS_COMPONENTS = (
    ("vix_percentile_63d", "VIX percentile", 0.35, False, True),
    ("hy_spread_roc_21d", "HY-OAS momentum", 0.25, False, False),
    ("realized_vol_21d", "Realised vol (avg)", 0.25, False, False),
    ("yield_curve_slope", "Curve inversion", 0.15, True, False),
)
MIN_STRESS_DATES = 30


def robust_stats(rows: DataFrame, keys, value: str = "value") -> DataFrame:
    """Median and median absolute deviation per key, whatever the size of a key."""
    keys = list(keys)
    rows = materialise(rows.select(*keys, value), "robust-rows")
    centre = exact_percentiles(rows, keys, value, {"median": 0.5})
    gaps = rows.join(centre, keys).withColumn("_gap", F.abs(F.col(value) - F.col("median")))
    mad = exact_percentiles(gaps, keys, "_gap", {"mad": 0.5})
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n_baseline"))
    return centre.join(mad, keys).join(sizes, keys)


def _long(quotes: DataFrame, ids) -> DataFrame:
    return quotes.select(
        *ids, *[F.col(m).cast("double").alias(m) for m in MEASURES]
    ).unpivot(list(ids), list(MEASURES), "measure", "value")


def friction_baseline(quotes: DataFrame) -> DataFrame:
    """(ticker, bucket, measure, median, mad, n_baseline) of historical quotes."""
    rows = quotes.withColumn("bucket", time_bucket(F.col("ts")))
    return robust_stats(_long(rows, ["ticker", "bucket"]), ["ticker", "bucket", "measure"])


def baseline_wide(baseline: DataFrame) -> DataFrame:
    """One row per (ticker, bucket): tickers x four buckets, so small by construction."""
    return baseline.groupBy("ticker", "bucket").agg(
        F.max("n_baseline").alias("n_baseline"),
        *[
            F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
            for m in MEASURES
            for c in ("median", "mad")
        ],
    )


def score_quotes(quotes: DataFrame, wide: DataFrame, calendar: DataFrame | None = None, threshold: float = ALERT_Z) -> DataFrame:
    """z of each quote against its (ticker, bucket) baseline; works on streams too."""
    df = quotes.withColumns(
        {"bucket": time_bucket(F.col("ts")), "effective_date": F.to_date("ts")}
    ).join(wide, ["ticker", "bucket"], "left")
    if calendar is not None:
        df = suppression(df, calendar)
    else:
        df = df.withColumns({"reason": F.lit(None).cast("string"), "suppressed": F.lit(False)})
    enough = F.coalesce(F.col("n_baseline"), F.lit(0)) >= MIN_BASELINE
    status = (
        F.when(F.col("suppressed"), "SUPPRESSED").when(~enough, "INSUFFICIENT_DATA").otherwise("OK")
    )
    df = df.withColumn("status", status)
    ok = F.col("status") == "OK"
    for m in MEASURES:
        z = robust_z(F.col(m), F.col(f"median_{m}"), F.col(f"mad_{m}"))
        df = df.withColumn(f"{m}_z", F.when(ok, z))
    biggest = F.greatest(*[F.abs(f"{m}_z") for m in MEASURES])
    return df.withColumn("max_abs_z", biggest).withColumn(
        "alert", F.coalesce(F.col("max_abs_z") >= threshold, F.lit(False))
    )


def friction_proxy(bars: DataFrame) -> DataFrame:
    """Per ticker: robust z of the last illiquidity value and the last spread estimate.

    Only the illiquidity z drives the alert. Groups are one ticker's daily bars.
    """
    df = corwin_schultz(amihud(bars))
    last = df.groupBy("ticker").agg(
        F.count("*").alias("n_bars"),
        F.count("amihud").alias("_finite"),
        F.percentile("amihud", 0.5).alias("_median"),
        F.max_by("amihud", "effective_date").alias("_last"),
        F.max_by("cs_spread", "effective_date").alias("_cs"),
        F.max("effective_date").alias("on_date"),
    )
    gaps = (
        df.select("ticker", "amihud").join(last.select("ticker", "_median"), "ticker")
        .groupBy("ticker").agg(F.percentile(F.abs(F.col("amihud") - F.col("_median")), 0.5).alias("_mad"))
    )
    df = last.join(gaps, "ticker")
    enough = F.col("n_bars") >= MIN_BARS
    z = F.when(
        enough & (F.col("_finite") >= MIN_FINITE), robust_z(F.col("_last"), F.col("_median"), F.col("_mad"))
    ).otherwise(0.0)
    return df.select(
        "ticker", "on_date", "n_bars",
        F.when(enough, "OK").otherwise("INSUFFICIENT_DATA").alias("status"),
        z.alias("amihud_z"),
        F.when(enough, F.coalesce("_cs", F.lit(0.0))).otherwise(0.0).alias("cs_spread_execution_proxy"),
        z.alias("anomaly_score"),
        (enough & (F.abs(z) >= ALERT_Z)).alias("alert"),
    )


def friction(mode: str, **inputs) -> DataFrame:
    """Daily proxy in lite mode, intraday scores otherwise."""
    if mode == "lite":
        return friction_proxy(inputs["bars"])
    return score_quotes(inputs["quotes"], inputs["baseline"], inputs.get("calendar"))


def stress_components(long: DataFrame) -> DataFrame:
    """Per component: latest value, percentile of it and the weighted 0-100 reading.

    Universe means come first, so what follows has one row per feature and date.
    """
    names = [c[0] for c in STRESS_COMPONENTS]
    means = (
        long.where(F.col("feature_name").isin(names))
        .groupBy("feature_name", "effective_date")
        .agg(F.avg("feature_value").alias("value"))
    )
    w = Window.partitionBy("feature_name")
    latest = F.max_by("value", "effective_date").over(w)
    by_feature = means.withColumn("_latest", latest).groupBy("feature_name").agg(
        F.count("*").alias("n_dates"),
        F.first("_latest").alias("latest"),
        F.avg((F.col("value") <= F.col("_latest")).cast("double")).alias("_rank"),
    )

    def table(i):
        return F.create_map(*[F.lit(x) for c in STRESS_COMPONENTS for x in (c[0], c[i])])[F.col("feature_name")]

    pct = F.when(table(4), F.col("latest")).otherwise(F.col("_rank"))
    pct = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pct))
    pct = F.when(table(3), 1 - pct).otherwise(pct)
    return by_feature.where(F.col("n_dates") >= MIN_STRESS_DATES).select(
        table(1).alias("component"), table(2).alias("weight"), "n_dates", "latest",
        F.bround(pct * 100, 1).alias("value"),
    )


def stress_gauge(components: DataFrame) -> DataFrame:
    """Composite over the components present, weights renormalised, with its level."""
    total = components.groupBy().agg(
        F.bround(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), 1).alias("composite"),
        F.count("*").alias("n_components"),
    )
    c = F.col("composite")
    level = F.when(c < 25, "calm").when(c < 50, "normal").when(c < 75, "elevated").otherwise("stressed")
    return total.where(F.col("n_components") > 0).withColumn("level", level)
