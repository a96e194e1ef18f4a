"""Block-bootstrap forecasts whose draws are fixed by a hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values
LOOKBACK = 504
BLOCK = 5
PATHS = 500
HORIZONS = (1, 3, 5, 10)
MIN_RETURNS = BLOCK + 5


def return_history(rows: DataFrame, value: str = "ret_1d", lookback: int = LOOKBACK) -> DataFrame:
    """Per ticker, its last ``lookback`` returns in date order as one bounded array."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("effective_date"))
    kept = rows.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(newest)).where(
        F.col("_r") <= lookback
    )
    packed = F.array_sort(F.collect_list(F.struct("effective_date", value)))
    return kept.groupBy("ticker").agg(
        F.transform(packed, lambda s: s[value]).alias("returns"), F.max("effective_date").alias("as_of")
    )


def simulate(history: DataFrame, paths: int = PATHS, block: int = BLOCK, horizon: int = max(HORIZONS)) -> DataFrame:
    """One row per ticker and path: cumulative return after each step, and its volatility.

    A path is made of contiguous blocks whose starts are hashes of ticker, path and
    block number, so a rerun, on any cluster, draws the same paths.
    """
    n_blocks = -(-horizon // block)
    df = history.where(F.size("returns") >= block + 5).withColumn(
        "path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))
    )

    def start(b: int):
        text = F.concat_ws("|", "ticker", F.col("path").cast("string"), F.lit(str(b)))
        draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return (draw % (F.size("returns") - block + 1)).cast("int")

    df = df.withColumns({f"_s{b}": start(b) for b in range(n_blocks)})
    df = df.withColumns(
        {f"_r{i}": F.col("returns")[F.col(f"_s{i // block}") + i % block] for i in range(horizon)}
    ).drop("returns", *[f"_s{b}" for b in range(n_blocks)])
    cumulative, steps = F.lit(1.0), {}
    for i in range(horizon):
        cumulative = cumulative * (1 + F.col(f"_r{i}"))
        if i + 1 in HORIZONS or i + 1 == horizon:
            steps[f"cum_{i + 1}"] = cumulative - 1
    mean = sum((F.col(f"_r{i}") for i in range(horizon)), F.lit(0.0)) / horizon
    df = df.withColumn("_mean", mean)
    spread = sum(((F.col(f"_r{i}") - F.col("_mean")) * (F.col(f"_r{i}") - F.col("_mean")) for i in range(horizon)), F.lit(0.0))
    steps["sim_vol"] = F.sqrt(spread / horizon) * math.sqrt(252.0)
    return df.select("ticker", "as_of", "path", *[c.alias(n) for n, c in steps.items()])


def bands(sims: DataFrame, calibration: DataFrame | None = None, current_vol: DataFrame | None = None) -> DataFrame:
    """Per ticker and horizon: p5/p50/p95 widened around the median, with probabilities."""
    aggs = []
    for h in HORIZONS:
        aggs.append(F.percentile(f"cum_{h}", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(f"_q{h}"))
    last = max(HORIZONS)
    df = sims
    if current_vol is not None:
        df = df.join(current_vol.select("ticker", "current_vol"), "ticker", "left")
    else:
        df = df.withColumn("current_vol", F.lit(None).cast("double"))
    shifted = F.when(F.col("current_vol") > 0, (F.col("sim_vol") > F.col("current_vol")).cast("double"))
    out = df.groupBy("ticker", "as_of").agg(
        *aggs,
        F.avg((F.col(f"cum_{last}") > 0).cast("double")).alias("p_up"),
        F.avg(shifted).alias("p_vol_shift"),
    )
    if calibration is not None:
        out = out.join(calibration.select("ticker", "calib"), "ticker", "left").withColumn(
            "calib", F.coalesce("calib", F.lit(1.0))
        )
    else:
        out = out.withColumn("calib", F.lit(1.0))
    rows = F.array(
        *[F.struct(F.lit(h).alias("h"), F.col(f"_q{h}").alias("q")) for h in HORIZONS]
    )
    mid = F.col("b.q")[1]
    return out.withColumn("b", F.explode(rows)).select(
        "ticker", "as_of", F.col("b.h").alias("h"),
        (mid + (F.col("b.q")[0] - mid) * F.col("calib")).alias("p5"),
        mid.alias("p50"),
        (mid + (F.col("b.q")[2] - mid) * F.col("calib")).alias("p95"),
        "p_up", "p_vol_shift", "calib",
    )


def band_calibration(sims: DataFrame, labels: DataFrame, label: str = "ret_fwd_10d", min_labels: int = 30) -> DataFrame:
    """Per ticker, the factor that gives the bands the width of the realised returns."""
    last = max(HORIZONS)

    def width(c):
        return F.percentile(c, 0.95) - F.percentile(c, 0.05)

    model = sims.groupBy("ticker").agg(width(f"cum_{last}").alias("_model"))
    real = labels.where(F.col(label).isNotNull()).groupBy("ticker").agg(
        width(label).alias("_real"), F.count("*").alias("n_labels")
    )
    usable = (F.col("n_labels") > min_labels) & (F.col("_model") > 0) & (F.col("_real") > 0)
    ratio = F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.col("_real") / F.col("_model")))
    return model.join(real, "ticker", "left").select(
        "ticker", F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.when(F.coalesce(usable, F.lit(False)), ratio).otherwise(1.0).alias("calib"),
    )


def point_forecast(history: DataFrame, horizon: int = max(HORIZONS)) -> DataFrame:
    """Mean return of the lookback times the horizon."""
    total = F.aggregate("returns", F.lit(0.0), lambda a, x: a + x)
    drift = F.when(F.size("returns") > 0, total / F.size("returns") * horizon).otherwise(0.0)
    return history.select("ticker", "as_of", drift.alias("point_forecast"))
