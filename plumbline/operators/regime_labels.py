"""Rule-based market regimes and expectancy conditional on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import exact_percentiles
from plumbline.session import materialise

# fixed values: the five labels, their order is the state id
LABELS = ("Calm bull", "Volatile bull", "Range / chop", "Stressed bear", "Volatile bear")
MIN_ROWS = 10


def classify(vix_percentile: Column, ret: Column) -> Column:
    """First matching rule wins; a rising market in high volatility has no label."""
    v, r = vix_percentile, ret
    return (
        F.when((v < 0.33) & (r > 0.01), LABELS[0])
        .when((v >= 0.33) & (v < 0.66) & (r > 0.01), LABELS[1])
        .when(F.abs(r) <= 0.01, LABELS[2])
        .when((v >= 0.66) & (r <= -0.01), LABELS[3])
        .when(r <= -0.01, LABELS[4])
    )


def state_id(label: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)
    return F.when(found > 0, found - 1)


def market_states(region_features: DataFrame, macro_features: DataFrame) -> DataFrame:
    """(effective_date, regime, state) for the dates that carry a label."""
    trend = region_features.groupBy("effective_date").agg(F.avg("ret_21d").alias("market_ret_21d"))
    return (
        trend.join(macro_features.select("effective_date", "vix_percentile_63d"), "effective_date")
        .withColumn("regime", classify(F.col("vix_percentile_63d"), F.col("market_ret_21d")))
        .where(F.col("regime").isNotNull())
        .select("effective_date", "regime", state_id(F.col("regime")).alias("state"))
    )


def attach_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Regime of each row's date, unmatched rows dropped, plus the latest regime.

    The state path holds one row per calendar date, so it is broadcast
    whatever the number of tickers, and the rows stay where they are.
    """
    current = states.groupBy().agg(F.max_by("state", "effective_date").alias("query_state"))
    return rows.join(
        F.broadcast(states.select("effective_date", "state").join(F.broadcast(current), F.lit(True))), "effective_date"
    )


def conditional_expectancy(df: DataFrame, label: str, value: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Count, mean, median and hit rate of ``value`` per label, thin labels removed.

    A label may hold a third of all rows, so the median is selected by rank
    instead of being gathered in one task.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(label, value)
    rows = materialise(rows, "expectancy")
    stats = rows.groupBy(label).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
    )
    median = exact_percentiles(rows, [label], value, {"median": 0.5})
    return stats.join(median, label).where(F.col("n") >= min_rows)
