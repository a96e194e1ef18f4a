"""Execution cost of orders against the book, whole and sliced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values
IMPACT = 0.1
FRICTION = 0.4


# fixed value: bars that a sliced order may use
SLICES = 20


def fill_costs(orders: DataFrame, impact: float = IMPACT, friction: float = FRICTION) -> DataFrame:
    """Cost of each order given bid, ask, order_size, adv, vol_z, spread_z on its row.

    Rows that no market could fill keep a status instead of figures.
    """
    bid, ask = F.col("bid"), F.col("ask")
    status = (
        F.when(~F.coalesce(F.col("direction").isin("buy", "sell"), F.lit(False)), "BAD_DIRECTION")
        .when(bid.isNull() | ask.isNull(), "NO_QUOTE")
        .when(ask < bid, "CROSSED_QUOTE")
        .when(~(F.col("order_size") > 0), "BAD_SIZE")
        .otherwise("OK")
    )
    df = orders.withColumn("status", status)
    ok = F.col("status") == "OK"
    mid = 0.5 * (bid + ask)
    df = df.withColumns(
        {
            "_mid": F.when(ok, mid),
            "spread_bps": F.when(ok, (ask - bid) / mid * 1e4),
            "_impact": F.when(
                ok, impact * F.sqrt(F.col("order_size") / F.greatest(F.col("adv"), F.lit(1.0)))
            ),
        }
    )
    extra = friction * (F.coalesce("vol_z", F.lit(0.0)) + F.coalesce("spread_z", F.lit(0.0))) * F.col("spread_bps")
    df = df.withColumn("friction_bps", F.when(ok, F.greatest(extra, F.lit(0.0))))
    drift = F.col("_mid") * F.col("friction_bps") / 1e4
    price = F.when(F.col("direction") == "buy", ask * (1 + F.col("_impact")) + drift).otherwise(
        bid * (1 - F.col("_impact")) - drift
    )
    df = df.withColumn("fill_price", F.when(ok, price))
    return df.withColumns(
        {
            "impact_bps": F.col("_impact") * 1e4,
            "slippage_bps": F.abs(F.col("fill_price") - F.col("_mid")) / F.col("_mid") * 1e4,
        }
    ).drop("_mid", "_impact")


def with_proxy(orders: DataFrame, proxy: DataFrame) -> DataFrame:
    """Lite mode: spread_z is the spread estimate, vol_z the illiquidity z, per ticker."""
    if "cs_spread_execution_proxy" not in proxy.columns:
        raise ValueError("fill costs need cs_spread_execution_proxy; amihud_z is no half-spread")
    p = proxy.select(
        "ticker", F.col("cs_spread_execution_proxy").alias("spread_z"), F.col("amihud_z").alias("vol_z")
    )
    return orders.drop("spread_z", "vol_z").join(p, "ticker", "left")


def sliced_costs(orders: DataFrame, bars: DataFrame, horizon: int = SLICES) -> DataFrame:
    """Average cost of an order cut into equal slices over its first bars.

    ``bars`` carry order_id, bar_no, bid, ask and volume; the volume of all bars of
    the order stands in for the daily volume.
    """
    w = Window.partitionBy("order_id")
    taken = (
        bars.withColumns(
            {
                "adv": F.greatest(F.sum("volume").over(w), F.lit(1.0)),
                "n_slices": F.least(F.count("*").over(w), F.lit(horizon)),
                "_r": F.row_number().over(w.orderBy("bar_no")),
            }
        )
        .where(F.col("_r") <= horizon)
        .select("order_id", "bid", "ask", "adv", "n_slices")
    )
    slices = taken.join(orders, "order_id").withColumn(
        "order_size", F.col("order_size") / F.col("n_slices")
    )
    return (
        fill_costs(slices)
        .groupBy("order_id")
        .agg(
            F.avg("fill_price").alias("avg_fill_price"),
            F.avg("slippage_bps").alias("avg_slippage_bps"),
            F.count("*").alias("n_slices_actual"),
        )
        .withColumn("n_slices_requested", F.lit(horizon))
    )
