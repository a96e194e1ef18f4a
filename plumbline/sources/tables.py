"""Market tables derived from the supplied star-schema parquet.

Bars are keyed by (ticker, effective_date), so whatever the size of the raw
trades a ticker never holds more rows than there are trading days. Window
partitions keyed by ticker are therefore bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import stored_once, stored_or

# fixed values: macro series served by each order priority
MACRO_SERIES = {
    "1-URGENT": "DGS10",
    "2-HIGH": "DGS2",
    "3-MEDIUM": "BAMLH0A0HYM2",
    "4-NOT SPECIFIED": "VIXCLS",
    "5-LOW": "BAMLC0A0CM",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced trades with a single sortable long as their order of arrival."""
    arrival = F.expr(
        "(l_orderkey * 8 + l_linenumber) * 1048576"
        " + (l_partkey * 7919 + l_suppkey * 104729"
        " + cast(round(l_extendedprice * 100) as bigint)) % 1048576"
    )
    return read(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("effective_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        arrival.alias("arrival"),
    )


def _roll_up(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by("open", "first_arrival").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_arrival").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("n_trades").alias("n_trades"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, day) with the names of its nation and region.

    Trades are reduced to one row per (supplier, day) with map-side combine
    before any join, so a supplier holding a third of the trades shuffles no
    more rows than any other. The aggregates keep fixed-width buffers, which
    keeps this stage a hash aggregate.
    """
    rows = trades(spark, sf_dir).groupBy("l_suppkey", "effective_date").agg(
        F.min_by("px", "arrival").alias("open"),
        F.min("arrival").alias("first_arrival"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "arrival").alias("close"),
        F.max("arrival").alias("last_arrival"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("n_trades"),
    )
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = (
        rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    return named.select(
        F.col("s_name").alias("supplier"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        "effective_date", "open", "first_arrival", "high", "low", "close", "last_arrival", "volume", "n_trades",
    )


def bars(spark: SparkSession, sf_dir: str, entity: str = "supplier", keep: bool = True) -> DataFrame:
    """Daily OHLCV bars per supplier, nation or region, rolled up from the stored daily rows.

    The trades are read once per application; every plan after the first starts
    from at most one row per (supplier, day). Without ``keep`` the rows are not
    written if no plan has done so yet, and only the columns asked for are aggregated.
    """
    if entity not in ("supplier", "nation", "region"):
        raise ValueError(f"unknown entity {entity!r}")
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    stored = (stored_once if keep else stored_or)(spark, "daily-bars", inputs, lambda: daily(spark, sf_dir))
    rows = stored.where(F.col(entity).isNotNull()).withColumnRenamed(entity, "ticker")
    columns = ["ticker", "effective_date", "open", "high", "low", "close", "volume", "n_trades"]
    return rows.select(*columns) if entity == "supplier" else _roll_up(rows, ["ticker", "effective_date"]).select(*columns)


def closing(spark: SparkSession, sf_dir: str, entity: str = "supplier") -> DataFrame:
    """(ticker, effective_date, close, volume) of the supplier or region bars.

    For plans that read suppliers and regions and need no other column: where no plan has
    stored the daily bars, only these columns of them are written, once per application.
    """
    if entity not in ("supplier", "region"):
        raise ValueError(f"unknown entity {entity!r}")
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    kept = ["supplier", "region", "effective_date", "close", "last_arrival", "volume"]
    stored = stored_or(
        spark, "daily-bars", inputs, lambda: stored_once(spark, "daily-closing", inputs, lambda: daily(spark, sf_dir).select(*kept)))
    rows = stored.where(F.col(entity).isNotNull()).withColumnRenamed(entity, "ticker")
    if entity == "region":
        rows = rows.groupBy("ticker", "effective_date").agg(
            F.max_by("close", "last_arrival").alias("close"), F.sum("volume").alias("volume"))
    return rows.select("ticker", "effective_date", "close", "volume")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, effective_date, close) of the supplier bars, straight from the trades where no plan has stored the bars.

    For tables that need nothing else of the bars and are stored themselves: only the closing
    price is aggregated, and the daily rows are not written first.
    """
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    rows = stored_or(spark, "daily-bars", inputs, lambda: daily(spark, sf_dir)).where(F.col("supplier").isNotNull())
    return rows.select(F.col("supplier").alias("ticker"), "effective_date", "close")


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, ticker, etf): each supplier with the region it belongs to."""
    return (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("s_name").alias("ticker"), F.col("r_name").alias("etf"))
    )


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_regions(spark, sf_dir).select("ticker", "etf")


def _macro_name() -> Column:
    pairs = [F.lit(x) for item in MACRO_SERIES.items() for x in item]
    return F.create_map(*pairs)[F.col("o_orderpriority")]


def _mean_of_cents(cents: Column, n: Column) -> Column:
    return cents / F.lit(100.0) / n


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, effective_date, value). Sums run over integer cents, so the
    value does not depend on the order in which partitions are merged."""
    return (
        read(spark, sf_dir, "orders")
        .groupBy(
            _macro_name().alias("series_id"), F.to_date("o_orderdate").alias("effective_date")
        )
        .agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
            F.count("*").alias("n"),
        )
        .select(
            "series_id", "effective_date", _mean_of_cents(F.col("cents"), F.col("n")).alias("value")
        )
    )


def macro_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vintages per observation: a first print over part of the orders, valid
    on its own day and the next, and the full figure from two days later on."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    early = F.col("o_custkey") % 2 == 0
    sums = (
        read(spark, sf_dir, "orders")
        .groupBy(_macro_name().alias("series_id"), F.to_date("o_orderdate").alias("obs_date"))
        .agg(
            F.sum(F.when(early, cents)).alias("c0"),
            F.count_if(early).alias("n0"),
            F.sum(cents).alias("c1"),
            F.count("*").alias("n1"),
        )
    )
    prints = F.array(
        F.struct(
            F.col("obs_date").alias("realtime_start"),
            F.date_add("obs_date", 1).alias("realtime_end"),
            F.when(F.col("n0") > 0, _mean_of_cents(F.col("c0"), F.col("n0"))).alias("value"),
        ),
        F.struct(
            F.date_add("obs_date", 2).alias("realtime_start"),
            F.lit("9999-12-31").cast("date").alias("realtime_end"),
            _mean_of_cents(F.col("c1"), F.col("n1")).alias("value"),
        ),
    )
    return sums.select("series_id", "obs_date", F.inline(prints))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday quotes per event type; rows without a positive price are dropped."""
    k = F.get_json_object("props", "$.k").cast("double")
    return (
        read(spark, sf_dir, "events")
        .where(F.col("value") > 0)
        .select(
            "event_id",
            F.col("event_type").alias("ticker"),
            "ts",
            "user_id",
            F.col("value").alias("mid"),
            (F.col("value") * (1 - k / 20000.0)).alias("bid"),
            (F.col("value") * (1 + k / 20000.0)).alias("ask"),
            k.alias("spread_bps"),
            (F.col("user_id") % 97 + 1).cast("double").alias("volume"),
            ((F.col("event_id") * 7919 % 1000) / 1000.0).alias("realized_vol"),
        )
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade journal: one entry per order, one trader per customer."""
    key = F.col("o_orderkey")
    closed = F.col("o_orderstatus") != "P"
    entry = F.to_date("o_orderdate")
    horizon = (key % 30).cast("int")
    direction = (
        F.when(key % 97 == 0, "hold")
        .when(key % 3 == 0, "long")
        .when(key % 3 == 1, "short")
        .otherwise("avoided")
    )
    return read(spark, sf_dir, "orders").select(
        key.cast("string").alias("entry_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        entry.alias("entry_date"),
        direction.alias("direction"),
        F.when(key % 89 == 0, " ").otherwise(F.concat(F.lit("thesis "), key)).alias("thesis"),
        horizon.alias("expected_horizon"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("confidence_self"),
        F.when(F.col("o_orderstatus") == "F", 0)
        .when(F.col("o_orderstatus") == "O", 1)
        .alias("market_state_id"),
        F.when(closed, F.date_add(entry, horizon)).alias("exit_date"),
        F.when(closed, (key * 7919 % 2001 - 1000) / 10000.0).alias("pnl_pct"),
        F.when(closed, key * 104729 % 3 != 0).alias("thesis_validated"),
        F.when(closed, F.lit("horizon")).alias("exit_reason"),
    )


def paper_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed journal entries attributed to a layer by their confidence."""
    return (
        journal(spark, sf_dir)
        .where(F.col("pnl_pct").isNotNull())
        .select(
            F.col("entry_id").cast("long").alias("trade_id"),
            F.concat(F.lit("layer"), F.col("confidence_self")).alias("layer_attributed_to"),
            "entry_date",
            "exit_date",
            "pnl_pct",
        )
    )
