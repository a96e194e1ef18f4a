"""Streaming jobs run to completion over the supplied tables, and the gold table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import friction as fr
from plumbline.plans import gold, governance_plans, model_plans, portfolio_plans, risk_plans, validation_plans  # noqa: F401
from plumbline.plans.analog_plans import history
from plumbline.plans.registry import PLANS, plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.session import scratch
from plumbline.session import materialise
from plumbline.sources import tables as tb
from plumbline.streaming import jobs

part("quote_windows", "quotes", """
SELECT ticker, time_bucket(INTERVAL 15 MINUTES, ts) AS ws, avg(spread_bps) AS spread_bps, sum(volume) AS volume, avg(realized_vol) AS realized_vol, count(*) AS n_quotes, ts >= TIMESTAMP '2024-01-20' AS live
FROM quotes GROUP BY ticker, ws, live""")
_B = "CASE WHEN hour(ws) + minute(ws) / 60.0 < 10.5 THEN 'open' WHEN hour(ws) + minute(ws) / 60.0 < 14 THEN 'midday' WHEN hour(ws) + minute(ws) / 60.0 < 16 THEN 'close' ELSE 'after' END"
part("window_long", "quote_windows", " UNION ALL ".join(
    f"SELECT ticker, {_B} AS bucket, '{m}' AS measure, {m} AS value FROM quote_windows WHERE NOT live" for m in fr.MEASURES))
part("window_base", "window_long", """
SELECT ticker, bucket, measure, any_value(m) AS median, quantile_cont(abs(value - m), 0.5) AS mad, count(*) AS n FROM (
 SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY ticker, bucket, measure) AS m FROM window_long) GROUP BY 1, 2, 3""")
_Z = ", ".join(
    f"max(CASE WHEN measure = '{m}' THEN CASE WHEN mad > 0 THEN 0.6745 * (w.{m} - median) / mad ELSE 0 END END) AS {m}_z" for m in fr.MEASURES)


@plan("friction_alert_stream", "ticker:s window_start:s bucket:s n_quotes:i status:s reason:s spread_bps_z:f9 volume_z:f9 realized_vol_z:f9 alert:b", "ST1 P7",
      with_parts("window_base", f"""
, w AS (SELECT *, {_B} AS bucket FROM quote_windows WHERE live),
z AS (SELECT w.ticker, ws, any_value(w.bucket) AS bucket, any_value(n_quotes) AS n_quotes, max(n) AS n, {_Z} FROM w LEFT JOIN window_base b ON b.ticker = w.ticker AND b.bucket = w.bucket GROUP BY 1, 2)
SELECT ticker, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, bucket, n_quotes,
 CASE WHEN day(ws) % 5 = 2 THEN 'SUPPRESSED' WHEN coalesce(n, 0) >= 10 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status,
 CASE WHEN day(ws) % 5 = 2 THEN 'CPI release — friction alerts suppressed' END AS reason, spread_bps_z, volume_z, realized_vol_z,
 day(ws) % 5 <> 2 AND coalesce(n, 0) >= 10 AND greatest(abs(spread_bps_z), abs(volume_z), abs(realized_vol_z)) >= 2.5 AS alert FROM z"""))
def _(spark, sf_dir):
    """The stream, and the windows still open where its input ends."""
    quotes = tb.quotes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    calendar = quotes.select(F.to_date("ts").alias("event_date")).distinct().where(F.dayofmonth("event_date") % 5 == 2).select(
        "event_date", F.lit("cpi_day").alias("event"), F.lit(0).alias("position"))
    history = quotes.where("ts < TIMESTAMP '2024-01-20'")
    landing, base, out = scratch(spark, "quotes"), scratch(spark, "baseline"), scratch(spark, "alerts")
    quotes.where("ts >= TIMESTAMP '2024-01-20'").write.parquet(landing)
    jobs.window_baseline(history).write.parquet(base)
    stream = spark.readStream.schema(quotes.schema).parquet(landing)
    baseline = spark.read.parquet(base)
    days = materialise(calendar, "calendar")
    jobs.start_alerts(stream, baseline, out, scratch(spark, "checkpoint"), days).awaitTermination()
    rest = jobs.open_windows(spark.read.parquet(landing), baseline, days)
    return spark.read.parquet(out).unionByName(rest).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@plan("bar_ingest_stream", "ticker:s feature_name:s n:i total:f", "ST2",
      with_parts("long_region", "SELECT ticker, feature_name, count(*) AS n, sum(feature_value) AS total FROM long_region GROUP BY 1, 2"))
def _(spark, sf_dir):
    """Three deliveries: all but one name, with wrong closes; the name left out and the
    corrections, both older than what was delivered; and rows that were there before."""
    landing, root, checkpoint = scratch(spark, "landing"), scratch(spark, "ingest"), scratch(spark, "checkpoint")
    bars = tb.bars(spark, sf_dir, "region").select("ticker", "effective_date", "open", "high", "low", "close", "volume")
    late, wrong = F.col("ticker") == "EUROPE", F.dayofmonth("effective_date") == 15
    deliveries = (
        bars.where(~late).withColumn("close", F.when(wrong, F.col("low")).otherwise(F.col("close"))),
        bars.where(late | wrong),
        bars.where(F.dayofmonth("effective_date") == 20),
    )
    ingest = jobs.BarIngest(spark, root)
    for rows in deliveries:
        rows.write.mode("append").parquet(landing)
        ingest.start(landing, checkpoint).awaitTermination()
    return ingest.current_features().groupBy("ticker", "feature_name").agg(
        F.count("*").alias("n"), F.sum("feature_value").alias("total"))


# Sections of the gold table: the plan that fills it, the column that names an item, whether Layer 0 stands behind it.
SECTIONS = {
    "meta": ("gate_counts", "status", True), "market_state": ("recent_occupancy", "series_id", False),
    "assets": ("analog_watchlist", "ticker", False), "layers": ("sign_off", "layer_name", True),
    "health": ("data_health", "feed", True), "stress": ("stress_gauge", None, False),
    "calibration": ("calibration_cards", "label", True), "track_record": ("track_record", "item", True),
    "notes": ("newest_notes", "note_id", False), "changes": ("decision_changes", "ticker", False),
    "feed": ("paper_feed", "entry_id", False), "journal": ("journal_closed", "entry_id", False),
    "portfolio": ("scenario_stress", "portfolio_id", False), "clusters": ("correlation_clusters", "component", False),
    "alerts": ("top_alerts", "alert_id", False), "contradictions": ("contradictions", "feature_a", False),
    "unknowns": ("unknowns", "ticker", False),
}


def gold_sql() -> str:
    """Items of every section from the SQL of the plan that fills it."""
    found = [
        f"SELECT '{section}' AS section, {f'CAST({item} AS VARCHAR)' if item else chr(39) + 'all' + chr(39)} AS item, {str(ok).lower()} AS validated FROM ({PLANS[name].sql}) AS s_{section}"
        for section, (name, item, ok) in SECTIONS.items()
    ]
    return with_parts("hist", f"""
SELECT (SELECT max(effective_date) FROM hist) AS as_of, section, item, validated, count(*) AS n_documents, count(*) AS n_filled FROM ({' UNION ALL '.join(found)}) GROUP BY ALL""")


@plan("gold_documents", "as_of:d section:s item:s validated:b n_documents:i n_filled:i", "S17 X6 Q13", gold_sql())
def _(spark, sf_dir):
    sections = {section: (PLANS[name].run(spark, sf_dir), item, ok) for section, (name, item, ok) in SECTIONS.items()}
    as_of = history(spark, sf_dir).groupBy().agg(F.max("effective_date").alias("as_of"))
    documents = materialise(gold.build(as_of, sections), "gold")
    return documents.groupBy("as_of", "section", "item", "validated").agg(
        F.count("*").alias("n_documents"), F.count_if(F.length("document") > 2).alias("n_filled"))
