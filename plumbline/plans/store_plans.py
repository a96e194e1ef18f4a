"""Plans for landed files, the feature store, data quality and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates as dt
from plumbline.operators import features as ft
from plumbline.operators import pit
from plumbline.operators import quality as ql
from plumbline.plans.feature_plans import W, WIDER_THAN_TRADES, long, long_of
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.plans.validation_plans import delisted, fetch_audit
from plumbline.session import scratch, spread, stored_or
from plumbline.sources import landing as ld
from plumbline.sources import store as st
from plumbline.sources import tables as tb


# ---- bitemporal rows: each value is known a day later, some are revised three days on
part("pit", "long_supplier", """
SELECT ticker, effective_date, effective_date + 1 AS knowledge_date, feature_name, feature_value FROM long_supplier
UNION ALL SELECT ticker, effective_date, effective_date + 4, feature_name, feature_value * 1.01 FROM long_supplier WHERE day(effective_date) % 5 = 0""")
part("requests", "", """
SELECT o_orderkey AS request_id, printf('Supplier#%09d', o_custkey % 100) AS ticker, CAST(o_orderdate AS DATE) AS as_of,
 CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN 'ret_21d' WHEN 1 THEN 'rsi_14' ELSE 'realized_vol_21d' END AS feature_name,
 CAST(o_orderdate AS DATE) - 30 AS effective_cap FROM orders""")


def pit_rows(spark, sf_dir, rows=None):
    rows = long(spark, sf_dir) if rows is None else rows

    def known(days, value):
        return F.struct(F.date_add("effective_date", days).alias("knowledge_date"), value.alias("feature_value"))

    # Both kinds of rows in one pass, which leaves the partitioning as it is.
    first, revised = known(1, F.col("feature_value")), known(4, F.col("feature_value") * 1.01)
    prints = F.when(F.dayofmonth("effective_date") % 5 == 0, F.array(first, revised)).otherwise(F.array(first))
    return rows.select("ticker", "effective_date", "feature_name", F.inline(prints))


def requests(spark, sf_dir):
    k = F.col("o_orderkey")
    return tb.read(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.format_string("Supplier#%09d", F.col("o_custkey") % 100).alias("ticker"),
        F.to_date("o_orderdate").alias("as_of"),
        F.when(k % 3 == 0, "ret_21d").when(k % 3 == 1, "rsi_14").otherwise("realized_vol_21d").alias("feature_name"),
        F.date_sub(F.to_date("o_orderdate"), 30).alias("effective_cap"))


@plan("as_of_lookup", "request_id:i ticker:s feature_name:s as_of:d feature_value:f", "J1",
      with_parts("pit requests", """
SELECT request_id, any_value(r.ticker) AS ticker, any_value(r.feature_name) AS feature_name, any_value(as_of) AS as_of,
 arg_max(feature_value, {'k': knowledge_date, 'e': effective_date}) AS feature_value
FROM requests r LEFT JOIN pit p ON p.ticker = r.ticker AND p.feature_name = r.feature_name AND p.knowledge_date < as_of AND p.effective_date <= as_of GROUP BY 1"""))
def _(spark, sf_dir):
    asked = requests(spark, sf_dir)
    return pit.as_of_lookup(asked, pit_rows(spark, sf_dir, long_of(spark, sf_dir, asked)))


@plan("as_of_lookup_capped", "request_id:i ticker:s feature_name:s as_of:d feature_value:f", "J1",
      with_parts("pit requests", """
SELECT request_id, any_value(r.ticker) AS ticker, any_value(r.feature_name) AS feature_name, any_value(as_of) AS as_of,
 arg_max(feature_value, {'k': knowledge_date, 'e': effective_date}) AS feature_value
FROM requests r LEFT JOIN pit p ON p.ticker = r.ticker AND p.feature_name = r.feature_name AND p.knowledge_date < as_of AND p.effective_date <= effective_cap GROUP BY 1"""))
def _(spark, sf_dir):
    return pit.as_of_lookup_capped(requests(spark, sf_dir), pit_rows(spark, sf_dir))


NAMES = ("ret_21d", "rsi_14", "realized_vol_21d", "pct_above_ma50")


@plan("lagged_history", "ticker:s effective_date:d ret_21d:f rsi_14:f realized_vol_21d:f pct_above_ma50:f", "J2 Q5",
      with_parts("pit", """
SELECT ticker, effective_date, arg_max(feature_value, knowledge_date) FILTER (WHERE feature_name = 'ret_21d') AS ret_21d,
 arg_max(feature_value, knowledge_date) FILTER (WHERE feature_name = 'rsi_14') AS rsi_14,
 arg_max(feature_value, knowledge_date) FILTER (WHERE feature_name = 'realized_vol_21d') AS realized_vol_21d,
 arg_max(feature_value, knowledge_date) FILTER (WHERE feature_name = 'pct_above_ma50') AS pct_above_ma50
FROM pit WHERE effective_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND knowledge_date <= DATE '1999-12-31'
 AND feature_name IN ('ret_21d', 'rsi_14', 'realized_vol_21d', 'pct_above_ma50') GROUP BY 1, 2"""))
def _(spark, sf_dir):
    return pit.feature_history(pit_rows(spark, sf_dir), NAMES, "1998-01-01", "1999-12-31", "1999-12-31")


@plan("vintage_values", "series_id:s obs_date:d value:f", "S4 X3",
      with_parts("vintages", """
SELECT s.series_id, s.obs_date, v.value FROM (SELECT series_id, CAST(unnest(range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 DAY)) AS DATE) AS obs_date FROM (SELECT DISTINCT series_id FROM vintages)) s
LEFT JOIN vintages v ON v.series_id = s.series_id AND v.obs_date = s.obs_date AND s.obs_date BETWEEN realtime_start AND realtime_end
WHERE isodow(s.obs_date) < 6"""))
def _(spark, sf_dir):
    return pit.vintage_values(tb.macro_vintages(spark, sf_dir), "1997-01-01", "1997-12-31")


# ---- ten factors: return and log volume change of each region
FACTORS = (
    "market_beta", "rates_sensitivity", "credit_sensitivity", "growth_factor", "value_factor",
    "small_cap", "usd_sensitivity", "commodities", "volatility_factor", "semiconductor_cycle",
)
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_COLS = ", ".join(
    [f"max(ret_1d) FILTER (WHERE ticker = '{r}') AS {FACTORS[i]}" for i, r in enumerate(REGIONS)]
    + [f"max(dv) FILTER (WHERE ticker = '{r}') AS {FACTORS[i + 5]}" for i, r in enumerate(REGIONS)])
part("factors", "feat_region", f"""
SELECT effective_date, {_COLS} FROM (SELECT *, ln(volume / lag(volume) OVER ({W})) AS dv FROM feat_region) GROUP BY 1""")


def factors(spark, sf_dir):
    bars = tb.closing(spark, sf_dir, "region")
    df = ft.add_returns(bars, (1,)).withColumn("dv", F.log(F.col("volume") / F.lag("volume", 1).over(ft.series())))
    pick = lambda r, c: F.max(F.when(F.col("ticker") == r, F.col(c)))
    return df.groupBy("effective_date").agg(
        *[pick(r, "ret_1d").alias(FACTORS[i]) for i, r in enumerate(REGIONS)],
        *[pick(r, "dv").alias(FACTORS[i + 5]) for i, r in enumerate(REGIONS)])


def assets(spark, sf_dir):
    closes = tb.closing(spark, sf_dir).select("ticker", "effective_date", "close")
    return ft.add_returns(spread(closes, "ticker"), (1,)).select("ticker", "effective_date", F.col("ret_1d").alias("asset_ret"))


_LAGS = ", ".join(f"lag({f}) OVER (ORDER BY effective_date) AS {f}" for f in FACTORS)
part("aligned", "factors feat_supplier", f"""
SELECT s.ticker, s.effective_date, s.ret_1d AS asset_ret, f.* EXCLUDE (effective_date) FROM feat_supplier s
JOIN (SELECT effective_date, lag(effective_date) OVER (ORDER BY effective_date) AS factor_date, {_LAGS} FROM factors) f ON f.effective_date = s.effective_date
WHERE s.ret_1d IS NOT NULL AND factor_date IS NOT NULL AND {' AND '.join(f + ' IS NOT NULL' for f in FACTORS)}""".replace("AND market_beta", "AND f.market_beta"))


def aligned(spark, sf_dir):
    return pit.lagged_factors(factors(spark, sf_dir), assets(spark, sf_dir), FACTORS)


@plan("lagged_factors", "ticker:s effective_date:d factor_date:d asset_ret:f " + " ".join(f"{f}:f" for f in FACTORS), "J4",
      with_parts("aligned", "SELECT * FROM aligned"))
def _(spark, sf_dir):
    return aligned(spark, sf_dir)


@plan("lag_assertion", "n_rows:i n_violations:i", "J4",
      with_parts("aligned", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE factor_date >= effective_date) AS n_violations FROM aligned"))
def _(spark, sf_dir):
    return pit.assert_lagged(aligned(spark, sf_dir))


# ---- landed files
@plan("wide_response_to_bars", "ticker:s effective_date:d open:f8 high:f8 low:f8 close:f8 volume:f", "S2",
      with_parts("bars_region", "SELECT * FROM bars_region"))
def _(spark, sf_dir):
    fields = ("open", "high", "low", "close", "volume")
    wide_rows = tb.bars(spark, sf_dir, "region").groupBy("effective_date").pivot("ticker", list(REGIONS)).agg(
        *[F.first(f).alias(f) for f in fields])
    return ld.wide_to_bars(wide_rows, REGIONS)


@plan("bars_by_ticker_and_date", "ticker:s effective_date:d close:f8", "S1",
      with_parts("bars_region", "SELECT * FROM bars_region WHERE ticker IN ('ASIA', 'EUROPE') AND effective_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def _(spark, sf_dir):
    path = scratch(spark, "landed-bars")
    tb.bars(spark, sf_dir, "region").write.mode("overwrite").parquet(path)
    return ld.read_bars(spark, path, ("ASIA", "EUROPE"), "1996-01-01", "1999-12-31")


@plan("macro_csv", "series_id:s effective_date:d value:f", "S3",
      with_parts("macro", "SELECT * FROM macro WHERE series_id = 'DGS10' AND day(effective_date) <> 13"))
def _(spark, sf_dir):
    path = scratch(spark, "landed-macro")
    ten = tb.macro(spark, sf_dir).where("series_id = 'DGS10'")
    text = F.when(F.dayofmonth("effective_date") == 13, ".").otherwise(F.col("value").cast("string"))
    ten.select(F.col("effective_date").alias("observation_date"), text.alias("DGS10")).write.option("header", True).csv(path)
    return ld.read_macro_csv(spark, path)


@plan("put_call_csv", "pc_date:d ratio:f10", "S5 S9",
      with_parts("macro", """
SELECT effective_date AS pc_date, CASE WHEN year(effective_date) >= 1999 THEN value / 100000.0 + 1 ELSE value / 100000.0 END AS ratio
FROM macro WHERE series_id = 'DGS2' AND day(effective_date) <> 7"""))
def _(spark, sf_dir):
    two = tb.macro(spark, sf_dir).where("series_id = 'DGS2'")
    bad = F.dayofmonth("effective_date") == 7
    ratio = F.col("value") / 100000.0
    first, second = scratch(spark, "put-call"), scratch(spark, "put-call")
    two.select(
        F.date_format("effective_date", "M/d/yyyy").alias("Trading Day"),
        F.when(bad, "n/a").otherwise(ratio.cast("string")).alias("Total Put_Call Ratio"),
    ).write.option("header", True).csv(first)
    two.where("year(effective_date) >= 1999").select(
        F.col("effective_date").alias("DATE"),
        F.when(bad, "").otherwise((ratio + 1).cast("string")).alias("PUT CALL RATIO"),
    ).write.option("header", True).csv(second)
    old = ld.read_put_call(spark, first).withColumn("version", F.lit(1))
    new = ld.read_put_call(spark, second).withColumn("version", F.lit(2))
    return st.upsert(old, new, ["pc_date"], "version")


def calendar_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 9 == 0, "fomc_day").when(k % 9 == 1, "cpi_day").when(k % 9 == 2, "quarter_end").otherwise("party")
    day = F.when(k % 200 == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tb.read(spark, sf_dir, "orders").select(
        F.to_json(F.create_map(day, F.array(name, F.lit("nfp_day")))).alias("value"))


@plan("economic_calendar", "event_date:d event:s position:i", "S6",
      """
SELECT CAST(o_orderdate AS DATE) AS event_date, e.event, e.position FROM orders,
 LATERAL (SELECT unnest([{'event': CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN 'fomc_day' WHEN 1 THEN 'cpi_day' WHEN 2 THEN 'quarter_end' ELSE 'party' END, 'position': 0}, {'event': 'nfp_day', 'position': 1}]) AS e) t
WHERE o_orderkey % 200 <> 0 AND e.event <> 'party'""")
def _(spark, sf_dir):
    return ld.parse_calendar(calendar_lines(spark, sf_dir))


@plan("calendar_suppression", "ticker:s effective_date:d suppressed:b reason:s", "P7",
      with_parts("bars_region", """
, c AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN 'FOMC day' WHEN 1 THEN 'CPI release' WHEN 2 THEN 'Quarter-end' ELSE 'NFP release' END AS r,
  CASE WHEN o_orderkey % 9 >= 3 THEN 100000 ELSE 0 END + CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS p
  FROM orders WHERE o_orderkey % 200 <> 0),
f AS (SELECT d, arg_min(r, p) AS r FROM c GROUP BY 1)
SELECT ticker, effective_date, r IS NOT NULL AS suppressed, r || ' — friction alerts suppressed' AS reason FROM bars_region LEFT JOIN f ON d = effective_date"""))
def _(spark, sf_dir):
    calendar = ld.parse_calendar(calendar_lines(spark, sf_dir))
    # Two landed objects may name the same day: order them by name within a position.
    calendar = calendar.withColumn("position", F.struct("position", "event"))
    return ql.suppression(tb.bars(spark, sf_dir, "region"), calendar)


def map_lines(spark, sf_dir):
    line = F.concat(F.lit("  "), "ticker", F.lit(" : "), "etf", F.lit(" "))
    key = F.substring("ticker", -3, 3).cast("int")
    text = F.when(key % 10 == 0, F.concat(F.lit("# "), line)).when(key % 10 == 1, "").otherwise(line)
    return tb.sector_map(spark, sf_dir).select(text.alias("value"))


_MAPPED = "SELECT ticker, etf FROM sector_map WHERE CAST(right(ticker, 3) AS INTEGER) % 10 > 1"


@plan("sector_map", "ticker:s etf:s", "S7", with_parts("sector_map", _MAPPED))
def _(spark, sf_dir):
    return ld.parse_sector_map(map_lines(spark, sf_dir))


@plan("sector_map_problems", "problem:s item:s", "S7",
      with_parts("sector_map", f"""
SELECT 'unmapped_ticker' AS problem, ticker AS item FROM sector_map WHERE ticker NOT IN (SELECT ticker FROM ({_MAPPED}))
UNION ALL SELECT DISTINCT 'unknown_etf', etf FROM ({_MAPPED}) WHERE etf NOT IN ('ASIA', 'EUROPE')"""))
def _(spark, sf_dir):
    return ld.sector_map_problems(
        tb.sector_map(spark, sf_dir), ld.parse_sector_map(map_lines(spark, sf_dir)), ("ASIA", "EUROPE"))


@plan("paper_feed", "entry_id:s topic:s authors:s published:d url:s has_title:b", "S15 K4", """
SELECT 'urn:' || doc_id AS entry_id, lang AS topic, source || ', B' AS authors,
 CASE WHEN doc_id % 40 BETWEEN 1 AND 31 THEN DATE '2024-01-01' + CAST(doc_id % 40 - 1 AS INTEGER) END AS published,
 'http://example.com/' || doc_id AS url, true AS has_title FROM documents""")
def _(spark, sf_dir):
    path = scratch(spark, "feed")
    link = F.struct(
        F.concat(F.lit("http://example.com/"), F.col("doc_id").cast("string")).alias("_href"), F.lit("alternate").alias("_rel"))
    day = F.format_string("2024-01-%02dT00:00:00Z", F.col("doc_id") % 40)
    printable = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    entries = tb.read(spark, sf_dir, "documents").select(
        F.concat(F.lit(" urn:"), F.col("doc_id").cast("string"), F.lit(" ")).alias("id"), F.col("lang").alias("topic"),
        printable.alias("title"), printable.alias("summary"), day.alias("published"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit("B").alias("name"))).alias("author"),
        F.array(link).alias("link"))
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    papers = ld.read_papers(spark, path)
    return papers.withColumn("has_title", F.length("title").between(1, ld.TITLE_CHARS) & (F.length("summary") <= ld.SUMMARY_CHARS))


@plan("paper_refresh", "entry_id:s topic:s title:s fetched_at:s", "S15 S9", """
SELECT 'urn:' || doc_id AS entry_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS topic,
 CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS title, CASE WHEN doc_id % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS fetched_at
FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def _(spark, sf_dir):
    """A cache of every second entry meets a batch of every third: known ones take topic and time only."""
    rows = tb.read(spark, sf_dir, "documents")
    entry = F.concat(F.lit("urn:"), F.col("doc_id").cast("string")).alias("entry_id")

    def feed(every, topic, title, day):
        return rows.where(F.col("doc_id") % every == 0).select(
            entry, topic.alias("topic"), F.lit(title).alias("title"), F.lit(day).alias("fetched_at"))

    cache, batch = feed(2, F.col("lang"), "first", "2024-01-01"), feed(3, F.lit("new"), "second", "2024-02-01")
    return ld.refresh_papers(cache, batch)


# ---- store
@plan("feature_store_write", "source:s feature_name:s feature_version:s n:i n_verified:i", "S8 S10",
      with_parts("long_region", "SELECT 'bars' AS source, feature_name, 'v2' AS feature_version, count(*) AS n, count(*) AS n_verified FROM long_region WHERE feature_name LIKE 'ret%' GROUP BY 2"))
def _(spark, sf_dir):
    path = scratch(spark, "features")
    batch = long(spark, sf_dir, "region").withColumn("knowledge_date", F.col("effective_date"))
    st.write_features(batch, path, "bars", "v1")
    # The reload brings fewer features; none of the others may be left.
    st.replace_source(batch.where("feature_name LIKE 'ret%'"), path, "bars", "v2")
    return st.read_features(spark, path, source="bars").groupBy("source", "feature_name", "feature_version").agg(
        F.count("*").alias("n"), F.count_if("pit_verified").alias("n_verified"))


@plan("ticker_source_replaced", "ticker:s feature_version:s n:i", "S10",
      with_parts("long_region", """
SELECT ticker, CASE WHEN ticker = 'ASIA' THEN 'v2' ELSE 'v1' END AS feature_version, count(*) AS n FROM long_region
WHERE ticker <> 'ASIA' OR feature_name = 'rsi_14' GROUP BY 1, 2"""))
def _(spark, sf_dir):
    path = scratch(spark, "features")
    batch = long(spark, sf_dir, "region").withColumn("knowledge_date", F.col("effective_date"))
    st.write_features(batch, path, "bars", "v1")
    st.replace_ticker_source(batch.where("ticker = 'ASIA' AND feature_name = 'rsi_14'"), path, "bars", "v2")
    return st.read_features(spark, path, source="bars").groupBy("ticker", "feature_version").agg(F.count("*").alias("n"))


@plan("source_reload", "version:i source:s feature_name:s n:i", "S10",
      with_parts("long_region", """
SELECT v AS version, s AS source, feature_name, count(*) AS n FROM long_region, (VALUES (2, 'bars'), (2, 'macro'), (3, 'macro'), (4, 'bars'), (4, 'macro')) AS t(v, s)
WHERE CASE WHEN v = 4 AND s = 'bars' THEN feature_name = 'rsi_14' WHEN s = 'macro' THEN feature_name LIKE 'ret%' ELSE true END GROUP BY 1, 2, 3"""))
def _(spark, sf_dir):
    """Two sources are written; one is reloaded without any row, then with some. Every version stays readable."""
    path = scratch(spark, "features")
    batch = long(spark, sf_dir, "region").withColumn("knowledge_date", F.col("effective_date"))
    st.write_features(batch, path, "bars")
    st.write_features(batch.where("feature_name LIKE 'ret%'"), path, "macro")
    st.replace_source(batch.limit(0), path, "bars")
    st.replace_source(batch.where("feature_name = 'rsi_14'"), path, "bars")
    read = [st.read_features(spark, path, version=v).withColumn("version", F.lit(v)) for v in (2, 3, 4)]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("version", "source", "feature_name").agg(F.count("*").alias("n"))


@plan("ticker_reload", "version:i ticker:s feature_version:s n:i", "S10",
      with_parts("long_region", """
SELECT v AS version, ticker, CASE WHEN v > 1 AND ticker = 'ASIA' THEN 'v2' ELSE 'v1' END AS feature_version, count(*) AS n FROM long_region, (VALUES (1), (2), (3)) AS t(v)
WHERE CASE WHEN v = 1 THEN true WHEN ticker = 'ASIA' THEN feature_name = 'rsi_14' ELSE ticker <> 'EUROPE' END GROUP BY 1, 2, 3"""))
def _(spark, sf_dir):
    """Two tickers are reloaded, one of them with no rows at all; then the source is compacted."""
    path = scratch(spark, "features")
    batch = long(spark, sf_dir, "region").withColumn("knowledge_date", F.col("effective_date"))
    st.write_features(batch, path, "bars")
    asked = batch.select("ticker").where("ticker IN ('ASIA', 'EUROPE')").distinct()
    st.replace_ticker_source(batch.where("ticker = 'ASIA' AND feature_name = 'rsi_14'"), path, "bars", "v2", asked)
    st.feature_table(spark, path).compact("bars")
    read = [st.read_features(spark, path, version=v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("version", "ticker", "feature_version").agg(F.count("*").alias("n"))


@plan("snapshot_round_trip", "ticker:s effective_date:d close:f8", "S11", with_parts("bars_region", "SELECT * FROM bars_region"))
def _(spark, sf_dir):
    path = scratch(spark, "snapshot")
    st.save_snapshot(tb.bars(spark, sf_dir, "region"), path)
    return st.load_snapshot(spark, path)


part("px", "bars_supplier", " UNION ALL ".join(
    f"SELECT ticker, effective_date, 'px_{c}' AS feature_name, CAST({c} AS DOUBLE) AS feature_value FROM bars_supplier" for c in st.PX_COLUMNS))


@plan("bar_archive", "ticker:s effective_date:d feature_name:s feature_value:f8", "S12", with_parts("px", "SELECT * FROM px"))
def _(spark, sf_dir):
    return st.bars_to_features(tb.bars(spark, sf_dir))


@plan("candles_from_archive", "ticker:s effective_date:d open:f8 close:f8 volume:f", "S13",
      with_parts("bars_supplier", """
SELECT * FROM bars_supplier QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY effective_date DESC) <= 504 AND count(*) OVER (PARTITION BY ticker) >= 60"""))
def _(spark, sf_dir):
    # Dealt by ticker while a day is one row; the archive's rows and the candles of them stay there.
    bars = spread(tb.bars(spark, sf_dir, keep=False), "ticker", wider=WIDER_THAN_TRADES)
    return st.features_to_bars(st.bars_to_features(bars))


@plan("live_edge", "ticker:s effective_date:d close:f8 live_edge:b", "S14",
      with_parts("bars_supplier", """
, m AS (SELECT ticker, max(effective_date) AS mx FROM bars_supplier WHERE effective_date < DATE '2001-06-01' GROUP BY 1)
SELECT ticker, effective_date, close, false AS live_edge FROM bars_supplier WHERE effective_date < DATE '2001-06-01'
UNION ALL SELECT b.ticker, max(b.effective_date), arg_max(b.close, b.effective_date), true FROM bars_supplier b JOIN m ON m.ticker = b.ticker AND b.effective_date > mx GROUP BY 1"""))
def _(spark, sf_dir):
    bars = tb.bars(spark, sf_dir)
    return st.with_live_edge(bars.where("effective_date < DATE '2001-06-01'"), bars)


@plan("delisted_accepted", "ticker:s termination_date:d termination_reason:s terminal_return:f", "S16",
      with_parts("delisted", "SELECT * FROM delisted WHERE termination_reason <> 'vanished'"))
def _(spark, sf_dir):
    return st.drop_synthetic(st.split_delisted(delisted(spark, sf_dir))[0])


@plan("delisted_quarantine", "ticker:s termination_reason:s", "S16",
      with_parts("delisted", "SELECT * FROM delisted WHERE termination_reason = 'vanished'"))
def _(spark, sf_dir):
    return st.split_delisted(delisted(spark, sf_dir))[1]


@plan("keyed_upsert", "ticker:s n:i last_event:i", "S9",
      """
SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(arg_max(event_id, ts) AS BIGINT) AS last_event, 1 AS n FROM events GROUP BY 1""")
def _(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), "ts", F.col("event_id").alias("last_event"))
    state = st.upsert(rows.where("last_event % 2 = 0"), rows.where("last_event % 2 = 1"), ["ticker"], "ts")
    return state.withColumn("n", F.lit(1))


@plan("insert_if_absent", "ticker:s n:i",  "S9",
      with_parts("bars_supplier", "SELECT ticker, count(*) AS n FROM bars_supplier b WHERE NOT EXISTS (SELECT 1 FROM bars_supplier o WHERE o.ticker = b.ticker AND o.effective_date = b.effective_date AND o.volume > 20) GROUP BY 1"))
def _(spark, sf_dir):
    bars = tb.bars(spark, sf_dir)
    return st.insert_absent(bars.where("volume > 20"), bars, ["ticker", "effective_date"]).groupBy("ticker").agg(F.count("*").alias("n"))


@plan("store_window", "n_rows:i n_tickers:i n_features:i first_date:d last_date:d", "A18 V5",
      with_parts("long_supplier", "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT feature_name) AS n_features, min(effective_date) AS first_date, max(effective_date) AS last_date FROM long_supplier"))
def _(spark, sf_dir):
    return st.store_window(long(spark, sf_dir))


@plan("execution_log", "layer_name:s n:i", "V5", "SELECT event_type AS layer_name, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    path = scratch(spark, "executions")
    runs = tb.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("layer_name"), F.lit("walk_forward").alias("function_name"),
        F.lit(None).cast("string").alias("git_sha"), F.col("props").alias("hyperparameters"))
    st.log_executions(runs, path)
    return spark.read.parquet(path).groupBy("layer_name").agg(F.count("*").alias("n"))


# ---- quality
part("dirty_all", "bars_supplier", """
SELECT ticker, effective_date, open, CASE WHEN day(effective_date) = 3 THEN low - 1 ELSE high END AS high, low, close, volume FROM bars_supplier""")
# The audit is asked for names that the response does not have.
part("dirty", "dirty_all", "SELECT * FROM dirty_all WHERE CAST(right(ticker, 3) AS INTEGER) % 7 <> 0")
_BAD = "(high < low OR close > high OR close < low)"


def dirty_all(spark, sf_dir):
    return tb.bars(spark, sf_dir).withColumn(
        "high", F.when(F.dayofmonth("effective_date") == 3, F.col("low") - 1).otherwise(F.col("high")))


def dirty(spark, sf_dir):
    return dirty_all(spark, sf_dir).where(F.substring("ticker", -3, 3).cast("int") % 7 != 0)


@plan("bar_sanity", "ticker:s n_good:i n_bad:i", "P1",
      with_parts("dirty_all", f"SELECT ticker, count(*) FILTER (WHERE NOT {_BAD}) AS n_good, count(*) FILTER (WHERE {_BAD}) AS n_bad FROM dirty_all GROUP BY 1"))
def _(spark, sf_dir):
    good, bad = ql.split_bars(dirty_all(spark, sf_dir))
    return good.withColumn("g", F.lit(1)).unionByName(bad.withColumn("g", F.lit(0))).groupBy("ticker").agg(
        F.count_if(F.col("g") == 1).alias("n_good"), F.count_if(F.col("g") == 0).alias("n_bad"))


@plan("fetch_audit", "ticker:s fetch_date:d status:s n_rows:i n_bad_rows:i n_consec_gaps:i note:s", "P2 W14",
      with_parts("dirty", f"""
, g AS (SELECT ticker, max(run) AS gaps FROM (SELECT ticker, island, sum(g) AS run FROM (SELECT ticker, g, sum(1 - g) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT ticker, effective_date, coalesce(CAST(effective_date - lag(effective_date) OVER ({W}) > 3 AS INT), 0) AS g FROM dirty WHERE NOT {_BAD})) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT ticker, count(*) FILTER (WHERE NOT {_BAD}) AS n, count(*) FILTER (WHERE {_BAD}) AS b FROM dirty GROUP BY 1)
SELECT s_name AS ticker, DATE '2001-12-31' AS fetch_date, CASE WHEN n IS NULL THEN 'MISSING' WHEN gaps > 3 THEN 'GAP_WARNING' WHEN b > 0 THEN 'BAD_ROWS' ELSE 'OK' END AS status,
 coalesce(n, 0) AS n_rows, coalesce(b, 0) AS n_bad_rows, coalesce(gaps, 0) AS n_consec_gaps,
 CASE WHEN n IS NULL THEN 'ticker not in response' WHEN gaps > 3 THEN gaps || ' consecutive trading-day gaps > 3' WHEN b > 0 THEN b || ' OHLCV-inconsistent rows dropped' END AS note
FROM supplier LEFT JOIN c ON c.ticker = s_name LEFT JOIN g ON g.ticker = s_name"""))
def _(spark, sf_dir):
    asked = tb.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker"))
    return ql.fetch_audit(asked, dirty(spark, sf_dir), "2001-12-31")


@plan("audit_read", "ticker:s fetch_date:d status:s n_rows:i", "P3",
      with_parts("fetch_audit", "SELECT * FROM fetch_audit WHERE fetch_date >= DATE '2024-01-10' AND ticker IN ('click', 'error')"))
def _(spark, sf_dir):
    return ql.read_audit(fetch_audit(spark, sf_dir), "2024-01-10", ("click", "error"))


@plan("latest_audit", "ticker:s gaps:i", "J8 W13",
      with_parts("fetch_audit", "SELECT ticker, arg_max(n_consec_gaps, fetched_at) AS gaps FROM fetch_audit GROUP BY 1"))
def _(spark, sf_dir):
    return fetch_audit(spark, sf_dir).groupBy("ticker").agg(F.max_by("n_consec_gaps", "fetched_at").alias("gaps"))


@plan("ticker_symbols", "doc_id:i symbol:s valid:b", "P4 X4", """
SELECT doc_id, substr(text, 1, 1) || CASE WHEN doc_id % 3 = 0 THEN '.B' ELSE upper(substr(source, 1, 4)) END AS symbol,
 regexp_full_match(substr(text, 1, 1) || CASE WHEN doc_id % 3 = 0 THEN '.B' ELSE upper(substr(source, 1, 4)) END, '[A-Z][A-Z0-9.\\-]{0,9}') AS valid FROM documents""")
def _(spark, sf_dir):
    symbol = F.concat(F.substring("text", 1, 1), F.when(F.col("doc_id") % 3 == 0, ".B").otherwise(F.upper(F.substring("source", 1, 4))))
    return tb.read(spark, sf_dir, "documents").select("doc_id", symbol.alias("symbol"), ql.valid_ticker(symbol).alias("valid"))


@plan("trading_days_before", "order_date:d back1:d back3:d back7:d stale:b", "P5 P6 X3", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS order_date FROM orders),
w AS (SELECT order_date, order_date - CAST(i AS INTEGER) AS x, row_number() OVER (PARTITION BY order_date ORDER BY i) AS r FROM d, range(1, 30) t(i) WHERE isodow(order_date - CAST(i AS INTEGER)) < 6)
SELECT order_date, max(x) FILTER (WHERE r = 1) AS back1, max(x) FILTER (WHERE r = 3) AS back3, max(x) FILTER (WHERE r = 7) AS back7,
 order_date - 3 < max(x) FILTER (WHERE r = 2) AS stale FROM w GROUP BY 1""")
def _(spark, sf_dir):
    d = tb.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("order_date")).distinct()
    c = F.col("order_date")
    return d.select(
        "order_date", *[dt.trading_days_before(c, n).alias(f"back{n}") for n in (1, 3, 7)],
        dt.is_stale(F.date_sub(c, 3), c).alias("stale"))


@plan("time_buckets", "bucket:s n:i", "P8", """
SELECT CASE WHEN h < 10.5 THEN 'open' WHEN h < 14 THEN 'midday' WHEN h < 16 THEN 'close' ELSE 'after' END AS bucket, count(*) AS n
FROM (SELECT hour(ts) + minute(ts) / 60.0 AS h FROM events) GROUP BY 1""")
def _(spark, sf_dir):
    return tb.read(spark, sf_dir, "events").groupBy(dt.time_bucket(F.col("ts")).alias("bucket")).agg(F.count("*").alias("n"))


part("feeds_pit", "long_supplier macro", """
SELECT 'yfinance' AS source, ticker, feature_name, effective_date, effective_date + 1 AS knowledge_date FROM long_supplier WHERE feature_name = 'ret_1d'
UNION ALL SELECT 'fred', 'MACRO', series_id, effective_date, effective_date FROM macro""")
part("health", "feeds_pit", """
SELECT source, feed, last_date, behind AS stale_days, CASE WHEN source = 'fred' THEN 0 ELSE last_known - last_date END AS pit_lag_days, rows_ AS rows,
 CASE WHEN source = 'fred' THEN 0 ELSE coalesce(gaps, 0) END AS gaps, CASE WHEN behind > 5 THEN 'missing' WHEN behind > 2 THEN 'stale' ELSE 'fresh' END AS status
FROM (SELECT source, CASE WHEN source = 'fred' THEN feature_name ELSE ticker END AS feed, max(effective_date) AS last_date, max(knowledge_date) AS last_known, count(*) AS rows_ FROM feeds_pit GROUP BY 1, 2)
JOIN (SELECT effective_date AS last_date, row_number() OVER (ORDER BY effective_date DESC) - 1 AS behind FROM (SELECT DISTINCT effective_date FROM feeds_pit)) USING (last_date)
LEFT JOIN (SELECT 'Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS feed, arg_max(event_id % 7, ts) AS gaps FROM events GROUP BY 1) USING (feed)""")


def health(spark, sf_dir):
    # The daily returns alone, unless all features are stored already.
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    returns = stored_or(
        spark, "features-supplier", inputs, lambda: ft.add_returns(spread(tb.closes(spark, sf_dir), "ticker", wider=WIDER_THAN_TRADES), (1,)))
    bars = ft.to_long(returns, ("ret_1d",)).select(
        F.lit("yfinance").alias("source"), "ticker", "feature_name", "effective_date", F.date_add("effective_date", 1).alias("knowledge_date"))
    macro = tb.macro(spark, sf_dir).select(
        F.lit("fred").alias("source"), F.lit("MACRO").alias("ticker"), F.col("series_id").alias("feature_name"),
        "effective_date", F.col("effective_date").alias("knowledge_date"))
    audit = tb.read(spark, sf_dir, "events").select(
        F.format_string("Supplier#%09d", "user_id").alias("ticker"), F.col("ts").alias("fetched_at"), (F.col("event_id") % 7).alias("n_consec_gaps"))
    return ql.data_health(bars.unionByName(macro), audit)


@plan("data_health", "source:s feed:s last_date:d stale_days:i pit_lag_days:i rows:i gaps:i status:s", "A13 J8",
      with_parts("health", "SELECT * FROM health"))
def _(spark, sf_dir):
    return health(spark, sf_dir)


@plan("data_health_overall", "overall:s n_feeds:i as_of:d", "A13",
      with_parts("health", "SELECT CASE max(CASE status WHEN 'missing' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END) WHEN 2 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'fresh' END AS overall, count(*) AS n_feeds, max(last_date) AS as_of FROM health"))
def _(spark, sf_dir):
    return ql.overall_health(health(spark, sf_dir))


@plan("universe_dates", "effective_date:d n_tickers:i", "U5",
      with_parts("bars_supplier", "SELECT effective_date, count(DISTINCT ticker) AS n_tickers FROM bars_supplier GROUP BY 1"))
def _(spark, sf_dir):
    pairs = tb.bars(spark, sf_dir).select("effective_date", "ticker").distinct()
    return pairs.groupBy("effective_date").agg(F.count("*").alias("n_tickers"))


@plan("ticker_set_algebra", "ticker:s side:s", "U2",
      with_parts("delisted live_universe", """
SELECT ticker, 'both' AS side FROM (SELECT ticker FROM delisted INTERSECT SELECT ticker FROM live_universe)
UNION ALL SELECT ticker, 'delisted_only' FROM (SELECT ticker FROM delisted EXCEPT SELECT ticker FROM live_universe)"""))
def _(spark, sf_dir):
    from plumbline.plans.validation_plans import live_universe
    gone, live = delisted(spark, sf_dir).select("ticker"), live_universe(spark, sf_dir).select("ticker")
    return gone.intersect(live).withColumn("side", F.lit("both")).union(gone.subtract(live).withColumn("side", F.lit("delisted_only")))
