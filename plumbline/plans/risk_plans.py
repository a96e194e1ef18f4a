"""Sizing, friction, execution and forecast plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.asof import asof_join
from plumbline.operators import execution as ex
from plumbline.operators import features as ft
from plumbline.operators import forecast as fc
from plumbline.operators import friction as fr
from plumbline.operators import sizing as sz
from plumbline.plans.analog_plans import past
from plumbline.plans.feature_plans import W, wide
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.sources import tables as tb

# ---- sizing: uncertainty and overlap vary by ticker so that every branch is met
_UNC = "(CAST(right(ticker, 3) AS INTEGER) % 10) / 20.0"
_OVL = "(CAST(right(ticker, 3) AS INTEGER) % 7) / 7.0"


def kelly_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, n, CASE WHEN n >= 30 THEN 'OK' ELSE 'INSUFFICIENT_ANALOGS' END AS status, CASE WHEN n >= 30 THEN win_rate END AS win_rate,
 CASE WHEN n >= 30 THEN avg_loss END AS avg_loss, CASE WHEN n >= 30 THEN least(0.2, raw) END AS raw_kelly, CASE WHEN n >= 30 THEN least(0.2, raw * 0.5) END AS haircut_kelly_standard,
 CASE WHEN n >= 30 THEN least(0.2, raw * cut) END AS displayed_kelly, CASE WHEN n >= 30 THEN cut END AS effective_haircut FROM (
 SELECT *, CASE WHEN avg_loss > 0 THEN greatest(0, win_rate - (1 - win_rate) / (win / avg_loss)) ELSE 0 END AS raw,
  CASE WHEN win IS NULL OR (es >= 0 AND loss IS NULL) THEN 0 ELSE 0.5 * (1 - unc) * least(1, ovl * 1.5) END AS cut FROM (
  SELECT *, CASE WHEN win IS NULL OR (es >= 0 AND loss IS NULL) THEN 0 WHEN es >= 0 THEN abs(loss) ELSE abs(es) END AS avg_loss FROM (
   SELECT {keys}, count(*) AS n, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(fwd) FILTER (WHERE fwd > 0) AS win, avg(fwd) FILTER (WHERE fwd < 0) AS loss,
    quantile_cont(fwd, 0.05) AS es, any_value({_UNC}) AS unc, any_value({_OVL}) AS ovl FROM {source} WHERE fwd IS NOT NULL GROUP BY {keys})))"""


part("kelly", "past_k", kelly_sql("past_k", "ticker, as_of"))
part("wiped", "past_k", """
SELECT ticker, as_of, fwd, false AS injected FROM past_k UNION ALL SELECT ticker, as_of, -0.6, true FROM past_k
WHERE fwd IS NOT NULL AND CAST('0x' || substr(md5(ticker || '|' || as_of || '|' || effective_date), 1, 8) AS BIGINT) / 4294967296.0 < 0.02 * 10 / 252.0""")
part("kelly_lite", "wiped", kelly_sql("wiped", "ticker, as_of"))


def sized(spark, sf_dir):
    k = F.substring("ticker", -3, 3).cast("int")
    return past(spark, sf_dir)[1].withColumns({"state_uncertainty": k % 10 / 20.0, "overlap_pct": k % 7 / 7.0})


_KELLY = "ticker:s as_of:d n:i status:s win_rate:f avg_loss:f raw_kelly:f haircut_kelly_standard:f displayed_kelly:f effective_haircut:f"


@plan("tail_aware_kelly", _KELLY, "M27", with_parts("kelly", "SELECT * FROM kelly"))
def _(spark, sf_dir):
    return sz.tail_aware_kelly(sized(spark, sf_dir), ["ticker", "as_of"])


@plan("wipeout_kelly", _KELLY + " n_injected:i", "M29",
      with_parts("kelly_lite", "SELECT * FROM kelly_lite JOIN (SELECT ticker, as_of, count(*) FILTER (WHERE injected) AS n_injected FROM wiped GROUP BY 1, 2) USING (ticker, as_of)"))
def _(spark, sf_dir):
    return sz.lite_kelly(sized(spark, sf_dir), ["ticker", "as_of"], ["ticker", "as_of", "effective_date"])


# ---- friction
_BUCKET = "CASE WHEN hour(ts) + minute(ts) / 60.0 < 10.5 THEN 'open' WHEN hour(ts) + minute(ts) / 60.0 < 14 THEN 'midday' WHEN hour(ts) + minute(ts) / 60.0 < 16 THEN 'close' ELSE 'after' END"
_M = " UNION ALL ".join(f"SELECT ticker, {_BUCKET} AS bucket, '{m}' AS measure, {m} AS value FROM quotes WHERE ts < TIMESTAMP '2024-01-20'" for m in fr.MEASURES)
part("base_long", "quotes", _M)
part("base_med", "base_long", "SELECT ticker, bucket, measure, quantile_cont(value, 0.5) AS median, count(*) AS n FROM base_long GROUP BY 1, 2, 3")
part("baseline", "base_long base_med", """
SELECT ticker, bucket, measure, any_value(median) AS median, quantile_cont(abs(value - median), 0.5) AS mad, any_value(n) AS n_baseline
FROM base_long JOIN base_med USING (ticker, bucket, measure) GROUP BY 1, 2, 3""")


def split_quotes(spark, sf_dir):
    q = tb.quotes(spark, sf_dir)
    return q.where("ts < TIMESTAMP_NTZ '2024-01-20'"), q.where("ts >= TIMESTAMP_NTZ '2024-01-20'")


@plan("friction_baseline", "ticker:s bucket:s measure:s median:f mad:f n_baseline:i", "A17", with_parts("baseline", "SELECT * FROM baseline"))
def _(spark, sf_dir):
    return fr.friction_baseline(split_quotes(spark, sf_dir)[0])


_Z = ", ".join(
    f"CASE WHEN max(mad) FILTER (WHERE measure = '{m}') > 0 THEN 0.6745 * (any_value(q.{m}) - max(median) FILTER (WHERE measure = '{m}')) / max(mad) FILTER (WHERE measure = '{m}') ELSE 0 END AS {m}_z"
    for m in fr.MEASURES)


@plan("friction_scores", "event_id:i ticker:s bucket:s status:s spread_bps_z:f10 volume_z:f10 realized_vol_z:f10 max_abs_z:f10 alert:b", "M20 P7 P8",
      with_parts("baseline", f"""
, q AS (SELECT *, {_BUCKET} AS bucket, CAST(ts AS DATE) AS d FROM quotes WHERE ts >= TIMESTAMP '2024-01-20'),
z AS (SELECT event_id, any_value(q.ticker) AS ticker, any_value(q.bucket) AS bucket, any_value(day(d)) AS dd, max(n_baseline) AS n, {_Z} FROM q LEFT JOIN baseline b ON b.ticker = q.ticker AND b.bucket = q.bucket GROUP BY 1),
s AS (SELECT *, CASE WHEN dd = 25 THEN 'SUPPRESSED' WHEN coalesce(n, 0) < 10 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS status FROM z)
SELECT event_id, ticker, bucket, status, CASE WHEN status = 'OK' THEN spread_bps_z END AS spread_bps_z, CASE WHEN status = 'OK' THEN volume_z END AS volume_z, CASE WHEN status = 'OK' THEN realized_vol_z END AS realized_vol_z,
 CASE WHEN status = 'OK' THEN greatest(abs(spread_bps_z), abs(volume_z), abs(realized_vol_z)) END AS max_abs_z, status = 'OK' AND greatest(abs(spread_bps_z), abs(volume_z), abs(realized_vol_z)) >= 2.5 AS alert FROM s"""))
def _(spark, sf_dir):
    old, new = split_quotes(spark, sf_dir)
    calendar = tb.read(spark, sf_dir, "events").where("day(ts) = 25").select(
        F.to_date("ts").alias("event_date"), F.lit("fomc_day").alias("event"), F.lit(0).alias("position")).distinct()
    return fr.score_quotes(new, fr.baseline_wide(fr.friction_baseline(old)), calendar)


part("amihud", "bars_supplier", f"""
SELECT ticker, effective_date, abs(ln(close / lag(close) OVER ({W}))) / greatest(close * volume, 1e4) AS a FROM bars_supplier""")
part("proxy", "amihud cs_supplier", """
SELECT ticker, n_bars, 'OK' AS status, CASE WHEN mad > 0 THEN 0.6745 * (last - median) / mad ELSE 0 END AS amihud_z, cs AS cs_spread_execution_proxy FROM (
 SELECT ticker, count(*) AS n_bars, arg_max(a, effective_date) AS last, any_value(m) AS median, quantile_cont(abs(a - m), 0.5) AS mad FROM (
  SELECT *, quantile_cont(a, 0.5) OVER (PARTITION BY ticker) AS m FROM amihud) GROUP BY 1)
JOIN (SELECT ticker, arg_max(cs_spread, effective_date) AS cs FROM cs_supplier GROUP BY 1) USING (ticker)""")


@plan("friction_proxy", "ticker:s n_bars:i status:s amihud_z:f cs_spread_execution_proxy:f alert:b", "M21",
      with_parts("proxy", "SELECT *, abs(amihud_z) >= 2.5 AS alert FROM proxy"))
def _(spark, sf_dir):
    return fr.friction_proxy(tb.bars(spark, sf_dir))


part("stress", "long_supplier macro_feat", """
SELECT CASE f WHEN 'vix_percentile_63d' THEN 'VIX percentile' WHEN 'hy_spread_roc_21d' THEN 'HY-OAS momentum' WHEN 'realized_vol_21d' THEN 'Realised vol (avg)' ELSE 'Curve inversion' END AS component,
 CASE f WHEN 'vix_percentile_63d' THEN 0.35 WHEN 'yield_curve_slope' THEN 0.15 ELSE 0.25 END AS weight, n AS n_dates, latest,
 round_even((CASE WHEN f = 'yield_curve_slope' THEN 1 - r WHEN f = 'vix_percentile_63d' THEN latest ELSE r END) * 100, 1) AS value FROM (
 SELECT f, count(*) AS n, any_value(l) AS latest, avg(CASE WHEN v <= l THEN 1.0 ELSE 0 END) AS r FROM (
  SELECT *, last_value(v) OVER (PARTITION BY f ORDER BY effective_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM (
   SELECT 'realized_vol_21d' AS f, effective_date, avg(feature_value) AS v FROM long_supplier WHERE feature_name = 'realized_vol_21d' GROUP BY 2
   UNION ALL SELECT 'yield_curve_slope', effective_date, yield_curve_slope FROM macro_feat WHERE yield_curve_slope IS NOT NULL
   UNION ALL SELECT 'hy_spread_roc_21d', effective_date, hy_spread_roc_21d FROM macro_feat WHERE hy_spread_roc_21d IS NOT NULL
   UNION ALL SELECT 'vix_percentile_63d', effective_date, vix_percentile_63d FROM macro_feat WHERE vix_percentile_63d IS NOT NULL)) GROUP BY 1)""")


def stress_rows(spark, sf_dir):
    macro = ft.macro_features(tb.macro(spark, sf_dir)).withColumn("ticker", F.lit("MACRO"))
    vol = ft.to_long(ft.add_realized_vol(tb.bars(spark, sf_dir)), ("realized_vol_21d",))
    return vol.unionByName(ft.to_long(macro, ("vix_percentile_63d", "hy_spread_roc_21d", "yield_curve_slope")))


@plan("stress_components", "component:s weight:f n_dates:i latest:f value:f", "M22 W15", with_parts("stress", "SELECT * FROM stress"))
def _(spark, sf_dir):
    return fr.stress_components(stress_rows(spark, sf_dir))


@plan("stress_gauge", "composite:f n_components:i level:s", "M22",
      with_parts("stress", """
SELECT c AS composite, n AS n_components, CASE WHEN c < 25 THEN 'calm' WHEN c < 50 THEN 'normal' WHEN c < 75 THEN 'elevated' ELSE 'stressed' END AS level
FROM (SELECT round_even(sum(value * weight) / sum(weight), 1) AS c, count(*) AS n FROM stress)"""))
def _(spark, sf_dir):
    return fr.stress_gauge(fr.stress_components(stress_rows(spark, sf_dir)))


# ---- execution: parent orders arrive over the month of quotes
part("parents", "", """
SELECT o_orderkey AS order_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS ticker,
 TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS order_ts, CASE WHEN o_orderkey % 101 = 0 THEN 'hold' WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS direction,
 CAST(o_custkey % 500 AS DOUBLE) AS order_size, 10000.0 + o_orderkey % 1000 AS adv, (o_orderkey % 7 - 3) / 2.0 AS vol_z, (o_orderkey % 5 - 2) / 2.0 AS spread_z FROM orders""")


def parents(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k * 7919 % 2592000)
    return tb.read(spark, sf_dir, "orders").select(
        k.alias("order_id"), names[(k % 5).cast("int")].alias("ticker"), at.cast("timestamp_ntz").alias("order_ts"),
        F.when(k % 101 == 0, "hold").when(k % 2 == 0, "buy").otherwise("sell").alias("direction"),
        (F.col("o_custkey") % 500).cast("double").alias("order_size"), (10000.0 + k % 1000).alias("adv"),
        ((k % 7 - 3) / 2.0).alias("vol_z"), ((k % 5 - 2) / 2.0).alias("spread_z"))


_FILL = """SELECT *, CASE WHEN ok THEN abs(fill_price - mid) / mid * 1e4 END AS slippage_bps, impact * 1e4 AS impact_bps FROM (
 SELECT *, CASE WHEN ok THEN CASE WHEN direction = 'buy' THEN ask * (1 + impact) + mid * friction_bps / 1e4 ELSE bid * (1 - impact) - mid * friction_bps / 1e4 END END AS fill_price FROM (
  SELECT *, CASE WHEN ok THEN greatest(0.4 * (vol_z + spread_z) * (ask - bid) / mid * 1e4, 0) END AS friction_bps, CASE WHEN ok THEN (ask - bid) / mid * 1e4 END AS spread_bps FROM (
   SELECT *, status = 'OK' AS ok, CASE WHEN status = 'OK' THEN 0.5 * (bid + ask) END AS mid, CASE WHEN status = 'OK' THEN 0.1 * sqrt(order_size / greatest(adv, 1)) END AS impact FROM (
    SELECT *, CASE WHEN direction NOT IN ('buy', 'sell') THEN 'BAD_DIRECTION' WHEN bid IS NULL THEN 'NO_QUOTE' WHEN ask < bid THEN 'CROSSED_QUOTE' WHEN order_size <= 0 THEN 'BAD_SIZE' ELSE 'OK' END AS status FROM {source}))))"""
part("matched", "parents quotes", """
SELECT p.*, q.event_id, q.bid, q.ask FROM parents p ASOF LEFT JOIN quotes q ON p.ticker = q.ticker AND p.order_ts >= q.ts""")


def matched(spark, sf_dir):
    return asof_join(
        parents(spark, sf_dir), tb.quotes(spark, sf_dir), "ticker", "order_ts", "ts", ["event_id", "bid", "ask"], "event_id")


@plan("orders_with_quotes", "order_id:i ticker:s event_id:i bid:f9 ask:f9", "J1 M34", with_parts("matched", "SELECT * FROM matched"))
def _(spark, sf_dir):
    return matched(spark, sf_dir)


@plan("fill_costs", "order_id:i status:s fill_price:f slippage_bps:f impact_bps:f spread_bps:f friction_bps:f", "M34",
      with_parts("matched", _FILL.format(source="matched")))
def _(spark, sf_dir):
    return ex.fill_costs(matched(spark, sf_dir))


@plan("sliced_costs", "order_id:i avg_fill_price:f avg_slippage_bps:f n_slices_actual:i n_slices_requested:i", "M35",
      with_parts("parents", """
, b AS (SELECT l_orderkey AS order_id, l_extendedprice / l_quantity * (1 - l_tax / 10) AS bid, l_extendedprice / l_quantity * (1 + l_tax / 10) AS ask,
  greatest(sum(l_quantity) OVER (PARTITION BY l_orderkey), 1) AS adv_, least(count(*) OVER (PARTITION BY l_orderkey), {h}) AS n_slices,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
s AS (SELECT p.order_id, direction, vol_z, spread_z, bid, ask, adv_ AS adv, order_size / n_slices AS order_size FROM b JOIN parents p USING (order_id) WHERE r <= {h}),
f AS (%s)
SELECT order_id, avg(fill_price) AS avg_fill_price, avg(slippage_bps) AS avg_slippage_bps, count(*) AS n_slices_actual, {h} AS n_slices_requested FROM f GROUP BY 1""".replace("{h}", str(ex.SLICES)) % _FILL.format(source="s")))
def _(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = tb.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("bar_no"),
        (price * (1 - F.col("l_tax") / 10)).alias("bid"), (price * (1 + F.col("l_tax") / 10)).alias("ask"), F.col("l_quantity").alias("volume"))
    orders = parents(spark, sf_dir).select("order_id", "direction", "order_size", "vol_z", "spread_z")
    return ex.sliced_costs(orders, bars)


# ---- forecast
part("ret_hist", "feat_supplier", """
SELECT ticker, list(ret_1d ORDER BY effective_date) AS r, max(effective_date) AS as_of FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY effective_date DESC) AS k FROM feat_supplier WHERE ret_1d IS NOT NULL) WHERE k <= 504 GROUP BY 1""")
_ST = "CAST('0x' || substr(md5(ticker || '|' || path || '|{b}'), 1, 8) AS BIGINT) % (len(r) - 4)"
_R = ", ".join(f"r[s{i // 5} + {i % 5} + 1] AS r{i}" for i in range(10))
_CUM = {h: " * ".join(f"(1 + r{i})" for i in range(h)) + " - 1" for h in fc.HORIZONS}
part("sims", "ret_hist", f"""
SELECT ticker, as_of, path, {', '.join(f'{e} AS cum_{h}' for h, e in _CUM.items())}, list_stddev_pop([{', '.join(f'r{i}' for i in range(10))}]) * sqrt(252.0) AS sim_vol FROM (
 SELECT ticker, as_of, path, {_R} FROM (SELECT *, {_ST.format(b=0)} AS s0, {_ST.format(b=1)} AS s1 FROM ret_hist, range(0, 500) AS t(path) WHERE len(r) >= 10))""")
part("calib", "sims feat_supplier", """
SELECT ticker, n_labels, CASE WHEN n_labels > 30 AND m > 0 AND e > 0 THEN greatest(0.5, least(3, e / m)) ELSE 1 END AS calib FROM
 (SELECT ticker, quantile_cont(cum_10, 0.95) - quantile_cont(cum_10, 0.05) AS m FROM sims GROUP BY 1)
 JOIN (SELECT ticker, count(*) AS n_labels, quantile_cont(ret_fwd_10d, 0.95) - quantile_cont(ret_fwd_10d, 0.05) AS e FROM feat_supplier WHERE ret_fwd_10d IS NOT NULL GROUP BY 1) USING (ticker)""")


def sims(spark, sf_dir):
    df = wide(spark, sf_dir).select("ticker", "effective_date", "ret_1d")
    return fc.simulate(fc.return_history(df))


def current_vol(spark, sf_dir):
    return ft.add_realized_vol(tb.bars(spark, sf_dir)).groupBy("ticker").agg(
        F.max_by("realized_vol_21d", "effective_date").alias("current_vol"))


@plan("band_calibration", "ticker:s n_labels:i calib:f", "M33", with_parts("calib", "SELECT * FROM calib"))
def _(spark, sf_dir):
    labels = ft.add_forward_label(tb.bars(spark, sf_dir)).select("ticker", "ret_fwd_10d")
    return fc.band_calibration(sims(spark, sf_dir), labels)


@plan("point_forecast", "ticker:s as_of:d point_forecast:f", "M33", with_parts("ret_hist", "SELECT ticker, as_of, list_avg(r) * 10 AS point_forecast FROM ret_hist"))
def _(spark, sf_dir):
    return fc.point_forecast(fc.return_history(ft.add_returns(tb.bars(spark, sf_dir), (1,))))


@plan("bootstrap_forecast", "ticker:s as_of:d h:i p5:f p50:f p95:f p_up:f p_vol_shift:f calib:f", "M32 X1",
      with_parts("calib", """
, v AS (SELECT ticker, arg_max(realized_vol_21d, effective_date) AS cv FROM feat_supplier GROUP BY 1),
a AS (SELECT ticker, as_of, avg(CASE WHEN cum_10 > 0 THEN 1.0 ELSE 0 END) AS p_up, avg(CASE WHEN cv > 0 THEN CASE WHEN sim_vol > cv THEN 1.0 ELSE 0 END END) AS p_vol_shift FROM sims JOIN v USING (ticker) GROUP BY 1, 2),
q AS (%s)
SELECT ticker, as_of, h, m + (lo - m) * calib AS p5, m AS p50, m + (hi - m) * calib AS p95, p_up, p_vol_shift, calib FROM q JOIN a USING (ticker) JOIN calib USING (ticker)""" % " UNION ALL ".join(
          f"SELECT ticker, {h} AS h, quantile_cont(cum_{h}, 0.05) AS lo, quantile_cont(cum_{h}, 0.5) AS m, quantile_cont(cum_{h}, 0.95) AS hi FROM sims GROUP BY 1" for h in fc.HORIZONS)))
def _(spark, sf_dir):
    runs = sims(spark, sf_dir)
    labels = ft.add_forward_label(tb.bars(spark, sf_dir)).select("ticker", "ret_fwd_10d")
    return fc.bands(runs, fc.band_calibration(runs, labels), current_vol(spark, sf_dir))
