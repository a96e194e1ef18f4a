"""Feature plans: bars, windows, macro features and the feature vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features as ft
from plumbline.operators.pit import dealt_facts
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.session import enough_tasks, spread, stored_once, stored_or
from plumbline.sources import tables as tb

W = "PARTITION BY ticker ORDER BY effective_date"


def frame(n: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


for _e in ("supplier", "nation", "region"):
    part(f"feat_{_e}", f"bars_{_e}", f"""
SELECT *, CASE WHEN count(lr) OVER {frame(21)} = 21 THEN stddev_samp(lr) OVER {frame(21)} * sqrt(252.0) END AS realized_vol_21d,
  CASE WHEN count(close) OVER {frame(50)} = 50 THEN CASE WHEN close > avg(close) OVER {frame(50)} THEN 1.0 ELSE 0.0 END END AS pct_above_ma50,
  100 - 100 / (1 + gain / greatest(loss, 1e-12)) AS rsi_14
FROM (SELECT *,
   sum(greatest(chg, 0) / 14 * pow(13.0/14, -n)) OVER ({W} ROWS UNBOUNDED PRECEDING) * pow(13.0/14, n) AS gain,
   sum(greatest(-chg, 0) / 14 * pow(13.0/14, -n)) OVER ({W} ROWS UNBOUNDED PRECEDING) * pow(13.0/14, n) AS loss
 FROM (SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d,
   close / lag(close, 21) OVER w - 1 AS ret_21d, close / lag(close, 63) OVER w - 1 AS ret_63d,
   lead(close, 10) OVER w / close - 1 AS ret_fwd_10d, ln(close / lag(close, 1) OVER w) AS lr,
   coalesce(close - lag(close, 1) OVER w, 0) AS chg, row_number() OVER w - 1 AS n
   FROM bars_{_e} WINDOW w AS ({W})) )""")

_LONG = " UNION ALL ".join(
    f"SELECT ticker, effective_date, '{f}' AS feature_name, CAST({f} AS DOUBLE) AS feature_value"
    f" FROM feat_{{e}} WHERE {f} IS NOT NULL"
    for f in ft.OHLCV_FEATURES
)
for _e in ("supplier", "nation", "region"):
    part(f"long_{_e}", f"feat_{_e}", _LONG.format(e=_e))


# Bytes of a row in the sorts of the feature windows to those in the files: of the stored bars, of the trades.
WIDER_THAN_BARS, WIDER_THAN_TRADES = 3, 8


def fresh(spark, sf_dir):
    """Close, features and label of the supplier bars, for what stores its own rows of them.

    The windows sort in tasks of an explicit number: AQE would fold them by the
    bytes of (ticker, date, close), and the rows they sort are several times wider.
    """
    return ft.ohlcv_features(spread(tb.closes(spark, sf_dir), "ticker", wider=WIDER_THAN_TRADES))


def wide(spark, sf_dir, entity="supplier"):
    """Bar features, stored by the first plan that needs them."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]

    def build():
        bars = tb.bars(spark, sf_dir, entity)
        if entity == "supplier":
            return ft.ohlcv_features(spread(bars, "ticker", wider=WIDER_THAN_BARS))
        return ft.ohlcv_features(enough_tasks(bars, "ticker"))

    return stored_once(spark, f"features-{entity}", inputs, build)


def long(spark, sf_dir, entity="supplier"):
    return ft.to_long(wide(spark, sf_dir, entity))


def long_of(spark, sf_dir, asked):
    """The long rows of the suppliers in ``asked`` (ticker), partitioned by ticker; nothing is written for them."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    asked = asked.select("ticker").distinct()
    rows = stored_or(spark, "features-supplier", inputs, lambda: None)
    if rows is None:
        return ft.to_long(ft.ohlcv_features(dealt_facts(tb.closes(spark, sf_dir).join(asked, "ticker", "left_semi"))))
    return ft.to_long(dealt_facts(rows.join(asked, "ticker", "left_semi")))


@plan("daily_bars", "ticker:s effective_date:d open:f8 high:f8 low:f8 close:f8 volume:f n_trades:i", "S1",
      with_parts("bars_supplier", "SELECT * FROM bars_supplier"))
def _(spark, sf_dir):
    return tb.bars(spark, sf_dir)


@plan("region_bars", "ticker:s effective_date:d open:f8 high:f8 low:f8 close:f8 volume:f n_trades:i", "S1",
      with_parts("bars_region", "SELECT * FROM bars_region"))
def _(spark, sf_dir):
    return tb.bars(spark, sf_dir, "region")


@plan("trailing_returns", "ticker:s effective_date:d ret_1d:f ret_5d:f ret_21d:f ret_63d:f", "W1 X1",
      with_parts("feat_supplier", "SELECT * FROM feat_supplier"))
def _(spark, sf_dir):
    return ft.add_returns(tb.bars(spark, sf_dir))


@plan("realized_volatility", "ticker:s effective_date:d realized_vol_21d:f", "W2",
      with_parts("feat_supplier", "SELECT * FROM feat_supplier"))
def _(spark, sf_dir):
    return ft.add_realized_vol(tb.bars(spark, sf_dir))


@plan("above_moving_average", "ticker:s effective_date:d pct_above_ma50:f", "W3",
      with_parts("feat_supplier", "SELECT * FROM feat_supplier"))
def _(spark, sf_dir):
    return ft.add_ma_flag(tb.bars(spark, sf_dir))


@plan("forward_label", "ticker:s effective_date:d ret_fwd_10d:f", "W4",
      with_parts("feat_supplier", "SELECT * FROM feat_supplier"))
def _(spark, sf_dir):
    return ft.add_forward_label(tb.bars(spark, sf_dir))


@plan("wilder_rsi", "ticker:s effective_date:d rsi_14:f", "W5",
      with_parts("bars_supplier", f"""
, steps AS (SELECT ticker, effective_date, coalesce(close - lag(close) OVER ({W}), 0) AS chg,
   row_number() OVER ({W}) AS n FROM bars_supplier),
walk AS (SELECT ticker, effective_date, n, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss FROM steps WHERE n = 1
  UNION ALL SELECT s.ticker, s.effective_date, s.n, w.gain * 13 / 14 + greatest(s.chg, 0) / 14,
    w.loss * 13 / 14 + greatest(-s.chg, 0) / 14
  FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.n = w.n + 1)
SELECT ticker, effective_date, 100 - 100 / (1 + gain / greatest(loss, 1e-12)) AS rsi_14 FROM walk""", recursive=True))
def _(spark, sf_dir):
    return ft.add_wilder_rsi(tb.bars(spark, sf_dir))


@plan("ohlcv_features", "ticker:s effective_date:d feature_name:s feature_value:f", "F17 U1 W1 W2 W3 W4 W5",
      with_parts("long_supplier", "SELECT * FROM long_supplier"))
def _(spark, sf_dir):
    return long(spark, sf_dir)


@plan("features_with_knowledge", "ticker:s effective_date:d knowledge_date:d feature_name:s feature_value:f", "F17 Q4",
      with_parts("long_supplier", f"""
SELECT l.ticker, l.effective_date, CASE WHEN feature_name = 'ret_fwd_10d' THEN known ELSE l.effective_date END AS knowledge_date, feature_name, feature_value
FROM long_supplier l JOIN (SELECT ticker, effective_date, lead(effective_date, 10) OVER ({W}) AS known FROM bars_supplier) k USING (ticker, effective_date)"""))
def _(spark, sf_dir):
    return ft.known_features(wide(spark, sf_dir))


_HL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ft.HALF_LIVES.items())


@plan("ewma_normalised", "ticker:s effective_date:d feature_name:s z:f", "W6",
      with_parts("long_region", f"""
, steps AS (SELECT *, pow(0.5, 1.0 / CASE feature_name {_HL} ELSE 63 END) AS d,
   row_number() OVER (PARTITION BY ticker, feature_name ORDER BY effective_date) AS n FROM long_region),
walk AS (SELECT ticker, feature_name, effective_date, n, feature_value AS x, feature_value AS m, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS w2
   FROM steps WHERE n = 1
  UNION ALL SELECT s.ticker, s.feature_name, s.effective_date, s.n, s.feature_value, d * w.m + (1 - d) * s.feature_value,
    d * (w.v + (1 - d) * (s.feature_value - w.m) * (s.feature_value - w.m)), d * d * w.w2 + (1 - d) * (1 - d)
  FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.feature_name = w.feature_name AND s.n = w.n + 1)
SELECT ticker, effective_date, feature_name,
  CASE WHEN n > 1 AND v > 1e-24 * (1 + m * m) THEN greatest(-4, least(4, (x - m) / sqrt(v / (1 - w2)))) ELSE 0 END AS z FROM walk""",
                 recursive=True))
def _(spark, sf_dir):
    return ft.ewma_normalise(long(spark, sf_dir, "region"))


part("macro_feat", "macro", """
SELECT effective_date, yield_curve_slope, hy_spread_roc_21d, vix_percentile_63d FROM
 (SELECT a.effective_date, a.value - b.value AS yield_curve_slope FROM macro a JOIN macro b USING (effective_date)
  WHERE a.series_id = 'DGS10' AND b.series_id = 'DGS2') s
 FULL JOIN (SELECT effective_date, (value - lag(value, 21) OVER w) / greatest(abs(lag(value, 21) OVER w), 1e-9) AS hy_spread_roc_21d
  FROM macro WHERE series_id = 'BAMLH0A0HYM2' WINDOW w AS (ORDER BY effective_date)) h USING (effective_date)
 FULL JOIN (SELECT effective_date, CASE WHEN n = 63 THEN len(list_filter(prior, lambda x: x <= value)) / 63.0 END AS vix_percentile_63d
  FROM (SELECT effective_date, value, list(value) OVER w AS prior, count(*) OVER w AS n FROM macro WHERE series_id = 'VIXCLS'
   WINDOW w AS (ORDER BY effective_date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))) v USING (effective_date)""")


@plan("macro_slope", "effective_date:d yield_curve_slope:f", "J3",
      with_parts("macro_feat", "SELECT * FROM macro_feat WHERE yield_curve_slope IS NOT NULL"))
def _(spark, sf_dir):
    return ft.macro_slope(tb.macro(spark, sf_dir))


@plan("macro_features", "effective_date:d yield_curve_slope:f hy_spread_roc_21d:f vix_percentile_63d:f", "J3 W7 W8",
      with_parts("macro_feat", "SELECT * FROM macro_feat"))
def _(spark, sf_dir):
    return ft.macro_features(tb.macro(spark, sf_dir))


@plan("volatility_percentile", "ticker:s effective_date:d vix_percentile_63d:f", "W7",
      with_parts("bars_supplier", f"""
SELECT ticker, effective_date, CASE WHEN n = 63 THEN len(list_filter(prior, lambda x: x <= close)) / 63.0 END AS vix_percentile_63d
FROM (SELECT ticker, effective_date, close, list(close) OVER w AS prior, count(*) OVER w AS n FROM bars_supplier
  WINDOW w AS ({W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))"""))
def _(spark, sf_dir):
    return ft.rolling_prior_share(tb.bars(spark, sf_dir), "close")


@plan("spread_rate_of_change", "series_id:s effective_date:d hy_spread_roc_21d:f", "W8",
      with_parts("macro", """
SELECT series_id, effective_date, (value - lag(value, 21) OVER w) / greatest(abs(lag(value, 21) OVER w), 1e-9) AS hy_spread_roc_21d
FROM macro WINDOW w AS (PARTITION BY series_id ORDER BY effective_date)"""))
def _(spark, sf_dir):
    return ft.rate_of_change(tb.macro(spark, sf_dir), keys=("series_id",))


part("trend_supplier", "bars_supplier", f"""
SELECT *, CASE WHEN count(tr) OVER {frame(21)} = 21 AND close <> 0 THEN avg(tr) OVER {frame(21)} / close END AS atr_pct_21d,
  CASE WHEN n >= 200 AND ma200 <> 0 THEN (ma50 - ma200) / ma200 END AS ma_spread_50_200d,
  CASE WHEN n >= 21 THEN volume / greatest(avg(volume) OVER {frame(21)}, 1e-12) END AS volume_norm_21d,
  CASE WHEN count(ret_1d) OVER {frame(21)} = 21 THEN stddev_samp(ret_1d) OVER {frame(21)} END AS vol_21d
FROM (SELECT *, row_number() OVER ({W}) AS n, avg(close) OVER {frame(50)} AS ma50, avg(close) OVER {frame(200)} AS ma200,
  CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr,
  close / lag(close) OVER ({W}) - 1 AS ret_1d, close / lag(close, 5) OVER ({W}) - 1 AS ret_5d, close / lag(close, 21) OVER ({W}) - 1 AS ret_21d
  FROM bars_supplier)""")


@plan("trend_spread", "ticker:s effective_date:d ma_spread_50_200d:f", "W9",
      with_parts("trend_supplier", "SELECT * FROM trend_supplier"))
def _(spark, sf_dir):
    return ft.add_trend_spread(tb.bars(spark, sf_dir))


@plan("true_range_pct", "ticker:s effective_date:d atr_pct_21d:f", "W10",
      with_parts("trend_supplier", "SELECT * FROM trend_supplier"))
def _(spark, sf_dir):
    return ft.add_atr_pct(tb.bars(spark, sf_dir))


part("relative", "bars_supplier bars_region sector_map", f"""
SELECT a.ticker, a.effective_date, m.etf, a.r AS asset_ret, e.r AS etf_ret, a.r - e.r AS sector_relative_ret_252d
FROM (SELECT ticker, effective_date, close / lag(close, 251) OVER ({W}) - 1 AS r FROM bars_supplier) a
JOIN sector_map m USING (ticker)
LEFT JOIN (SELECT ticker, effective_date, close / lag(close, 251) OVER ({W}) - 1 AS r FROM bars_region) e
  ON e.ticker = m.etf AND e.effective_date = a.effective_date""")


@plan("sector_relative_return", "ticker:s effective_date:d etf:s asset_ret:f etf_ret:f sector_relative_ret_252d:f", "W11 J12",
      with_parts("relative", "SELECT * FROM relative"))
def _(spark, sf_dir):
    return ft.sector_relative_return(
        tb.bars(spark, sf_dir), tb.sector_map(spark, sf_dir), tb.bars(spark, sf_dir, "region"))


@plan("volume_norm", "ticker:s effective_date:d volume_norm_21d:f", "W12",
      with_parts("trend_supplier", "SELECT * FROM trend_supplier"))
def _(spark, sf_dir):
    return ft.add_volume_norm(tb.bars(spark, sf_dir))


@plan("latest_feature_value", "ticker:s feature_name:s effective_date:d feature_value:f", "W13",
      with_parts("long_supplier", """SELECT ticker, feature_name, max(effective_date) AS effective_date,
 arg_max(feature_value, effective_date) AS feature_value FROM long_supplier GROUP BY 1, 2"""))
def _(spark, sf_dir):
    return long(spark, sf_dir).groupBy("ticker", "feature_name").agg(
        F.max("effective_date").alias("effective_date"),
        F.max_by("feature_value", "effective_date").alias("feature_value"))


part("gaps", "bars_supplier", f"""
SELECT ticker, max(run) AS n_consec_gaps FROM (SELECT ticker, island, sum(g) AS run FROM (
 SELECT ticker, effective_date, g, sum(1 - g) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT ticker, effective_date, coalesce(CAST(effective_date - lag(effective_date) OVER ({W}) > 3 AS INT), 0) AS g FROM bars_supplier))
 GROUP BY 1, 2) GROUP BY 1""")


@plan("longest_gap_run", "ticker:s n_consec_gaps:i", "W14", with_parts("gaps", "SELECT * FROM gaps"))
def _(spark, sf_dir):
    return ft.longest_gap_run(tb.bars(spark, sf_dir))


@plan("latest_value_rank", "ticker:s effective_date:d volatility_rank:f", "W15",
      with_parts("feat_supplier", """
SELECT ticker, max(effective_date) AS effective_date, avg(CASE WHEN v <= latest THEN 1.0 ELSE 0.0 END) AS volatility_rank FROM (
 SELECT ticker, effective_date, realized_vol_21d AS v,
  last_value(realized_vol_21d) OVER (PARTITION BY ticker ORDER BY effective_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest
 FROM feat_supplier WHERE realized_vol_21d IS NOT NULL) GROUP BY 1"""))
def _(spark, sf_dir):
    vol = ft.add_realized_vol(tb.bars(spark, sf_dir)).dropna(subset=["realized_vol_21d"])
    latest = vol.groupBy("ticker").agg(
        F.max("effective_date").alias("effective_date"),
        F.max_by("realized_vol_21d", "effective_date").alias("latest"))
    return vol.select("ticker", "realized_vol_21d").join(latest, "ticker").groupBy(
        "ticker", "effective_date").agg(
        F.avg((F.col("realized_vol_21d") <= F.col("latest")).cast("double")).alias("volatility_rank"))


@plan("amihud_illiquidity", "ticker:s effective_date:d amihud:f12", "W19",
      with_parts("bars_supplier", f"""SELECT ticker, effective_date,
 abs(ln(close / lag(close) OVER ({W}))) / greatest(close * volume, 1e4) AS amihud FROM bars_supplier"""))
def _(spark, sf_dir):
    return ft.amihud(tb.bars(spark, sf_dir))


part("cs_supplier", "bars_supplier", f"""
SELECT ticker, effective_date, CASE WHEN h0 IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS cs_spread FROM (
 SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM (
  SELECT *, pow(ln(h0 / l0), 2) + pow(ln(high / low), 2) AS beta,
   pow(ln(greatest(h0, high) / greatest(least(l0, low), 1e-12)), 2) AS gamma
  FROM (SELECT *, lag(high) OVER ({W}) AS h0, lag(low) OVER ({W}) AS l0 FROM bars_supplier)))""")


@plan("high_low_spread", "ticker:s effective_date:d cs_spread:f", "W20",
      with_parts("cs_supplier", "SELECT * FROM cs_supplier"))
def _(spark, sf_dir):
    return ft.corwin_schultz(tb.bars(spark, sf_dir))


@plan("training_windows", "ticker:s start_row:i start_date:d n:i first_close:f4 last_close:f4 sum_volume:f2 sum_weekday:i", "W21 X7",
      with_parts("bars_region", f"""
SELECT ticker, n AS start_row, effective_date AS start_date, len(c) AS n,
 CAST(greatest(-5, least(5, (c[1] - list_avg(c)) / (list_stddev_pop(c) + 1e-5))) AS FLOAT) AS first_close,
 CAST(greatest(-5, least(5, (c[101] - list_avg(c)) / (list_stddev_pop(c) + 1e-5))) AS FLOAT) AS last_close,
 list_sum(list_transform(v, lambda x: CAST(CAST(greatest(-5, least(5, (x - list_avg(v)) / (list_stddev_pop(v) + 1e-5))) AS FLOAT) AS DOUBLE))) AS sum_volume,
 list_sum(list_transform(d, lambda x: isodow(x) - 1)) AS sum_weekday
FROM (SELECT ticker, effective_date, row_number() OVER ({W}) - 1 AS n, count(*) OVER (PARTITION BY ticker) AS rows_,
 list(close) OVER w AS c, list(volume) OVER w AS v, list(effective_date) OVER w AS d FROM bars_region
 WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING))
WHERE rows_ >= 120 AND n % 5 = 0 AND len(c) = 101"""))
def _(spark, sf_dir):
    out = ft.training_windows(tb.bars(spark, sf_dir, "region"))
    return out.select(
        "ticker", "start_row", "start_date", F.size("close").alias("n"),
        F.element_at("close", 1).alias("first_close"), F.element_at("close", -1).alias("last_close"),
        F.aggregate("volume", F.lit(0.0), lambda a, x: a + x).alias("sum_volume"),
        F.aggregate("stamps", F.lit(0), lambda a, x: a + x["weekday"]).alias("sum_weekday"))


@plan("winsorised_features", "ticker:s effective_date:d ret_1d:f realized_vol_21d:f", "W22",
      with_parts("feat_supplier", """
, m AS (SELECT ticker, avg(ret_1d) AS m1, stddev_samp(ret_1d) AS s1, avg(realized_vol_21d) AS m2, stddev_samp(realized_vol_21d) AS s2
  FROM feat_supplier GROUP BY 1)
SELECT ticker, effective_date,
 CASE WHEN ret_1d IS NOT NULL THEN greatest(m1 - 2 * s1, least(m1 + 2 * s1, ret_1d)) END AS ret_1d,
 CASE WHEN realized_vol_21d IS NOT NULL THEN greatest(m2 - 2 * s2, least(m2 + 2 * s2, realized_vol_21d)) END AS realized_vol_21d
FROM feat_supplier JOIN m USING (ticker)"""))
def _(spark, sf_dir):
    # A cap of 2 spreads, so that the supplied prices do reach it.
    df = ft.add_realized_vol(ft.add_returns(tb.bars(spark, sf_dir), (1,)))
    return ft.winsorise(df, ["ret_1d", "realized_vol_21d"], 2.0, ["ticker"])


part("breadth", "bars_supplier", f"""
SELECT effective_date, avg(a20) AS breadth_ma20, avg(a50) AS breadth_ma50, count(a50) AS n_tickers FROM (
 SELECT effective_date,
  CASE WHEN count(*) OVER {frame(20)} = 20 THEN CASE WHEN close > avg(close) OVER {frame(20)} THEN 1.0 ELSE 0.0 END END AS a20,
  CASE WHEN count(*) OVER {frame(50)} = 50 THEN CASE WHEN close > avg(close) OVER {frame(50)} THEN 1.0 ELSE 0.0 END END AS a50
 FROM bars_supplier) GROUP BY 1""")


@plan("market_breadth", "effective_date:d breadth_ma20:f breadth_ma50:f n_tickers:i", "F15",
      with_parts("breadth", "SELECT * FROM breadth"))
def _(spark, sf_dir):
    return ft.breadth_by_date(tb.bars(spark, sf_dir))


@plan("sector_correlation", "effective_date:d sector_correlation:f n_pairs:i", "F16",
      with_parts("feat_region", """
, p AS (SELECT x.effective_date, x.ticker AS a, y.ticker AS b, x.ret_1d AS ra, y.ret_1d AS rb
  FROM feat_region x JOIN feat_region y ON x.effective_date = y.effective_date AND x.ticker < y.ticker
  WHERE x.ret_1d IS NOT NULL AND y.ret_1d IS NOT NULL)
SELECT effective_date, avg(c) AS sector_correlation, count(*) AS n_pairs FROM (
 SELECT effective_date, corr(ra, rb) OVER w AS c, count(*) OVER w AS n FROM p
 WINDOW w AS (PARTITION BY a, b ORDER BY effective_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
WHERE n = 63 GROUP BY 1"""))
def _(spark, sf_dir):
    return ft.sector_correlation(tb.bars(spark, sf_dir, "region"))


@plan("feature_vector",
      "ticker:s effective_date:d trend:f volatility:f breadth:f liquidity:f macro:f correlation:f options_proxy:f sector_relative_return:f fundamental:f",
      "F14",
      with_parts("trend_supplier relative macro breadth", """
, roc AS (SELECT effective_date, (value - lag(value, 21) OVER w) / greatest(abs(lag(value, 21) OVER w), 1e-9) AS roc FROM macro
  WHERE series_id = 'DGS10' WINDOW w AS (ORDER BY effective_date)),
spine AS (SELECT d AS effective_date, h.value AS hy, g.value AS ig, t.value AS t10, u.value AS t2, v.value AS vix, roc FROM (
   SELECT DISTINCT effective_date AS d FROM bars_supplier UNION SELECT effective_date FROM macro)
 LEFT JOIN macro h ON h.effective_date = d AND h.series_id = 'BAMLH0A0HYM2' LEFT JOIN macro g ON g.effective_date = d AND g.series_id = 'BAMLC0A0CM'
 LEFT JOIN macro t ON t.effective_date = d AND t.series_id = 'DGS10' LEFT JOIN macro u ON u.effective_date = d AND u.series_id = 'DGS2'
 LEFT JOIN macro v ON v.effective_date = d AND v.series_id = 'VIXCLS'
 LEFT JOIN roc ON roc.effective_date = d),
filled AS (SELECT effective_date, last_value(hy IGNORE NULLS) OVER w AS hy, last_value(ig IGNORE NULLS) OVER w AS ig,
  last_value(t10 IGNORE NULLS) OVER w AS t10, last_value(t2 IGNORE NULLS) OVER w AS t2, last_value(vix IGNORE NULLS) OVER w AS vix,
  last_value(roc IGNORE NULLS) OVER w AS roc FROM spine WINDOW w AS (ORDER BY effective_date ROWS UNBOUNDED PRECEDING))
SELECT t.ticker, t.effective_date, list_avg([ret_1d, ret_5d, ret_21d, ma_spread_50_200d]) AS trend,
  list_avg([vol_21d, atr_pct_21d]) AS volatility, breadth_ma50 AS breadth, volume_norm_21d AS liquidity,
  list_avg([hy, ig, t10 - t2, roc]) AS macro, NULL AS correlation, list_avg([0.9 * vix, vix, 1.1 * vix, vix / 1000, 1.1 * vix - vix]) AS options_proxy,
  sector_relative_ret_252d AS sector_relative_return, NULL AS fundamental
FROM trend_supplier t LEFT JOIN relative r USING (ticker, effective_date) LEFT JOIN filled f USING (effective_date)
LEFT JOIN breadth USING (effective_date)"""))
def _(spark, sf_dir):
    """The supplied tables hold one volatility series; the other terms and the skew are multiples of it."""
    macro = tb.macro(spark, sf_dir)
    v = F.col("value")
    options = macro.where("series_id = 'VIXCLS'").select(
        "effective_date", (0.9 * v).alias("vix_9d"), v.alias("vix_1m"), (1.1 * v).alias("vix_3m"), (v / 1000).alias("skew_index"))
    return ft.feature_vector(
        tb.bars(spark, sf_dir), tb.sector_map(spark, sf_dir), tb.bars(spark, sf_dir, "region"), macro, options)


HISTORY = ("ret_1d", "ret_21d", "realized_vol_21d", "pct_above_ma50", "yield_curve_slope", "hy_spread_roc_21d")

part("history", "long_region macro_feat", """
SELECT * FROM (SELECT effective_date, ret_1d, ret_21d, realized_vol_21d, pct_above_ma50,
 last_value(yield_curve_slope IGNORE NULLS) OVER w AS yield_curve_slope, last_value(hy_spread_roc_21d IGNORE NULLS) OVER w AS hy_spread_roc_21d
 FROM (SELECT effective_date, avg(feature_value) FILTER (WHERE feature_name = 'ret_1d') AS ret_1d,
  avg(feature_value) FILTER (WHERE feature_name = 'ret_21d') AS ret_21d,
  avg(feature_value) FILTER (WHERE feature_name = 'realized_vol_21d') AS realized_vol_21d,
  avg(feature_value) FILTER (WHERE feature_name = 'pct_above_ma50') AS pct_above_ma50 FROM long_region GROUP BY 1)
 FULL JOIN macro_feat USING (effective_date) WINDOW w AS (ORDER BY effective_date ROWS UNBOUNDED PRECEDING))
WHERE ret_1d IS NOT NULL AND ret_21d IS NOT NULL AND realized_vol_21d IS NOT NULL AND pct_above_ma50 IS NOT NULL
  AND yield_curve_slope IS NOT NULL AND hy_spread_roc_21d IS NOT NULL""")


def market(spark, sf_dir):
    macro = ft.macro_features(tb.macro(spark, sf_dir)).withColumn("ticker", F.lit("MACRO"))
    rows = long(spark, sf_dir, "region").unionByName(
        ft.to_long(macro, ("yield_curve_slope", "hy_spread_roc_21d")))
    return ft.market_history(rows, HISTORY, ("yield_curve_slope", "hy_spread_roc_21d"))


@plan("market_history",
      "effective_date:d ret_1d:f ret_21d:f realized_vol_21d:f pct_above_ma50:f yield_curve_slope:f hy_spread_roc_21d:f",
      "A1", with_parts("history", "SELECT * FROM history"))
def _(spark, sf_dir):
    return market(spark, sf_dir)
