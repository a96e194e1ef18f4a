"""Plans of the validation layer."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.stats import expected_max_normal
from plumbline.operators import validation as va
from plumbline.plans.feature_plans import wide
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.session import scratch
from plumbline.sources import store as st
from plumbline.sources import tables as tb

CV_COLUMNS = ("ret_1d", "ret_21d", "realized_vol_21d")
SIGNALS = tuple(va.SIGNALS)

part("cv_rows", "feat_region", """
SELECT ticker AS series_id, effective_date, ret_1d, ret_21d, realized_vol_21d,
 row_number() OVER (PARTITION BY ticker ORDER BY effective_date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n
FROM feat_region WHERE ret_1d IS NOT NULL AND ret_21d IS NOT NULL AND realized_vol_21d IS NOT NULL""")
part("wf_paths", "cv_rows", """
SELECT * FROM (SELECT r.*, i AS path_id, CASE WHEN idx < i * (n // 4) THEN 'train'
  WHEN idx >= i * (n // 4) + 504 AND idx < i * (n // 4) + 504 + n // 4 THEN 'test' END AS role
 FROM cv_rows r, range(1, 4) AS t(i) WHERE i * (n // 4) + 504 + n // 4 <= n) WHERE role IS NOT NULL""")
_PAIRS = ", ".join(f"({k + 1}, {a}, {b})" for k, (a, b) in enumerate(combinations(range(6), 2)))


def cp_sql(rows: str, embargo: int) -> str:
    return f"""
SELECT * FROM (SELECT r.*, path_id,
 CASE WHEN (idx >= a * s AND idx < ea) OR (idx >= b * s AND idx < eb) THEN 'test'
  WHEN NOT ((idx >= a * s - {embargo} AND idx < ea + {embargo}) OR (idx >= b * s - {embargo} AND idx < eb + {embargo})) THEN 'train' END AS role
 FROM (SELECT *, n // 6 AS s, CASE WHEN a = 5 THEN n ELSE (a + 1) * (n // 6) END AS ea, CASE WHEN b = 5 THEN n ELSE (b + 1) * (n // 6) END AS eb
  FROM {rows}, (VALUES {_PAIRS}) AS p(path_id, a, b)) r) WHERE role IS NOT NULL"""


part("cp_paths", "cv_rows", cp_sql("cv_rows", 60))
part("all_paths", "cv_rows", """
SELECT *, 0 AS path_id, 'train' AS role FROM cv_rows WHERE idx < n // 2 UNION ALL SELECT *, 0, 'test' FROM cv_rows""")


def pnl_parts(tag: str) -> None:
    part(f"{tag}_train", f"{tag}_paths", f"""
SELECT series_id, path_id, count(*) AS n_train, quantile_cont(realized_vol_21d, 0.5) AS mv, avg(ret_1d) AS mr FROM {tag}_paths WHERE role = 'train' GROUP BY 1, 2""")
    part(f"{tag}_test", f"{tag}_paths {tag}_train", f"""
SELECT t.series_id, t.path_id, idx, effective_date, n_train,
 coalesce(lag(CASE WHEN realized_vol_21d < mv THEN 1.0 ELSE 0.0 END) OVER w, 0) * ret_1d AS low_volatility,
 CASE WHEN mr > 0 THEN 1 ELSE -1 END * ret_1d AS train_drift,
 coalesce(lag(sign(ret_21d)) OVER w, 0) * ret_1d AS momentum,
 coalesce(lag(sign(drift)) OVER w, 0) * ret_1d AS rolling_drift
FROM (SELECT *, CASE WHEN count(*) OVER v >= 10 THEN avg(ret_1d) OVER v END AS drift FROM {tag}_paths WHERE role = 'test'
 WINDOW v AS (PARTITION BY series_id, path_id ORDER BY idx ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) t
JOIN {tag}_train USING (series_id, path_id) WINDOW w AS (PARTITION BY t.series_id, t.path_id ORDER BY idx)""")
    part(f"{tag}_pnl", f"{tag}_test", " UNION ALL ".join(
        f"SELECT series_id, path_id, idx, effective_date, n_train, '{s}' AS signal, {s} AS pnl FROM {tag}_test" for s in SIGNALS))
    part(f"{tag}_sharpe", f"{tag}_pnl", f"""
SELECT series_id, signal, path_id, count(*) AS n_test, any_value(n_train) AS n_train,
 CASE WHEN count(*) >= 2 AND stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252.0) ELSE 0 END AS sharpe FROM {tag}_pnl GROUP BY 1, 2, 3""")


# All regions' rows in one long series: enough rows for the fixed embargo.
part("chained", "cv_rows", """
SELECT 'chained' AS series_id, effective_date, ret_1d, ret_21d, realized_vol_21d,
 row_number() OVER (ORDER BY series_id, idx) - 1 AS idx, count(*) OVER () AS n FROM cv_rows""")
part("cq_paths", "chained", cp_sql("chained", 504))

for _t in ("wf", "cp", "cq", "all"):
    pnl_parts(_t)
_SIG = ", ".join(f"('{s}')" for s in SIGNALS)
part("wf_summary", "wf_sharpe cv_rows", f"""
SELECT e.series_id, e.signal, n_rows, coalesce(n_paths, 0) AS n_paths, coalesce(mean_sharpe, 0) AS mean_sharpe, coalesce(p30, 0) AS p30, coalesce(p50, 0) AS p50,
 CASE WHEN n_rows < 5 THEN 'INSUFFICIENT_DATA' WHEN n_paths IS NULL THEN 'NO_VALID_PATHS' ELSE 'OK' END AS status
FROM (SELECT series_id, signal, count(*) AS n_rows FROM cv_rows, (VALUES {_SIG}) AS s(signal) GROUP BY 1, 2) e
LEFT JOIN (SELECT series_id, signal, count(*) AS n_paths, avg(sharpe) AS mean_sharpe, quantile_cont(sharpe, 0.3) AS p30, quantile_cont(sharpe, 0.5) AS p50
 FROM wf_sharpe GROUP BY 1, 2) USING (series_id, signal)""")
part("moments", "all_pnl", """
SELECT series_id, signal, count(*) AS n_obs, avg(pow(pnl - m, 3)) / pow(avg(pow(pnl - m, 2)), 1.5) AS skew,
 avg(pow(pnl - m, 4)) / pow(avg(pow(pnl - m, 2)), 2) - 3 AS kurt FROM (SELECT *, avg(pnl) OVER (PARTITION BY series_id, signal) AS m FROM all_pnl) GROUP BY 1, 2""")


def phi(z: str) -> str:
    """Normal CDF in SQL: density times a series whose terms are all positive."""
    series = (f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({z})) - "
              f"(lgamma(k + 1.5) + (k + 1) * ln(2.0) - 0.5 * ln(pi())))))")
    up = f"(0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series})"
    return f"CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 WHEN {z} > 0 THEN {up} ELSE 1 - {up} END"


# The execution log has one row per (series, signal): a trial each.
part("deflated", "wf_summary moments", f"""
SELECT *, {phi('z_statistic')} AS deflated_sharpe FROM (
 SELECT series_id, signal, mean_sharpe AS sharpe, p30, n_obs, skew, kurt, (SELECT greatest(count(*), 2000) FROM wf_summary) AS n_trials,
  (mean_sharpe - {expected_max_normal(2000)!r}) / sqrt(greatest((1 - skew * mean_sharpe + (kurt - 1) / 4 * mean_sharpe * mean_sharpe) / (n_obs - 1), 1e-12)) AS z_statistic
 FROM wf_summary JOIN moments USING (series_id, signal))""")


def cv_rows(spark, sf_dir):
    df = wide(spark, sf_dir, "region").withColumnRenamed("ticker", "series_id")
    return va.numbered(df, CV_COLUMNS)


@plan("walk_forward_paths", "series_id:s path_id:i role:s n:i first_idx:i last_idx:i", "V1",
      with_parts("wf_paths", "SELECT series_id, path_id, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM wf_paths GROUP BY 1, 2, 3"))
def _(spark, sf_dir):
    return va.walk_forward_paths(cv_rows(spark, sf_dir)).groupBy("series_id", "path_id", "role").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@plan("walk_forward_pnl", "series_id:s path_id:i signal:s idx:i effective_date:d pnl:f", "V3 W16 W17 E1",
      with_parts("wf_pnl", "SELECT * FROM wf_pnl"))
def _(spark, sf_dir):
    return va.signal_pnl(va.walk_forward_paths(cv_rows(spark, sf_dir)))


@plan("walk_forward_sharpes", "series_id:s signal:s path_id:i n_train:i n_test:i sharpe:f", "A3 V1",
      with_parts("wf_sharpe", "SELECT * FROM wf_sharpe"))
def _(spark, sf_dir):
    return va.path_sharpes(va.signal_pnl(va.walk_forward_paths(cv_rows(spark, sf_dir))))


@plan("walk_forward", "series_id:s signal:s n_rows:i n_paths:i mean_sharpe:f p30:f p50:f status:s", "V1 A5",
      with_parts("wf_summary", "SELECT * FROM wf_summary"))
def _(spark, sf_dir):
    return va.walk_forward(cv_rows(spark, sf_dir))


@plan("combinatorial_paths", "series_id:s path_id:i role:s n:i first_idx:i last_idx:i", "V2",
      with_parts("cp_paths", "SELECT series_id, path_id, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM cp_paths GROUP BY 1, 2, 3"))
def _(spark, sf_dir):
    # 60 embargo rows: the supplied calendar is too short for the public floor.
    return va.combinatorial_paths(cv_rows(spark, sf_dir), embargo=60).groupBy("series_id", "path_id", "role").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@plan("combinatorial_sharpes", "series_id:s signal:s path_id:i n_train:i n_test:i sharpe:f", "V2",
      with_parts("cp_sharpe", "SELECT * FROM cp_sharpe WHERE n_train >= 30 AND n_test >= 5"))
def _(spark, sf_dir):
    pnl = va.signal_pnl(va.combinatorial_paths(cv_rows(spark, sf_dir), embargo=60))
    return va.path_sharpes(pnl, min_train=va.MIN_TRAIN_ROWS, min_test=va.MIN_TEST_ROWS)


def chained_rows(spark, sf_dir):
    rows = cv_rows(spark, sf_dir)
    one = Window.partitionBy().orderBy("series_id", "idx")  # one row per region and day
    return rows.select(
        F.lit("chained").alias("series_id"), *[c for c in rows.columns if c not in ("series_id", "idx", "n")],
        (F.row_number().over(one) - 1).alias("idx"), F.count("*").over(Window.partitionBy()).alias("n"))


@plan("cpcv_with_fallback", "series_id:s signal:s n_rows:i n_paths:i p30:f p50:f status:s cv_method:s", "V2",
      with_parts("wf_summary cq_sharpe chained", f"""
SELECT series_id, signal, n_rows, n_paths, p30, p50, status, 'walk_forward_fallback' AS cv_method FROM wf_summary UNION ALL
SELECT 'chained', signal, (SELECT count(*) FROM chained), count(sharpe), quantile_cont(sharpe, 0.3), quantile_cont(sharpe, 0.5), 'OK', 'cpcv'
FROM (VALUES {_SIG}) AS s(signal) LEFT JOIN (SELECT * FROM cq_sharpe WHERE n_train >= 30 AND n_test >= 5) USING (signal) GROUP BY signal"""))
def _(spark, sf_dir):
    """Regions are too short for the embargo and fall back; the chained series is not."""
    return va.cpcv(cv_rows(spark, sf_dir).unionByName(chained_rows(spark, sf_dir)))


@plan("pnl_moments", "series_id:s signal:s n_obs:i skew:f kurt:f", "A4", with_parts("moments", "SELECT * FROM moments"))
def _(spark, sf_dir):
    return va.pnl_moments(va.signal_pnl(va.whole_sample(cv_rows(spark, sf_dir))))


def deflated(spark, sf_dir):
    """Every series and signal is logged before it is computed; the Sharpe is deflated by the length of the log."""
    rows = cv_rows(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in SIGNALS])
    runs = rows.select("series_id").distinct().select(
        F.explode(names).alias("layer_name"), F.lit("walk_forward").alias("function_name"), F.col("series_id").alias("hyperparameters"))
    trials = st.log_executions(runs, scratch(spark, "executions"), run="deflated")
    wf = va.walk_forward(rows).withColumnRenamed("mean_sharpe", "sharpe")
    moments = va.pnl_moments(va.signal_pnl(va.whole_sample(rows)))
    return va.deflated_sharpe(wf.join(moments, ["series_id", "signal"]), trials)


@plan("deflated_sharpe", "series_id:s signal:s sharpe:f n_obs:i n_trials:i z_statistic:f deflated_sharpe:f", "V4 X2",
      with_parts("deflated", "SELECT * FROM deflated"))
def _(spark, sf_dir):
    return deflated(spark, sf_dir)


part("delisted", "", """
SELECT s_name AS ticker, DATE '1995-01-01' + CAST(s_suppkey * 37 % 3000 AS INTEGER) AS termination_date,
 CASE CAST(s_suppkey % 6 AS INTEGER) WHEN 0 THEN 'merger' WHEN 1 THEN 'bankruptcy' WHEN 2 THEN 'acquisition' WHEN 3 THEN 'voluntary' WHEN 4 THEN 'unknown' ELSE 'vanished' END AS termination_reason,
 CAST(s_acctbal / 10000.0 AS DOUBLE) AS terminal_return FROM supplier WHERE s_suppkey % 4 <> 0""")
part("live_universe", "", "SELECT DISTINCT s_name AS ticker FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.095")


def delisted(spark, sf_dir):
    k = F.col("s_suppkey")
    reason = F.coalesce(*[F.when(k % 6 == i, r) for i, r in enumerate(
        ("merger", "bankruptcy", "acquisition", "voluntary", "unknown"))], F.lit("vanished"))
    return tb.read(spark, sf_dir, "supplier").where(k % 4 != 0).select(
        F.col("s_name").alias("ticker"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 3000).cast("int")).alias("termination_date"),
        reason.alias("termination_reason"), (F.col("s_acctbal") / 10000.0).alias("terminal_return"))


def live_universe(spark, sf_dir):
    big = tb.read(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.095").select("l_suppkey").distinct()
    return tb.read(spark, sf_dir, "supplier").join(big, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("ticker"))


WINDOW = ("1996-01-01", "2001-12-31")


@plan("survivorship_audit", "expected_n:i found_n:i coverage:f passed:b note:s", "J7",
      with_parts("delisted live_universe", """
, m AS (SELECT DISTINCT d.ticker, l.ticker IS NOT NULL AS found FROM delisted d LEFT JOIN live_universe l USING (ticker)
 WHERE termination_date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'),
c AS (SELECT count(*) AS expected_n, count(*) FILTER (WHERE found) AS found_n FROM m)
SELECT expected_n, found_n, cov AS coverage, cov >= 0.8 AS passed, CASE WHEN expected_n = 0 THEN 'PASS (no delisted tickers in window)'
 WHEN cov >= 0.8 THEN printf('PASS coverage=%.3f >= floor=0.80', cov)
 ELSE printf('FAIL coverage=%.3f < floor=0.80; missing %d delisted ticker(s)', cov, expected_n - found_n) END AS note
FROM (SELECT *, CASE WHEN expected_n = 0 THEN 1 ELSE found_n / expected_n END AS cov FROM c)"""))
def _(spark, sf_dir):
    return va.survivorship(live_universe(spark, sf_dir), delisted(spark, sf_dir), *WINDOW)


@plan("survivorship_missing", "ticker:s", "J7 U2",
      with_parts("delisted live_universe", """
SELECT DISTINCT ticker FROM delisted WHERE termination_date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31' AND ticker NOT IN (SELECT ticker FROM live_universe)"""))
def _(spark, sf_dir):
    return va.missing_tickers(live_universe(spark, sf_dir), delisted(spark, sf_dir), *WINDOW)


# Reports: one layer per signal, one as-of date per series; calibration error from the journal share.
part("reports", "deflated bars_region", """
SELECT d.signal AS layer_name, (SELECT max(effective_date) FROM bars_region) - CAST(rank() OVER (PARTITION BY signal ORDER BY series_id) AS INTEGER) AS as_of,
 CASE CAST(rank() OVER (PARTITION BY signal ORDER BY series_id) % 3 AS INTEGER) WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PASSED' ELSE 'NOT_RUN' END AS survivorship_audit,
 sharpe AS walk_forward_sharpe, abs(skew) / 10 AS walk_forward_ece, p30 AS cpcv_p30_sharpe, deflated_sharpe FROM deflated d""")
part("signed", "reports", """
SELECT *, rationale = '' AS production_ready, CASE WHEN survivorship_audit = 'FAILED' OR walk_forward_sharpe <= 0 THEN 'blocked' WHEN rationale = '' THEN 'production' ELSE 'research_preview' END AS status
FROM (SELECT *, concat_ws('; ', CASE survivorship_audit WHEN 'FAILED' THEN 'survivorship audit FAILED' WHEN 'NOT_RUN' THEN 'survivorship audit not run' END,
 CASE WHEN walk_forward_sharpe < 0.5 THEN printf('walk_forward_sharpe=%.3f < floor 0.50', walk_forward_sharpe) END,
 CASE WHEN walk_forward_ece > 0.05 THEN printf('walk_forward_ece=%.3f > ceiling 0.05', walk_forward_ece) END,
 CASE WHEN cpcv_p30_sharpe < 0 THEN printf('cpcv_p30_sharpe=%.3f < floor 0.00', cpcv_p30_sharpe) END,
 CASE WHEN deflated_sharpe < 0.95 THEN printf('deflated_sharpe=%.3f < floor 0.95', deflated_sharpe) END) AS rationale FROM reports)""")


def reports(spark, sf_dir):
    from pyspark.sql.window import Window
    d = deflated(spark, sf_dir)
    last = tb.trades(spark, sf_dir).groupBy().agg(F.max("effective_date").alias("_last"))
    rank = F.rank().over(Window.partitionBy("signal").orderBy("series_id"))
    d = d.join(F.broadcast(last), F.lit(True)).withColumn("_r", rank)
    return d.select(
        F.col("signal").alias("layer_name"), F.date_sub("_last", F.col("_r")).alias("as_of"),
        F.when(F.col("_r") % 3 == 0, "FAILED").when(F.col("_r") % 3 == 1, "PASSED").otherwise("NOT_RUN").alias("survivorship_audit"),
        F.col("sharpe").alias("walk_forward_sharpe"), (F.abs("skew") / 10).alias("walk_forward_ece"),
        F.col("p30").alias("cpcv_p30_sharpe"), "deflated_sharpe")


@plan("sign_off", "layer_name:s as_of:d survivorship_audit:s walk_forward_sharpe:f status:s production_ready:b rationale:s", "V6",
      with_parts("signed", "SELECT * REPLACE (CASE WHEN rationale = '' THEN 'all sign-off criteria met' ELSE rationale END AS rationale) FROM signed"))
def _(spark, sf_dir):
    return va.sign_off(reports(spark, sf_dir))


@plan("latest_reports", "report_id:s layer_name:s as_of:d status:s walk_forward_sharpe:f", "V7 X6 W13 S9",
      with_parts("signed", "SELECT layer_name || '::' || as_of AS report_id, * FROM signed QUALIFY row_number() OVER (PARTITION BY layer_name ORDER BY as_of DESC) = 1"))
def _(spark, sf_dir):
    stored = va.report_rows(va.sign_off(reports(spark, sf_dir)))
    back = va.parse_reports(va.latest_reports(stored), "walk_forward_sharpe double, rationale string")
    return back.withColumn("walk_forward_sharpe", F.col("report.walk_forward_sharpe"))


@plan("layer_status", "layer_name:s status:s rationale:s", "J9",
      with_parts("signed", """
, l AS (SELECT DISTINCT event_type AS layer_name FROM events UNION SELECT DISTINCT signal FROM deflated)
SELECT layer_name, coalesce(status, 'no_report') AS status, coalesce(CASE WHEN rationale = '' THEN 'all sign-off criteria met' ELSE rationale END, 'No validation report persisted yet.') AS rationale FROM l
LEFT JOIN (SELECT * FROM signed QUALIFY row_number() OVER (PARTITION BY layer_name ORDER BY as_of DESC) = 1) USING (layer_name)"""))
def _(spark, sf_dir):
    signed = va.sign_off(reports(spark, sf_dir))
    names = tb.read(spark, sf_dir, "events").select(F.col("event_type").alias("layer_name")).distinct()
    names = names.union(spark.createDataFrame([(s,) for s in SIGNALS], "layer_name string"))
    return va.layer_status(names, signed)


@plan("gate_counts", "status:s n:i", "A21", with_parts("signed", "SELECT status, count(*) AS n FROM signed GROUP BY 1"))
def _(spark, sf_dir):
    return va.sign_off(reports(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@plan("gated_preview", "layer_name:s series_id:s sharpe:f disclosure:s", "P12",
      with_parts("signed", """
SELECT signal AS layer_name, series_id, sharpe, CASE WHEN NOT production_ready THEN 'Research preview: ' || rationale END AS disclosure FROM deflated d
JOIN (SELECT * FROM signed QUALIFY row_number() OVER (PARTITION BY layer_name ORDER BY as_of DESC) = 1) s ON s.layer_name = d.signal
WHERE production_ready OR status = 'research_preview'"""))
def _(spark, sf_dir):
    rows = deflated(spark, sf_dir).select(F.col("signal").alias("layer_name"), "series_id", "sharpe")
    return va.gate(rows, va.sign_off(reports(spark, sf_dir)), preview=True)


@plan("locked_layers", "layer_name:s series_id:s sharpe:f status:s", "P11",
      with_parts("deflated", """
SELECT signal AS layer_name, series_id, CASE WHEN signal NOT IN ('momentum', 'train_drift') THEN sharpe END AS sharpe,
 CASE WHEN signal IN ('momentum', 'train_drift') THEN 'LOCKED' ELSE 'OK' END AS status FROM deflated"""))
def _(spark, sf_dir):
    rows = deflated(spark, sf_dir).select(F.col("signal").alias("layer_name"), "series_id", "sharpe")
    return va.lock_layers(rows, ["sharpe"], ("momentum", "train_drift"), "lite")


part("fetch_audit", "", """
SELECT event_type AS ticker, CAST(ts AS DATE) AS fetch_date, ts AS fetched_at, CASE WHEN event_id % 50 = 0 THEN 'MISSING' WHEN event_id % 7 = 0 THEN 'BAD_ROWS' ELSE 'OK' END AS status,
 CASE WHEN event_id % 50 = 0 THEN 0 ELSE user_id % 20 END AS n_rows, event_id % 7 AS n_consec_gaps FROM events""")


def fetch_audit(spark, sf_dir):
    k = F.col("event_id")
    return tb.read(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.to_date("ts").alias("fetch_date"), F.col("ts").alias("fetched_at"),
        F.when(k % 50 == 0, "MISSING").when(k % 7 == 0, "BAD_ROWS").otherwise("OK").alias("status"),
        F.when(k % 50 == 0, 0).otherwise(F.col("user_id") % 20).alias("n_rows"), (k % 7).alias("n_consec_gaps"))


part("integrity", "fetch_audit", """
SELECT *, reasons = '' AS integrity_ok FROM (SELECT *, concat_ws('; ', CASE WHEN missing_fraction > 0.02 THEN printf('missing-bar fraction %.3f > 0.020', missing_fraction) END,
 CASE WHEN stale_fraction > 0.2 THEN printf('cross-ticker stale fraction %.3f > 0.200', stale_fraction) END) AS reasons FROM (
 SELECT sum(m) / sum(n) AS missing_fraction, max(s / n) AS stale_fraction FROM (
  SELECT fetch_date, count(*) AS n, count(*) FILTER (WHERE status = 'MISSING') AS m, count(*) FILTER (WHERE n_rows = 0) AS s FROM fetch_audit GROUP BY 1)))""")


@plan("data_integrity", "missing_fraction:f stale_fraction:f integrity_ok:b reasons:s", "A14",
      with_parts("integrity", "SELECT * FROM integrity"))
def _(spark, sf_dir):
    return va.integrity(fetch_audit(spark, sf_dir))


part("diverge", "paper_trades", """
SELECT layer_attributed_to AS layer_name, count(*) AS n_days, avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(252.0) AS live_sharpe FROM paper_trades GROUP BY 1""")


def reference_sharpes(spark, sf_dir):
    return tb.paper_trades(spark, sf_dir).groupBy(F.col("layer_attributed_to").alias("layer_name")).agg(
        F.avg(F.col("trade_id") % 100 / 1000.0).alias("pre_deployment_sharpe"))


@plan("live_divergence", "layer_name:s n_days:i pre_deployment_sharpe:f status:s live_sharpe:f divergence:f demote_to_research:b", "A15",
      with_parts("diverge", """
, r AS (SELECT layer_attributed_to AS layer_name, avg(trade_id % 100 / 1000.0) AS ref FROM paper_trades GROUP BY 1)
SELECT layer_name, n_days, ref AS pre_deployment_sharpe, CASE WHEN n_days < 90 THEN 'INSUFFICIENT_PAPER_DATA' ELSE 'OK' END AS status,
 CASE WHEN n_days >= 90 THEN live_sharpe END AS live_sharpe, CASE WHEN n_days >= 90 THEN abs(live_sharpe - ref) / abs(ref) END AS divergence,
 n_days >= 90 AND abs(live_sharpe - ref) / abs(ref) > 0.3 AS demote_to_research FROM diverge JOIN r USING (layer_name)"""))
def _(spark, sf_dir):
    return va.divergence(tb.paper_trades(spark, sf_dir), reference_sharpes(spark, sf_dir))


@plan("live_divergence_lite", "layer_name:s status:s live_sharpe:f divergence:f demote_to_research:b", "A14 A15",
      with_parts("diverge integrity", """
, r AS (SELECT layer_attributed_to AS layer_name, avg(trade_id % 100 / 1000.0) AS ref FROM paper_trades GROUP BY 1)
SELECT layer_name, CASE WHEN NOT integrity_ok THEN 'VALIDATION_PAUSED_DATA_INTEGRITY' WHEN n_days < 90 THEN 'INSUFFICIENT_PAPER_DATA' ELSE 'OK' END AS status,
 CASE WHEN integrity_ok AND n_days >= 90 THEN live_sharpe END AS live_sharpe, CASE WHEN integrity_ok AND n_days >= 90 THEN abs(live_sharpe - ref) / abs(ref) END AS divergence,
 integrity_ok AND n_days >= 90 AND abs(live_sharpe - ref) / abs(ref) > 0.4 AS demote_to_research FROM diverge JOIN r USING (layer_name), integrity"""))
def _(spark, sf_dir):
    return va.divergence(tb.paper_trades(spark, sf_dir), reference_sharpes(spark, sf_dir), fetch_audit(spark, sf_dir), lite=True)
