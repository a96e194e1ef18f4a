"""Calibration, hygiene and governance plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import analogs as an
from plumbline.operators import calibration as cal
from plumbline.operators import features as ft
from plumbline.operators import governance as gov
from plumbline.operators import hygiene as hy
from plumbline.operators import pit
from plumbline.plans.analog_plans import by_state, history, nearest, past, states
from plumbline.plans.feature_plans import fresh
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.session import materialise, stored_once, stored_or
from plumbline.sources import store as st
from plumbline.sources import tables as tb

_P = "CASE confidence_self WHEN 1 THEN 0.30 WHEN 2 THEN 0.45 WHEN 3 THEN 0.55 WHEN 4 THEN 0.70 WHEN 5 THEN 0.85 END"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    c = f"(({k} / {n} + 1.9208 / {n}) / (1 + 3.8416 / {n}))"
    h = f"(1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
    return f"greatest(0, {c} - {h})", f"least(1, {c} + {h})"


_LO, _HI = wilson_sql("CAST(wins AS DOUBLE)", "n")
for _name, _win, _where in (
    ("bands", "pnl_pct > 0", "pnl_pct IS NOT NULL"),
    ("graded_bands", "thesis_validated", "exit_date IS NOT NULL AND thesis_validated IS NOT NULL"),
):
    part(_name, "journal", f"""
SELECT *, {_P} AS avg_predicted, wins / n AS avg_observed, {_LO} AS ci_low, {_HI} AS ci_high FROM (
 SELECT confidence_self, count(*) AS n, sum(CASE WHEN {_win} THEN 1 ELSE 0 END) AS wins FROM journal WHERE {_where} GROUP BY 1)""")
    part(f"{_name}_score", _name, """
SELECT 'OK' AS status, sum(n) AS n_entries, sum(wins * (1 - avg_predicted) * (1 - avg_predicted) + (n - wins) * avg_predicted * avg_predicted) / sum(n) AS brier,
 sum(n * abs(avg_predicted - avg_observed)) / sum(n) AS ece FROM %s""" % _name)
_BAND_COLS = "confidence_self:i n:i avg_predicted:f avg_observed:f ci_low:f ci_high:f"


@plan("confidence_reliability", _BAND_COLS, "A6 A8", with_parts("bands", "SELECT * FROM bands"))
def _(spark, sf_dir):
    return cal.reliability(tb.journal(spark, sf_dir))


@plan("graded_reliability", _BAND_COLS, "A7 A8", with_parts("graded_bands", "SELECT * FROM graded_bands"))
def _(spark, sf_dir):
    return cal.graded_reliability(tb.journal(spark, sf_dir))


@plan("calibration_score", "status:s n_entries:i brier:f ece:f calibration_band:s", "A6",
      with_parts("bands_score", "SELECT *, CASE WHEN ece < 0.05 THEN 'well_calibrated' WHEN ece < 0.1 THEN 'moderately_calibrated' ELSE 'poorly_calibrated' END AS calibration_band FROM bands_score"))
def _(spark, sf_dir):
    return cal.score(cal.reliability(tb.journal(spark, sf_dir)))


@plan("calibration_cards", "label:s value:s note:s", "A7",
      with_parts("graded_bands_score", """
SELECT 'Brier score' AS label, printf('%.3f', brier) AS value, 'Lower is better. 0.25 = coin flip.' AS note FROM graded_bands_score
UNION ALL SELECT 'Expected calibration error', printf('%.3f', ece), CASE WHEN ece > 0.05 THEN 'Above the 0.05 ceiling — overconfident.' ELSE 'Within the 0.05 ceiling.' END FROM graded_bands_score
UNION ALL SELECT 'Graded entries', CAST(CAST(n_entries AS BIGINT) AS VARCHAR), CASE WHEN n_entries < 15 THEN 'Below the 15-entry minimum — treat with caution.' WHEN n_entries < 30 THEN 'Above the 15-entry minimum, below comfort.' ELSE 'Sufficient sample.' END FROM graded_bands_score"""))
def _(spark, sf_dir):
    return cal.score_cards(cal.score(cal.graded_reliability(tb.journal(spark, sf_dir)), cal.MIN_GRADED))


@plan("regime_performance", "market_state_id:i n:i hit_rate:f mean_pnl_pct:f excluded:b", "A9",
      with_parts("journal", """
SELECT market_state_id, count(*) AS n, CASE WHEN market_state_id IS NOT NULL THEN avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END) END AS hit_rate,
 CASE WHEN market_state_id IS NOT NULL THEN avg(pnl_pct) END AS mean_pnl_pct, market_state_id IS NULL AS excluded
FROM (SELECT CASE WHEN CAST(entry_id AS BIGINT) % 5 <> 0 THEN market_state_id END AS market_state_id, pnl_pct FROM journal WHERE pnl_pct IS NOT NULL) GROUP BY 1"""))
def _(spark, sf_dir):
    rows = tb.journal(spark, sf_dir)
    some = F.when(F.col("entry_id").cast("long") % 5 != 0, F.col("market_state_id"))
    return cal.regime_performance(rows.withColumn("market_state_id", some))


@plan("thesis_drift", "n_invalidated_losses:i warning:b recent:i recent_warning:b", "A10",
      with_parts("journal", """
SELECT count(*) AS n_invalidated_losses, count(*) > 3 AS warning, count(*) FILTER (WHERE exit_date >= DATE '2001-12-31' - 30) AS recent,
 count(*) FILTER (WHERE exit_date >= DATE '2001-12-31' - 30) > 3 AS recent_warning FROM journal WHERE NOT thesis_validated AND pnl_pct < 0"""))
def _(spark, sf_dir):
    rows = tb.journal(spark, sf_dir)
    recent = cal.thesis_drift(rows, "2001-12-31").select(F.col("n_invalidated_losses").alias("recent"), F.col("warning").alias("recent_warning"))
    return cal.thesis_drift(rows).join(F.broadcast(recent), F.lit(True))


@plan("binned_calibration_error", "n:i ece:f n_bins:i", "A11", """
SELECT sum(n) AS n, sum(CASE WHEN inside THEN n * abs(p - y) ELSE 0 END) / sum(n) AS ece, count(*) FILTER (WHERE inside) AS n_bins FROM (
 SELECT floor(p * 10) AS b, p < 1 AS inside, count(*) AS n, avg(p) AS p, avg(y) AS y FROM (SELECT (doc_id * 7919 % 101) / 100.0 AS p, quality AS y FROM labels) GROUP BY 1, 2)""")
def _(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "labels").select((F.col("doc_id") * 7919 % 101 / 100.0).alias("p"), F.col("quality").alias("y"))
    return cal.binned_calibration_error(rows)


# ---- predictions graded against what followed
part("predicted", "past_kelly", """
SELECT sha1(ticker || '|' || as_of || '|10') AS prediction_id, ticker, as_of AS knowledge_date, 10 AS horizon_days, p50 AS pred_p50, p5 AS pred_p5, p95 AS pred_p95,
 hit_rate AS pred_hit_prob, kelly_displayed AS pred_sizing, effective_n FROM past_kelly WHERE n_returns >= 5""")
part("bench", "feat_region", "SELECT effective_date, ret_fwd_10d AS benchmark_ret FROM feat_region WHERE ticker = 'AMERICA'")
part("resolved", "predicted bench feat_supplier", """
SELECT p.*, ok AS resolved, CASE WHEN ok THEN ret_fwd_10d END AS realized_ret, CASE WHEN ok THEN b END AS benchmark_ret, CASE WHEN ok THEN ret_fwd_10d - b END AS alpha FROM (
 SELECT p.*, ret_fwd_10d, benchmark_ret AS b, coalesce(later >= 10 AND ret_fwd_10d IS NOT NULL, false) AS ok FROM predicted p
 LEFT JOIN (SELECT ticker, effective_date, ret_fwd_10d, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY effective_date) AS later FROM feat_supplier) f
  ON f.ticker = p.ticker AND f.effective_date = p.knowledge_date
 LEFT JOIN bench ON bench.effective_date = p.knowledge_date) p""".replace("SELECT p.*, ok", "SELECT p.* EXCLUDE (ret_fwd_10d, b, ok), ok"))


def predictions(spark, sf_dir):
    return gov.emit_predictions(an.kelly_ladder(an.summarise(past(spark, sf_dir)[1])))


def labels(spark, sf_dir):
    own = ft.add_forward_label(tb.bars(spark, sf_dir)).select("ticker", "effective_date", "ret_fwd_10d")
    bench = ft.add_forward_label(tb.bars(spark, sf_dir, "region")).select("ticker", "effective_date", "ret_fwd_10d")
    return own.unionByName(bench.where("ticker = 'AMERICA'"))


def resolved(spark, sf_dir):
    return pit.resolve_predictions(predictions(spark, sf_dir), labels(spark, sf_dir), "AMERICA")


@plan("emitted_predictions", "prediction_id:s ticker:s knowledge_date:d horizon_days:i pred_p50:f pred_p5:f pred_p95:f pred_hit_prob:f pred_sizing:f effective_n:f", "G1 K5 X5",
      with_parts("predicted", "SELECT * FROM predicted"))
def _(spark, sf_dir):
    """A rerun over dates of which some are stored: only absent predictions are added."""
    every = materialise(predictions(spark, sf_dir), "predictions")
    stored = every.where(F.dayofmonth("knowledge_date") % 2 == 0)
    return stored.unionByName(st.insert_absent(stored, every, ["prediction_id"]))


@plan("backfill_dates", "ticker:s as_of:d", "K5", with_parts("past_q", "SELECT ticker, effective_date AS as_of FROM past_q"))
def _(spark, sf_dir):
    return an.sampled_queries(history(spark, sf_dir), 126, 5).withColumnRenamed("effective_date", "as_of")


@plan("resolved_predictions", "prediction_id:s ticker:s knowledge_date:d resolved:b realized_ret:f benchmark_ret:f alpha:f", "J6",
      with_parts("resolved", "SELECT * FROM resolved"))
def _(spark, sf_dir):
    return resolved(spark, sf_dir)


_AGG = """count(*) AS n, avg(pred_hit_prob) AS predicted, avg(CASE WHEN realized_ret > 0 THEN 1.0 ELSE 0 END) AS hit_rate,
 avg(CASE WHEN sign(pred_p50) = sign(realized_ret) THEN 1.0 ELSE 0 END) AS directional_accuracy, avg(pred_p50) AS mean_pred_p50, avg(realized_ret) AS mean_realized,
 avg(alpha) AS alpha_mean, avg(CASE WHEN alpha IS NULL THEN NULL WHEN alpha > 0 THEN 1.0 ELSE 0 END) AS alpha_hit_rate, (SELECT count(*) >= 20 FROM done) AS enough"""


@plan("track_record", "scope:s item:s n:i predicted:f4 hit_rate:f4 directional_accuracy:f4 mean_pred_p50:f4 mean_realized:f4 alpha_mean:f4 alpha_hit_rate:f4 enough:b", "A12 Q12",
      with_parts("resolved", f"""
, done AS (SELECT * FROM resolved WHERE resolved AND realized_ret IS NOT NULL)
SELECT 'overall' AS scope, 'all' AS item, {_AGG} FROM done UNION ALL
SELECT 'bin', printf('%.1f', least(floor(pred_hit_prob * 5), 4) * 0.2 + 0.1), {_AGG} FROM done GROUP BY 2 UNION ALL SELECT 'ticker', ticker, {_AGG} FROM done GROUP BY 2"""))
def _(spark, sf_dir):
    return cal.track_record(resolved(spark, sf_dir))


@plan("prediction_counts", "resolved:i pending:i", "A12",
      with_parts("resolved", "SELECT count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS pending FROM resolved"))
def _(spark, sf_dir):
    return cal.pending_count(resolved(spark, sf_dir))


# ---- decisions and their change log
part("verdicts", "regime_kelly both_sets drive2 market_state", """
SELECT *, CASE WHEN n_bull - n_bear >= 2 THEN 'lean long' WHEN n_bull - n_bear <= -2 THEN 'lean short' ELSE 'neutral' END AS verdict,
 printf('%.2f', round_even(kelly_displayed / 0.05, 0) * 0.05) AS sizing_band FROM (
 SELECT k.*, d.dis AS disagreement,
  ups + CAST(hit_rate > 0.5 AS INT) + CAST(p50 > 0 AND p95 > abs(p5) AS INT) + CAST(regime LIKE '%Bull%' AS INT) + CAST(kelly_displayed > 0 AS INT) AS n_bull,
  downs + CAST(hit_rate <= 0.5 AS INT) + CAST(NOT (p50 > 0 AND p95 > abs(p5)) AND abs(p5) > p95 AS INT)
  + CAST(regime LIKE '%Bear%' AND regime NOT LIKE '%Bull%' AS INT) + CAST(dis AS INT) + CAST(round_even(effective_n, 0) < 15 AS INT) AS n_bear
 FROM regime_kelly k JOIN drive2 USING (ticker)
 JOIN market_state ms ON ms.effective_date = k.as_of
 JOIN (SELECT ticker, sum(g * w) / count(*) < 0.5 AS dis FROM (SELECT ticker, effective_date, max(CASE WHEN analog_set = 'global' THEN 1 ELSE 0 END) AS g,
   max(CASE WHEN analog_set = 'within' THEN 1 ELSE 0 END) AS w FROM both_sets GROUP BY 1, 2) GROUP BY 1) d USING (ticker))""")
_FZ = " UNION ALL ".join(
    f"SELECT ticker, {i} AS p, (arg_max({f}, row_no) - avg({f})) / CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS z FROM shist GROUP BY 1"
    for i, f in enumerate(ft.DISTANCE_FEATURES))
part("drive2", "shist", f"""
SELECT ticker, count(*) FILTER (WHERE z >= 0) AS ups, count(*) FILTER (WHERE z < 0) AS downs FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(z) DESC, p) AS r FROM ({_FZ})) WHERE r <= 3 GROUP BY 1""")


def decided(spark, sf_dir):
    assets = an.assets(*by_state(spark, sf_dir)).where("n_returns IS NOT NULL")
    regimes = states(spark, sf_dir).select(F.col("effective_date").alias("as_of"), "regime")
    return gov.cases(
        assets.join(regimes, "as_of").withColumns({
            "n": F.bround("effective_n").cast("int"),
            "disagreement": F.coalesce("disagreement", F.lit(False))}))


@plan("bull_bear_cases", "ticker:s n_bull:i n_bear:i verdict:s", "G7", with_parts("verdicts", "SELECT ticker, n_bull, n_bear, verdict FROM verdicts"))
def _(spark, sf_dir):
    return decided(spark, sf_dir).withColumn("n_bull", F.size("bull")).withColumn("n_bear", F.size("bear"))


@plan("decision_state", "ticker:s verdict:s sizing_band:s disagreement:s", "G7 G2",
      with_parts("verdicts", "SELECT ticker, verdict, sizing_band, CASE WHEN disagreement THEN 'yes' ELSE 'no' END AS disagreement FROM verdicts"))
def _(spark, sf_dir):
    return gov.decision_state(decided(spark, sf_dir))


# The log holds an earlier opinion on some tickers, dated by their trades.
part("old_log", "bars_supplier", """
SELECT ticker, field, v AS new_value, effective_date AS changed_at FROM (SELECT ticker, effective_date FROM bars_supplier WHERE day(effective_date) = 1 AND CAST(right(ticker, 3) AS INTEGER) % 3 <> 0),
 (VALUES ('verdict', 'neutral'), ('sizing_band', '0.00'), ('disagreement', 'yes')) AS t(field, v)""")


def old_log(spark, sf_dir):
    days = tb.bars(spark, sf_dir).where((F.dayofmonth("effective_date") == 1) & (F.substring("ticker", -3, 3).cast("int") % 3 != 0))
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("new_value")) for f, v in (
        ("verdict", "neutral"), ("sizing_band", "0.00"), ("disagreement", "yes"))])
    return days.select("ticker", F.col("effective_date").alias("changed_at"), F.inline(values))


@plan("decision_changes", "ticker:s field:s prev_value:s new_value:s prev_hash:s new_hash:s guard_passed:b", "G2 X5",
      with_parts("verdicts old_log", """
, s AS (SELECT ticker, verdict, sizing_band, CASE WHEN disagreement THEN 'yes' ELSE 'no' END AS dis, kelly_displayed FROM verdicts),
h AS (SELECT s.*, l.ticker IS NOT NULL AS had, sha1(s.ticker || '|{"disagreement": "' || dis || '", "sizing_band": "' || sizing_band || '", "verdict": "' || verdict || '"}') AS new_hash,
 CASE WHEN l.ticker IS NOT NULL THEN sha1(s.ticker || '|{"disagreement": "yes", "sizing_band": "0.00", "verdict": "neutral"}') END AS prev_hash
 FROM s LEFT JOIN (SELECT DISTINCT ticker FROM old_log) l USING (ticker))
SELECT ticker, field, CASE WHEN had THEN p END AS prev_value, v AS new_value, prev_hash, new_hash, kelly_displayed <= 0.2 + 1e-9 AS guard_passed FROM (
 SELECT *, 'verdict' AS field, 'neutral' AS p, verdict AS v FROM h UNION ALL SELECT *, 'sizing_band', '0.00', sizing_band FROM h UNION ALL SELECT *, 'disagreement', 'yes', dis FROM h)
WHERE NOT had OR p <> v"""))
def _(spark, sf_dir):
    return gov.change_log(gov.decision_state(decided(spark, sf_dir)), old_log(spark, sf_dir))


# ---- notes
part("notes_feed", "", """
SELECT event_id AS note_id, CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS ticker, ts AS created_at, event_type AS source, 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS body,
 CASE WHEN event_type IN ('click', 'error') THEN 'alert' WHEN event_type = 'view' THEN 'user' ELSE 'system' END AS kind, user_id % 2 = 0 AS standing FROM events""")


def notes(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "error"), "alert").when(F.col("event_type") == "view", "user").otherwise(F.col("event_type"))
    return tb.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").alias("created_at"), F.col("event_type").alias("source"),
        F.concat(F.lit(" value "), F.floor("value").cast("string")).alias("body"), kind.alias("kind"), (F.col("user_id") % 2 == 0).alias("standing"))


@plan("merged_notes", "ticker:s source:s body:s kind:s n:i", "G4 J11",
      with_parts("notes_feed", """
, f AS (SELECT * FROM notes_feed WHERE created_at < TIMESTAMP '2024-01-15'), b AS (SELECT * FROM notes_feed WHERE created_at >= TIMESTAMP '2024-01-15')
SELECT ticker, source, body, kind, sum(n) AS n FROM (SELECT ticker, source, body, kind, 1 AS n FROM (SELECT DISTINCT ticker, source, body, kind FROM b WHERE standing) b
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = b.source AND f.body = b.body AND f.ticker IS NOT DISTINCT FROM b.ticker)
UNION ALL SELECT ticker, source, body, kind, count(*) FROM b WHERE NOT standing GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4"""))
def _(spark, sf_dir):
    rows = notes(spark, sf_dir)
    feed = rows.where("created_at < TIMESTAMP_NTZ '2024-01-15'").withColumn("body", F.trim("body"))
    merged = gov.merge_notes(feed, rows.where("created_at >= TIMESTAMP_NTZ '2024-01-15'"))
    return merged.groupBy("ticker", "source", "body", "kind").agg(F.count("*").alias("n"))


@plan("newest_notes", "note_id:i source:s body:s", "K4 G4",
      with_parts("notes_feed", "SELECT * FROM notes_feed ORDER BY created_at DESC NULLS LAST, note_id LIMIT 100"))
def _(spark, sf_dir):
    return gov.newest(notes(spark, sf_dir), "created_at", gov.NOTE_FEED, ["note_id"]).withColumn("body", F.trim("body"))


@plan("unread_notes", "n_notes:i unread:i", "G4",
      "SELECT count(*) AS n_notes, count(*) FILTER (WHERE event_id % 3 <> 0) AS unread FROM events")
def _(spark, sf_dir):
    rows = notes(spark, sf_dir)
    return gov.unread(rows, rows.where("note_id % 3 = 0"))


@plan("newest_paper_trades", "layer_attributed_to:s rank:i trade_id:i entry_date:d pnl_pct:f", "G8 K4",
      with_parts("paper_trades", "SELECT *, row_number() OVER (PARTITION BY layer_attributed_to ORDER BY entry_date DESC, trade_id) AS rank FROM paper_trades QUALIFY rank <= 365"))
def _(spark, sf_dir):
    return gov.newest_per_group(tb.paper_trades(spark, sf_dir), ["layer_attributed_to"], "entry_date", gov.PAPER_TRADE_FEED, ["trade_id"])


# ---- journal and watchlist folds
@plan("journal_quarantine", "entry_id:s problem:s", "G5",
      with_parts("journal", """
SELECT entry_id, CASE WHEN direction = 'hold' THEN 'direction' WHEN expected_horizon <= 0 THEN 'horizon' ELSE 'thesis' END AS problem FROM journal
WHERE direction = 'hold' OR expected_horizon <= 0 OR trim(thesis) = ''"""))
def _(spark, sf_dir):
    return gov.split_journal(tb.journal(spark, sf_dir))[1]


@plan("journal_closed", "entry_id:s exit_date:d pnl_pct:f exit_reason:s is_open:b", "G5",
      with_parts("journal", """
SELECT entry_id, CASE WHEN c THEN entry_date + 5 ELSE exit_date END AS exit_date, CASE WHEN c THEN 0.01 ELSE pnl_pct END AS pnl_pct, CASE WHEN c THEN 'late close' ELSE exit_reason END AS exit_reason,
 NOT c AND exit_date IS NULL AS is_open FROM (SELECT *, exit_date IS NULL AND CAST(entry_id AS BIGINT) % 2 = 0 AS c FROM journal WHERE direction <> 'hold' AND expected_horizon > 0 AND trim(thesis) <> '')"""))
def _(spark, sf_dir):
    valid = gov.split_journal(tb.journal(spark, sf_dir))[0]
    late = gov.open_trades(valid).where(F.col("entry_id").cast("long") % 2 == 0).select(
        "entry_id", F.date_add("entry_date", 5).alias("exit_date"), F.lit(0.01).alias("pnl_pct"), F.lit("late close").alias("exit_reason"),
        F.lit(True).alias("thesis_validated"), F.col("entry_date").alias("closed_at"))
    return gov.close_trades(valid, late).withColumn("is_open", F.col("exit_date").isNull())


part("watch_events", "", """
SELECT event_id, user_id, ts, 'T' || CAST(event_id * 31 % 7 AS VARCHAR) AS ticker, 'sector ' || event_type AS sector,
 CASE event_id % 4 WHEN 0 THEN 'status' WHEN 3 THEN 'remove' ELSE 'add' END AS action, CASE WHEN event_id % 8 = 0 THEN 'ready' ELSE 'error' END AS status FROM events WHERE user_id % 3 <> 0""")


def watch_events(spark, sf_dir):
    k = F.col("event_id")
    return tb.read(spark, sf_dir, "events").where("user_id % 3 <> 0").select(
        "event_id", "user_id", "ts", F.concat(F.lit("T"), (k * 31 % 7).cast("string")).alias("ticker"),
        F.concat(F.lit("sector "), "event_type").alias("sector"),
        F.when(k % 4 == 0, "status").when(k % 4 == 3, "remove").otherwise("add").alias("action"),
        F.when(k % 8 == 0, "ready").otherwise("error").alias("status"))


@plan("watchlists", "user_id:i ticker:s sector:s status:s position:i", "G6",
      with_parts("watch_events", """
, r AS (SELECT user_id, ticker, max(ts) AS removed FROM watch_events WHERE action = 'remove' GROUP BY 1, 2),
own AS (SELECT e.user_id, e.ticker, arg_min(sector, ts) AS sector, arg_max(CASE WHEN action = 'add' THEN 'pending' ELSE status END, ts) AS status, min(ts) FILTER (WHERE action = 'add') AS added
 FROM watch_events e LEFT JOIN r USING (user_id, ticker) WHERE action <> 'remove' AND (removed IS NULL OR ts > removed) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE action = 'add') > 0),
seed AS (SELECT user_id, t AS ticker, s AS sector, 'ready' AS status, NULL AS added FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0),
 (VALUES ('NVDA', 'Semiconductors'), ('MSFT', 'Software'), ('AAPL', 'Consumer Tech'), ('GOOGL', 'Internet'), ('AMZN', 'E-commerce')) AS d(t, s))
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added NULLS FIRST, ticker) AS position FROM (SELECT * FROM own UNION ALL SELECT * FROM seed)"""))
def _(spark, sf_dir):
    return gov.fold_watchlist(watch_events(spark, sf_dir), tb.read(spark, sf_dir, "events"))


# ---- hygiene
PAIRS = (("ret_21d", "realized_vol_21d"), ("rsi_14", "ret_63d"), ("ret_5d", "rsi_14"))
_CNT = " UNION ALL ".join(f"""
SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) FILTER (WHERE hi AND hit) AS high_hits, count(*) FILTER (WHERE hi AND NOT hit) AS high_misses,
 count(*) FILTER (WHERE lo AND hit) AS low_hits, count(*) FILTER (WHERE lo AND NOT hit) AS low_misses FROM (
 SELECT coalesce(ret_fwd_10d > 0, false) AS hit, {a} > (SELECT quantile_cont({a}, 0.5) FROM feat_supplier) AND {b} > (SELECT quantile_cont({b}, 0.5) FROM feat_supplier) AS hi,
  {a} < (SELECT quantile_cont({a}, 0.5) FROM feat_supplier) AND {b} < (SELECT quantile_cont({b}, 0.5) FROM feat_supplier) AS lo FROM feat_supplier)""" for a, b in PAIRS)
part("pair_counts", "feat_supplier", _CNT)


def _logp(x: str) -> str:
    r1, r2, c1 = "(high_hits + high_misses)", "(low_hits + low_misses)", "(high_hits + low_hits)"
    g = lambda e: f"lgamma(({e}) + 1.0)"
    return (f"{g(r1)} - {g(x)} - {g(f'{r1} - {x}')} + {g(r2)} - {g(f'{c1} - {x}')} - {g(f'{r2} - {c1} + {x}')}"
            f" - ({g(f'{r1} + {r2}')} - {g(c1)} - {g(f'{r1} + {r2} - {c1}')})")


part("pair_tests", "pair_counts", f"""
SELECT *, least(1, list_sum(list_transform(list_filter(lp, lambda v: v <= seen + 1e-7), lambda v: exp(v)))) AS p FROM (
 SELECT *, {_logp('high_hits')} AS seen, list_transform(range(greatest(0, high_hits - low_misses), least(high_hits + high_misses, high_hits + low_hits) + 1), lambda x: {_logp('x')}) AS lp FROM pair_counts)""")


def pair_rows(spark, sf_dir):
    """Features of the pairs and the label: those of the stored features, or stored with these columns only."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")]
    used = [*sorted({f for p in PAIRS for f in p}), "ret_fwd_10d"]
    return stored_or(spark, "features-supplier", inputs, lambda: stored_once(
        spark, "pair-features", inputs, lambda: fresh(spark, sf_dir).select(*used)))


@plan("contradiction_counts", "feature_a:s feature_b:s high_hits:i high_misses:i low_hits:i low_misses:i", "M30",
      with_parts("pair_counts", "SELECT * FROM pair_counts"))
def _(spark, sf_dir):
    return hy.contradiction_counts(pair_rows(spark, sf_dir), PAIRS, stored=True)


@plan("contradictions", "feature_a:s feature_b:s n_high:i n_low:i joint_high_hit_rate:f joint_low_hit_rate:f p_value:f status:s", "M30",
      with_parts("pair_tests", """
SELECT feature_a, feature_b, high_hits + high_misses AS n_high, low_hits + low_misses AS n_low, high_hits / (high_hits + high_misses) AS joint_high_hit_rate,
 low_hits / (low_hits + low_misses) AS joint_low_hit_rate, p AS p_value, CASE WHEN p <= 0.01 THEN 'VALIDATED' ELSE 'NOT_SIGNIFICANT' END AS status FROM pair_tests"""))
def _(spark, sf_dir):
    return hy.contradictions(hy.contradiction_counts(pair_rows(spark, sf_dir), PAIRS, stored=True))


part("alerts", "", """
SELECT event_id AS alert_id, user_id % 5 AS family, CASE event_type WHEN 'click' THEN 'contradiction' WHEN 'error' THEN 'friction_anomaly' WHEN 'view' THEN 'transition_signal' ELSE event_type END AS alert_type,
 CASE WHEN event_id % 11 <> 0 THEN pow(CAST(event_id * 7919 % 10007 AS DOUBLE) / 10007, 4) END AS p_value FROM events""")
part("corrected", "alerts", """
SELECT *, least(1, min(q) OVER (PARTITION BY family ORDER BY p_value DESC, alert_id DESC ROWS UNBOUNDED PRECEDING)) AS pc FROM (
 SELECT *, p_value * m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i)) / r AS q FROM (
  SELECT *, count(*) OVER (PARTITION BY family) AS m, rank() OVER (PARTITION BY family ORDER BY p_value) + count(*) OVER (PARTITION BY family, p_value) - 1 AS r FROM alerts WHERE p_value IS NOT NULL))""")


def alerts(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "contradiction").when(F.col("event_type") == "error", "friction_anomaly").when(
        F.col("event_type") == "view", "transition_signal").otherwise(F.col("event_type"))
    return tb.read(spark, sf_dir, "events").select(
        k.alias("alert_id"), (F.col("user_id") % 5).alias("family"), kind.alias("alert_type"),
        F.when(k % 11 != 0, F.pow((k * 7919 % 10007).cast("double") / 10007, 4)).alias("p_value"))


@plan("fdr_corrected", "alert_id:i family:i p_value:f p_value_corrected:f", "M31",
      with_parts("corrected", "SELECT alert_id, family, p_value, pc AS p_value_corrected FROM corrected WHERE pc <= 0.05 UNION ALL SELECT alert_id, family, p_value, NULL FROM alerts WHERE p_value IS NULL"))
def _(spark, sf_dir):
    return hy.fdr_correct(alerts(spark, sf_dir), ["family"])


part("ranked_alerts", "corrected", """
SELECT alert_id, family, alert_type, CASE alert_type WHEN 'contradiction' THEN 3 WHEN 'friction_anomaly' THEN 1 WHEN 'transition_signal' THEN 2 ELSE 0 END AS severity, coalesce(pc, p_value, 1.0) AS p FROM (
 SELECT alert_id, family, alert_type, p_value, pc FROM corrected WHERE pc <= 0.05 UNION ALL SELECT alert_id, family, alert_type, p_value, NULL FROM alerts WHERE p_value IS NULL)""")


@plan("top_alerts", "alert_id:i alert_type:s severity:i", "K2",
      with_parts("ranked_alerts", "SELECT * FROM ranked_alerts ORDER BY severity DESC, p, alert_id LIMIT 25"))
def _(spark, sf_dir):
    return hy.top_alerts(hy.fdr_correct(alerts(spark, sf_dir), ["family"]), 25, ["alert_id"])


@plan("top_alerts_per_family", "family:i rank:i alert_id:i severity:i", "K2",
      with_parts("ranked_alerts", "SELECT *, row_number() OVER (PARTITION BY family ORDER BY severity DESC, p, alert_id) AS rank FROM ranked_alerts QUALIFY rank <= 5"))
def _(spark, sf_dir):
    return hy.top_alerts_per_group(hy.fdr_correct(alerts(spark, sf_dir), ["family"]), ["family"], 5, ["alert_id"])


_NLO, _ = wilson_sql("hit_rate * n_analogs", "n_analogs")


@plan("confidence_language", "ticker:s tier:s sentence:s", "X8 X4 A8",
      with_parts("near_sum", f"""
SELECT ticker, CASE WHEN n_analogs < 15 THEN 'insufficient' WHEN n_analogs >= 50 AND lo >= 0.55 THEN 'strong' WHEN n_analogs >= 25 AND lo >= 0.5 THEN 'moderate' ELSE 'weak' END AS tier,
 CASE WHEN n_analogs < 15 THEN 'Insufficient evidence: only ' || n_analogs || ' analogs available; no confident statement possible.'
 ELSE CASE WHEN n_analogs >= 50 AND lo >= 0.55 THEN 'Strong' WHEN n_analogs >= 25 AND lo >= 0.5 THEN 'Moderate' ELSE 'Weak' END || ' evidence: ' || n_analogs || ' analogs, hit rate ' || printf('%.0f', hit_rate * 100)
 || '% (Wilson 95% CI lower bound ' || printf('%.0f', lo * 100) || '%)' || CASE WHEN (n_analogs >= 50 AND lo >= 0.55) OR (n_analogs >= 25 AND lo >= 0.5) THEN '.' ELSE ' — sample size or CI does not support a confident claim.' END END AS sentence
FROM (SELECT *, {_NLO} AS lo FROM near_sum)"""))
def _(spark, sf_dir):
    from plumbline.functions.stats import wilson
    s = an.summarise(nearest(spark, sf_dir)[1])
    lo, _hi = wilson(F.col("hit_rate") * F.col("n_analogs"), F.col("n_analogs"))
    tier, text = hy.confidence_language(F.col("n_analogs"), F.col("hit_rate"), lo)
    return s.select("ticker", tier.alias("tier"), text.alias("sentence"))


@plan("unknowns", "ticker:s n_items:i first:s last:s", "X12",
      with_parts("near_sum", f"""
SELECT ticker, CASE WHEN n_analogs < 15 THEN 1 ELSE 0 END + 1 + CASE WHEN hit_rate < 0.5 THEN 1 ELSE 0 END + CASE WHEN effective_n < 25 THEN 1 ELSE 0 END + 1 AS n_items,
 CASE WHEN n_analogs < 15 THEN 'Only ' || n_analogs || ' historical analogs available — estimates have wide error bars.' ELSE 'Covariance was estimated by Ledoit-Wolf shrinkage (MCD fell back due to small sample) — outlier-resistance is reduced.' END AS first,
 '{hy.STRUCTURAL_CHANGE}' AS last FROM near_sum"""))
def _(spark, sf_dir):
    s = an.summarise(nearest(spark, sf_dir)[1])
    items = hy.unknowns(F.col("n_analogs"), F.col("covariance_method"), F.col("hit_rate") >= 0.5, F.col("effective_n") >= 25)
    return s.select("ticker", items.alias("items")).select(
        "ticker", F.size("items").alias("n_items"), F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"))


@plan("factor_redundancy", "dominant_driver:s dominance_share:f n_assets:i redundancy_warning:b", "A16",
      with_parts("drive_stats", """
, d AS (SELECT ticker, arg_max(f, {'a': abs(z), 'p': -p}) AS d FROM (%s) GROUP BY 1), c AS (SELECT d, count(*) AS n FROM d GROUP BY 1)
SELECT arg_max(d, {'n': n, 'd': d}) AS dominant_driver, max(n) / sum(n) AS dominance_share, sum(n) AS n_assets, max(n) / sum(n) >= 0.5 AS redundancy_warning FROM c""" % " UNION ALL ".join(
          f"SELECT ticker, {i} AS p, '{f}' AS f, (l{i} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END AS z FROM drive_stats" for i, f in enumerate(ft.DISTANCE_FEATURES))))
def _(spark, sf_dir):
    first = F.split(F.col("drivers")[0], " ")[0]
    return cal.factor_redundancy(an.drivers(history(spark, sf_dir)).withColumn("primary_driver", first))
