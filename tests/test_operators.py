"""Friction, sizing, hygiene, calibration, governance, execution and streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from plumbline.operators import calibration as cal
from plumbline.operators import execution as ex
from plumbline.operators import friction as fr
from plumbline.operators import governance as gov
from plumbline.operators import hygiene as hy
from plumbline.operators import quality as ql
from plumbline.operators import regime_labels as rl
from plumbline.operators import sizing as sz
from plumbline.sources import landing as ld
from plumbline.streaming import jobs
from tests.conftest import business_days

D = dt.date


# ---- sizing


def kelly(spark, samples: dict, unc=0.2, overlap=0.8):
    rows = [(k, float(v), unc, overlap) for k, values in samples.items() for v in values]
    df = spark.createDataFrame(rows, "k string, fwd double, state_uncertainty double, overlap_pct double")
    return {r.k: r for r in sz.tail_aware_kelly(df, ["k"]).collect()}


def test_kelly_cases(spark):
    rng = np.random.default_rng(0)
    mixed = np.concatenate([rng.normal(0.04, 0.01, 65), rng.normal(-0.02, 0.005, 35)])
    tail = [0.02] * 100 + [-0.005] * 80 + [-0.5] * 20
    soft = [0.01] * 195 + [-0.001] * 5
    got = kelly(spark, {"mixed": mixed, "tail": tail, "soft": soft, "down": [-0.01] * 40, "up": [0.01] * 40, "few": [0.01] * 29})
    p, r = np.mean(mixed > 0), np.mean(mixed[mixed > 0]) / abs(np.quantile(mixed, 0.05))
    raw = max(0.0, p - (1 - p) / r)
    assert np.isclose(got["mixed"].displayed_kelly, min(0.2, raw * 0.5 * 0.8 * 1.0))
    assert got["mixed"].raw_kelly == 0.2 and got["tail"].displayed_kelly == 0.0
    assert any("non-negative" in w for w in got["soft"].warnings) and np.isclose(got["soft"].avg_loss, 0.001)
    assert got["down"].warnings[-1] == "No winning analogs in sample." and got["down"].displayed_kelly == 0.0
    assert "no negative tail" in got["up"].warnings[-1] and any("fragile" in w for w in got["up"].warnings)
    assert got["few"].status == "INSUFFICIENT_ANALOGS" and got["few"].displayed_kelly is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.floats(-1, 1), min_size=30, max_size=60), hs.floats(-1, 2), hs.floats(-1, 2))
def test_kelly_stays_in_bounds(spark, values, unc, overlap):
    r = kelly(spark, {"k": values}, unc, overlap)["k"]
    for name in ("raw_kelly", "haircut_kelly_standard", "haircut_kelly_regime", "displayed_kelly"):
        assert 0.0 <= r[name] <= 0.2


def test_wipeouts_lower_the_fraction_and_repeat(spark):
    rows = [(i, 0.04 if i % 3 else -0.02, 0.0, 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, fwd double, state_uncertainty double, overlap_pct double").withColumn("k", F.lit(1))
    one = sz.lite_kelly(df, ["k"], ["i"], annual_rate=2.0).first()
    two = sz.lite_kelly(df.repartition(5), ["k"], ["i"], annual_rate=2.0).first()
    assert one.n_injected == two.n_injected and 150 < one.n_injected < 330
    assert one.n == 3000 + one.n_injected


# ---- friction


def test_modified_z_and_suppression(spark):
    rng = np.random.default_rng(1)
    base = [(dt.datetime(2024, 1, 1 + i % 28, 12, i % 60), "A", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.normal(10, 1.5, 60), rng.normal(1e6, 1e5, 60), rng.normal(0.15, 0.02, 60)))]
    schema = "ts timestamp, ticker string, spread_bps double, volume double, realized_vol double"
    wide = fr.baseline_wide(fr.friction_baseline(spark.createDataFrame(base, schema)))
    now = spark.createDataFrame(
        [(dt.datetime(2024, 2, 1, 12), "A", 30.0, 1e6, 0.15), (dt.datetime(2024, 2, 2, 12), "A", 30.0, 1e6, 0.15), (dt.datetime(2024, 2, 1, 15), "A", 30.0, 1e6, 0.15)], schema
    )
    calendar = spark.createDataFrame([(D(2024, 2, 2), "cpi_day", 0), (D(2024, 2, 1), "party", 0)], "event_date date, event string, position int")
    got = {r.ts.isoformat(): r for r in fr.score_quotes(now, wide, calendar).collect()}
    first = got["2024-02-01T12:00:00"]
    spreads = np.array([r[2] for r in base])
    med = np.median(spreads)
    want = (30 - med) * 0.6745 / np.median(np.abs(spreads - med))
    assert first.alert and np.isclose(first.spread_bps_z, want)
    assert got["2024-02-02T12:00:00"].status == "SUPPRESSED" and "CPI" in got["2024-02-02T12:00:00"].reason
    assert got["2024-02-01T15:00:00"].status == "INSUFFICIENT_DATA"


def test_zero_deviation_gives_zero_z(spark):
    df = spark.createDataFrame([(5.0, 1.0, 0.0)], "x double, m double, d double")
    from plumbline.functions.stats import robust_z
    assert df.select(robust_z(F.col("x"), F.col("m"), F.col("d"))).first()[0] == 0.0


def test_only_illiquidity_drives_the_daily_alert(spark, ohlcv):
    spike = ohlcv.withColumn("volume", F.when(F.col("effective_date") == "2024-06-28", 1.0).otherwise(F.col("volume")))
    got = {r.ticker: r for r in fr.friction_proxy(spike).collect()}
    assert got["AAA"].alert and got["AAA"].anomaly_score == got["AAA"].amihud_z
    assert got["AAA"].cs_spread_execution_proxy == {r.ticker: r for r in fr.friction_proxy(ohlcv).collect()}["AAA"].cs_spread_execution_proxy
    short = fr.friction_proxy(ohlcv.where("effective_date > '2024-06-10'")).first()
    assert short.status == "INSUFFICIENT_DATA" and short.amihud_z == 0.0


def test_stress_needs_thirty_dates(spark):
    days = business_days(D(2024, 6, 28), 40)
    rows = [("X", d, "vix_percentile_63d", 0.9) for d in days] + [("X", d, "yield_curve_slope", float(i)) for i, d in enumerate(days)] + [("X", d, "hy_spread_roc_21d", 1.0) for d in days[:20]]
    df = spark.createDataFrame(rows, "ticker string, effective_date date, feature_name string, feature_value double")
    parts = fr.stress_components(df)
    assert {r.component: r.value for r in parts.collect()} == {"VIX percentile": 90.0, "Curve inversion": 0.0}
    gauge = fr.stress_gauge(parts).first()
    assert gauge.composite == 63.0 and gauge.level == "elevated"


# ---- execution


def test_fills_never_beat_the_book(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "buy" if i % 2 else "sell", float(b), float(b + s), float(z), 1e4, float(v), float(w)) for i, (b, s, z, v, w) in enumerate(zip(rng.uniform(10, 100, 200), rng.uniform(0, 1, 200), rng.uniform(1, 5000, 200), rng.normal(0, 2, 200), rng.normal(0, 2, 200)))]
    rows += [(900, "hold", 1.0, 2.0, 1.0, 1.0, 0.0, 0.0), (901, "buy", 2.0, 1.0, 1.0, 1.0, 0.0, 0.0), (902, "buy", 1.0, 2.0, 0.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "order_id int, direction string, bid double, ask double, order_size double, adv double, vol_z double, spread_z double")
    got = {r.order_id: r for r in ex.fill_costs(df).collect()}
    for i in range(200):
        r = got[i]
        assert r.fill_price >= r.ask if r.direction == "buy" else r.fill_price <= r.bid
        assert r.slippage_bps >= 0 and r.friction_bps >= 0
    assert [got[i].status for i in (900, 901, 902)] == ["BAD_DIRECTION", "CROSSED_QUOTE", "BAD_SIZE"]
    with pytest.raises(ValueError):
        ex.with_proxy(df.withColumn("ticker", F.lit("A")), spark.createDataFrame([("A", 1.0)], "ticker string, amihud_z double"))


def test_slices_stop_at_the_available_bars(spark):
    bars = spark.createDataFrame([(1, i, 99.0, 101.0, 1000.0) for i in range(5)], "order_id int, bar_no int, bid double, ask double, volume double")
    orders = spark.createDataFrame([(1, "buy", 500.0, 0.0, 0.0)], "order_id int, direction string, order_size double, vol_z double, spread_z double")
    r = ex.sliced_costs(orders, bars).first()
    assert (r.n_slices_actual, r.n_slices_requested) == (5, 20)
    assert np.isclose(r.avg_fill_price, 101 * (1 + 0.1 * np.sqrt(100 / 5000)))


# ---- hygiene


def test_by_correction_matches_the_definition(spark):
    rng = np.random.default_rng(3)
    p = np.sort(np.concatenate([rng.uniform(0, 1e-4, 6), rng.uniform(0, 1, 14)]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(99, None)], "i int, p_value double")
    got = {r.i: r.p_value_corrected for r in hy.fdr_correct(df).collect()}
    m, c = len(p), sum(1 / i for i in range(1, len(p) + 1))
    q = np.minimum.accumulate((p * m * c / np.arange(1, m + 1))[::-1])[::-1].clip(max=1)
    assert got.pop(99) is None
    assert got.keys() == {i for i in range(m) if q[i] <= 0.05}
    assert all(np.isclose(got[i], q[i]) for i in got)


def test_by_correction_of_heaped_p_values_and_null_families(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([10.0 ** -rng.uniform(3, 300, 3000), [0.0, 0.0, 1.0], 0.01 + 1e-12 * rng.uniform(0, 1, 2000), rng.uniform(0, 1, 1000)])
    rows = [("x", float(v)) for v in p] + [(None, 0.001), (None, 0.9)]
    df = spark.createDataFrame(rows, "family string, p_value double")
    got = [(r.family, r.p_value, r.p_value_corrected) for r in hy.fdr_correct(df, ["family"]).collect()]
    order = np.sort(p)
    m, c = len(p), sum(1 / i for i in range(1, len(p) + 1))
    q = np.minimum.accumulate((order * m * c / np.arange(1, m + 1))[::-1])[::-1].clip(max=1)
    mine = sorted(g[1:] for g in got if g[0] == "x")
    assert np.allclose(mine, [(a, b) for a, b in zip(order, q) if b <= 0.05], rtol=1e-9)
    assert [g for g in got if g[0] is None] == [(None, 0.001, pytest.approx(0.003))]
    pieces = df.where("family = 'x'").select("p_value").distinct().withColumn(
        "b", hy._piece(F.col("p_value"), F.array(*[F.lit(float(x)) for x in np.quantile(np.unique(p), np.arange(1, 256) / 256)])))
    assert pieces.groupBy("b").count().agg(F.max("count")).first()[0] < 60


def test_contradiction_found_and_small_cells_skipped(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=800)
    rows = [(float(v), float(v + 0.1 * e), -0.05 if v > 0 else 0.05) for v, e in zip(x, rng.normal(size=800))]
    df = spark.createDataFrame(rows, "a double, b double, ret_fwd_10d double")
    r = hy.contradictions(hy.contradiction_counts(df, [("a", "b")])).first()
    assert r.status == "VALIDATED" and r.joint_high_hit_rate < r.joint_low_hit_rate
    assert hy.contradictions(hy.contradiction_counts(df.limit(30), [("a", "b")])).first()["status"] == "INSUFFICIENT_DATA"
    tested = spark.createDataFrame([(*hy.CONTRADICTION_PAIRS[0], "VALIDATED", "contradiction")], "feature_a string, feature_b string, status string, alert_type string")
    assert sorted(r.status for r in hy.with_untestable(tested).collect()) == ["UNTESTABLE_LITE", "UNTESTABLE_LITE", "VALIDATED"]


def test_alert_order(spark):
    rows = [(1, "friction_anomaly", 0.001), (2, "contradiction", 0.04), (3, "contradiction", 0.01), (4, "other", None)]
    df = spark.createDataFrame(rows, "i int, alert_type string, p_value double").withColumn("p_value_corrected", F.lit(None).cast("double"))
    assert [r.i for r in hy.top_alerts(df, 3, ["i"]).collect()] == [3, 2, 1]


@pytest.mark.parametrize("n,lo,tier", [(10, 0.9, "insufficient"), (60, 0.56, "strong"), (60, 0.52, "moderate"), (30, 0.51, "moderate"), (30, 0.4, "weak"), (20, 0.9, "weak")])
def test_language_tiers(spark, n, lo, tier):
    df = spark.createDataFrame([(n, 0.6, lo)], "n int, h double, l double")
    got = df.select(*hy.confidence_language(F.col("n"), F.col("h"), F.col("l"))).first()
    assert got[0] == tier and str(n) in got[1]


def test_unknowns_always_end_with_structural_change(spark):
    df = spark.createDataFrame([(40, "mcd", True, True), (3, "ledoit_wolf", False, False)], "n int, m string, d boolean, s boolean")
    got = [r[0] for r in df.select(hy.unknowns(*[F.col(c) for c in "nmds"])).collect()]
    assert [len(g) for g in got] == [1, 5] and all(g[-1] == hy.STRUCTURAL_CHANGE for g in got)


@pytest.mark.parametrize("v,r,label", [(0.1, 0.05, "Calm bull"), (0.5, 0.05, "Volatile bull"), (0.9, 0.005, "Range / chop"), (0.9, -0.05, "Stressed bear"), (0.2, -0.05, "Volatile bear"), (0.9, 0.05, None)])
def test_regime_labels(spark, v, r, label):
    assert spark.createDataFrame([(v, r)], "v double, r double").select(rl.classify(F.col("v"), F.col("r"))).first()[0] == label


# ---- calibration and governance


def journal(spark, rows):
    return spark.createDataFrame(rows, "confidence_self int, pnl_pct double, market_state_id int, thesis_validated boolean, exit_date date")


def test_calibrated_journal_scores_well(spark):
    rows = []
    for level, p in cal.IMPLIED_PROBABILITY.items():
        wins = round(100 * p)
        rows += [(level, 0.01 if i < wins else -0.01, level % 2, i < wins, D(2024, 6, 1)) for i in range(100)]
    r = cal.score(cal.reliability(journal(spark, rows))).first()
    assert r.calibration_band == "well_calibrated" and r.ece < 1e-9
    want = np.mean([(p - (i < round(100 * p))) ** 2 for p in cal.IMPLIED_PROBABILITY.values() for i in range(100)])
    assert np.isclose(r.brier, want)
    assert cal.score(cal.reliability(journal(spark, rows[:10]))).first()["status"] == "INSUFFICIENT_DATA"
    perf = {x.market_state_id: x for x in cal.regime_performance(journal(spark, rows + [(3, 0.1, None, True, None)])).collect()}
    assert perf[None].n == 1 and perf[None].hit_rate is None and perf[0].n == 200


def test_thesis_drift_window(spark):
    rows = [(3, -0.1, 0, False, D(2024, 6, d)) for d in range(1, 6)] + [(3, -0.1, 0, False, D(2024, 1, 1))]
    assert cal.thesis_drift(journal(spark, rows)).first()["n_invalidated_losses"] == 6
    r = cal.thesis_drift(journal(spark, rows), "2024-06-30").first()
    assert r.n_invalidated_losses == 5 and r.warning


def test_certainty_falls_in_no_bin(spark):
    df = spark.createDataFrame([(1.0, 0), (0.05, 1), (0.05, 0)], "p double, y int")
    assert np.isclose(cal.binned_calibration_error(df).first()["ece"], 2 / 3 * 0.45)


def test_change_log_only_records_changes(spark):
    state = spark.createDataFrame([("A", "neutral", "0.05", "no", 0.05), ("B", "lean long", "0.10", "yes", 0.5)], "ticker string, verdict string, sizing_band string, disagreement string, kelly_displayed double")
    log = spark.createDataFrame([("A", f, v, dt.datetime(2024, 1, d)) for f, v, d in (("verdict", "lean long", 1), ("verdict", "neutral", 2), ("sizing_band", "0.00", 1), ("disagreement", "no", 1))], "ticker string, field string, new_value string, changed_at timestamp")
    got = gov.change_log(state, log).collect()
    a = [r for r in got if r.ticker == "A"]
    assert [(r.field, r.prev_value, r.new_value) for r in a] == [("sizing_band", "0.00", "0.05")] and a[0].prev_hash != a[0].new_hash
    b = [r for r in got if r.ticker == "B"]
    assert len(b) == 3 and all(r.prev_hash is None and not r.guard_passed for r in b)
    again = gov.change_log(state, log.unionByName(spark.createDataFrame([("A", "sizing_band", "0.05", dt.datetime(2024, 2, 1))], log.schema))).where("ticker = 'A'")
    assert again.count() == 0


@pytest.mark.parametrize("change,problem", [({}, None), ({"thesis": "  "}, "thesis"), ({"confidence_self": 6}, "confidence"), ({"direction": "hold"}, "direction"), ({"expected_horizon": 0}, "horizon")])
def test_journal_rules(spark, change, problem):
    row = {**dict(entry_id="1", direction="long", thesis="t", confidence_self=3, expected_horizon=5), **change}
    good, bad = gov.split_journal(spark.createDataFrame([row]))
    assert (bad.first()["problem"] if problem else good.count()) == (problem or 1)


def test_watchlist_fold(spark):
    t = lambda i: dt.datetime(2024, 1, i)
    events = spark.createDataFrame(
        [(1, 1, "AAA", "s", "add", None, t(1)), (2, 1, "AAA", "s", "status", "ready", t(2)), (3, 1, "BBB", "s", "add", None, t(3)), (4, 1, "BBB", "s", "remove", None, t(4)),
         (5, 1, "CCC", "s", "add", None, t(5)), (6, 1, "CCC", "s", "remove", None, t(6)), (7, 1, "CCC", "s", "add", None, t(7)), (8, 1, "DDD", "s", "status", "ready", t(8))],
        "event_id int, user_id int, ticker string, sector string, action string, status string, ts timestamp",
    )
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    got = gov.fold_watchlist(events, users).orderBy("user_id", "position").collect()
    assert [(r.ticker, r.status) for r in got if r.user_id == 1] == [("AAA", "ready"), ("CCC", "pending")]
    assert {r.ticker for r in got if r.user_id == 2} == {x[0] for x in gov.DEFAULT_WATCHLIST}
    walked = spark.createDataFrame([("pending", True), ("pending", False), ("ready", False)], "s string, ok boolean").select(gov.walk_status(F.col("s"), F.col("ok"))).collect()
    assert [r[0] for r in walked] == ["ready", "error", "ready"]


def test_calendar_and_sector_lines(spark):
    lines = spark.createDataFrame([('{"2024-01-02": ["party", "cpi_day", "fomc_day"], "bad": ["cpi_day"]}',)], "value string")
    calendar = ld.parse_calendar(lines)
    assert {(r.event, r.position) for r in calendar.collect()} == {("cpi_day", 1), ("fomc_day", 2)}
    day = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 3),)], "effective_date date")
    got = {r.effective_date.day: r for r in ql.suppression(day, calendar).collect()}
    assert got[2].suppressed and "CPI" in got[2].reason and not got[3].suppressed
    sectors = ld.parse_sector_map(spark.createDataFrame([("# c",), ("",), (" A : XLK ",), ("B: ZZZ",)], "value string"))
    with pytest.raises(ValueError):
        ld.validate_sector_map(spark.createDataFrame([("A",), ("C",)], "ticker string"), sectors)


# ---- streams


def test_late_quotes_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "ts timestamp, ticker string, spread_bps double, volume double, realized_vol double"
    start = dt.datetime(2024, 1, 2, 12)
    history = [(start + dt.timedelta(days=-d, minutes=15 * k), "A", 10.0 + (d % 3), 100.0 + k, 0.1) for d in range(1, 20) for k in range(4)]
    base = jobs.window_baseline(spark.createDataFrame(history, schema)).persist()
    landing = tmp_path / "q"
    spark.createDataFrame([(start + dt.timedelta(minutes=m), "A", 90.0, 100.0, 0.1) for m in (0, 5, 60)], schema).coalesce(1).write.parquet(str(landing / "one"))
    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(landing))
        q = jobs.start_alerts(stream, base, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        return q
    run()
    first = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n_quotes, r.alert) for r in first] == [(2, True)]
    spark.createDataFrame([(start, "A", 1.0, 1.0, 0.1), (start + dt.timedelta(minutes=120), "A", 10.0, 100.0, 0.1)], schema).coalesce(1).write.parquet(str(landing / "two"))
    query = run()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert sorted(r.n_quotes for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_bar_ingest_is_idempotent_and_flags_missing(spark, ohlcv, tmp_path):
    landing = str(tmp_path / "landing")
    early, late = ohlcv.where("effective_date < '2024-06-01'"), ohlcv.where("effective_date >= '2024-06-01'")
    wanted = spark.createDataFrame([("AAA",), ("ZZZ",)], "ticker string")
    ingest = jobs.BarIngest(spark, str(tmp_path / "root"), wanted)
    for part in (early, early, late):
        part.coalesce(1).write.mode("append").parquet(landing)
        ingest.start(landing, str(tmp_path / "cp")).awaitTermination()
    status = {r.ticker: r for r in ingest.current_status().collect()}
    assert status["AAA"].list_status == "ready" and status["ZZZ"].list_status == "error"
    assert status["AAA"].n_rows == 100
    from plumbline.operators import features as ft
    want = ft.to_long(ft.ohlcv_features(ohlcv)).count()
    assert ingest.current_features().count() == want
    batch = ingest.read("bars").where("batch_id = 0").drop("batch_id", "bucket")
    ingest.process(batch, 0)
    assert ingest.current_bars().count() == 200


def test_bar_ingest_takes_old_history_and_corrections(spark, ohlcv, tmp_path):
    from plumbline.operators import features as ft

    landing = str(tmp_path / "landing")
    ingest = jobs.BarIngest(spark, str(tmp_path / "root"))
    wrong = F.when(F.col("effective_date") == "2024-05-15", F.col("low")).otherwise(F.col("close"))
    first = ohlcv.where("ticker = 'AAA'").withColumn("close", wrong)
    for part in (first, ohlcv.where("ticker = 'BBB' OR effective_date = '2024-05-15'"), ohlcv.where("effective_date > '2024-06-01'")):
        part.coalesce(1).write.mode("append").parquet(landing)
        ingest.start(landing, str(tmp_path / "cp")).awaitTermination()
    keys = ["ticker", "effective_date", "feature_name"]
    want = {tuple(r[k] for k in keys): r.feature_value for r in ft.to_long(ft.ohlcv_features(ohlcv)).collect()}
    got = {tuple(r[k] for k in keys): r.feature_value for r in ingest.current_features().collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The last batch wrote only days that its bars, or labels looking ahead to them, can change.
    assert ingest.read("features").where("batch_id = 2").agg(F.min("effective_date")).first()[0] > dt.date(2024, 5, 15)


def test_injected_rows_and_their_count_come_from_one_pass(spark):
    rows = [("k", i, float(i % 5 - 2) / 100) for i in range(80)] + [("k", 900, None), (None, 1, 0.01)]
    df = spark.createDataFrame(rows, "k string, i int, fwd double").selectExpr("*", "0.1D state_uncertainty", "0.8D overlap_pct")
    out = sz.inject_wipeouts(df, ["i"], annual_rate=10.0)
    assert out.where("injected").count() > 5 and out.where("injected AND fwd <> -0.6").isEmpty()
    assert out.where("NOT injected").count() == len(rows) and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sz.lite_kelly(df, ["k"], ["i"], annual_rate=10.0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.k, r.n_injected, r.n) for r in got.collect()] == [("k", out.where("injected AND k = 'k'").count(), 80 + out.where("injected AND k = 'k'").count())]


def test_contradiction_counts_of_stored_rows(spark, tmp_path):
    rows = [(float(k % 37), float(k % 11), 0.1 if k % 3 else -0.1) for k in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, ret_fwd_10d double")
    df.write.parquet(f"{tmp_path}/rows")
    one = hy.contradiction_counts(spark.read.parquet(f"{tmp_path}/rows"), [("a", "b")], stored=True).collect()
    assert one == hy.contradiction_counts(df, [("a", "b")]).collect() and one[0].high_hits > 0
