from __future__ import annotations

import datetime as dt
import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import validation as va
from plumbline.functions.stats import expected_max_normal, normal_cdf
from plumbline.plans.registry import shape_sql
from plumbline.sources import store as st
from tests.conftest import business_days


def history(spark, n, seed=0, series="s"):
    rng = np.random.default_rng(seed)
    days = business_days(dt.date(2024, 6, 28), n)
    r, v = rng.normal(0.0004, 0.01, n), np.abs(rng.normal(0.15, 0.03, n))
    rows = [(series, d, float(a), float(a * 3), float(b)) for d, a, b in zip(days, r, v)]
    df = spark.createDataFrame(rows, "series_id string, effective_date date, ret_1d double, ret_21d double, realized_vol_21d double")
    return va.numbered(df, ("ret_1d", "ret_21d", "realized_vol_21d")), r, v


def sharpe(x):
    return x.mean() / x.std(ddof=1) * math.sqrt(252) if len(x) > 1 and x.std(ddof=1) > 0 else 0.0


def test_walk_forward_matches_numpy(spark):
    rows, r, v = history(spark, 2400)
    got = {x.path_id: x.sharpe for x in va.path_sharpes(va.signal_pnl(va.walk_forward_paths(rows))).where("signal = 'low_volatility'").collect()}
    fold, want = 2400 // 4, {}
    for i in (1, 2, 3):
        start = i * fold + 504
        if start + fold > 2400:
            break
        position = (v[start : start + fold] < np.median(v[: i * fold])).astype(float)
        want[i] = sharpe(np.concatenate([[0], position[:-1]]) * r[start : start + fold])
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_short_history_reports_why(spark):
    rows, *_ = history(spark, 100)
    got = va.walk_forward(rows).collect()
    assert {r.status for r in got} == {"NO_VALID_PATHS"} and {r.p30 for r in got} == {0.0}
    assert {r.status for r in va.walk_forward(history(spark, 4)[0]).collect()} == {"INSUFFICIENT_DATA"}
    assert {r.cv_method for r in va.cpcv(rows).collect()} == {"walk_forward_fallback"}


def test_embargo_floor_is_enforced(spark):
    rows, *_ = history(spark, 100)
    with pytest.raises(ValueError):
        va.walk_forward(rows, embargo=503)
    with pytest.raises(ValueError):
        va.cpcv(rows, embargo=10)


def test_combinatorial_paths_keep_train_away_from_test(spark):
    rows, r, _ = history(spark, 3400)
    paths = va.combinatorial_paths(rows, embargo=504).select("path_id", "idx", "role").toPandas()
    size = 3400 // 6
    assert paths["path_id"].nunique() == 15
    for pid, chosen in enumerate(combinations(range(6), 2), 1):
        part = paths[paths.path_id == pid]
        test, barred = set(), set()
        for g in chosen:
            start, stop = g * size, (g + 1) * size if g < 5 else 3400
            test |= set(range(start, stop))
            barred |= set(range(start - 504, stop + 504))
        assert set(part[part.role == "test"].idx) == test
        assert set(part[part.role == "train"].idx) == set(range(3400)) - barred
    got = va.cpcv(rows).where("signal = 'train_drift'").first()
    assert got.cv_method == "cpcv" and got.n_paths > 0


def test_custom_signal_gets_train_and_test(spark):
    rows, r, _ = history(spark, 2400)

    def always_long(train, test):
        assert train.idx.max() < test.idx.min()
        return test.ret_1d.to_numpy()

    got = va.path_sharpes(va.custom_signal_pnl(va.walk_forward_paths(rows), always_long)).orderBy("path_id").collect()
    assert np.isclose(got[0].sharpe, sharpe(r[1104:1704]))


def test_deflated_sharpe_against_the_closed_form(spark):
    df = spark.createDataFrame([(1.5, -0.2, 1.0, 500), (0.2, 0.0, 0.0, 1)], "sharpe double, skew double, kurt double, n_obs long")
    got = va.deflated_sharpe(df, 10).orderBy(F.desc("sharpe")).collect()
    nd = NormalDist()
    best = (1 - 0.5772156649015329) * nd.inv_cdf(1 - 1 / 2000) + 0.5772156649015329 * nd.inv_cdf(1 - 1 / (2000 * math.e))
    z = (1.5 - best) / math.sqrt((1 + 0.2 * 1.5 + 0.0) / 499)
    assert got[0].n_trials == 2000 and np.isclose(got[0].z_statistic, z) and np.isclose(got[0].deflated_sharpe, nd.cdf(z))
    assert got[1].deflated_sharpe == 0.0
    assert expected_max_normal(1) == 0.0 and expected_max_normal(5000) > expected_max_normal(2000)


@pytest.mark.parametrize("found", range(0, 11))
def test_survivorship_threshold(spark, found):
    gone = spark.createDataFrame([(f"T{i}", dt.date(2021, 6, 15)) for i in range(10)] + [("OLD", dt.date(2010, 1, 1))], "ticker string, termination_date date")
    live = spark.createDataFrame([(f"T{i}",) for i in range(found)] + [("X",)], "ticker string")
    got = va.survivorship(live, gone, "2020-01-01", "2022-01-01").first()
    assert got.coverage == found / 10 and got.passed == (found >= 8)


def test_survivorship_of_an_empty_window_passes(spark):
    gone = spark.createDataFrame([("OLD", dt.date(2010, 1, 1))], "ticker string, termination_date date")
    got = va.survivorship(gone, gone, "2020-01-01", "2022-01-01").first()
    assert got.passed and got.coverage == 1.0
    with pytest.raises(ValueError):
        va.survivorship(gone, gone, "2020-01-01", "2022-01-01", floor=0.5)


PASSING = dict(survivorship_audit="PASSED", walk_forward_sharpe=1.0, walk_forward_ece=0.01, cpcv_p30_sharpe=0.5, deflated_sharpe=0.99)


@pytest.mark.parametrize(
    "change,status,words",
    [
        ({}, "production", "all sign-off criteria met"),
        ({"survivorship_audit": "FAILED"}, "blocked", "survivorship audit FAILED"),
        ({"survivorship_audit": "NOT_RUN"}, "research_preview", "survivorship audit not run"),
        ({"walk_forward_sharpe": 0.2}, "research_preview", "walk_forward_sharpe=0.200 < floor 0.50"),
        ({"walk_forward_sharpe": -0.2}, "blocked", "walk_forward_sharpe=-0.200 < floor 0.50"),
        ({"walk_forward_ece": 0.2}, "research_preview", "walk_forward_ece=0.200 > ceiling 0.05"),
        ({"cpcv_p30_sharpe": -0.1}, "research_preview", "cpcv_p30_sharpe=-0.100 < floor 0.00"),
        ({"deflated_sharpe": 0.5}, "research_preview", "deflated_sharpe=0.500 < floor 0.95"),
    ],
)
def test_sign_off_criteria(spark, change, status, words):
    row = {**PASSING, **change, "layer_name": "L", "as_of": dt.date(2024, 1, 1)}
    got = va.sign_off(spark.createDataFrame([row])).first()
    assert got.status == status and words in got.rationale
    assert got.production_ready == (not change)


def test_lite_status_overrides_and_reports_round_trip(spark):
    rows = [{**PASSING, "layer_name": "L", "as_of": dt.date(2024, 1, d), "lite_status": "lite_survivorship"} for d in (1, 2)]
    signed = va.sign_off(spark.createDataFrame(rows))
    assert {r.status for r in signed.collect()} == {"lite_survivorship"}
    latest = va.latest_reports(va.report_rows(signed)).first()
    assert latest.report_id == "L::2024-01-02"
    back = va.parse_reports(va.latest_reports(va.report_rows(signed)), "lite_status string").first()
    assert back.report.lite_status == "lite_survivorship"


def test_gate_hides_blocked_and_discloses_preview(spark):
    rows = [{**PASSING, **c, "layer_name": n, "as_of": dt.date(2024, 1, 1)} for n, c in (("good", {}), ("mid", {"deflated_sharpe": 0.1}), ("bad", {"survivorship_audit": "FAILED"}))]
    signed = va.sign_off(spark.createDataFrame(rows))
    data = spark.createDataFrame([("good", 1.0), ("mid", 2.0), ("bad", 3.0), ("none", 4.0)], "layer_name string, v double")
    assert {r.layer_name for r in va.gate(data, signed).collect()} == {"good"}
    shown = {r.layer_name: r.disclosure for r in va.gate(data, signed, preview=True).collect()}
    assert set(shown) == {"good", "mid"} and shown["good"] is None and "deflated" in shown["mid"]


def test_divergence_demotes_and_pauses(spark):
    rng = np.random.default_rng(1)
    paper = spark.createDataFrame([("a", float(x)) for x in rng.normal(0.0006, 0.01, 120)] + [("b", 0.01)] * 10, "layer_attributed_to string, pnl_pct double")
    ref = spark.createDataFrame([("a", 50.0), ("b", 1.0), ("c", 1.0)], "layer_name string, pre_deployment_sharpe double")
    got = {r.layer_name: r for r in va.divergence(paper, ref).collect()}
    assert got["a"].demote_to_research and got["b"].status == got["c"].status == "INSUFFICIENT_PAPER_DATA"
    audit = spark.createDataFrame([(dt.date(2024, 1, 1), "MISSING" if i < 5 else "OK", 0 if i < 5 else 9) for i in range(100)], "fetch_date date, status string, n_rows int")
    paused = va.divergence(paper, ref, audit, lite=True).collect()
    assert {r.status for r in paused} == {"VALIDATION_PAUSED_DATA_INTEGRITY"} and not any(r.demote_to_research for r in paused)


def test_shape_sql_adds_positive_zero():
    assert "+ 0.0 AS x" in shape_sql("SELECT 1 AS x", "x:f")


def test_normal_cdf_is_exact_to_double_precision(spark):
    z = [0.0, -0.0, 1e-300, 0.3, 0.66, 0.6629, 0.663, 1.0, 5.656, 5.657, 8.0, 20.0, 37.0, 38.4, 40.0, 1e9, math.inf]
    z += [-v for v in z] + [float(v) for v in np.random.default_rng(2).normal(0, 4, 2000)]
    rows = spark.createDataFrame([(v,) for v in z] + [(None,), (math.nan,)], "z double").select("z", normal_cdf(F.col("z")).alias("p"))
    got = [(r.z, r.p) for r in rows.collect()]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for v, p in got:
        if v is None:
            assert p is None
        elif math.isnan(v):
            assert math.isnan(p)
        else:
            want = 0.5 * math.erfc(-v / math.sqrt(2))
            assert math.isclose(p, want, rel_tol=4e-14, abs_tol=1e-300), (v, p, want)


def test_an_attempt_logged_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    runs = spark.createDataFrame([("a", "walk_forward", "x"), ("a", "walk_forward", "y"), ("b", None, None)], "layer_name string, function_name string, hyperparameters string")
    assert st.log_executions(runs, path, run="first") == 3
    assert st.log_executions(runs, path, run="first") == 3
    assert st.log_executions(runs.limit(1), path, run="second") == 4
    assert st.log_executions(runs, path) == 7
