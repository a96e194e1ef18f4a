from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates
from plumbline.operators import features as ft
from tests.conftest import business_days


def by_ticker(df, ticker="AAA"):
    return df.where(F.col("ticker") == ticker).orderBy("effective_date").toPandas()


def test_bar_features_match_numpy(ohlcv):
    got = by_ticker(ft.ohlcv_features(ohlcv))
    close = got["close"]
    assert np.allclose(got["ret_21d"][21:], (close / close.shift(21) - 1)[21:])
    log_ret = np.log(close / close.shift(1))
    assert np.allclose(got["realized_vol_21d"][21:], (log_ret.rolling(21).std() * np.sqrt(252))[21:])
    assert got["realized_vol_21d"][:21].isna().all()
    assert got["pct_above_ma50"][:49].isna().all()
    assert set(got["pct_above_ma50"][49:]) <= {0.0, 1.0}
    assert got["ret_fwd_10d"][-10:].isna().all()
    assert np.allclose(got["ret_fwd_10d"][:-10], (close.shift(-10) / close - 1)[:-10])


@pytest.mark.parametrize("segment", [7, 4096])
def test_wilder_rsi_across_segments(ohlcv, segment):
    df = ohlcv.withColumn("_up", F.greatest(F.col("close") - 100, F.lit(0.0)))
    got = by_ticker(ft.ewm_mean(df, {"_up": "m"}, 0.5, segment=segment))
    want = got["_up"].ewm(alpha=0.5, adjust=False).mean()
    # A border carries only the last segment's value: exact to decay**segment.
    assert np.allclose(got["m"], want, atol=0.5**segment * 100 + 1e-9)


def test_rsi_is_seeded_and_bounded(ohlcv):
    got = by_ticker(ft.add_wilder_rsi(ohlcv))
    change = got["close"].diff().fillna(0)
    gain = change.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-change.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    assert np.allclose(got["rsi_14"], 100 - 100 / (1 + gain / loss.clip(lower=1e-12)))
    assert got["rsi_14"].between(0, 100).all()


def test_ewma_normalise_matches_pandas(ohlcv):
    long = ft.to_long(ft.add_returns(ohlcv, (1,)), ("ret_1d",))
    got = by_ticker(ft.ewma_normalise(long))
    s = got["feature_value"]
    z = (s - s.ewm(halflife=5, adjust=False).mean()) / s.ewm(halflife=5, adjust=False).std()
    want = z.replace([np.inf, -np.inf], np.nan).fillna(0).clip(-4, 4)
    assert np.allclose(got["z"], want, atol=1e-8)


def test_constant_series_normalises_to_zero(spark):
    rows = [("A", d, "ret_1d", 0.5) for d in business_days(dt.date(2024, 1, 31), 30)]
    df = spark.createDataFrame(rows, "ticker string, effective_date date, feature_name string, feature_value double")
    assert {r.z for r in ft.ewma_normalise(df).collect()} == {0.0}


def test_percentile_of_a_ramp_is_one(spark):
    rows = [("^VIX", d, float(i)) for i, d in enumerate(business_days(dt.date(2024, 5, 31), 99))]
    df = spark.createDataFrame(rows, "ticker string, effective_date date, close double")
    got = by_ticker(ft.rolling_prior_share(df, "close", rows=10), "^VIX")
    assert got["vix_percentile_63d"][:10].isna().all()
    assert (got["vix_percentile_63d"][10:] == 1.0).all()


def test_slope_and_rate_of_change(spark):
    days = business_days(dt.date(2024, 3, 29), 5)
    ten = [("DGS10", d, v) for d, v in zip(days, (4.0, 4.1, 4.2, 4.3, 4.4))]
    two = [("DGS2", d, v) for d, v in zip(days, (3.0, 3.0, 3.1, 3.2, 3.3))]
    macro = spark.createDataFrame(ten + two, "series_id string, effective_date date, value double")
    got = [round(r[1], 6) for r in ft.macro_slope(macro).orderBy("effective_date").collect()]
    assert got == [1.0, 1.1, 1.1, 1.1, 1.1]
    ramp = spark.createDataFrame(
        [("HY", d, 1 + 0.1 * i) for i, d in enumerate(business_days(dt.date(2024, 3, 29), 40))],
        "ticker string, effective_date date, value double",
    )
    roc = by_ticker(ft.rate_of_change(ramp), "HY")["hy_spread_roc_21d"]
    assert roc[:21].isna().all() and np.isclose(roc[21], 2.1)


def test_winsorise_clips_by_own_or_stored_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + [100]], "x double")
    clipped = ft.winsorise(df, ["x"], 2.0).agg(F.max("x")).first()[0]
    v = np.array([0.0] * 50 + [100.0])
    assert np.isclose(clipped, v.mean() + 2 * v.std(ddof=1))
    stored = spark.createDataFrame([(0.0, 1.0)], "mu_x double, sd_x double")
    assert ft.winsorise(df, ["x"], 2.0, moments=stored).agg(F.max("x")).first()[0] == 2.0


def test_training_windows_never_cross_tickers(ohlcv, spark):
    assert ft.training_windows(ohlcv).count() == 0
    days = business_days(dt.date(2024, 6, 28), 130)
    rng = np.random.default_rng(0)
    rows = [(t, d, *map(float, rng.normal(100, 1, 4)), 1e6) for t in ("A", "B") for d in days]
    bars = spark.createDataFrame(rows, ohlcv.schema)
    got = ft.training_windows(bars).orderBy("ticker", "start_row").collect()
    assert [(r.ticker, r.start_row) for r in got] == [(t, s) for t in "AB" for s in range(0, 30, 5)]
    x = np.array([r[5] for r in rows[:101]])
    assert np.allclose(got[0]["close"], np.clip((x - x.mean()) / (x.std() + 1e-5), -5, 5), atol=1e-5)
    assert len(got[0]["stamps"]) == 101 and got[0]["stamps"][0]["weekday"] == days[0].weekday()


def test_trading_days_before_matches_a_walk(spark):
    cases = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), n) for i in range(14) for n in range(0, 13)]
    df = spark.createDataFrame(cases, "d date, n int")
    for r in df.select("d", "n", dates.trading_days_before(F.col("d"), F.col("n")).alias("x")).collect():
        day, left = r.d, r.n
        while left > 0:
            day -= dt.timedelta(days=1)
            left -= day.weekday() < 5
        assert r.x == day


def test_longest_gap_run(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in (0, 1, 6, 11, 12, 20, 28, 36)]
    df = spark.createDataFrame([("A", d) for d in days], "ticker string, effective_date date")
    assert ft.longest_gap_run(df).first()["n_consec_gaps"] == 3


def test_finite_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(ft.finite_mean(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [2.0, None]


def test_spread_and_illiquidity_are_not_negative(ohlcv):
    got = ft.corwin_schultz(ft.amihud(ohlcv)).toPandas()
    assert (got["cs_spread"].dropna() >= 0).all() and (got["amihud"].dropna() > 0).all()
    assert pd.isna(got.sort_values(["ticker", "effective_date"])["amihud"].iloc[0])
