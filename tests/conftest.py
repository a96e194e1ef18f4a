from __future__ import annotations

import datetime as dt
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_days(end: dt.date, n: int) -> list[dt.date]:
    out, day = [], end
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day -= dt.timedelta(days=1)
    return out[::-1]


@pytest.fixture(scope="session")
def ohlcv(spark):
    """100 daily bars per ticker around a random walk."""
    rng = np.random.default_rng(7)
    rows = []
    for ticker in ("AAA", "BBB"):
        close = 100 * np.cumprod(np.exp(rng.normal(0.0005, 0.012, 100)))
        for d, c in zip(business_days(dt.date(2024, 6, 28), 100), close):
            rows.append((ticker, d, float(c), float(c * 1.005), float(c * 0.995), float(c), 1e6))
    return spark.createDataFrame(
        rows, "ticker string, effective_date date, open double, high double, low double, close double, volume double"
    )


@pytest.fixture(scope="session")
def factor_data(spark):
    """600 days of ten factors, and an asset driven by the previous day's factors."""
    from plumbline.operators.risk import FACTOR_ORDER

    rng = np.random.default_rng(3)
    days = business_days(dt.date(2024, 6, 28), 600)
    f = rng.normal(0, 0.01, (600, 10))
    betas = np.linspace(1.2, -0.6, 10)
    y = np.concatenate([[0.0], f[:-1] @ betas]) + rng.normal(0, 0.005, 600)
    factors = spark.createDataFrame(
        [(d, *map(float, r)) for d, r in zip(days, f)],
        "effective_date date, " + ", ".join(f"{n} double" for n in FACTOR_ORDER),
    )
    assets = spark.createDataFrame(
        [("X", d, float(v)) for d, v in zip(days, y)], "ticker string, effective_date date, asset_ret double"
    )
    return factors, assets, f, y, betas
