"""Statistics used by several operators."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.session import materialise

EULER_MASCHERONI = 0.5772156649015329


# Distinct values that one task may sort.
SORTED = 65_536
BUCKETS = 4096


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], most: int = SORTED, stored: bool = False,
) -> DataFrame:
    """Exact, linearly interpolated percentiles of groups of any size; a null key is a key.

    ``percentile`` keeps a group's distinct values in one buffer. Here equal values
    are counted with map-side combine and stored, and each wanted rank has an
    interval that holds it. Intervals of more than ``most`` distinct values are cut
    into equal widths between their own smallest and largest value, again and again,
    so outliers and heaps of values cost rounds, not a large sort. Rows that lie in files
    (``stored``) are read anew by every round instead of being counted by value first:
    where hardly a value repeats, the counts are as large as the rows.
    """
    by = list(keys) or ["_all"]
    rows = (df if keys else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *by, F.col(value).cast("double").alias("_v"))
    if stored:
        counts = rows.withColumn("_c", F.lit(1).cast("long"))
    else:
        counts = materialise(rows.groupBy(*by, "_v").agg(F.count("*").alias("_c")), "value-counts")
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
        for name, p in probs.items() for side in (0, 1)
    ]))
    pos = F.col("t.p") * (F.col("_n") - 1)
    spans = counts.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"), _distinct().alias("_d")
    )
    state = materialise(
        spans.withColumn("t", wanted).select(
            *by, F.col("t.name").alias("_name"), F.col("t.side").alias("_side"), (pos - F.floor(pos)).alias("_frac"),
            F.when(F.col("t.side") == 0, F.floor(pos)).otherwise(F.ceil(pos)).alias("_rank"),
            "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_d",
        ),
        "ranks",
    )
    while True:
        large = state.where(F.col("_d") > most)
        if large.isEmpty():
            break
        state = materialise(state.where(F.col("_d") <= most).unionByName(_narrowed(counts, large, by)), "ranks")
    cells = state.select(*by, "_lo", "_hi", "_before").distinct()
    inside = Window.partitionBy(*by, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = _values_in(counts, cells, by)
    if stored:
        held = held.groupBy(*by, "_lo", "_hi", "_before", "_v").agg(F.sum("_c").alias("_c"))
    ranked = held.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    hits = null_safe_join(state.drop("_before"), ranked.drop("_before"), [*by, "_lo", "_hi"]).where(
        (F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto"))
    )
    out = []
    for name in probs:
        mine = F.col("_name") == name
        low = F.max(F.when(mine & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_side") == 1), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_frac")))
        out.append((low + (high - low) * frac).alias(name))
    return hits.groupBy(*by).agg(*out).drop("_all")


def _distinct() -> Column:
    """Distinct values of an interval, or its rows where values may repeat; a heap of one value is one."""
    return F.when(F.min("_v") == F.max("_v"), 1).otherwise(F.count("*"))


def _values_in(counts: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Values inside the intervals of their group; intervals of a group do not overlap."""
    return null_safe_join(counts, cells, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(counts: DataFrame, large: DataFrame, by: list[str]) -> DataFrame:
    """Each wanted rank with the bucket of its interval that holds it."""
    cells = large.select(*by, "_lo", "_hi", "_before").distinct()
    # Halves, as the difference of two doubles may be too large for one.
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    cut = _values_in(counts, cells, by).groupBy(*by, "_lo", "_hi", "_before", bucket.alias("_b")).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"), _distinct().alias("_bd")
    )
    # At most BUCKETS rows per interval reach this window.
    w = Window.partitionBy(*by, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_before")
    found = null_safe_join(large.drop("_before", "_d"), cut, [*by, "_lo", "_hi"]).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n"))
    )
    return found.select(
        *by, "_name", "_side", "_frac", "_rank", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
        F.col("_start").alias("_before"), F.col("_bd").alias("_d"),
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal; the keys of ``left`` remain."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return F.when(mad > 0, 0.6745 * (value - median) / mad).otherwise(0.0)


def annualised_sharpe(pnl: str = "pnl") -> Column:
    sd = F.stddev_samp(pnl)
    return F.when((F.count(pnl) >= 2) & (sd > 0), F.avg(pnl) / sd * math.sqrt(252.0)).otherwise(0.0)


def wilson(wins: Column, n: Column, empty=(0.0, 1.0), z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; ``empty`` is what no trials yield."""
    p = wins / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    some = n > 0
    return (
        F.when(some, F.greatest(F.lit(0.0), centre - half)).otherwise(empty[0]),
        F.when(some, F.least(F.lit(1.0), centre + half)).otherwise(empty[1]),
    )


def expected_max_normal(trials: int) -> float:
    """Expected largest of ``trials`` standard normal draws."""
    if trials <= 1:
        return 0.0
    ppf = NormalDist().inv_cdf
    return (1 - EULER_MASCHERONI) * ppf(1 - 1 / trials) + EULER_MASCHERONI * ppf(
        1 - 1 / (trials * math.e)
    )


# fixed values: W. J. Cody's rational approximations of the error function, 1969, to double precision:
# erf(x) / x in x^2 up to 0.46875, erfc(x) exp(x^2) in x up to 4, and in 1 / x^2 beyond.
_ERF_TOP = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_LOW = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MID_TOP = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
_MID_LOW = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
_FAR_TOP = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
    6.58749161529837803e-4,
)
_FAR_LOW = (
    1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3,
)


def _polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function as a column expression, to double precision; NULL and NaN stay."""
    y = F.abs(x.cast("double"))
    square = y * y
    near = 1.0 - y * _polynomial(_ERF_TOP, square) / _polynomial(_ERF_LOW, square)
    # exp(-y^2) in two factors, the first of them exact.
    step = F.floor(y * 16.0) / 16.0
    decay = F.exp(-step * step) * F.exp(-(y - step) * (y + step))
    mid = decay * _polynomial(_MID_TOP, y) / _polynomial(_MID_LOW, y)
    over = 1.0 / square
    far = decay * (1.0 / math.sqrt(math.pi) - over * _polynomial(_FAR_TOP, over) / _polynomial(_FAR_LOW, over)) / y
    tail = F.when(y <= 0.46875, near).when(y <= 4.0, mid).when(y < 27.0, far).when(F.isnan(y), y).when(y.isNotNull(), 0.0)
    return F.when(x < 0, 2.0 - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2.0))


def normal_cdf_udf():
    """For callers from SQL text; plans use the column expression."""

    @F.pandas_udf(T.DoubleType())
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2)))

    return cdf


_TERMS = 4096


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2x2 table.

    Probabilities fall from the mode on both sides. Each tail of tables no likelier
    than the one seen is summed outward from its likeliest table by ratios of
    neighbours, a block at a time, until terms no longer count.
    """
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    lo, hi = max(0, c1 - r2), min(r1, c1)

    def log_p(x: int) -> float:
        lg = math.lgamma
        return (
            lg(r1 + 1) - lg(x + 1) - lg(r1 - x + 1) + lg(r2 + 1) - lg(c1 - x + 1) - lg(r2 - c1 + x + 1)
            - lg(n + 1) + lg(c1 + 1) + lg(n - c1 + 1)
        )

    def tail(x: int, step: int) -> float:
        total, at = 0.0, log_p(x)
        while lo <= x <= hi:
            xs = x + step * np.arange(min(_TERMS, (hi - x if step > 0 else x - lo) + 1), dtype=float)
            if step > 0:
                ratio = (r1 - xs) * (c1 - xs) / ((xs + 1) * (r2 - c1 + xs + 1))
            else:
                ratio = xs * (r2 - c1 + xs) / ((r1 - xs + 1) * (c1 - xs + 1))
            with np.errstate(divide="ignore"):
                logs = at + np.concatenate([[0.0], np.cumsum(np.log(ratio))])
            terms = np.exp(logs[:-1])
            total += float(terms.sum())
            if terms[-1] <= total * 1e-18:
                break
            x, at = x + step * len(xs), logs[-1]
        return total

    mode = min(hi, max(lo, (r1 + 1) * (c1 + 1) // (n + 2)))
    seen = log_p(a) + 1e-7
    if log_p(mode) <= seen:
        return 1.0
    away = 1 if a > mode else -1
    # The first table on the other side that is no likelier, by halving: beyond the mode probabilities only fall.
    near, far = mode, (lo if away > 0 else hi) - away
    while abs(far - near) > 1:
        middle = (near + far) // 2
        near, far = (near, middle) if log_p(middle) <= seen else (middle, far)
    return min(1.0, tail(a, away) + (tail(far, -away) if lo <= far <= hi else 0.0))


def fisher_udf():
    @F.pandas_udf(T.DoubleType())
    def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_fisher(*map(int, t)) for t in zip(a, b, c, d)])

    return fisher_p


def distance_udf():
    @F.pandas_udf(T.DoubleType())
    def mahalanobis(x: pd.Series, q: pd.Series, precision: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        diff = np.stack(x.to_numpy()) - np.stack(q.to_numpy())
        d = diff.shape[1]
        p = np.stack(precision.to_numpy()).reshape(-1, d, d)
        return pd.Series(np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", diff, p, diff), 0.0)))

    return mahalanobis


def register_sql_functions(spark) -> None:
    """Make the distance, the exact test and the normal CDF callable from SQL."""
    spark.udf.register("plumbline_mahalanobis", distance_udf())
    spark.udf.register("plumbline_fisher_p", fisher_udf())
    spark.udf.register("plumbline_normal_cdf", normal_cdf_udf())
