"""Nearest historical analogs for every ticker and as-of date in one plan.

A query is a row of the history itself: the state of a ticker on a date. Its
candidates are the ticker's earlier rows, the most recent ``gap`` left out. Their
covariance is robust where there are enough of them (``fit_robust_precision``, the
published rule); plain and shrunk ones of any number of as-of dates come from running
sums in one pass (``fit_precision``). Distances are computed next to a ticker's rows, and
only the nearest rows leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.linalg import robust_fits, shrink, whitening
from plumbline.operators.features import DISTANCE_FEATURES
from plumbline.session import materialise, spread

# fixed values
NEIGHBOURS = 30
SEPARATION_ROWS = 21
MIN_SEPARATION_ROWS = 5
RECENCY_HALF_LIFE_DAYS = 1260
MIN_HISTORY_ROWS = 60
MIN_RETURNS = 5
OVERLAP_FLOOR = 0.5
BANNER_OVERLAP_FLOOR = 0.70
FORECAST_HORIZONS = (1, 3, 5, 10)
LITE_MISSING_FEATURES = ("analyst_upgrade_z", "earnings_revision_z")


def numbered(history: DataFrame, features=DISTANCE_FEATURES, label: str = "ret_fwd_10d", ties: str | None = None) -> DataFrame:
    """Rows with every distance feature, numbered by date within the ticker; rows of one date by ``ties``, the largest first."""
    order = [F.col("effective_date"), *([F.desc(ties)] if ties else [])]
    w = Window.partitionBy("ticker").orderBy(*order)
    keep = [c for c in ("state", "query_state", ties) if c in history.columns]
    return (
        history.select("ticker", "effective_date", *features, label, *keep)
        .dropna(subset=list(features))
        .withColumn("row_no", F.row_number().over(w))
        .withColumn("n_rows", F.count("*").over(Window.partitionBy("ticker")))
        .drop(*([ties] if ties else []))
    )


def prefix_moments(rows: DataFrame, features=DISTANCE_FEATURES, gap: int = SEPARATION_ROWS) -> DataFrame:
    """Adds the moments of each row's candidate set: all rows before it but the
    last ``gap``. Values are centred on the ticker mean first."""
    d = len(features)
    whole = Window.partitionBy("ticker")
    before = (
        Window.partitionBy("ticker")
        .orderBy("effective_date")
        .rowsBetween(Window.unboundedPreceding, -(gap + 1))
    )
    df = rows.withColumns({f"_c{i}": F.col(f) - F.avg(f).over(whole) for i, f in enumerate(features)})
    df = df.withColumn("_q", sum((F.col(f"_c{i}") * F.col(f"_c{i}") for i in range(d)), F.lit(0.0)))
    sums = {"_n": F.count("*").over(before).cast("double")}
    for i in range(d):
        sums[f"_s{i}"] = F.sum(f"_c{i}").over(before)
        sums[f"_t{i}"] = F.sum(F.col(f"_c{i}") * F.col("_q")).over(before)
        for j in range(i, d):
            sums[f"_p{i}_{j}"] = F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).over(before)
    sums["_qq"] = F.sum(F.col("_q") * F.col("_q")).over(before)
    df = df.withColumns(sums)
    flat = (
        ["_n"]
        + [f"_s{i}" for i in range(d)]
        + [f"_p{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]
        + [f"_t{i}" for i in range(d)]
        + ["_qq"]
    )
    return (
        df.withColumn("moments", F.array(*[F.col(c) for c in flat]))
        .withColumnRenamed("_n", "n_candidates")
        .drop("_q", *[f"_c{i}" for i in range(d)], *sums)
    )


def whitening_udf(d: int, method: str):
    """Whitening of a query from the moments of its candidates, a batch at a time."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def whiten(moments: pd.Series, query: pd.Series) -> pd.Series:
        if not len(moments):
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(v, dtype=float) for v in moments])
        n = m[:, 0]
        s = m[:, 1 : 1 + d]
        p = m[:, 1 + d : 1 + d + d * d].reshape(-1, d, d)
        t = m[:, 1 + d + d * d : 1 + 2 * d + d * d]
        qq = m[:, -1]
        mu = s / n[:, None]
        emp = p / n[:, None, None] - mu[:, :, None] * mu[:, None, :]
        if method == "sample":
            cov = emp * (n / (n - 1))[:, None, None]
        else:
            c = np.sum(mu * mu, axis=1)
            norm4 = (
                qq
                + 4 * np.einsum("ni,nij,nj->n", mu, p, mu)
                + n * c * c
                - 4 * np.sum(mu * t, axis=1)
                + 2 * c * np.trace(p, axis1=1, axis2=2)
                - 4 * c * np.sum(mu * s, axis=1)
            )
            cov, _ = shrink(emp, n, norm4)
        return pd.Series(list(whitening(cov, np.stack([np.asarray(v, dtype=float) for v in query]))))

    return whiten


def latest_queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_no") == F.col("n_rows"))


def sampled_queries(rows: DataFrame, trailing: int, every: int, horizon: int = 10) -> DataFrame:
    """Every ``every``-th of each ticker's trailing dates, the last horizon+1 left out."""
    back = F.col("n_rows") - F.col("row_no")
    return rows.where(
        (back > horizon) & (back <= horizon + trailing) & ((back - horizon - 1) % every == 0)
    )


def fit_precision(queries: DataFrame, features=DISTANCE_FEATURES, method: str = "ledoit_wolf") -> DataFrame:
    if method not in ("ledoit_wolf", "sample"):
        raise ValueError(f"unknown method {method!r}")
    return (
        queries.where(F.col("n_candidates") > 1)
        .withColumn("whitening", whitening_udf(len(features), method)("moments", F.array(*features)))
        .withColumn("covariance_method", F.lit(method))
        .drop("moments")
    )


# Queries of one ticker that are fitted in one task.
QUERIES_PER_TASK = 64


def _by_ticker(rows: DataFrame) -> DataFrame:
    """The history that a fit and a search both read, partitioned by ticker: one exchange serves both."""
    return spread(rows.where(F.col("ticker").isNotNull()).drop("moments", "n_candidates", "n_rows", "query_state"), "ticker")


def _in_order(history: pa.Table, features) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A ticker's rows in the order of their numbers, those numbers, and the features."""
    history = history.take(pa.array(np.argsort(history["row_no"].to_numpy(), kind="stable")))
    return history, history["row_no"].to_numpy(), np.column_stack([history[f].to_numpy() for f in features])


def fit_robust_precision(
    rows: DataFrame, queries: DataFrame | None = None, features=DISTANCE_FEATURES, gap: int = SEPARATION_ROWS,
) -> DataFrame:
    """Queries of any as-of date with the published covariance of their candidates.

    The robust estimate where a query has 20 candidates per feature, else Ledoit-Wolf;
    ``covariance_method`` names it. Without ``queries``, the latest of each ticker.
    A group is at most ``QUERIES_PER_TASK`` queries of a ticker next to its daily rows,
    however many as-of dates are asked for; its queries are fitted together.
    """
    features = list(features)
    d = len(features)
    queries = latest_queries(rows) if queries is None else queries
    number = F.row_number().over(Window.partitionBy("ticker").orderBy("row_no"))
    part = F.floor((number - 1) / QUERIES_PER_TASK)
    asked = queries.drop("moments").where(F.col("ticker").isNotNull()).withColumn("_part", part)
    asked = materialise(asked, "analog-asked")  # numbered once, and apart from the rows it comes from
    kept = asked.drop("_part").columns
    schema = T.StructType(list(asked.drop("_part").schema.fields))
    for name, kind in (
        ("whitening", T.ArrayType(T.DoubleType())), ("covariance_method", T.StringType()), ("n_fitted", T.LongType()),
        ("n_kept", T.LongType()), ("covariance", T.ArrayType(T.DoubleType())),
    ):
        schema = schema.add(name, kind)

    def solve(history: pa.Table, asked: pa.Table) -> pa.Table:
        _, at, x = _in_order(history, features)
        ends = np.searchsorted(at, asked["row_no"].to_numpy() - gap)
        asked = asked.select(kept).filter(pa.array(ends > 1))
        ends = ends[ends > 1]
        fits = robust_fits(x, ends)
        covs = np.array([cov for cov, _, _ in fits], dtype=float).reshape(-1, d, d)
        points = np.column_stack([asked[f].to_numpy() for f in features]).astype(float)
        white = whitening(covs, points) if len(fits) else np.zeros((0, 0))
        vectors = pa.list_(pa.float64())
        columns = [
            pa.array(list(white), vectors), pa.array([m for _, m, _ in fits], pa.string()), pa.array(ends, pa.int64()),
            pa.array([n for _, _, n in fits], pa.int64()), pa.array(list(covs.reshape(len(fits), d * d)), vectors),
        ]
        return pa.table([*asked.columns, *columns], names=schema.names)

    if asked.where("_part > 0").isEmpty():
        return _by_ticker(rows).groupBy("ticker").cogroup(asked.groupBy("ticker")).applyInArrow(solve, schema)
    # A ticker's rows go to each of its tasks; a task needs none after its last query.
    tasks = asked.groupBy("ticker", F.col("_part").alias("_task")).agg(F.max("row_no").alias("_last"))
    history = rows.select("ticker", "row_no", *features).join(tasks, "ticker").where(F.col("row_no") < F.col("_last")).drop("_last")
    history = spread(history, "ticker", "_task").groupBy("ticker", "_task")
    return history.cogroup(asked.groupBy("ticker", "_part")).applyInArrow(solve, schema)


def _distances(x: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Queries x rows: distance of every row to every query under the query's unpacked whitening.

    Term by term, so that equal rows are equally far, wherever they stand.
    """
    d = x.shape[1]
    total, at = np.zeros((len(white), len(x))), 0
    for i in range(d):
        projected = -white[:, d * (d + 1) // 2 + i][:, None]
        for j in range(i, d):
            projected = projected + white[:, at][:, None] * x[:, j]
            at += 1
        total = total + projected * projected
    return np.sqrt(total)


def _nearest(rows: np.ndarray, far: np.ndarray, day: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``rows``, ties by day, and how far they are."""
    if len(rows) > k:
        near = far <= np.partition(far, k - 1)[k - 1]
        if np.count_nonzero(near) >= k:
            rows, far = rows[near], far[near]
    top = np.lexsort((day[rows], far))[:k]
    return rows[top], far[top]


def _days(column: pa.ChunkedArray) -> np.ndarray:
    """Dates as numbers, nulls first."""
    return column.cast(pa.int32()).fill_null(-(1 << 31)).to_numpy()


def find_analogs(
    rows: DataFrame, queries: DataFrame, features=DISTANCE_FEATURES, k: int = NEIGHBOURS,
    gap: int = SEPARATION_ROWS, label: str = "ret_fwd_10d", by_state: bool = False,
) -> DataFrame:
    """The ``k`` nearest candidates of each query; ties go to the earlier date.

    With ``by_state`` a second set per query is drawn from the rows that share the
    query's ``query_state``; its own ``gap`` most recent rows are left out and the
    covariance stays that of the global set. A ticker's rows and queries meet in one
    task, so no row but the nearest leaves it. Queries of one date answer as one.
    """
    if gap < MIN_SEPARATION_ROWS:
        raise ValueError(f"gap must be >= {MIN_SEPARATION_ROWS}")
    features = list(features)
    asked = queries.where(F.col("ticker").isNotNull()).select(
        "ticker", F.col("effective_date").alias("as_of"), F.col("row_no").alias("q_row"), "covariance_method", "whitening",
        *(["query_state"] if by_state else []),
    )
    date, fwd = rows.schema["effective_date"].dataType.simpleString(), rows.schema[label].dataType.simpleString()
    schema = (
        f"ticker string, as_of {date}, analog_set string, effective_date {date}, covariance_method string, "
        f"fwd {fwd}, distance double, rank int"
    )

    def search(history: pa.Table, asked: pa.Table) -> pa.Table:
        history, at, x = _in_order(history, features)
        day, q_row, as_of = _days(history["effective_date"]), asked["q_row"].to_numpy(), _days(asked["as_of"])
        sets: dict[tuple, list] = {}
        for lo in range(0, asked.num_rows, QUERIES_PER_TASK):
            white = np.array(asked["whitening"].slice(lo, QUERIES_PER_TASK).to_pylist(), dtype=float)
            far = _distances(x, white)
            for q in range(lo, lo + len(white)):
                pools = {"global": np.arange(np.searchsorted(at, q_row[q] - gap))}
                if by_state:
                    state, wanted = history["state"].slice(0, int(np.searchsorted(at, q_row[q]))), asked["query_state"][q].as_py()
                    same = np.array([s is not None and s == wanted for s in state.to_pylist()], dtype=bool)
                    recent = max(0, gap - (state.null_count if wanted is not None else 0))
                    pools["within"] = np.flatnonzero(same)[: max(0, int(same.sum()) - recent)]
                for tag, pool in pools.items():
                    near, dist = _nearest(pool, far[q - lo, pool], day, k)
                    sets.setdefault((as_of[q], tag), []).append((np.full(len(near), q), near, dist))
        of, near, dist, tags, ranks = [], [], [], [], []
        for (_, tag), found in sets.items():
            q, row, far = (np.concatenate(v) for v in zip(*found))
            top = np.lexsort((day[row], far))[:k]
            of.append(q[top]), near.append(row[top]), dist.append(far[top])
            tags += [tag] * len(top)
            ranks.append(np.arange(1, len(top) + 1))
        of, near = (np.concatenate([np.zeros(0, dtype=int), *v]).astype(int) for v in (of, near))
        of, near = pa.array(of), pa.array(near)
        columns = [
            asked["ticker"].take(of), asked["as_of"].take(of), pa.array(tags, pa.string()), history["effective_date"].take(near),
            asked["covariance_method"].take(of), history[label].take(near),
            pa.array(np.concatenate([np.zeros(0), *dist]), pa.float64()), pa.array(np.concatenate([np.zeros(0, dtype=int), *ranks]), pa.int32()),
        ]
        return pa.table(columns, names=["ticker", "as_of", "analog_set", "effective_date", "covariance_method", "fwd", "distance", "rank"])

    return _by_ticker(rows).groupBy("ticker").cogroup(asked.groupBy("ticker")).applyInArrow(search, schema)


def recency_weight() -> Column:
    age = F.datediff("as_of", "effective_date")
    return F.exp(-math.log(2) * age / F.lit(float(RECENCY_HALF_LIFE_DAYS)))


def summarise(neighbours: DataFrame) -> DataFrame:
    """Forward-return distribution of each analog set (at most k rows per group)."""
    w = recency_weight()
    win, loss = F.when(F.col("fwd") > 0, F.col("fwd")), F.when(F.col("fwd") < 0, F.col("fwd"))
    out = neighbours.groupBy("ticker", "as_of", "analog_set").agg(
        F.count("*").alias("n_analogs"),
        F.count("fwd").alias("n_returns"),
        F.first("covariance_method").alias("covariance_method"),
        F.avg(F.coalesce(F.col("fwd") > 0, F.lit(False)).cast("double")).alias("hit_rate"),
        (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"),
        F.percentile("fwd", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("_p"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(-F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.max("distance").alias("max_distance"),
        F.collect_list("fwd").alias("returns"),
        F.collect_set("effective_date").alias("dates"),
    )
    return out.withColumns(
        {f"p{q}": F.col("_p")[i] for i, q in enumerate((5, 25, 50, 75, 95))}
    ).drop("_p")


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def disagreement(summary: DataFrame) -> DataFrame:
    """Overlap of the global and the within-state set of each query."""
    def pick(tag):
        return F.max(F.when(F.col("analog_set") == tag, F.col("dates")))
    nothing = F.array().cast("array<date>")
    pairs = summary.groupBy("ticker", "as_of").agg(
        F.coalesce(pick("global"), nothing).alias("_g"), F.coalesce(pick("within"), nothing).alias("_w")
    )
    overlap = jaccard(F.col("_g"), F.col("_w"))
    return pairs.select(
        "ticker", "as_of",
        F.size("_g").alias("n_global"), F.size("_w").alias("n_within"),
        overlap.alias("overlap_pct"),
        (overlap < OVERLAP_FLOOR).alias("disagreement"),
        (overlap < BANNER_OVERLAP_FLOOR).alias("show_banner"),
    )


def evidence_tier(effective_n: Column) -> Column:
    return F.when(effective_n >= 20, "moderate").when(effective_n >= 12, "weak").otherwise("insufficient")


def kelly_ladder(df: DataFrame, k: int = NEIGHBOURS, cap: float = 0.20) -> DataFrame:
    """Raw, half, evidence-scaled and displayed fractions from mean win and loss."""
    odds = F.col("avg_win") / F.col("avg_loss")
    raw = F.when(
        (F.col("avg_win") > 0) & (F.col("avg_loss") > 0),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("hit_rate") - (1 - F.col("hit_rate")) / odds)),
    ).otherwise(0.0)
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.col("effective_n") / k))
    df = df.withColumn("kelly_raw", raw).withColumn("kelly_std", F.col("kelly_raw") * 0.5)
    df = df.withColumn("kelly_regime", F.col("kelly_std") * scale)
    return df.withColumn("kelly_displayed", F.least(F.col("kelly_regime"), F.lit(cap)))


def forecast_fan(summary: DataFrame, horizon: int = 10) -> DataFrame:
    """Per-horizon bands scaled from the terminal ones, in both published forms."""
    s, share = F.sqrt(F.col("h") / F.lit(float(horizon))), F.col("h") / F.lit(float(horizon))
    mid = F.col("p50") * share
    return summary.withColumn("h", F.explode(F.array(*[F.lit(h) for h in FORECAST_HORIZONS]))).select(
        "ticker", "as_of", "h",
        (F.col("p5") * s).alias("band_p5"), mid.alias("band_p50"), (F.col("p95") * s).alias("band_p95"),
        (mid + (F.col("p5") - F.col("p50")) * s).alias("around_p5"),
        (mid + (F.col("p95") - F.col("p50")) * s).alias("around_p95"),
    )


def vol_shift_probability(returns: Column, annual_vol: Column, horizon: int = 10) -> Column:
    """Share of analog moves larger than the current volatility over the horizon."""
    limit = annual_vol * math.sqrt(horizon / 252.0)
    n = F.size(returns)
    share = F.size(F.filter(returns, lambda r: F.abs(r) > limit)) / n
    return F.when((annual_vol > 0) & (n > 0), share)


def ticker_profile(rows: DataFrame, features=DISTANCE_FEATURES, top: int = 3) -> DataFrame:
    """Per ticker in one aggregate: row count, last date, last volatility and the
    features of the last row furthest from their own history."""
    stats = []
    for f in features:
        stats += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.max_by(f, "row_no").alias(f"l_{f}")]
    stats += [F.max("effective_date").alias("as_of"), F.count("*").alias("n_rows")]
    z = rows.groupBy("ticker").agg(*stats)
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(i).alias("position"),
                (
                    (F.col(f"l_{f}") - F.col(f"m_{f}"))
                    / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0)
                ).alias("z"),
            )
            for i, f in enumerate(features)
        ]
    )
    ordered = F.array_sort(
        F.transform(
            items,
            lambda x: F.struct(
                (-F.abs(x["z"])).alias("a"), x["position"].alias("p"), x["feature"].alias("f"), x["z"].alias("z")
            ),
        )
    )
    named = F.transform(
        F.slice(ordered, 1, top),
        lambda x: F.concat(x["f"], F.when(x["z"] >= 0, " ↑").otherwise(" ↓")),
    )
    return z.select(
        "ticker", "as_of", "n_rows", F.col("l_realized_vol_21d").alias("current_vol"), named.alias("drivers")
    )


def drivers(rows: DataFrame, features=DISTANCE_FEATURES, top: int = 3) -> DataFrame:
    return ticker_profile(rows, features, top).select("ticker", "as_of", "drivers")


def assets(rows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Everything known about each ticker's latest query, one row per ticker.

    Global and within-state sets come side by side from a single pass over the
    neighbours, and the ticker's own figures from a single pass over its rows.
    """
    summary = summarise(neighbours)
    own = [c for c in summary.columns if c not in ("ticker", "as_of", "analog_set")]
    both = summary.groupBy("ticker", "as_of").agg(
        F.first(F.when(F.col("analog_set") == "global", F.struct(*own)), ignorenulls=True).alias("_g"),
        F.first(F.when(F.col("analog_set") == "within", F.col("dates")), ignorenulls=True).alias("_w"),
    )
    main = both.select("ticker", "_g.*", "_w")
    overlap = jaccard(F.col("dates"), F.coalesce("_w", F.array().cast("array<date>")))
    # An empty within-state set overlaps in nothing; without states there is no second set.
    split = F.lit("state" in rows.columns)
    with_overlap = kelly_ladder(main).withColumns(
        {
            "overlap_pct": F.when(split, overlap),
            "disagreement": F.when(split, overlap < OVERLAP_FLOOR),
        }
    )
    return ticker_profile(rows).join(with_overlap.drop("_w", "dates"), "ticker", "left")


def watchlist(rows: DataFrame, neighbours: DataFrame, min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """One row per ticker: analog distribution, tier, sizing, drivers, probabilities.

    Tickers with too little history keep a row whose status says so.
    """
    out = assets(rows, neighbours)
    enough = (F.col("n_rows") >= min_rows) & (F.coalesce(F.col("n_returns"), F.lit(0)) >= MIN_RETURNS)
    return out.select(
        "ticker",
        "as_of",
        F.when(enough, "ready").otherwise("pending").alias("status"),
        F.when(enough, F.bround("effective_n").cast("int")).alias("n"),
        F.when(enough, F.col("hit_rate")).alias("hit_rate"),
        F.when(enough, evidence_tier(F.col("effective_n"))).alias("conf"),
        *[F.when(enough, F.col(f"p{q}")).alias(f"p{q}") for q in (5, 25, 50, 75, 95)],
        F.when(enough, F.concat_ws(", ", "drivers")).alias("drivers"),
        *[
            F.when(enough, F.col(c)).alias(c)
            for c in ("kelly_raw", "kelly_std", "kelly_regime", "kelly_displayed")
        ],
        F.when(enough, vol_shift_probability(F.col("returns"), F.col("current_vol"))).alias("p_vol_shift"),
        F.when(enough, F.col("covariance_method")).alias("covariance_method"),
        F.when(enough, F.col("overlap_pct")).alias("overlap_pct"),
        F.when(enough, F.col("disagreement")).alias("disagreement"),
    )
