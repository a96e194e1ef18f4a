"""Factor orthogonalisation, per-ticker factor regressions and clusters in what they leave."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from plumbline.session import materialise, small_batches, spread

# fixed values: the order in which factors are orthogonalised
FACTOR_ORDER = (
    "market_beta", "rates_sensitivity", "credit_sensitivity", "growth_factor", "value_factor",
    "small_cap", "usd_sensitivity", "commodities", "volatility_factor", "semiconductor_cycle",
)
ZERO_VARIANCE = 1e-8
MIN_OBS = 80
DECAY_SHORT = 0.97
DECAY_LONG = 0.99
TAIL_LOOKBACK_DAYS = 504
SIGNIFICANT_T = 1.96
LOADING_CUTOFF = 0.30
MIN_CLUSTER = 3
JACCARD_MATCH = 0.70
STABILITY = 0.80
BOOTSTRAPS = 100


def orthogonalisation(factors: DataFrame, names=FACTOR_ORDER) -> np.ndarray:
    """Coefficients that express each residual factor in the original ones.

    One aggregate pass yields the Gram matrix; what reaches the driver is that
    (d+1) x (d+1) matrix, whatever the number of rows. Row i holds the intercept and
    the weights of factor i's residual.
    """
    d = len(names)
    shift = factors.groupBy().agg(*[F.avg(n).alias(n) for n in names]).first()
    # A row serves the fits of its leading non-NULL factors.
    leading = F.lit(d)
    for i in reversed(range(d)):
        leading = F.when(F.col(names[i]).isNull(), i).otherwise(leading)
    cols = [F.lit(1.0)] + [F.coalesce(F.col(n) - F.lit(shift[n]), F.lit(0.0)) for n in names]
    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = factors.groupBy(leading.alias("leading")).agg(
        *[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in cells]
    ).collect()
    grams = np.zeros((d + 1, d + 1, d + 1))
    for row in sums:
        for i, j in cells:
            grams[row["leading"], i, j] = grams[row["leading"], j, i] = row[f"g{i}_{j}"]
    basis = np.zeros((d, d + 1))
    passed = []
    for i in range(d):
        gram = grams[i + 1 :].sum(axis=0)
        n = gram[0, 0]
        target = np.zeros(d + 1)
        target[i + 1] = 1.0
        basis[i] = target
        passed.append(i)
        if i == 0 or n < i + 2:
            continue
        variance = (gram[i + 1, i + 1] - gram[0, i + 1] ** 2 / n) / max(n - 1, 1)
        if np.sqrt(max(variance, 0.0)) < ZERO_VARIANCE:
            continue
        passed.pop()
        prior = np.vstack([np.eye(1, d + 1), basis[:i]])
        beta = np.linalg.lstsq(prior @ gram @ prior.T, prior @ gram @ target, rcond=None)[0]
        basis[i] = target - beta @ prior
    # Back from centred to original columns; factors passed through stay as they are.
    means = np.array([shift[n] or 0.0 for n in names])
    out = basis.copy()
    out[:, 0] = basis[:, 0] - basis[:, 1:] @ means
    out[passed, 0] = 0.0
    return out


def orthogonalise(factors: DataFrame, names=FACTOR_ORDER, keys=("effective_date",)) -> DataFrame:
    """Each factor freed of all before it, as plain column arithmetic."""
    coef = orthogonalisation(factors, names)
    out = []
    for i, name in enumerate(names):
        expr = F.lit(float(coef[i, 0]))
        for j, other in enumerate(names[: i + 1]):
            expr = expr + F.lit(float(coef[i, j + 1])) * F.col(other)
        out.append(expr.alias(name))
    return factors.select(*keys, *out)


EXPOSURES = (
    "ticker string, method string, factor string, beta double, t_stat double, significant boolean,"
    " r_squared double, idiosyncratic_pct double, n_obs long, status string"
)


def weighted_ols(x: np.ndarray, y: np.ndarray, decay: float):
    n = len(y)
    w = decay ** np.arange(n - 1, -1, -1)
    z = np.column_stack([np.ones(n), x])
    root = np.sqrt(w)
    q, r = np.linalg.qr(z * root[:, None])
    beta = np.linalg.solve(r, q.T @ (y * root))
    resid = y - z @ beta
    ssr = float(np.sum(w * resid**2))
    centre = np.sum(w * y) / w.sum()
    r2 = 1 - ssr / float(np.sum(w * (y - centre) ** 2))
    inverse = np.linalg.inv(r)
    se = np.sqrt(np.sum(inverse**2, axis=1) * ssr / (n - z.shape[1]))
    var = np.var(y, ddof=1)
    idio = float(np.var(resid, ddof=1) / var) if var > 0 else 1.0
    return beta, beta / se, r2, idio


def ridge(x: np.ndarray, y: np.ndarray, alpha: float):
    sd = x.std(axis=0, ddof=1)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - x.mean(axis=0)) / sd
    yc = y - y.mean()
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ yc)
    resid = yc - z @ beta
    total = float(np.sum(yc**2))
    share = float(np.sum(resid**2)) / total if total > 0 else 1.0
    return beta / sd, (1 - share) if total > 0 else 0.0, share


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, steps: int = 1000, tol: float = 1e-6):
    """Iteratively reweighted least squares for the q-th conditional quantile."""
    z = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    for _ in range(steps):
        resid = y - z @ beta
        loss = np.where(resid < 0, 1 - q, q)
        w = loss / np.maximum(np.abs(resid), 1e-6)
        zw = z * w[:, None]
        new = np.linalg.lstsq(zw.T @ z, zw.T @ y, rcond=None)[0]
        if np.max(np.abs(new - beta)) < tol:
            return new
        beta = new
    return beta


# Fits of quantiles that are iterated side by side.
FITS_AT_ONCE = 128
# Largest ratio of singular values up to which normal equations are solved without truncation.
WELL_POSED = 1e3


def quantile_regressions(problems, steps: int = 1000, tol: float = 1e-6) -> list[np.ndarray]:
    """:func:`quantile_regression` of many (x, y, q), step by step side by side; each stops where it would alone."""
    out: list[np.ndarray] = [None] * len(problems)
    held = []
    for k, (x, y, q) in enumerate(problems):
        z = np.column_stack([np.ones(len(y)), x])
        beta, _, rank, sizes = np.linalg.lstsq(z, y, rcond=None)
        if rank < z.shape[1] or sizes[-1] * WELL_POSED < sizes[0]:
            out[k] = quantile_regression(x, y, q, steps, tol)
        else:
            held.append((k, np.column_stack([z, y]), q, beta))
    # Fits of like width; rows of zeros behind the shorter ones weigh nothing.
    for d in {zy.shape[1] - 1 for _, zy, _, _ in held}:
        some = [h for h in held if h[1].shape[1] == d + 1]
        for lo in range(0, len(some), FITS_AT_ONCE):
            at, parts, quantiles, starts = zip(*some[lo : lo + FITS_AT_ONCE])
            zy = np.zeros((len(at), max(map(len, parts)), d + 1))
            for own, part in zip(zy, parts):
                own[: len(part)] = part
            at, beta, q = np.array(at), np.stack(starts), np.array(quantiles, dtype=float)[:, None]
            zt = np.ascontiguousarray(zy[:, :, :d].transpose(0, 2, 1))
            for _ in range(steps):
                resid = zy[:, :, d] - (beta[:, None, :] @ zt)[:, 0]
                w = np.where(resid < 0, 1 - q, q) / np.maximum(np.abs(resid), 1e-6)
                sums = (zt * w[:, None, :]) @ zy
                new = _solved(sums[:, :, :d], sums[:, :, d])
                moving = ~(np.abs(new - beta).max(axis=1) < tol)
                beta = new
                if not moving.all():
                    for k in np.flatnonzero(~moving):
                        out[at[k]] = beta[k]
                    at, beta, q, zy, zt = at[moving], beta[moving], q[moving], zy[moving], zt[moving]
                    if not len(at):
                        break
            # A fit that has not settled by now depends on the rounding of every step.
            for k in at:
                out[k] = quantile_regression(*problems[k], steps, tol)
    return out


def _solved(grams: np.ndarray, sums: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(grams, sums[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(g, s, rcond=None)[0] for g, s in zip(grams, sums)])


def factor_regressions(
    aligned: DataFrame, names=FACTOR_ORDER, decay: float = DECAY_SHORT, alpha: float = 1.0,
    lookback_days: int = TAIL_LOOKBACK_DAYS, min_obs: int = MIN_OBS,
    methods=("ew_ols", "ridge", "tail_5", "tail_95"),
) -> DataFrame:
    """Exposures of every ticker by every method from lag-aligned rows.

    A group is one ticker's daily rows. Rows that are partitioned by ticker stay where they are;
    tickers stream by, and the quantile fits of some of them are iterated together.
    """
    names, d = list(names), len(names)
    columns = [f.split()[0] for f in EXPOSURES.split(", ")]

    def rows(ticker, method, n, beta=None, t=None, r2=None, idio=None):
        """Values of the columns of EXPOSURES; without betas the ticker has too few rows."""
        if beta is None:
            return [ticker], [method], [None], [None], [None], [False], [None], [None], [n], ["INSUFFICIENT_DATA"]
        t = [None] * d if t is None else t
        found = [bool(abs(v) >= SIGNIFICANT_T) if v is not None and np.isfinite(v) else False for v in t]
        return [ticker] * d, [method] * d, names, beta, t, found, [r2] * d, [idio] * d, [n] * d, ["OK"] * d

    def exposures(groups):
        """Rows of (ticker, day, y and x) groups, in the order of the methods."""
        out, problems, wanted = [], [], []
        for ticker, days, values in groups:
            if not (np.diff(days) > 0).all():
                order = np.argsort(np.where(np.isnan(days), np.inf, days).astype(object))
                days, values = days[order], values[order]
            y, x = values[:, 0], np.ascontiguousarray(values[:, 1:])
            for method in methods:
                if method in ("ew_ols", "ridge"):
                    n = len(y)
                    if n < min_obs:
                        out.append(rows(ticker, method, n))
                    elif method == "ew_ols":
                        beta, t, r2, idio = weighted_ols(x, y, decay)
                        out.append(rows(ticker, method, n, beta[1:], t[1:], r2, idio))
                    else:
                        beta, r2, idio = ridge(x, y, alpha)
                        out.append(rows(ticker, method, n, beta, None, r2, idio))
                    continue
                # A missing day sorts last and is not recent.
                dated = days[~np.isnan(days)]
                recent = days >= dated[-1] - (lookback_days + 30) if len(dated) else np.zeros(len(days), dtype=bool)
                if recent.sum() < min_obs:
                    out.append(rows(ticker, method, int(recent.sum())))
                    continue
                problems.append((x[recent], y[recent], int(method.split("_")[1]) / 100))
                wanted.append((len(out), ticker, method, int(recent.sum())))
                out.append(None)
        for (at, ticker, method, n), beta in zip(wanted, quantile_regressions(problems)):
            out[at] = rows(ticker, method, n, beta[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array([v for part in out for v in part[k]], kind.type, from_pandas=True) for k, kind in enumerate(schema)], columns)

    def fit(batches):
        done, pieces, ticker = [], [], None

        def whole():
            return ticker, *(np.concatenate(p) for p in zip(*pieces))

        for batch in batches:
            day = batch.column("_day").to_numpy(zero_copy_only=False).astype(float)
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("asset_ret", *names)])
            first = batch.column("_no").to_numpy(zero_copy_only=False) == 1
            cuts = np.unique([0, *np.flatnonzero(first), batch.num_rows])
            for lo, hi in zip(cuts, cuts[1:]):
                if first[lo]:
                    if pieces:
                        done.append(whole())
                    pieces, ticker = [], batch.column("ticker")[lo].as_py()
                pieces.append((day[lo:hi], values[lo:hi]))
                if len(done) * 2 >= FITS_AT_ONCE:
                    yield exposures(done)
                    done = []
        if pieces:
            yield exposures([*done, whole()])

    schema = to_arrow_schema(StructType.fromDDL(EXPOSURES))
    # The window asks for whole tickers in one task, in their order; its number says where one begins.
    by_day = Window.partitionBy("ticker").orderBy("effective_date")
    dealt = aligned.select("ticker", F.unix_date(F.col("effective_date").cast("date")).alias("_day"), "asset_ret", *names, F.row_number().over(by_day).alias("_no"))
    return dealt.mapInArrow(fit, EXPOSURES)


def residuals(aligned: DataFrame, exposures: DataFrame, names=FACTOR_ORDER, method: str = "ew_ols") -> DataFrame:
    """(ticker, effective_date, residual): returns less what the betas explain."""
    betas = exposures.where((F.col("method") == method) & (F.col("status") == "OK")).groupBy("ticker").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("beta"))).alias(f"_b_{n}") for n in names]
    )
    explained = sum((F.col(n) * F.col(f"_b_{n}") for n in names), F.lit(0.0))
    return aligned.join(betas, "ticker").select("ticker", "effective_date", (F.col("asset_ret") - explained).alias("residual"))


def residual_panel(rows: DataFrame, groups: DataFrame, value: str = "residual") -> tuple[DataFrame, DataFrame]:
    """(group_id, effective_date, x) and (group_id, names): a group's values of one day in the order of its names, 0 where missing.

    ``groups`` (group_id, ticker) says who stands together. Names of a group are a bounded
    universe; a name without any value is not among them.
    """
    held = rows.where(F.col(value).isNotNull()).join(groups, "ticker")
    names = materialise(held.groupBy("group_id").agg(F.array_sort(F.collect_set("ticker")).alias("names")), "residual-names")
    # A name travels as its place in the group, a day as the values that it has.
    places = names.select("group_id", F.size("names").alias("_d"), F.posexplode("names").alias("_k", "ticker"))
    day = held.join(places, ["group_id", "ticker"]).groupBy("group_id", "effective_date").agg(
        F.first("_d").alias("_d"), F.collect_list(F.struct("_k", F.col(value).cast("double").alias("_v"))).alias("_m")
    )
    kinds = day.schema
    schema = StructType([kinds["group_id"], kinds["effective_date"]]).add("x", ArrayType(DoubleType()))

    def filled(batches):
        for batch in batches:
            out = []
            for d, held in zip(batch.column("_d").to_pylist(), batch.column("_m")):
                at, x = held.values.field("_k").to_numpy(), np.zeros(d)
                if len(np.unique(at)) < len(at):
                    raise ValueError("a name has two values on one day")
                x[at] = held.values.field("_v").to_numpy()
                out.append(x)
            kept = [batch.column(c) for c in ("group_id", "effective_date")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], schema.names)

    small_batches(rows.sparkSession)
    return materialise(day.select("group_id", "effective_date", "_d", "_m").mapInArrow(filled, schema), "residual-panel"), names


def bootstrap_draws(days: DataFrame, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """(group_id, effective_date, replicates): which resamples drew a day, named once per draw.

    Each resample of a group of n days makes n draws with replacement; draw s of
    replicate b takes the day whose number is the first 32 bits of md5(group|b|s)
    modulo n, so reruns draw alike. Only (group, number, replicate) meet, not the panel.
    """
    by_date = Window.partitionBy("group_id").orderBy("effective_date")
    numbered = days.select("group_id", "effective_date", (F.row_number().over(by_date) - 1).alias("_k"))
    slots = numbered.withColumn("_n", F.count("*").over(Window.partitionBy("group_id"))).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(bootstraps - 1)))
    )
    # A day's number stands for one slot of every replicate: n slots each.
    digest = F.md5(F.concat_ws("|", "group_id", F.col("_b").cast("string"), F.col("_k").cast("string")))
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n")).cast("int")
    picks = slots.select("group_id", drawn.alias("_k"), "_b").groupBy("group_id", "_k").agg(F.collect_list("_b").alias("replicates"))
    return numbered.join(picks, ["group_id", "_k"], "left").select("group_id", "effective_date", "replicates")


COMPONENTS = "group_id string, replicate int, component int, share double, n_days long, members array<int>"
# Days of a group whose weighted moments are summed in one task.
MOMENT_DAYS = 512


def weighted_moments(panel: DataFrame, draws: DataFrame, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """(group_id, replicate, d, sums): per replicate the day count, the sums and the products of a group's values, each day as often as drawn.

    Replicate -1 takes every day once. The panel travels once; what a task sends is one
    matrix per (group, replicate), of which the upper half, whatever the number of its
    days. That is the square of a group's names: ``bootstrap_components`` sends only
    narrow groups here.
    """
    schema = "group_id string, replicate int, d int, sums binary"
    small_batches(panel.sparkSession)

    def reduce(batches):
        for pdf in batches:
            for g, part in pdf.groupby("group_id"):
                x = np.stack(part["x"].to_list()).astype(float)
                n, d = x.shape
                w = np.zeros((bootstraps + 1, n))
                w[bootstraps] = 1
                for k, picks in enumerate(part["replicates"]):
                    if picks is not None and len(picks):
                        np.add.at(w[:, k], np.asarray(picks, dtype=int), 1)
                for b, weight in enumerate(w):
                    at = np.flatnonzero(weight)
                    wx = x[at] * weight[at, None]
                    sums = np.concatenate([[weight.sum()], wx.sum(axis=0), (wx.T @ x[at])[np.triu_indices(d)]])
                    yield pd.DataFrame({"group_id": [g], "replicate": [b if b < bootstraps else -1], "d": [d], "sums": [sums.tobytes()]})

    rows = panel.join(draws, ["group_id", "effective_date"], "left")
    place = F.pmod(F.datediff("effective_date", F.lit("1970-01-01")), F.lit(1 << 30)) / MOMENT_DAYS
    dealt = spread(rows.withColumn("_span", F.floor(place)), "group_id", "_span").sortWithinPartitions("group_id", "_span")
    return dealt.select("group_id", "x", "replicates").mapInPandas(reduce, schema)


def residual_components(moments: DataFrame, n_components: int = 3) -> DataFrame:
    """(group_id, replicate, component, share, n_days, members): positions with a large loading on each leading component.

    Partial matrices of one (group, replicate) are added up as they stream by; one matrix
    is held at a time.
    """
    schema = COMPONENTS

    def solved(key, d, total):
        n, sums, products = total[0], total[1 : 1 + d], _whole(total[1 + d :], d)
        if n < 2 or d < MIN_CLUSTER:
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        values, vectors = np.linalg.eigh(products - np.outer(sums, sums) / n)
        order = np.argsort(values)[::-1][: min(n_components, int(n), d)]
        whole = max(float(np.trace(products) - sums @ sums / n), 1e-300)
        return pd.DataFrame({
            "group_id": key[0], "replicate": key[1], "component": range(len(order)), "share": values[order] / whole, "n_days": int(n),
            "members": [np.flatnonzero(np.abs(vectors[:, k]) >= LOADING_CUTOFF).tolist() for k in order],
        })

    def add(batches):
        key, d, total = None, 0, None
        for pdf in batches:
            for g, b, width, sums in zip(pdf["group_id"], pdf["replicate"], pdf["d"], pdf["sums"]):
                if (g, b) != key:
                    if key is not None:
                        yield solved(key, d, total)
                    key, d, total = (g, b), width, 0.0
                total = total + np.frombuffer(sums)
        if key is not None:
            yield solved(key, d, total)

    keys = ["group_id", "replicate"]
    return materialise(spread(moments, *keys).sortWithinPartitions(*keys).mapInPandas(add, schema), "residual-components")


# A group of more names goes by the products of its days instead of its names.
MOST_NAMES = 256
# Names of a wide group that are looked at in one task.
NAMES_PER_TASK = 4096


def _whole(upper: np.ndarray, d: int) -> np.ndarray:
    """The symmetric matrix of an upper half."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def wide_components(panel: DataFrame, draws: DataFrame, n_components: int = 3, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """As ``residual_components`` of ``weighted_moments``, for groups with more names than days.

    The days' products with each other hold the shares and, per day, the weights of a
    component; they are summed over stretches of names, so their size is that of the
    calendar. A name's loadings are its values times those weights, stretch by stretch.
    """
    group = panel.schema["group_id"]
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / NAMES_PER_TASK)), lambda k: F.slice("x", (k * NAMES_PER_TASK + 1).cast("int"), NAMES_PER_TASK))
    slices = panel.select("group_id", "effective_date", F.posexplode(cut).alias("block", "x"))
    times = draws.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("effective_date", "replicates"))).alias("days"))
    times = materialise(times.select("group_id", F.transform("days", lambda d: F.coalesce(d["replicates"], F.array().cast("array<int>"))).alias("drawn")), "component-draws")

    def products(table: pa.Table) -> pa.Table:
        x = _matrix(table.sort_by("effective_date")["x"])
        upper = (x @ x.T)[np.triu_indices(len(x))]
        return pa.table([table["group_id"].slice(0, 1), pa.array([upper.tobytes()], pa.binary())], names=["group_id", "products"])

    small_batches(panel.sparkSession)
    by_days = spread(slices, "group_id", "block").groupBy("group_id", "block").applyInArrow(products, StructType([group]).add("products", "binary"))
    by_days = materialise(by_days, "day-products")
    weights_schema = StructType([group]).add("replicate", "integer").add("component", "integer").add("share", "double").add("n_days", "long").add("weights", "binary")

    def solved(key, products, drawn):
        n = len(drawn)
        k = _whole(products, n)
        w = np.zeros((bootstraps + 1, n))
        w[bootstraps] = 1
        for day, picks in enumerate(drawn):
            np.add.at(w[:, day], np.asarray(picks, dtype=int), 1)
        for b, weight in enumerate(w):
            total = weight.sum()
            if total < 2:
                continue
            at = np.flatnonzero(weight)
            drawn_days, root = weight[at], np.sqrt(weight[at])
            part = k[np.ix_(at, at)]
            mean = part @ drawn_days / total
            part -= mean[:, None]
            part -= mean[None, :] - drawn_days @ mean / total
            whole = max(float(drawn_days @ np.diag(part)), 1e-300)
            part *= root[:, None]
            part *= root[None, :]
            values, vectors = np.linalg.eigh(part)
            order = np.argsort(values)[::-1][: min(n_components, int(total))]
            for c, e in enumerate(order):
                share = max(float(values[e]), 0.0)
                each = np.zeros(n)
                # A direction without variance has no names.
                if share > 1e-12 * whole:
                    each[at] = root * vectors[:, e] / np.sqrt(share)
                yield key, b if b < bootstraps else -1, c, share / whole, int(total), each.tobytes()

    def add(batches):
        key, total, drawn = None, None, None
        for batch in batches:
            rows = []
            for g, products, picks in zip(batch.column("group_id").to_pylist(), batch.column("products"), batch.column("drawn")):
                if g != key:
                    if key is not None:
                        rows += solved(key, total, drawn)
                    key, total, drawn = g, 0.0, picks.as_py()
                total = total + np.frombuffer(products.as_buffer())
            yield pa.RecordBatch.from_pylist([dict(zip(weights_schema.names, r)) for r in rows], to_arrow_schema(weights_schema))
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(weights_schema.names, r)) for r in solved(key, total, drawn)], to_arrow_schema(weights_schema))

    dealt = spread(by_days.join(times, "group_id"), "group_id").sortWithinPartitions("group_id")
    found = materialise(dealt.mapInArrow(add, weights_schema), "component-weights")
    blocks = by_days.groupBy("group_id").agg(F.count("*").cast("int").alias("_n"))
    asked = found.select("group_id", "replicate", "component", "weights").join(blocks, "group_id").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def loaded(table: pa.Table, asked: pa.Table) -> pa.Table:
        x = _matrix(table.sort_by("effective_date")["x"])
        c = np.stack([np.frombuffer(v.as_buffer()) for v in asked["weights"]])
        row, name = np.nonzero(np.abs(c @ x) >= LOADING_CUTOFF)
        name = name + NAMES_PER_TASK * table["block"][0].as_py()
        kept = asked.select(["group_id", "replicate", "component"]).take(pa.array(row))
        return kept.append_column("name", pa.array(name, pa.int32()))

    hits = spread(slices, "group_id", "block").groupBy("group_id", "block").cogroup(asked.groupBy("group_id", "block")).applyInArrow(
        loaded, StructType([group]).add("replicate", "integer").add("component", "integer").add("name", "integer"))
    keys = ["group_id", "replicate", "component"]
    members = hits.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("members"))
    return found.drop("weights").join(members, keys, "left").select(
        *keys, "share", "n_days", F.coalesce("members", F.array().cast("array<int>")).alias("members"))


def bootstrap_components(panel: DataFrame, names: DataFrame, draws: DataFrame, n_components: int = 3, bootstraps: int = BOOTSTRAPS) -> DataFrame:
    """Components of every group and resample: narrow groups by the products of their names, wide ones by those of their days."""
    wide = names.where(F.size("names") > MOST_NAMES).select("group_id")
    if wide.isEmpty():
        return residual_components(weighted_moments(panel, draws, bootstraps), n_components)
    wide = F.broadcast(wide)
    narrow = residual_components(weighted_moments(panel.join(wide, "group_id", "left_anti"), draws, bootstraps), n_components)
    found = wide_components(panel.join(wide, "group_id", "left_semi"), draws.join(wide, "group_id", "left_semi"), n_components, bootstraps)
    return narrow.unionByName(materialise(found, "wide-components"))


def hidden_concentration(
    rows: DataFrame, groups: DataFrame, value: str = "residual", n_components: int = 3, bootstraps: int = BOOTSTRAPS,
) -> DataFrame:
    """Clusters of a group's names that share a residual component, and in how many resamples they show again.

    ``rows`` are (ticker, effective_date, ``value``), as ``residuals`` gives them;
    ``groups`` (group_id, ticker) says who is looked at together.
    """
    panel, names = residual_panel(rows, groups, value)
    found = bootstrap_components(panel, names, bootstrap_draws(panel, bootstraps), n_components, bootstraps)
    found = found.where(F.size("members") >= MIN_CLUSTER)
    base = found.where("replicate = -1").select("group_id", "component", "n_days", "members")
    again = found.where("replicate >= 0").select("group_id", "replicate", F.col("members").alias("cluster"))
    overlap = F.size(F.array_intersect("members", "cluster")) / F.size(F.array_union("members", "cluster"))
    hits = base.join(again, "group_id").where(overlap >= JACCARD_MATCH).groupBy("group_id", "component").agg(
        (F.countDistinct("replicate") / bootstraps).alias("stability")
    )
    told = base.join(hits, ["group_id", "component"], "left").join(names, "group_id").select(
        "group_id", "component", F.transform("members", lambda k: F.col("names")[k]).alias("members"),
        F.coalesce("stability", F.lit(0.0)).alias("stability"), (F.col("n_days") < 5 * F.size("names")).alias("poorly_conditioned"),
    )
    return told.select(
        "group_id", "component", "members", F.size("members").alias("n_members"), "stability",
        (F.col("stability") >= STABILITY).alias("stable"), "poorly_conditioned",
        F.concat(
            F.lit("Hidden residual factor links "), F.size("members").cast("string"), F.lit(" tickers ("),
            F.concat_ws(", ", "members"), F.lit("). Stability "), F.format_string("%.2f", "stability"),
            F.lit(f" across {bootstraps} bootstraps."),
        ).alias("message"),
    )
