"""The evidence gate: cross-validation, deflated Sharpe, survivorship, sign-off.

Folds are rows: every observation is repeated once per path it takes part in,
with its role there, so all series, signals and paths run in one plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.config import DEFAULTS, Settings
from plumbline.functions.stats import annualised_sharpe, expected_max_normal, normal_cdf

# fixed values
EMBARGO_FLOOR = 504
MIN_TRAIN_ROWS = 30
MIN_TEST_ROWS = 5
MIN_PAPER_DAYS = 90
DIVERGENCE_LIMIT = 0.30
DIVERGENCE_LIMIT_LITE = 0.40
LAYERS = (
    "layer0", "layer1", "layer2", "layer3", "layer4", "layer5", "layer6", "layer7",
    "layer8_journal", "layer9_calibration", "layer10_sizing",
)


def numbered(history: DataFrame, columns, series: str = "series_id") -> DataFrame:
    """Complete rows of each series with their 0-based position and the row count."""
    w = Window.partitionBy(series).orderBy("effective_date")
    return (
        history.select(series, "effective_date", *columns)
        .dropna()
        .withColumn("idx", F.row_number().over(w) - 1)
        .withColumn("n", F.count("*").over(Window.partitionBy(series)))
    )


def walk_forward_paths(rows: DataFrame, n_splits: int = 3, embargo: int = EMBARGO_FLOOR) -> DataFrame:
    """Rows with path_id and role: train up to the fold, test after the embargo."""
    fold = F.greatest(F.lit(1), F.floor(F.col("n") / (n_splits + 1)).cast("int"))
    df = rows.withColumn("_fold", fold).withColumn(
        "path_id", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))
    )
    start = F.col("path_id") * F.col("_fold")
    test = start + embargo
    role = F.when(F.col("idx") < start, "train").when(
        (F.col("idx") >= test) & (F.col("idx") < test + F.col("_fold")), "test"
    )
    return (
        df.where((test + F.col("_fold") <= F.col("n")) & (F.col("n") >= n_splits + 2))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("_fold")
    )


def combinatorial_paths(
    rows: DataFrame, n_groups: int = 6, n_test_groups: int = 2, embargo: int = EMBARGO_FLOOR,
    horizon: int = 10,
) -> DataFrame:
    """Every choice of test groups as one path; rows near a test group sit out."""
    if not 1 <= n_test_groups < n_groups:
        raise ValueError(f"cannot test on {n_test_groups} of {n_groups} groups")
    margin = max(embargo, horizon)
    paths = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("path_id"),
                F.array(*[F.lit(g) for g in chosen]).alias("groups"),
            )
            for i, chosen in enumerate(combinations(range(n_groups), n_test_groups))
        ]
    )
    size = F.floor(F.col("n") / n_groups).cast("int")
    df = rows.withColumn("_size", size).withColumn("_path", F.explode(paths))

    def bounds(g: Column):
        start = g * F.col("_size")
        return start, F.when(g == n_groups - 1, F.col("n")).otherwise(start + F.col("_size"))

    def inside(g: Column, pad: int) -> Column:
        start, stop = bounds(g)
        return (F.col("idx") >= start - pad) & (F.col("idx") < stop + pad)

    groups = F.col("_path.groups")
    in_test = F.exists(groups, lambda g: inside(g, 0))
    near_test = F.exists(groups, lambda g: inside(g, margin))
    role = F.when(in_test, "test").when(~near_test, "train")
    return (
        df.withColumn("role", role)
        .where(F.col("role").isNotNull())
        .withColumn("path_id", F.col("_path.path_id"))
        .drop("_path", "_size")
    )


# A signal maps the test rows of a path, with the path's train statistics, to PnL.
Signal = Callable[[object], Column]


def _lagged(position: Column, w) -> Column:
    return F.coalesce(F.lag(position, 1).over(w), F.lit(0.0))


def low_volatility(w) -> Column:
    position = (F.col("realized_vol_21d") < F.col("train_median_vol")).cast("double")
    return _lagged(position, w) * F.col("ret_1d")


def train_drift(w) -> Column:
    return F.when(F.col("train_mean_ret") > 0, 1.0).otherwise(-1.0) * F.col("ret_1d")


def momentum(w) -> Column:
    return _lagged(F.signum("ret_21d"), w) * F.col("ret_1d")


def rolling_drift(w) -> Column:
    frame = w.rowsBetween(-62, 0)
    drift = F.when(F.count("ret_1d").over(frame) >= 10, F.avg("ret_1d").over(frame))
    return F.coalesce(F.lag(F.signum(drift), 1).over(w), F.lit(0.0)) * F.col("ret_1d")


SIGNALS: dict[str, Signal] = {
    "low_volatility": low_volatility,
    "train_drift": train_drift,
    "momentum": momentum,
    "rolling_drift": rolling_drift,
}


def signal_pnl(paths: DataFrame, signals: dict[str, Signal] | None = None, series: str = "series_id") -> DataFrame:
    """(series, path_id, signal, idx, pnl) over the test rows of every path."""
    signals = signals or SIGNALS
    keys = [series, "path_id"]
    train = paths.where(F.col("role") == "train").groupBy(*keys).agg(
        F.count("*").alias("n_train"),
        F.percentile("realized_vol_21d", 0.5).alias("train_median_vol"),
        F.avg("ret_1d").alias("train_mean_ret"),
    )
    test = paths.where(F.col("role") == "test").join(train, keys)
    w = Window.partitionBy(*keys).orderBy("idx")
    wide = test.select(
        *keys, "idx", "effective_date", "n_train",
        *[fn(w).cast("double").alias(name) for name, fn in signals.items()],
    )
    return wide.unpivot([*keys, "idx", "effective_date", "n_train"], list(signals), "signal", "pnl")


def custom_signal_pnl(paths: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], list], series: str = "series_id") -> DataFrame:
    """Same output for a Python callable ``fn(train, test) -> pnl`` run per path."""
    schema = f"{series} string, path_id int, signal string, idx int, pnl double, n_train long"
    name = getattr(fn, "__name__", "custom")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        return pd.DataFrame(
            {
                series: test[series].to_numpy(),
                "path_id": test["path_id"].to_numpy(),
                "signal": name,
                "idx": test["idx"].to_numpy(),
                "pnl": list(fn(train, test)),
                "n_train": len(train),
            }
        )

    return paths.groupBy(series, "path_id").applyInPandas(run, schema)


def path_sharpes(pnl: DataFrame, series: str = "series_id", min_train: int = 0, min_test: int = 0) -> DataFrame:
    out = pnl.groupBy(series, "signal", "path_id").agg(
        F.count("*").alias("n_test"),
        F.first("n_train").alias("n_train"),
        annualised_sharpe("pnl").alias("sharpe"),
    )
    return out.where((F.col("n_test") >= min_test) & (F.col("n_train") >= min_train))


def summarise_paths(rows: DataFrame, sharpes: DataFrame, method: str, signals=None, series: str = "series_id", n_splits: int = 3) -> DataFrame:
    """Per series and signal: path count, p30 and p50 Sharpe, status."""
    names = F.array(*[F.lit(s) for s in (signals or SIGNALS)])
    every = (
        rows.groupBy(series).agg(F.count("*").alias("n_rows")).withColumn("signal", F.explode(names))
    )
    stats = sharpes.groupBy(series, "signal").agg(
        F.count("*").alias("n_paths"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.percentile("sharpe", 0.3).alias("p30"),
        F.percentile("sharpe", 0.5).alias("p50"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return every.join(stats, [series, "signal"], "left").select(
        series, "signal", "n_rows",
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"),
        zero("mean_sharpe"), zero("p30"), zero("p50"),
        F.when(F.col("n_rows") < n_splits + 2, "INSUFFICIENT_DATA")
        .when(F.col("n_paths").isNull(), "NO_VALID_PATHS")
        .otherwise("OK").alias("status"),
        F.lit(method).alias("cv_method"),
    )


def walk_forward(rows: DataFrame, n_splits: int = 3, embargo: int = EMBARGO_FLOOR, series: str = "series_id") -> DataFrame:
    if embargo < EMBARGO_FLOOR:
        raise ValueError(f"embargo={embargo} below floor {EMBARGO_FLOOR}")
    pnl = signal_pnl(walk_forward_paths(rows, n_splits, embargo), series=series)
    return summarise_paths(rows, path_sharpes(pnl, series), "walk_forward", series=series, n_splits=n_splits)


def cpcv(rows: DataFrame, n_groups: int = 6, n_test_groups: int = 2, embargo: int = EMBARGO_FLOOR, horizon: int = 10, series: str = "series_id") -> DataFrame:
    """Combinatorial CV per series; series too short for it take the walk-forward."""
    if embargo < EMBARGO_FLOOR:
        raise ValueError(f"embargo={embargo} below floor {EMBARGO_FLOOR}")
    enough = F.col("n") >= n_groups * (embargo + 50)
    long, short = rows.where(enough), rows.where(~enough)
    pnl = signal_pnl(combinatorial_paths(long, n_groups, n_test_groups, embargo, horizon), series=series)
    sharpes = path_sharpes(pnl, series, MIN_TRAIN_ROWS, MIN_TEST_ROWS)
    full = summarise_paths(long, sharpes, "cpcv", series=series)
    fallback = walk_forward(short, embargo=embargo, series=series)
    return full.unionByName(fallback.withColumn("cv_method", F.lit("walk_forward_fallback")))


def whole_sample(rows: DataFrame) -> DataFrame:
    """One path per series whose statistics come from the first half and whose test is every row."""
    half = F.floor(F.col("n") / 2)
    roles = F.array_compact(F.array(F.when(F.col("idx") < half, "train"), F.lit("test")))
    return rows.withColumn("role", F.explode(roles)).withColumn("path_id", F.lit(0))


def pnl_moments(pnl: DataFrame, series: str = "series_id") -> DataFrame:
    """Population skewness, excess kurtosis and size of each PnL series."""
    return pnl.where(F.col("pnl").isNotNull()).groupBy(series, "signal").agg(
        F.count("*").alias("n_obs"), F.skewness("pnl").alias("skew"), F.kurtosis("pnl").alias("kurt")
    )


def deflated_sharpe(
    df: DataFrame, trial_count: int, settings: Settings = DEFAULTS, per_period: bool = False,
) -> DataFrame:
    """Adds z and the probability that the Sharpe beats the best of the trials.

    ``trial_count`` is the row count of the execution log, never a free choice of
    the caller of a report. The default form keeps the published reading of
    annualised Sharpe with excess kurtosis; ``per_period`` uses the per-row Sharpe
    and full kurtosis.
    """
    trials = max(trial_count, settings.trial_floor)
    best = expected_max_normal(trials)
    sr, kurt = F.col("sharpe"), F.col("kurt")
    if per_period:
        sr, kurt = sr / math.sqrt(252.0), kurt + 3
        best = best / math.sqrt(252.0)
    var = (1 - F.col("skew") * sr + (kurt - 1) / 4 * sr * sr) / (F.col("n_obs") - 1)
    z = F.when(F.col("n_obs") > 1, (sr - F.lit(best)) / F.sqrt(F.greatest(var, F.lit(1e-12)))).otherwise(0.0)
    df = df.withColumn("n_trials", F.lit(trials)).withColumn("z_statistic", z)
    return df.withColumn(
        "deflated_sharpe", F.when(F.col("n_obs") > 1, normal_cdf(F.col("z_statistic"))).otherwise(0.0)
    )


def survivorship(live: DataFrame, delisted: DataFrame, start, end, floor: float = DEFAULTS.survivorship_floor) -> DataFrame:
    """Coverage of the tickers delisted inside the window by the live universe, one row."""
    if floor < 0.80:
        raise ValueError("coverage floor must be >= 0.80")
    when = F.col("termination_date")
    expected = delisted.where((when >= F.lit(start).cast("date")) & (when <= F.lit(end).cast("date")))
    expected = expected.select("ticker").distinct()
    known = live.select("ticker").distinct().withColumn("_found", F.lit(True))
    marked = expected.join(known, "ticker", "left")
    counts = marked.groupBy().agg(
        F.count("*").alias("expected_n"),
        F.count("_found").alias("found_n"),
    )
    coverage = F.when(F.col("expected_n") == 0, 1.0).otherwise(F.col("found_n") / F.col("expected_n"))
    df = counts.withColumn("coverage", coverage).withColumn("passed", F.col("coverage") >= floor)
    missing = (F.col("expected_n") - F.col("found_n")).cast("long")
    return df.withColumn(
        "note",
        F.when(F.col("expected_n") == 0, "PASS (no delisted tickers in window)")
        .when(F.col("passed"), F.format_string(f"PASS coverage=%.3f >= floor={floor:.2f}", "coverage"))
        .otherwise(
            F.concat(
                F.format_string(f"FAIL coverage=%.3f < floor={floor:.2f}; missing ", "coverage"),
                missing.cast("string"), F.lit(" delisted ticker(s)"),
            )
        ),
    )


def missing_tickers(live: DataFrame, delisted: DataFrame, start, end) -> DataFrame:
    when = F.col("termination_date")
    expected = delisted.where((when >= F.lit(start).cast("date")) & (when <= F.lit(end).cast("date")))
    return expected.select("ticker").distinct().join(live.select("ticker").distinct(), "ticker", "left_anti")


def sign_off(reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds rationale, production_ready and status from the five criteria.

    A ``lite_status`` column, where not NULL, overrides the status.
    """
    def line(name: str, op: str, word: str, limit: float) -> Column:
        return F.format_string(f"{name}=%.3f {op} {word} {limit:.2f}", name)

    reasons = F.array_compact(
        F.array(
            F.when(F.col("survivorship_audit") == "FAILED", "survivorship audit FAILED").when(
                F.col("survivorship_audit") != "PASSED", "survivorship audit not run"
            ),
            F.when(F.col("walk_forward_sharpe") < settings.wf_sharpe_floor,
                   line("walk_forward_sharpe", "<", "floor", settings.wf_sharpe_floor)),
            F.when(F.col("walk_forward_ece") > settings.wf_ece_ceiling,
                   line("walk_forward_ece", ">", "ceiling", settings.wf_ece_ceiling)),
            F.when(F.col("cpcv_p30_sharpe") < settings.cpcv_p30_floor,
                   line("cpcv_p30_sharpe", "<", "floor", settings.cpcv_p30_floor)),
            F.when(F.col("deflated_sharpe") < settings.dsr_floor,
                   line("deflated_sharpe", "<", "floor", settings.dsr_floor)),
        )
    )
    df = reports.withColumn("_reasons", reasons)
    ready = F.size("_reasons") == 0
    own = (
        F.when((F.col("survivorship_audit") == "FAILED") | (F.col("walk_forward_sharpe") <= 0), "blocked")
        .when(ready, "production")
        .otherwise("research_preview")
    )
    status = F.coalesce(F.col("lite_status"), own) if "lite_status" in reports.columns else own
    return (
        df.withColumn("production_ready", ready)
        .withColumn("rationale", F.when(ready, "all sign-off criteria met").otherwise(F.concat_ws("; ", "_reasons")))
        .withColumn("status", status)
        .drop("_reasons")
    )


def report_rows(signed: DataFrame) -> DataFrame:
    """Storage form: keyed by layer and date, the whole report as a JSON payload."""
    payload = F.to_json(F.struct(*[c for c in signed.columns]))
    return signed.select(
        F.concat_ws("::", "layer_name", F.date_format("as_of", "yyyy-MM-dd")).alias("report_id"),
        "layer_name", "as_of", "status", "production_ready", payload.alias("payload"),
    )


def parse_reports(stored: DataFrame, payload_schema: str) -> DataFrame:
    """Reports read back; the status comes as stored text."""
    return stored.withColumn("report", F.from_json("payload", payload_schema))


def latest_reports(reports: DataFrame) -> DataFrame:
    w = Window.partitionBy("layer_name").orderBy(F.desc("as_of"))
    return reports.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def layer_status(layers: DataFrame, reports: DataFrame) -> DataFrame:
    """Every known layer with its latest report, or the note that it has none."""
    return layers.join(latest_reports(reports), "layer_name", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("no_report")),
            "rationale": F.coalesce("rationale", F.lit("No validation report persisted yet.")),
        }
    )


def gate(rows: DataFrame, reports: DataFrame, preview: bool = False) -> DataFrame:
    """Rows of layers whose latest report is production ready; with ``preview``
    those under research preview pass too, carrying a disclosure."""
    latest = latest_reports(reports).select("layer_name", "status", "production_ready", "rationale")
    joined = rows.join(latest, "layer_name", "left")
    disclosure = F.when(
        ~F.coalesce(F.col("production_ready"), F.lit(False)),
        F.concat(F.lit("Research preview: "), F.coalesce("rationale", F.lit("no report"))),
    )
    shown = F.col("production_ready")
    if preview:
        shown = shown | (F.col("status") == "research_preview")
    return joined.where(F.coalesce(shown, F.lit(False))).withColumn("disclosure", disclosure)


def lock_layers(rows: DataFrame, value_columns, locked, mode: str) -> DataFrame:
    """In lite mode, rows of locked layers keep their key and lose their values."""
    closed = F.col("layer_name").isin(list(locked)) & F.lit(mode == "lite")
    return rows.withColumns(
        {c: F.when(~closed, F.col(c)) for c in value_columns}
    ).withColumn("status", F.when(closed, "LOCKED").otherwise("OK"))


def integrity(audit: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: missing and stale fractions of the fetch audit and whether they pass."""
    by_date = audit.groupBy("fetch_date").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "MISSING").alias("n_missing"),
        F.count_if(F.col("n_rows") == 0).alias("n_stale"),
    )
    total = by_date.groupBy().agg(
        (F.sum("n_missing") / F.sum("n")).alias("missing_fraction"),
        F.max(F.col("n_stale") / F.col("n")).alias("stale_fraction"),
    )
    df = total.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("missing_fraction", "stale_fraction")}
    )
    lim_m, lim_s = settings.max_missing_bar_fraction, settings.max_stale_cross_ticker_fraction
    reasons = F.array_compact(
        F.array(
            F.when(F.col("missing_fraction") > lim_m,
                   F.format_string(f"missing-bar fraction %.3f > {lim_m:.3f}", "missing_fraction")),
            F.when(F.col("stale_fraction") > lim_s,
                   F.format_string(f"cross-ticker stale fraction %.3f > {lim_s:.3f}", "stale_fraction")),
        )
    )
    return df.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn(
        "integrity_ok", F.size(reasons) == 0
    )


def divergence(
    paper: DataFrame, reference: DataFrame, audit: DataFrame | None = None, lite: bool = False,
) -> DataFrame:
    """Live Sharpe per layer against its reference; a failed data gate pauses the check."""
    live = paper.groupBy(F.col("layer_attributed_to").alias("layer_name")).agg(
        F.count("*").alias("n_days"), annualised_sharpe("pnl_pct").alias("live_sharpe")
    )
    ref = F.col("pre_deployment_sharpe")
    df = reference.join(live, "layer_name", "left").withColumn(
        "n_days", F.coalesce("n_days", F.lit(0))
    )
    if lite and audit is not None:
        df = df.join(F.broadcast(integrity(audit)), F.lit(True))
    else:
        df = df.withColumn("integrity_ok", F.lit(True))
    enough = F.col("n_days") >= MIN_PAPER_DAYS
    gap = F.when(ref == 0, 0.0).otherwise(F.abs(F.col("live_sharpe") - ref) / F.abs(ref))
    limit = DIVERGENCE_LIMIT_LITE if lite else DIVERGENCE_LIMIT
    ok = F.col("integrity_ok") & enough
    return df.select(
        "layer_name", "n_days", "pre_deployment_sharpe",
        F.when(~F.col("integrity_ok"), "VALIDATION_PAUSED_DATA_INTEGRITY")
        .when(~enough, "INSUFFICIENT_PAPER_DATA")
        .otherwise("OK").alias("status"),
        F.when(ok, F.col("live_sharpe")).alias("live_sharpe"),
        F.when(ok, gap).alias("divergence"),
        F.coalesce(ok & (gap > limit), F.lit(False)).alias("demote_to_research"),
    )
