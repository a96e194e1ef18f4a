"""Regime models of many series at once: fit, choose k, decode, name, report.

A group is one series' daily rows (or one series and k), so groups are bounded by
the calendar and Spark spreads them over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import hmm
from plumbline.session import spread

# fixed values: states named from risk-off to risk-on
SPECTRUM = ("Stressed Bear", "Calm Bear", "Neutral / transition", "Volatile Bull", "Calm Bull")
TRANSITION_BELOW = 0.65
MIN_SELECTION_ROWS = 50
OCCUPANCY_ROWS = 63
DECODE_ROWS = 300
R2_FLOOR = 0.40
MIN_ADEQUACY_ROWS = 30

MODEL_SCHEMA = """
series_id string, k int, n_rows long, log_likelihood double, rounds int, start array<double>,
trans array<double>, means array<double>, covs array<double>, mu array<double>, sd array<double>
"""


def fit_models(obs: DataFrame, features, ks=(2, 3, 4), cap: float = 4.0, seed: int = 42) -> DataFrame:
    """One model row per (series, k); the winsorising moments travel with the model."""
    features = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("effective_date")
        k = int(pdf["k"].iloc[0])
        x, mu, sd = hmm.winsorise(pdf[features].to_numpy(float), cap)
        m = hmm.fit(x, k, seed)
        return pd.DataFrame(
            {
                "series_id": [pdf["series_id"].iloc[0]], "k": [k], "n_rows": [len(x)], "log_likelihood": [m["ll"]],
                "rounds": [m["rounds"]], "start": [m["start"]], "trans": [m["trans"].ravel()],
                "means": [m["means"].ravel()], "covs": [m["covs"].ravel()], "mu": [mu], "sd": [sd],
            }
        )

    fan_out = obs.select("series_id", "effective_date", *features).dropna().withColumn(
        "k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    )
    return spread(fan_out, "series_id", "k").groupBy("series_id", "k").applyInPandas(run, MODEL_SCHEMA)


def score_ks(obs: DataFrame, features, ks=(2, 3, 4), cap: float = 4.0, seed: int = 42) -> DataFrame:
    """(series_id, k, n_train, n_test, oos_ll): fit on the first 80 %, scored on the rest.

    A fit that fails scores minus infinity; short series score nothing.
    """
    features = list(features)
    schema = "series_id string, k int, n_train int, n_test int, oos_ll double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("effective_date")
        raw, k = pdf[features].to_numpy(float), int(pdf["k"].iloc[0])
        cut = int(len(raw) * 0.8)
        if len(raw) < MIN_SELECTION_ROWS:
            ll = None
        else:
            try:
                train, _, _ = hmm.winsorise(raw[:cut], cap)
                test, _, _ = hmm.winsorise(raw[cut:], cap)
                ll = hmm.score(test, hmm.fit(train, k, seed))
            except np.linalg.LinAlgError:
                ll = -np.inf
        return pd.DataFrame(
            {"series_id": [pdf["series_id"].iloc[0]], "k": [k], "n_train": [cut], "n_test": [len(raw) - cut], "oos_ll": [ll]}
        )

    fan_out = obs.select("series_id", "effective_date", *features).dropna().withColumn(
        "k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))
    )
    return spread(fan_out, "series_id", "k").groupBy("series_id", "k").applyInPandas(run, schema)


def select_k(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("oos_ll").isNotNull()).groupBy("series_id").agg(
        F.max_by("k", F.struct("oos_ll", -F.col("k"))).alias("selected_k"),
        F.max("oos_ll").alias("oos_ll"),
        F.first("n_train").alias("n_train"),
        F.first("n_test").alias("n_test"),
    )


def chosen_models(models: DataFrame, selected: DataFrame) -> DataFrame:
    return models.join(
        selected.select("series_id", F.col("selected_k").alias("k")), ["series_id", "k"], "left_semi"
    )


def _unpack(row, d: int) -> dict:
    k = int(row["k"])
    return {
        "start": np.asarray(row["start"]), "trans": np.asarray(row["trans"]).reshape(k, k),
        "means": np.asarray(row["means"]).reshape(k, d), "covs": np.asarray(row["covs"]).reshape(k, d, d),
    }


def decode(obs: DataFrame, models: DataFrame, features, cap: float = 4.0) -> DataFrame:
    """Most likely state of every row of every series under its model."""
    features = list(features)
    schema = "series_id string, effective_date date, state int"

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if model.empty or rows.empty:
            return pd.DataFrame({"series_id": [], "effective_date": [], "state": []}).astype({"state": int})
        rows, m = rows.sort_values("effective_date"), model.iloc[0]
        x, _, _ = hmm.winsorise(rows[features].to_numpy(float), cap, np.asarray(m["mu"]), np.asarray(m["sd"]))
        path = hmm.viterbi(x, _unpack(m, len(features)))
        return pd.DataFrame({"series_id": rows["series_id"], "effective_date": rows["effective_date"], "state": path})

    left = spread(obs.select("series_id", "effective_date", *features).dropna(), "series_id")
    return left.groupBy("series_id").cogroup(models.groupBy("series_id")).applyInPandas(run, schema)


def current_state(obs: DataFrame, models: DataFrame, features, cap: float = 4.0) -> DataFrame:
    """Posterior of the last row, its dominant state and the uncertainty around it."""
    features = list(features)
    schema = "series_id string, as_of date, probs array<double>"

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if model.empty or rows.empty:
            return pd.DataFrame({"series_id": [], "as_of": [], "probs": []}, dtype=object)
        rows, m = rows.sort_values("effective_date"), model.iloc[0]
        x, _, _ = hmm.winsorise(rows[features].to_numpy(float), cap, np.asarray(m["mu"]), np.asarray(m["sd"]))
        u = _unpack(m, len(features))
        alpha = hmm.forward(hmm.log_density(x, u["means"], u["covs"]), u["start"], u["trans"])[0]
        return pd.DataFrame(
            {"series_id": [rows["series_id"].iloc[0]], "as_of": [rows["effective_date"].iloc[-1]], "probs": [alpha[-1] / alpha[-1].sum()]}
        )

    left = obs.select("series_id", "effective_date", *features).dropna()
    df = left.groupBy("series_id").cogroup(models.groupBy("series_id")).applyInPandas(run, schema)
    top = F.array_max("probs")
    return df.select(
        "series_id", "as_of", "probs",
        (F.array_position("probs", top) - 1).cast("int").alias("dominant_state"),
        (1 - top).alias("state_uncertainty"), (top < TRANSITION_BELOW).alias("transition_signal"),
    )


def state_means(models: DataFrame, features) -> DataFrame:
    """(series_id, state, one column per feature) from the model table."""
    d = len(features)
    states = models.select("series_id", "k", "means", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("state"))
    return states.select(
        "series_id", "state", *[F.col("means")[F.col("state") * d + i].alias(f) for i, f in enumerate(features)]
    )


def label_states(means: DataFrame, trend: str = "ret_21d", vol: str = "realized_vol_21d") -> DataFrame:
    """Names each state of a series by the rank of z(trend) - z(volatility)."""
    whole = Window.partitionBy("series_id")

    def z(c):
        sd = F.stddev_pop(c).over(whole)
        return (F.col(c) - F.avg(c).over(whole)) / F.when(sd > 0, sd).otherwise(1.0)

    df = means.withColumn("score", z(trend) - z(vol)).withColumn("_k", F.count("*").over(whole))
    df = df.withColumn("_rank", F.row_number().over(whole.orderBy("score", "state")) - 1)
    last = len(SPECTRUM) - 1
    spot = F.when(F.col("_k") == 1, 0).otherwise(F.bround(F.col("_rank") / (F.col("_k") - 1) * last)).cast("int")
    return df.select(
        "series_id", "state", "score", F.array(*[F.lit(s) for s in SPECTRUM])[spot].alias("label")
    )


def recent_occupancy(path: DataFrame, rows: int = OCCUPANCY_ROWS) -> DataFrame:
    """Shares of the last rows per state, with current and dominant state per series."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("effective_date"))
    recent = path.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= rows)
    counts = recent.groupBy("series_id", "state").agg(
        F.count("*").alias("_n"), F.max("effective_date").alias("_last")
    )
    whole = Window.partitionBy("series_id")
    counts = counts.withColumn("share", F.col("_n") / F.sum("_n").over(whole))
    out = counts.groupBy("series_id").agg(
        F.max_by("state", "_last").alias("current_state"),
        F.max_by("state", F.struct("share", -F.col("state"))).alias("dominant_state"),
        F.max("share").alias("_top"),
        F.sort_array(F.collect_list(F.struct("share", "state")), asc=False).alias("occupancy"),
    )
    return out.select(
        "series_id", "current_state", "dominant_state", F.col("_top").alias("dominant_share"),
        (1 - F.col("_top")).alias("uncertainty"),
        ((F.col("current_state") != F.col("dominant_state")) | (F.col("_top") < 0.5)).alias("transition_signal"),
        "occupancy",
    )


def disclosure(validated: Column, sharpe: Column, floor: float = 0.5) -> Column:
    """What a reader is told of a model that is not validated; NULL for one that is."""
    end = "; shown for situational awareness, not as a validated signal."
    known = F.concat(
        F.lit("Research preview — regime model walk-forward Sharpe "), F.format_string("%.2f", sharpe), F.lit(f" < {floor:.2f} floor{end}"))
    unknown = F.lit(f"Research preview — regime model has not passed Layer 0 predictive sign-off{end}")
    return F.when(~validated, F.when(sharpe.isNotNull(), known).otherwise(unknown))


def market_state_report(
    path: DataFrame, labels: DataFrame, promoted: DataFrame | None = None, reports: DataFrame | None = None,
) -> DataFrame:
    """Per series: named occupancy, uncertainty, a sentence, and a disclosure if unpromoted.

    ``promoted`` holds the validated series, ``reports`` their gate's (series_id, walk_forward_sharpe).
    """
    newest = Window.partitionBy("series_id").orderBy(F.desc("effective_date"))
    recent = path.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= DECODE_ROWS).drop("_r")
    occ = recent_occupancy(recent)
    names = labels.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("state", "label"))).alias("_names"))
    df = occ.join(names, "series_id")
    dominant, current = F.col("_names")[F.col("dominant_state")], F.col("_names")[F.col("current_state")]
    share = F.concat(F.format_string("%.0f", F.col("dominant_share") * 100), F.lit("% of days)"))
    text = F.when(
        F.col("transition_signal"),
        F.concat(
            F.lit("Regime mix is unsettled — today reads as "), current, F.lit(", against a prevailing "), dominant,
            F.lit(" over the last quarter ("), share, F.lit(". Treat regime persistence as uncertain."),
        ),
    ).otherwise(
        F.concat(dominant, F.lit(" has prevailed over the last quarter ("), share, F.lit(", and today is consistent with it."))
    )
    if promoted is None:
        df = df.withColumn("validated", F.lit(False))
    else:
        df = df.join(promoted.select("series_id", F.lit(True).alias("validated")), "series_id", "left").withColumn(
            "validated", F.coalesce("validated", F.lit(False))
        )
    if reports is None:
        df = df.withColumn("_sharpe", F.lit(None).cast("double"))
    else:
        df = df.join(reports.select("series_id", F.col("walk_forward_sharpe").alias("_sharpe")), "series_id", "left")
    return df.select(
        "series_id", dominant.alias("dominant"), current.alias("current"),
        F.transform("occupancy", lambda o: F.struct(F.col("_names")[o["state"]].alias("name"), o["share"].alias("prob"))).alias("states"),
        F.format_string("%.2f", "uncertainty").alias("uncertainty"), text.alias("transition"), "validated",
        disclosure(F.col("validated"), F.col("_sharpe")).alias("disclosure"),
    )


def dimensionality_adequacy(obs: DataFrame, features) -> DataFrame:
    """Out-of-sample fit of the first principal direction by the features, per series.

    The target is itself linear in the features, so the fit is near one wherever the
    test rows vary; the check is kept as published.
    """
    features = list(features)
    schema = "series_id string, n_obs int, oos_r2 double, passed boolean, status string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("effective_date")[features].to_numpy(float)
        n, r2, status = len(x), 0.0, "INSUFFICIENT_DATA"
        if n >= MIN_ADEQUACY_ROWS:
            cut, status = int(n * 0.8), "OK"
            train, test = x[:cut], x[cut:]
            direction = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)[2][0]
            z = np.column_stack([np.ones(cut), train])
            beta = np.linalg.lstsq(z, train @ direction, rcond=None)[0]
            y = test @ direction
            total = float(np.sum((y - y.mean()) ** 2))
            miss = float(np.sum((y - np.column_stack([np.ones(len(test)), test]) @ beta) ** 2))
            r2 = 1 - miss / total if total > 0 else 0.0
        return pd.DataFrame(
            {"series_id": [pdf["series_id"].iloc[0]], "n_obs": [n], "oos_r2": [r2], "passed": [bool(r2 >= R2_FLOOR)], "status": [status]}
        )

    return obs.select("series_id", "effective_date", *features).dropna().groupBy("series_id").applyInPandas(run, schema)


# ---- model registry


def register(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Registry with the candidates added; a known model id is replaced."""
    kept = registry.join(candidates.select("model_id"), "model_id", "left_anti")
    fresh = candidates.withColumns(
        {
            "validation_status": F.lit("candidate"),
            "retired_at": F.lit(None).cast("timestamp"),
            "retired_reason": F.lit(None).cast("string"),
        }
    )
    return kept.unionByName(fresh, allowMissingColumns=True)


def promote(registry: DataFrame, promotions: DataFrame, status: str = "lite_survivorship") -> DataFrame:
    """Applies promotions (model_id, app_mode, promoted_at): the promoted model takes
    the new status, every other active model of its mode is retired as superseded.

    The latest promotion per mode decides.
    """
    winner = promotions.groupBy("app_mode").agg(
        F.max_by("model_id", "promoted_at").alias("_winner"), F.max("promoted_at").alias("_at")
    )
    df = registry.join(winner, "app_mode", "left")
    wins = F.col("model_id") == F.col("_winner")
    retires = F.col("_winner").isNotNull() & ~wins & F.col("retired_at").isNull()
    return df.withColumns(
        {
            "validation_status": F.when(wins, status).otherwise(F.col("validation_status")),
            "retired_reason": F.when(retires, "superseded").otherwise(F.col("retired_reason")),
            "retired_at": F.when(retires, F.col("_at")).otherwise(F.col("retired_at")),
        }
    ).drop("_winner", "_at")


def active_models(registry: DataFrame) -> DataFrame:
    """Newest un-retired model of each mode."""
    w = Window.partitionBy("app_mode").orderBy(F.desc("trained_at"), F.desc("model_id"))
    live = registry.where(F.col("retired_at").isNull())
    return live.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
