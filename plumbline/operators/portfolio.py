"""Two-regime covariance, scenario stress, position impact and correlation clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.matrix import (
    covariance_cells,
    dense,
    moment_matrices,
    portfolio_vols,
    robust_cells,
    sample_covariance,
)
from plumbline.session import materialise

# fixed values: closed date ranges of stressed markets
CRISIS_WINDOWS = (
    ("2008-09-15", "2009-03-31"),
    ("2011-08-01", "2011-10-31"),
    ("2020-02-19", "2020-04-30"),
    ("2022-06-13", "2022-10-31"),
)
# fixed values: shocks in standard deviations per factor
SCENARIOS = {
    "2008_credit_crunch": {
        "market_beta": -3.0, "credit_sensitivity": -3.5, "volatility_factor": -2.5,
    },
    "2020_covid_crash": {
        "market_beta": -4.0, "volatility_factor": -4.5, "credit_sensitivity": -2.0,
    },
    "2022_rate_shock": {
        "rates_sensitivity": -2.5, "growth_factor": -2.0, "market_beta": -1.5,
    },
    "stagflation_2x_macro": {
        "rates_sensitivity": -2.0, "commodities": 2.5, "growth_factor": -2.0, "market_beta": -1.5,
    },
}
DEFAULT_FACTOR_VOL = 0.01
MIN_ROWS_PER_NAME = 5
CLUSTER_CORRELATION = 0.75
MIN_CLUSTER_ROWS = 30
SIGNIFICANT_T = 1.96
CLUSTER_WARNING = "These positions behave as a single trade."


def crisis(day: Column, windows=CRISIS_WINDOWS) -> Column:
    hit = F.lit(False)
    for start, end in windows:
        hit = hit | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return hit


def regime_rows(panel: DataFrame, windows=CRISIS_WINDOWS) -> DataFrame:
    return panel.withColumn("regime", F.when(crisis(F.col("effective_date"), windows), "crisis").otherwise("normal"))


def two_regime_covariance(panel: DataFrame, d: int, windows=CRISIS_WINDOWS, robust: bool = True) -> DataFrame:
    """(regime, i, j, n, cov, method) for normal and stressed rows.

    Stressed rows give a robust matrix from 5 rows per name on, a sample matrix from
    2 on, and twice the normal matrix below that. Without normal rows there is no result.
    """
    rows = materialise(regime_rows(panel, windows), "panel")
    sample = sample_covariance(rows, d, "regime").select("regime", "i", "j", "n", "cov").withColumn(
        "method", F.lit("sample")
    )
    normal = sample.where("regime = 'normal'")
    stressed = sample.where("regime = 'crisis'")
    if robust:
        cells = materialise(robust_cells(rows, d, "regime", MIN_ROWS_PER_NAME), "robust")
        normal = cells.where("regime = 'normal'")
        enough = cells.where((F.col("regime") == "crisis") & (F.col("n") >= MIN_ROWS_PER_NAME * d))
        stressed = stressed.where(F.col("n") < MIN_ROWS_PER_NAME * d).unionByName(enough)
    doubled = normal.select(
        F.lit("crisis").alias("regime"), "i", "j", F.lit(0).cast("long").alias("n"),
        (F.col("cov") * 2).alias("cov"), F.lit("normal_x2").alias("method"),
    )
    fallback = doubled.join(stressed.select("i", "j"), ["i", "j"], "left_anti")
    return normal.unionByName(stressed).unionByName(fallback.select(*normal.columns))


def weight_vectors(weights: DataFrame, names: list[str], key: str = "portfolio_id") -> DataFrame:
    """(key, w): weights in universe order, zero where a name is not held."""
    held = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("_m"))
    return held.select(key, F.array(*[F.coalesce(F.col("_m")[n], F.lit(0.0)) for n in names]).alias("w"))


def scenario_table(spark) -> DataFrame:
    rows = [(s, f, float(x)) for s, shocks in SCENARIOS.items() for f, x in shocks.items()]
    return spark.createDataFrame(rows, "scenario string, factor string, shock double")


def portfolio_betas(weights: DataFrame, betas: DataFrame, key: str = "portfolio_id") -> DataFrame:
    return weights.join(betas, "ticker").groupBy(key, "factor").agg(
        F.sum(F.col("weight") * F.col("beta")).alias("beta")
    )


def stress_test(
    weights: DataFrame, betas: DataFrame, cells: DataFrame, names: list[str], factor_vols: DataFrame | None = None,
    key: str = "portfolio_id",
) -> DataFrame:
    """Factor impact and stressed volatility of every portfolio under every scenario."""
    spark = weights.sparkSession
    scenarios = scenario_table(spark)
    exposed = portfolio_betas(weights, betas, key).join(scenarios, "factor")
    if factor_vols is not None:
        exposed = exposed.join(factor_vols.select("factor", "vol"), "factor", "left")
    else:
        exposed = exposed.withColumn("vol", F.lit(None).cast("double"))
    impact = exposed.groupBy(key, "scenario").agg(
        F.sum(F.col("beta") * F.col("shock") * F.coalesce("vol", F.lit(DEFAULT_FACTOR_VOL))).alias("factor_impact")
    )
    matrix = dense(cells.where("regime = 'crisis'"), len(names))
    vols = portfolio_vols(weight_vectors(weights, names, key), {"w": "stressed_vol"}, matrix).select(key, "stressed_vol")
    every = F.array(*[F.lit(s) for s in SCENARIOS])
    return (
        vols.withColumn("scenario", F.explode(every))
        .join(impact, [key, "scenario"], "left")
        .withColumn("factor_impact", F.coalesce("factor_impact", F.lit(0.0)))
    )


def effective_n(w: Column) -> Column:
    s = F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(s > 0, 1 / s).otherwise(0.0)


def position_impact(
    weights: DataFrame, candidates: DataFrame, cells: DataFrame, names: list[str], exposures: DataFrame | None = None,
    key: str = "portfolio_id",
) -> DataFrame:
    """Volatility and effective number of positions before and after each candidate.

    ``candidates`` are (key, ticker, target_weight); the other weights are rescaled to
    fill the rest. A name outside the universe yields a row with an error.
    """
    d = len(names)
    universe = F.array(*[F.lit(n) for n in names])
    zero = F.array(*[F.lit(0.0)] * d)
    df = (
        candidates.join(weight_vectors(weights, names, key), key, "left")
        .withColumn("w", F.coalesce("w", zero))
        .withColumn("_at", F.array_position(universe, F.col("ticker")) - 1)
    )
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    rest = total - F.get("w", F.col("_at"))
    empty = total < 1e-12
    scale = F.when(rest > 0, (1 - F.col("target_weight")) / rest).otherwise(1.0)
    after = F.transform(
        "w",
        lambda x, i: F.when(i == F.col("_at"), F.col("target_weight"))
        .when(empty, 0.0)
        .otherwise(x * scale),
    )
    known = F.col("_at") >= 0
    df = df.withColumn("_after", F.when(known, after))
    df = portfolio_vols(df, {"w": "_vol_before", "_after": "_vol_after"}, dense(cells.where("regime = 'normal'"), d))
    before_vol = F.when(empty, 0.0).otherwise(F.col("_vol_before"))
    out = df.select(
        key, "ticker", "target_weight",
        F.when(known, before_vol).otherwise(0.0).alias("vol_before"),
        F.when(known, F.col("_vol_after")).otherwise(0.0).alias("vol_after"),
        F.when(known, effective_n(F.col("w"))).otherwise(0.0).alias("eff_n_before"),
        F.when(known, effective_n(F.col("_after"))).otherwise(0.0).alias("eff_n_after"),
        F.when(~known, F.concat("ticker", F.lit(" not in universe"))).alias("error"),
    )
    out = out.withColumns(
        {
            "vol_change": F.col("vol_after") - F.col("vol_before"),
            "effective_n_change": F.col("eff_n_after") - F.col("eff_n_before"),
        }
    )
    if exposures is not None:
        added = exposures.where(F.abs("t_stat") >= SIGNIFICANT_T).groupBy("ticker").agg(
            F.map_from_entries(F.collect_list(F.struct("factor", "beta"))).alias("_b")
        )
        out = out.join(added, "ticker", "left").withColumn(
            "factor_additions", F.transform_values("_b", lambda k, b: b * F.col("target_weight"))
        ).drop("_b")
    return out


def correlation_edges(panel: DataFrame, names: list[str], threshold: float = CLUSTER_CORRELATION) -> DataFrame:
    """(a, b) pairs of the universe whose absolute correlation reaches the threshold."""
    d = len(names)
    cells = covariance_cells(moment_matrices(panel.withColumn("_k", F.lit("all")), d, "_k"), "_k")
    label = F.array(*[F.lit(n) for n in names])
    return cells.where((F.col("i") != F.col("j")) & (F.abs("corr") >= threshold) & (F.col("n") >= MIN_CLUSTER_ROWS)).select(
        label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), "corr"
    )


def held_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges between names that are both held: a name not held links nothing."""
    held = weights.select("ticker").distinct()
    return edges.join(held.select(F.col("ticker").alias("a")), "a", "left_semi").join(
        held.select(F.col("ticker").alias("b")), "b", "left_semi"
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) by spreading the smallest label along symmetric edges.

    Each round also jumps to the label of the label, so the rounds needed grow with
    the logarithm of the longest path; they end when no label moves. Rounds are
    written to the shared folder.
    """
    edges = materialise(edges.select("a", "b").distinct(), "edges")
    labels = materialise(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = (
            edges.join(labels, edges.b == labels.node)
            .groupBy("a").agg(F.min("component").alias("_near"))
        )
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
        )
        jump = step.select(F.col("node").alias("_n"), F.col("component").alias("_jump"))
        moved = step.join(jump, step.component == jump._n, "left").select(
            "node", "_old", F.least("component", "_jump").alias("component")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where(F.col("_old") != F.col("component")).isEmpty():
            return labels


def clusters(components: DataFrame, weights: DataFrame, min_size: int = 2) -> DataFrame:
    """Members, size and summed weight per component."""
    w = weights.select(F.col("ticker").alias("node"), "weight")
    return (
        components.join(w, "node")
        .groupBy("component")
        .agg(
            F.count("*").alias("n_members"),
            F.sum("weight").alias("combined_weight"),
            F.array_sort(F.collect_list("node")).alias("members"),
        )
        .where(F.col("n_members") >= min_size)
        .withColumn("warning", F.lit(CLUSTER_WARNING))
    )

