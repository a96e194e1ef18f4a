"""How well stated confidence and predictions match what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import wilson

# fixed values: probability each confidence level stands for
IMPLIED_PROBABILITY = {1: 0.30, 2: 0.45, 3: 0.55, 4: 0.70, 5: 0.85}
MIN_ENTRIES = 15
MIN_GRADED = 5
DRIFT_LIMIT = 3
DRIFT_WINDOW_DAYS = 30
MIN_RESOLVED = 20


def implied(confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in IMPLIED_PROBABILITY.items() for x in kv])
    return table[confidence]


def reliability(journal: DataFrame) -> DataFrame:
    """Per confidence level: n, predicted, observed win rate and its interval."""
    rows = journal.where(F.col("pnl_pct").isNotNull() & F.col("confidence_self").isNotNull())
    return _bands(rows, (F.col("pnl_pct") > 0).cast("double"), (0.0, 1.0))


def graded_reliability(journal: DataFrame) -> DataFrame:
    """The live variant: closed entries whose thesis was graded, known bands only."""
    rows = journal.where(
        F.col("exit_date").isNotNull() & F.col("thesis_validated").isNotNull()
        & F.col("confidence_self").isin(list(IMPLIED_PROBABILITY))
    )
    return _bands(rows, F.col("thesis_validated").cast("double"), (0.0, 0.0))


def _bands(rows: DataFrame, win: Column, empty) -> DataFrame:
    df = rows.select("confidence_self", win.alias("_win")).groupBy("confidence_self").agg(
        F.count("*").alias("n"), F.sum("_win").alias("wins")
    )
    low, high = wilson(F.col("wins"), F.col("n"), empty)
    p = implied(F.col("confidence_self"))
    return df.select(
        "confidence_self", "n", p.alias("avg_predicted"), (F.col("wins") / F.col("n")).alias("avg_observed"),
        low.alias("ci_low"), high.alias("ci_high"),
        # Squared error of a band from its counts alone.
        (F.col("wins") * (1 - p) * (1 - p) + (F.col("n") - F.col("wins")) * p * p).alias("_sq"),
    )


def score(bands: DataFrame, min_rows: int = MIN_ENTRIES) -> DataFrame:
    """Brier score, calibration error and band over the reliability rows, one row."""
    total = bands.groupBy().agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"),
        (F.sum("_sq") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("avg_predicted") - F.col("avg_observed"))) / F.sum("n")).alias("ece"),
    )
    enough = F.col("n_entries") >= min_rows
    band = (
        F.when(F.col("ece") < 0.05, "well_calibrated")
        .when(F.col("ece") < 0.10, "moderately_calibrated")
        .otherwise("poorly_calibrated")
    )
    return total.select(
        F.when(enough, "OK").otherwise("INSUFFICIENT_DATA").alias("status"),
        "n_entries",
        F.when(enough, F.col("brier")).alias("brier"),
        F.when(enough, F.col("ece")).alias("ece"),
        F.when(enough, band).alias("calibration_band"),
    )


def score_cards(scores: DataFrame) -> DataFrame:
    """The score as (label, value, note) text rows."""
    ece_note = F.when(F.col("ece") > 0.05, "Above the 0.05 ceiling — overconfident.").otherwise(
        "Within the 0.05 ceiling."
    )
    n_note = (
        F.when(F.col("n_entries") < 15, "Below the 15-entry minimum — treat with caution.")
        .when(F.col("n_entries") < 30, "Above the 15-entry minimum, below comfort.")
        .otherwise("Sufficient sample.")
    )

    def card(label, value, note):
        return F.struct(F.lit(label).alias("label"), value.alias("value"), note.alias("note"))

    return scores.where("status = 'OK'").select(
        F.inline(
            F.array(
                card("Brier score", F.format_string("%.3f", "brier"), F.lit("Lower is better. 0.25 = coin flip.")),
                card("Expected calibration error", F.format_string("%.3f", "ece"), ece_note),
                card("Graded entries", F.col("n_entries").cast("string"), n_note),
            )
        )
    )


def regime_performance(journal: DataFrame) -> DataFrame:
    """Per state: n, hit rate, mean PnL; rows without a state are only counted."""
    rows = journal.where(F.col("pnl_pct").isNotNull() & F.col("confidence_self").isNotNull())
    return rows.groupBy("market_state_id").agg(
        F.count("*").alias("n"),
        F.avg((F.col("pnl_pct") > 0).cast("double")).alias("hit_rate"),
        F.avg("pnl_pct").alias("mean_pnl_pct"),
    ).select(
        "market_state_id", "n",
        F.when(F.col("market_state_id").isNotNull(), F.col("hit_rate")).alias("hit_rate"),
        F.when(F.col("market_state_id").isNotNull(), F.col("mean_pnl_pct")).alias("mean_pnl_pct"),
        F.col("market_state_id").isNull().alias("excluded"),
    )


def thesis_drift(journal: DataFrame, today=None, keys=()) -> DataFrame:
    """Losses on an invalidated thesis, all time or over the trailing window to ``today``."""
    lost = ~F.col("thesis_validated") & (F.col("pnl_pct") < 0)
    if today is not None:
        lost = lost & (F.col("exit_date") >= F.date_sub(F.lit(today).cast("date"), DRIFT_WINDOW_DAYS))
    return journal.groupBy(*keys).agg(F.count_if(lost).alias("n_invalidated_losses")).withColumn(
        "warning", F.col("n_invalidated_losses") > DRIFT_LIMIT
    )


def binned_calibration_error(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Calibration error over equal half-open bins; a certainty of 1 falls in none."""
    spot = F.floor(F.col(p) * bins)
    by_bin = rows.groupBy(spot.alias("bin"), (F.col(p) < 1).alias("_in")).agg(
        F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y")
    )
    gap = F.when(F.col("_in"), F.col("n") * F.abs(F.col("p") - F.col("y"))).otherwise(0.0)
    return by_bin.groupBy().agg(
        F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"),
        F.count_if("_in").alias("n_bins"),
    )


def track_record(resolved: DataFrame) -> DataFrame:
    """Report over resolved predictions in one pass: overall, per probability bin, per ticker."""
    done = resolved.where(F.col("resolved") & F.col("realized_ret").isNotNull())
    spot = F.least(F.floor(F.col("pred_hit_prob") * 5), F.lit(4))
    df = done.select(
        "ticker", spot.alias("bin"), "pred_p50", "pred_hit_prob", "realized_ret", "alpha"
    )
    share = lambda c: F.avg(c.cast("double"))
    grouped = df.groupingSets(
        [[], [F.col("bin")], [F.col("ticker")]], F.col("bin"), F.col("ticker")
    ).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("n"),
        F.avg("pred_hit_prob").alias("predicted"),
        share(F.col("realized_ret") > 0).alias("hit_rate"),
        share(F.signum("pred_p50") == F.signum("realized_ret")).alias("directional_accuracy"),
        F.avg("pred_p50").alias("mean_pred_p50"),
        F.avg("realized_ret").alias("mean_realized"),
        F.avg("alpha").alias("alpha_mean"),
        share(F.col("alpha") > 0).alias("alpha_hit_rate"),
    )
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "bin").otherwise("ticker")
    return grouped.select(
        scope.alias("scope"),
        F.when(F.col("_g") == 3, "all")
        .when(F.col("_g") == 1, F.format_string("%.1f", F.col("bin") * 0.2 + 0.1))
        .otherwise(F.col("ticker")).alias("item"),
        "n", "predicted", "hit_rate", "directional_accuracy", "mean_pred_p50", "mean_realized",
        "alpha_mean", "alpha_hit_rate",
        (F.max(F.when(F.col("_g") == 3, F.col("n"))).over(_everything()) >= MIN_RESOLVED).alias("enough"),
    )


def _everything():
    from pyspark.sql.window import Window

    # Only the report's own rows pass here: bins and tickers, not predictions.
    return Window.partitionBy(F.lit("report"))


def pending_count(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy().agg(
        F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("pending")
    )


def factor_redundancy(drivers: DataFrame, limit: float = 0.5) -> DataFrame:
    """Share of the most common primary driver over all assets, one row."""
    counts = drivers.where(F.col("primary_driver").isNotNull()).groupBy("primary_driver").agg(
        F.count("*").alias("n")
    )
    total = counts.groupBy().agg(
        F.max_by("primary_driver", F.struct("n", "primary_driver")).alias("dominant_driver"),
        F.max("n").alias("_top"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_assets"),
    )
    share = F.when(F.col("n_assets") > 0, F.col("_top") / F.col("n_assets")).otherwise(0.0)
    return total.select(
        "dominant_driver", share.alias("dominance_share"), "n_assets",
        (share >= limit).alias("redundancy_warning"),
    )
