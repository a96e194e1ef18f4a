"""From fitted models to the registry: candidates, the gate's reports, promotion, and what readers may call validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Settings
from plumbline.operators.regime import active_models, promote, register
from plumbline.schemas import REGISTRY
from plumbline.sources.versioned import VersionedTable

# fixed values
LAYER = "hmm_candidate"
PROMOTED = ("lite_survivorship", "production")


def candidates(models: DataFrame, n_dimensions: int, trained_at) -> DataFrame:
    """A registry row for every fitted model of regimes (series_id, k, log_likelihood); a series is a mode of its own."""
    return models.select(
        F.concat("series_id", F.lit("-k"), F.col("k").cast("string")).alias("model_id"), F.col("series_id").alias("app_mode"),
        F.lit(trained_at).cast("timestamp").alias("trained_at"), F.lit(n_dimensions).alias("n_dimensions"),
        F.col("k").alias("k_selected"), F.col("log_likelihood").alias("oos_log_likelihood"),
    )


def gate_reports(models: DataFrame, graded: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """The gate's report on every candidate: its cross-validated figures, what was bypassed, and whether it passes.

    ``graded`` is (series_id, sharpe, p30, deflated_sharpe, n_trials), one row per mode. A
    mode that was not graded has a Sharpe of zero, and does not pass.
    """
    g = graded.select(
        F.col("series_id").alias("app_mode"), F.col("sharpe").alias("walk_forward_sharpe"), F.col("p30").alias("cpcv_p30_sharpe"),
        "deflated_sharpe", "n_trials")
    sharpe, deflated = F.coalesce("walk_forward_sharpe", F.lit(0.0)), F.coalesce("deflated_sharpe", F.lit(0.0))
    df = models.select("model_id", "app_mode").join(g, "app_mode", "left")
    return df.select(
        F.concat(F.lit(f"{LAYER}::"), "app_mode").alias("layer_name"), F.lit(as_of).cast("date").alias("as_of"), "model_id", "app_mode",
        sharpe.alias("walk_forward_sharpe"), "cpcv_p30_sharpe", deflated.alias("deflated_sharpe"), "n_trials",
        F.lit("BYPASSED_LITE_MODE").alias("survivorship_audit"), F.lit(PROMOTED[0]).alias("validation_status"),
        ((sharpe >= settings.wf_sharpe_floor) & (deflated >= 0)).alias("passed"),
    )


class ModelRegistry:
    """The registry as a table with versions; changes next to each other are applied one after the other."""

    def __init__(self, spark: SparkSession, path: str):
        self._table = VersionedTable(spark, path, REGISTRY, ("app_mode", "model_id"))

    def rows(self, version: int | None = None) -> DataFrame:
        return self._table.read(version=version)

    def register(self, models: DataFrame) -> None:
        self._table.update("registry", lambda known: register(known, models))

    def promote(self, reports: DataFrame, promoted_at) -> None:
        """Models whose report passes become their mode's active one, with the figures of the report; the others of the mode retire."""
        passed = reports.where("passed").select(
            "model_id", "app_mode", F.lit(promoted_at).cast("timestamp").alias("promoted_at"),
            F.col("walk_forward_sharpe").alias("_sharpe"), F.col("deflated_sharpe").alias("_deflated"))

        def change(known):
            df = promote(known, passed).join(passed.select("model_id", "_sharpe", "_deflated"), "model_id", "left")
            return df.withColumns({
                "walk_forward_sharpe": F.coalesce("_sharpe", "walk_forward_sharpe"),
                "deflated_sharpe": F.coalesce("_deflated", "deflated_sharpe"),
            })

        self._table.update("registry", change)

    def validated(self) -> DataFrame:
        """series_id of the modes whose active model is a promoted one."""
        live = active_models(self.rows())
        return live.where(F.col("validation_status").isin(*PROMOTED)).select(F.col("app_mode").alias("series_id"))
