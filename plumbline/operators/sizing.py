"""Position sizing diagnostics from analog return distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
KELLY_CAP = 0.20
MIN_ANALOGS = 30
FRAGILE_BELOW = 100
TAIL_QUANTILE = 0.05
NOTE = (
    "These are diagnostic computations, not recommendations. Kelly uses "
    "|ES₅| as the loss term to be tail-aware, is capped at 20%, and "
    "is haircut by regime uncertainty and HMM/Analog disagreement."
)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tail_aware_kelly(
    returns: DataFrame, keys, value: str = "fwd", base_haircut: float = 0.5, more: dict[str, Column] | None = None,
) -> DataFrame:
    """Kelly variants per key, with ``more`` aggregates. ``returns`` also carries state_uncertainty and overlap_pct.

    The loss term is the size of the 5 % quantile; where that is no loss, the mean
    loss. Without wins, or without any loss, the fraction is zero.
    """
    x = F.col(value)
    stats = returns.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(x > 0, x)).alias("_win"),
        F.avg(F.when(x < 0, x)).alias("_loss"),
        F.percentile(value, TAIL_QUANTILE).alias("es_5"),
        F.first("state_uncertainty").alias("_unc"),
        F.first("overlap_pct").alias("_overlap"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    no_win, no_tail = F.col("_win").isNull(), F.col("es_5") >= 0
    no_loss = no_tail & F.col("_loss").isNull()
    avg_loss = F.when(no_win | no_loss, 0.0).when(no_tail, F.abs("_loss")).otherwise(F.abs("es_5"))
    df = stats.withColumns(
        {"avg_win": F.coalesce("_win", F.lit(0.0)), "avg_loss": avg_loss}
    )
    odds = F.col("avg_win") / F.col("avg_loss")
    raw = F.when(
        F.col("avg_loss") > 0, F.greatest(F.lit(0.0), F.col("win_rate") - (1 - F.col("win_rate")) / odds)
    ).otherwise(0.0)
    flat = no_win | no_loss
    haircut = F.when(flat, 0.0).otherwise(
        base_haircut
        * (1 - _clamp(F.col("_unc"), 0.0, 1.0))
        * F.least(F.lit(1.0), _clamp(F.col("_overlap"), 0.0, 1.0) * 1.5)
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("n") < FRAGILE_BELOW,
                F.concat(
                    F.lit("Sample fragile: "), F.col("n").cast("string"),
                    F.lit(f" analogs < threshold {FRAGILE_BELOW}; treat magnitudes with extra scepticism."),
                ),
            ),
            F.when(no_win, "No winning analogs in sample."),
            F.when(
                ~no_win & no_loss,
                "Analog distribution has no negative tail — Kelly undefined; displayed as 0.0.",
            ),
            F.when(
                ~no_win & no_tail & ~no_loss,
                F.concat(
                    F.lit("Analog ES₅ is non-negative ("), F.format_string("%.4f", "es_5"),
                    F.lit("); falling back to mean of negative returns for Kelly loss term."),
                ),
            ),
        )
    )
    df = df.withColumns({"_raw": raw, "effective_haircut": haircut, "warnings": warnings})
    ok = F.col("n") >= MIN_ANALOGS
    shown = {
        "win_rate": F.col("win_rate"), "avg_win": F.col("avg_win"), "avg_loss": F.col("avg_loss"),
        "es_5": F.when(no_win, 0.0).otherwise(F.col("es_5")),
        "raw_kelly": _clamp(F.col("_raw"), 0.0, KELLY_CAP),
        "haircut_kelly_standard": _clamp(F.col("_raw") * base_haircut, 0.0, KELLY_CAP),
        "haircut_kelly_regime": _clamp(F.col("_raw") * F.col("effective_haircut"), 0.0, KELLY_CAP),
        "displayed_kelly": _clamp(F.col("_raw") * F.col("effective_haircut"), 0.0, KELLY_CAP),
        "effective_haircut": F.col("effective_haircut"),
    }
    return df.select(
        *keys, "n",
        F.when(ok, "OK").otherwise("INSUFFICIENT_ANALOGS").alias("status"),
        *[F.when(ok, c).alias(name) for name, c in shown.items()],
        F.when(ok, F.col("warnings")).alias("warnings"),
        F.lit(NOTE).alias("note"),
        *(more or {}),
    )


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its inputs, equal in any SQL engine with md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def inject_wipeouts(
    returns: DataFrame, id_columns, value: str = "fwd", annual_rate: float = 0.02, period_days: int = 10,
    wipeout: float = -0.60,
) -> DataFrame:
    """Returns plus one wipeout row for each analog its hash selects, flagged ``injected``."""
    p = annual_rate * period_days / 252.0
    hit = uniform_hash(*[F.col(c) for c in id_columns]) < p
    copies = F.when(hit & F.col(value).isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    kind = returns.schema[value].dataType
    return returns.withColumn("injected", F.explode(copies)).withColumn(
        value, F.when(F.col("injected"), F.lit(wipeout).cast(kind)).otherwise(F.col(value))
    )


def lite_kelly(returns: DataFrame, keys, id_columns, value: str = "fwd", **wipeouts) -> DataFrame:
    augmented = inject_wipeouts(returns, id_columns, value, **wipeouts)
    # Keys without a null, in one pass: an injected row always has a return.
    return tail_aware_kelly(augmented.dropna(subset=list(keys)), keys, value, more={"n_injected": F.count_if("injected")})
