"""Predictions, change logs, notes, journals and watchlists as event folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.pit import new_rows

# fixed values
NOTE_KINDS = ("alert", "system", "user", "outcome")
DIRECTIONS = ("long", "short", "avoided")
VERDICTS = ("lean long", "neutral", "lean short")
STATE_FIELDS = ("verdict", "sizing_band", "disagreement")
NOTE_FEED = 100
CHANGE_FEED = 60
PAPER_FEED = 24
PAPER_TRADE_FEED = 365
DEFAULT_WATCHLIST = (
    ("NVDA", "Semiconductors"),
    ("MSFT", "Software"),
    ("AAPL", "Consumer Tech"),
    ("GOOGL", "Internet"),
    ("AMZN", "E-commerce"),
)


def prediction_id(ticker: Column, day: Column, horizon: Column) -> Column:
    return F.sha1(F.concat_ws("|", ticker, F.date_format(day, "yyyy-MM-dd"), horizon.cast("string")))


def emit_predictions(summary: DataFrame, horizon: int = 10, min_returns: int = 5) -> DataFrame:
    """One prediction row per (ticker, as_of) from analog summaries with Kelly columns."""
    rows = summary.where(F.col("n_returns") >= min_returns)
    return rows.select(
        prediction_id(F.col("ticker"), F.col("as_of"), F.lit(horizon)).alias("prediction_id"),
        "ticker",
        F.col("as_of").alias("knowledge_date"),
        F.lit(horizon).alias("horizon_days"),
        F.col("p50").alias("pred_p50"), F.col("p5").alias("pred_p5"), F.col("p95").alias("pred_p95"),
        F.col("hit_rate").alias("pred_hit_prob"),
        F.col("kelly_displayed").alias("pred_sizing"),
        "effective_n",
    )


def cases(assets: DataFrame) -> DataFrame:
    """Arguments for and against each asset and the verdict of their balance.

    Expects drivers (array), hit_rate, p5, p50, p95, regime, disagreement, n, kelly_displayed.
    """
    c = F.col
    up = F.filter("drivers", lambda d: d.contains("↑"))
    down = F.filter("drivers", lambda d: ~d.contains("↑"))
    hit = F.concat(F.lit("hit rate "), F.format_string("%.0f", c("hit_rate") * 100), F.lit("%"))
    regime = F.concat(F.lit("regime: "), c("regime"))
    right = (c("p50") > 0) & (c("p95") > F.abs("p5"))
    bull_regime = F.coalesce(c("regime").contains("Bull"), F.lit(False))
    bear_regime = F.coalesce(c("regime").contains("Bear"), F.lit(False))
    bull = F.concat(
        up,
        F.array_compact(
            F.array(
                F.when(c("hit_rate") > 0.5, hit),
                F.when(right, "right-skewed forward distribution"),
                F.when(bull_regime, regime),
                F.when(c("kelly_displayed") > 0, F.concat(F.lit("positive Kelly ("), F.format_string("%.2f", "kelly_displayed"), F.lit(")"))),
            )
        ),
    )
    bear = F.concat(
        down,
        F.array_compact(
            F.array(
                F.when(~(c("hit_rate") > 0.5), hit),
                F.when(~right & (F.abs("p5") > c("p95")), "large downside tail"),
                F.when(~bull_regime & bear_regime, regime),
                F.when(c("disagreement"), "regime-conditioning disagreement"),
                F.when(c("n") < 15, F.concat(F.lit("thin analog set (n="), c("n").cast("string"), F.lit(")"))),
            )
        ),
    )
    df = assets.withColumn("bull", bull).withColumn("bear", bear)
    net = F.size("bull") - F.size("bear")
    return df.withColumn(
        "verdict", F.when(net >= 2, "lean long").when(net <= -2, "lean short").otherwise("neutral")
    )


def decision_state(assets: DataFrame) -> DataFrame:
    band = F.format_string("%.2f", F.bround(F.col("kelly_displayed") / 0.05) * 0.05)
    return assets.select(
        "ticker", "verdict", band.alias("sizing_band"),
        F.when(F.col("disagreement"), "yes").otherwise("no").alias("disagreement"), "kelly_displayed",
    )


def state_hash(prefix: str = "") -> Column:
    """sha1 over the ticker and the state fields in key order."""
    pairs = []
    for f in sorted(STATE_FIELDS):
        value = F.col(f"{prefix}{f}")
        pairs.append(F.concat(F.lit(f'"{f}": '), F.when(value.isNull(), "null").otherwise(F.concat(F.lit('"'), value, F.lit('"')))))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return F.sha1(F.concat_ws("|", "ticker", body))


def change_log(state: DataFrame, log: DataFrame, cap: float = 0.20) -> DataFrame:
    """Rows for the fields whose value differs from the last one logged per ticker."""
    last = log.groupBy("ticker").pivot("field", list(STATE_FIELDS)).agg(F.max_by("new_value", "changed_at"))
    last = last.select("ticker", F.lit(True).alias("_had"), *[F.col(f).alias(f"prev_{f}") for f in STATE_FIELDS])
    df = state.join(last, "ticker", "left")
    df = df.withColumn("new_hash", state_hash()).withColumn(
        "prev_hash", F.when(F.col("_had"), state_hash("prev_"))
    )
    guard = F.col("verdict").isin(*VERDICTS) & (F.col("kelly_displayed") <= cap + 1e-9)
    fields = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"prev_{f}").alias("prev_value"), F.col(f).alias("new_value"))
            for f in STATE_FIELDS
        ]
    )
    return (
        df.select("ticker", "prev_hash", "new_hash", guard.alias("guard_passed"), F.inline(fields))
        .where(~F.col("prev_value").eqNullSafe(F.col("new_value")))
    )


def merge_notes(feed: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch notes to append: unknown kinds become system, standing notes are kept once."""
    clean = batch.withColumn(
        "kind", F.when(F.col("kind").isin(*NOTE_KINDS), F.col("kind")).otherwise("system")
    ).withColumn("body", F.trim("body"))
    standing = clean.where("standing").dropDuplicates(["ticker", "source", "body"])
    fresh = new_rows(standing, feed, ["ticker", "source", "body"])
    return fresh.unionByName(clean.where("NOT standing"))


def newest(df: DataFrame, order: str, n: int, tie_break=()) -> DataFrame:
    return df.orderBy(F.col(order).desc_nulls_last(), *tie_break).limit(n)


def newest_per_group(df: DataFrame, keys, order: str, n: int, tie_break=()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *tie_break)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unread(notes: DataFrame, markers: DataFrame) -> DataFrame:
    """Notes without a read marker, one row."""
    marked = notes.join(markers.select("note_id").distinct().withColumn("_read", F.lit(True)), "note_id", "left")
    return marked.groupBy().agg(F.count("*").alias("n_notes"), F.count_if(F.col("_read").isNull()).alias("unread"))


def journal_problem() -> Column:
    """First rule an entry breaks, NULL when it breaks none."""
    return (
        F.when(~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "direction")
        .when(~F.coalesce(F.col("confidence_self").between(1, 5), F.lit(False)), "confidence")
        .when(~F.coalesce(F.col("expected_horizon") > 0, F.lit(False)), "horizon")
        .when(F.trim(F.coalesce("thesis", F.lit(""))) == "", "thesis")
    )


def split_journal(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) entries; the latter carry the rule they break."""
    marked = entries.withColumn("problem", journal_problem())
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


def close_trades(entries: DataFrame, closes: DataFrame) -> DataFrame:
    """Entries with the exit, PnL, reason and grade of their latest close applied."""
    fields = ("exit_date", "pnl_pct", "exit_reason", "thesis_validated")
    last = closes.groupBy("entry_id").agg(F.max_by(F.struct(*fields), "closed_at").alias("_close"))
    return entries.join(last, "entry_id", "left").withColumns(
        {f: F.when(F.col("_close").isNotNull(), F.col(f"_close.{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("_close")


def open_trades(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("exit_date").isNull())


def completed_trades(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("pnl_pct").isNotNull())


def fold_watchlist(events: DataFrame, users: DataFrame) -> DataFrame:
    """Current list per user from add/status/remove events; users without events
    get the default names. Ordered by first add after the last removal."""
    removed = F.max(F.when(F.col("action") == "remove", F.col("ts")))
    last_removal = events.groupBy("user_id", "ticker").agg(removed.alias("_removed"))
    alive = events.join(last_removal, ["user_id", "ticker"]).where(
        (F.col("_removed").isNull() | (F.col("ts") > F.col("_removed"))) & (F.col("action") != "remove")
    )
    state = F.when(F.col("action") == "add", "pending").otherwise(F.col("status"))
    first_add = F.min(F.when(F.col("action") == "add", F.col("ts")))
    own = (
        alive.groupBy("user_id", "ticker")
        .agg(
            F.max_by(state, F.struct("ts", "event_id")).alias("status"), first_add.alias("added_at"),
            F.min_by("sector", F.struct("ts", "event_id")).alias("sector"),
        )
        # A status change of a name that is not on the list has no effect.
        .where(F.col("added_at").isNotNull())
    )
    defaults = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(s).alias("sector")) for t, s in DEFAULT_WATCHLIST])
    seeded = (
        users.select("user_id").distinct()
        .join(events.select("user_id").distinct(), "user_id", "left_anti")
        .select("user_id", F.inline(defaults))
        .withColumns({"status": F.lit("ready"), "added_at": F.lit(None).cast("timestamp")})
    )
    out = own.select("user_id", "ticker", "sector", "status", F.col("added_at").cast("timestamp").alias("added_at"))
    listed = out.unionByName(seeded.select(*out.columns))
    w = Window.partitionBy("user_id").orderBy(F.col("added_at").asc_nulls_first(), "ticker")
    return listed.withColumn("position", F.row_number().over(w))


def walk_status(status: Column, ok: Column) -> Column:
    """A pending name becomes ready when its bars arrived, error when they did not."""
    return F.when(status == "pending", F.when(ok, "ready").otherwise("error")).otherwise(status)
