"""Point-in-time reads: as-of lookup, lagged history, vintages, resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.dates import business_days, trading_days_before
from plumbline.functions.stats import null_safe_join
from plumbline.session import materialise, spread, tasks

# fixed values: trading days before a feature is available; others take 1
LAGS = {
    "earnings_revision_z": 3,
    "earnings_surprise_z": 3,
    "revenue_growth_yoy": 5,
    "pe_ratio_z": 1,
    "analyst_upgrade_z": 1,
    "vix_percentile_63d": 0,
    "hy_spread_roc_21d": 0,
    "ret_1d": 0,
    "ret_5d": 0,
    "ret_21d": 0,
    "ret_63d": 0,
    "realized_vol_21d": 0,
    "rsi_14": 0,
    "iv_rv_ratio": 0,
    "pct_above_ma50": 0,
    "yield_curve_slope": 0,
    "sector_relative_str": 0,
    "ret_fwd_10d": 0,
}
DEFAULT_LAG = 1


def lag_of(feature: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LAGS.items() for x in kv])
    return F.coalesce(table[feature], F.lit(DEFAULT_LAG))


# Bytes of a ticker's long rows in a sort to those in the files behind them.
WIDER_THAN_FILES = 8


def dealt_facts(rows: DataFrame) -> DataFrame:
    """Rows of facts, partitioned by ticker as :func:`as_of_lookup` wants them.

    To be called on wide rows: the long ones made of them are many more, and they stay where they are.
    """
    return spread(rows, "ticker", wider=WIDER_THAN_FILES)


def as_of_lookup(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``feature_value``: the newest one known strictly before ``as_of``.

    Requests are first reduced to distinct (ticker, feature, as_of), at most one
    per calendar day and key, so a key asked for by a third of all requests costs
    no more than any other. Features and requests then share one sorted pass per
    key, in tasks that hold whole tickers: facts that come so dealt (``dealt_facts``)
    are not shuffled. The closing join is an equi-join whose skew AQE splits.

    A feature row counts from the day after it is known and never before its own
    effective date; among those that count, the latest known wins, then the
    latest effective.
    """
    keys = ["ticker", "feature_name"]
    asked = requests.select(*keys, "as_of").distinct()
    seen = F.struct("knowledge_date", "effective_date", F.col("feature_value").alias("value"))
    facts = dealt_facts(features).select(
        *keys,
        F.greatest(F.col("knowledge_date"), F.date_sub("effective_date", 1)).alias("at"),
        F.lit(1).alias("kind"),
        seen.alias("fact"),
    )
    empty = F.lit(None).cast(
        "struct<knowledge_date:date,effective_date:date,value:double>"
    )
    probes = asked.select(*keys, F.col("as_of").alias("at"), F.lit(0).alias("kind"), empty.alias("fact"))
    probes = probes.repartition(tasks(features, WIDER_THAN_FILES), "ticker")
    w = (
        Window.partitionBy(*keys)
        .orderBy("at", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        facts.unionByName(probes)
        .withColumn("fact", F.max("fact").over(w))
        .where("kind = 0")
        .select(
            *keys, F.col("at").alias("as_of"), F.col("fact.value").alias("feature_value"),
            F.col("fact.effective_date").alias("effective_date"),
            F.col("fact.knowledge_date").alias("knowledge_date"),
        )
    )
    return requests.join(found, [*keys, "as_of"], "left")


# Distinct requests of a key that are answered in one task.
REQUESTS_PER_TASK = 65_536


def as_of_lookup_capped(requests: DataFrame, features: DataFrame, most: int = REQUESTS_PER_TASK) -> DataFrame:
    """As above with ``effective_cap`` bounding the effective date of the answer.

    Distinct requests of a key are dealt to as many tasks as they need, each next to the
    key's facts, whose number is that of the calendar's days. In order of knowledge date,
    a request wants the last fact before its own place that is effective by its cap;
    it is found by halving over least effective dates of stretches of 1, 2, 4, ...
    facts, so a request costs a logarithm of its key's facts.
    """
    by, keys = ["ticker", "feature_name"], ["ticker", "feature_name", "as_of", "effective_cap"]
    asked = requests.select(*keys).distinct()
    parts = asked.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("as_of", "effective_cap"), F.col("_parts")).cast("int")
    parts = materialise(parts, "capped-keys")  # its true size decides whether the facts have to be shuffled to meet it
    dealt = materialise(null_safe_join(asked, parts, by).withColumn("_part", part).drop("_parts"), "capped-requests")
    facts = null_safe_join(features.select(*by, "knowledge_date", "effective_date", "feature_value"), parts, by)
    facts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    out = "ticker string, feature_name string, as_of date, effective_cap date, feature_value double"
    by = [*by, "_part"]
    found = dealt.groupBy(*by).cogroup(facts.groupBy(*by)).applyInPandas(
        lambda a, f: _last_before_within(a.drop(columns="_part"), f), out
    )
    return requests.join(found, keys, "left")


def _last_before_within(asked: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    def days(column):
        return pd.to_datetime(column).to_numpy().astype("datetime64[D]")

    asked = asked[asked["as_of"].notna() & asked["effective_cap"].notna()]
    facts = facts[facts["knowledge_date"].notna() & facts["effective_date"].notna()]
    known, effective = days(facts["knowledge_date"]), days(facts["effective_date"])
    order = np.lexsort((effective, known))
    known, effective, value = known[order], effective[order], facts["feature_value"].to_numpy()[order]
    cap = days(asked["effective_cap"])
    end = np.searchsorted(known, days(asked["as_of"]))  # facts known before
    least = [effective]  # least[k][i]: over the 2^k facts from i on
    while len(least[-1]) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    # Step back over stretches in which every fact is effective too late.
    for k in range(len(least) - 1, -1, -1):
        start = end - (1 << k)
        inside = start >= 0
        late = np.zeros(len(end), dtype=bool)
        late[inside] = least[k][start[inside]] > cap[inside]
        end = np.where(late, start, end)
    hit = end > 0
    return asked[hit].assign(feature_value=value[end[hit] - 1])


def feature_history(features: DataFrame, names, start, end, as_of) -> DataFrame:
    """Wide history safe at ``as_of``: each feature stops at its own lag's cutoff.

    Several revisions of a value collapse to the latest one known by the cutoff.
    """
    as_of = F.lit(as_of).cast("date")
    rows = features.where(
        F.col("feature_name").isin(list(names))
        & F.col("effective_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("knowledge_date") <= trading_days_before(as_of, lag_of(F.col("feature_name"))))
    )
    return (
        rows.groupBy("ticker", "effective_date")
        .pivot("feature_name", list(names))
        .agg(F.max_by("feature_value", "knowledge_date"))
    )


def vintage_values(vintages: DataFrame, start, end, series_id: str | None = None) -> DataFrame:
    """Value of each series as published on each business day, NULL where none was."""
    span = F.explode(business_days(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if series_id is not None:
        vintages = vintages.where(F.col("series_id") == series_id)
    spine = vintages.select("series_id").distinct().withColumn("obs_date", span)
    printed = vintages.where(F.col("obs_date").between(F.col("realtime_start"), F.col("realtime_end")))
    return spine.join(printed.select("series_id", "obs_date", "value"), ["series_id", "obs_date"], "left")


def lagged_factors(factors: DataFrame, assets: DataFrame, names, ticker: str = "ticker") -> DataFrame:
    """Asset returns next to the factor returns of the previous factor row.

    ``factors`` is wide with one row per date; rows with any gap are dropped.
    """
    calendar = factors.withColumn("_all", F.lit("factors"))
    w = Window.partitionBy("_all").orderBy("effective_date")
    lagged = calendar.select(
        "effective_date",
        F.lag("effective_date", 1).over(w).alias("factor_date"),
        *[F.lag(n, 1).over(w).alias(n) for n in names],
    )
    # One row per date: broadcast, so that the asset rows stay where they are.
    return assets.select(ticker, "effective_date", "asset_ret").join(F.broadcast(lagged), "effective_date").dropna()


def assert_lagged(aligned: DataFrame) -> DataFrame:
    """One row: how many aligned rows carry a factor of the same or a later date."""
    return aligned.groupBy().agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("factor_date") >= F.col("effective_date")).alias("n_violations"),
    )


def resolve_predictions(predictions: DataFrame, labels: DataFrame, benchmark: str) -> DataFrame:
    """Predictions with their realised and benchmark-relative returns.

    A prediction resolves once at least ``horizon_days`` later dates exist for its
    ticker and the label of its own date is known.
    """
    w = Window.partitionBy("ticker").orderBy("effective_date")
    ranked = labels.select("ticker", "effective_date", "ret_fwd_10d").withColumn(
        "_later", F.count("*").over(Window.partitionBy("ticker")) - F.row_number().over(w)
    )
    bench = labels.where(F.col("ticker") == benchmark).select(
        F.col("effective_date").alias("knowledge_date"), F.col("ret_fwd_10d").alias("benchmark_ret")
    )
    joined = predictions.join(
        ranked.withColumnRenamed("effective_date", "knowledge_date"), ["ticker", "knowledge_date"], "left"
    ).join(bench, "knowledge_date", "left")
    done = (F.col("_later") >= F.col("horizon_days")) & F.col("ret_fwd_10d").isNotNull()
    done = F.coalesce(done, F.lit(False))
    return joined.withColumn("resolved", done).select(
        *predictions.columns,
        "resolved",
        F.when(done, F.col("ret_fwd_10d")).alias("realized_ret"),
        F.when(done, F.col("benchmark_ret")).alias("benchmark_ret"),
        F.when(done, F.col("ret_fwd_10d") - F.col("benchmark_ret")).alias("alpha"),
    )


def new_rows(batch: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """Rows of the batch that no existing row matches, NULL matching NULL."""
    condition = None
    e = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys]).distinct()
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        condition = term if condition is None else condition & term
    return batch.join(e, condition, "left_anti")
