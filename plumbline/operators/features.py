"""Engineered features over daily bars.

Every function takes and returns a DataFrame keyed by (ticker, effective_date).
All windows partition by ticker, so one exchange serves the whole chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

OHLCV_FEATURES = (
    "ret_1d", "ret_5d", "ret_21d", "ret_63d", "realized_vol_21d", "rsi_14",
    "pct_above_ma50", "ret_fwd_10d",
)
DISTANCE_FEATURES = (
    "ret_1d", "ret_5d", "ret_21d", "ret_63d", "realized_vol_21d", "pct_above_ma50", "rsi_14",
)

# fixed values: half-life in rows of each feature's exponential moments
HALF_LIVES = {
    "ret_1d": 5,
    "realized_vol_21d": 42,
    "hy_spread_roc_21d": 42,
    "vix_percentile_63d": 63,
    "yield_curve_slope": 126,
    "earnings_revision_z": 126,
    "pct_above_ma50": 42,
    "iv_rv_ratio": 21,
    "hy_oas": 63,
    "ig_oas": 63,
    "sector_relative_ret_252d": 126,
    "vix_9d": 5,
    "vix_1m": 21,
    "vix_3m": 42,
    "vix_term_slope": 21,
    "skew_index": 21,
    "put_call_ratio": 10,
    "ma_spread_50_200d": 42,
    "atr_pct_21d": 42,
    "pct_above_ma20": 21,
    "volume_norm_21d": 21,
    "treasury_10yr_roc_21d": 42,
    "rolling_sector_correlation_63d": 63,
}
DEFAULT_HALF_LIFE = 63


def series(*keys: str, order: str = "effective_date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(order)


def trailing(rows: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(1 - rows, 0)


def full_window(value: Column, rows: int, agg, w: WindowSpec | None = None) -> Column:
    """``agg(value)`` over the last ``rows`` rows, NULL until that many are present."""
    frame = trailing(rows, w)
    return F.when(F.count(value).over(frame) == rows, agg(value).over(frame))


def add_returns(df: DataFrame, horizons=(1, 5, 21, 63)) -> DataFrame:
    w = series()
    return df.withColumns(
        {f"ret_{h}d": F.col("close") / F.lag("close", h).over(w) - 1 for h in horizons}
    )


def add_realized_vol(df: DataFrame, rows: int = 21) -> DataFrame:
    w = series()
    log_ret = F.log(F.col("close") / F.lag("close", 1).over(w))
    df = df.withColumn("_lr", log_ret)
    vol = full_window(F.col("_lr"), rows, F.stddev_samp) * math.sqrt(252.0)
    return df.withColumn(f"realized_vol_{rows}d", vol).drop("_lr")


def add_ma_flag(df: DataFrame, rows: int = 50) -> DataFrame:
    ma = full_window(F.col("close"), rows, F.avg)
    flag = F.when(ma.isNotNull(), (F.col("close") > ma).cast("double"))
    return df.withColumn(f"pct_above_ma{rows}", flag)


# rows that a forward label looks ahead
FORWARD_ROWS = 10


def add_forward_label(df: DataFrame, horizon: int = FORWARD_ROWS) -> DataFrame:
    fwd = F.lead("close", horizon).over(series()) / F.col("close") - 1
    return df.withColumn(f"ret_fwd_{horizon}d", fwd)


def ewm_mean(
    df: DataFrame, columns: dict[str, str], decay, keys=("ticker",), order: str = "effective_date",
    segment: int | Column = 4096, seed_weight: bool = True,
) -> DataFrame:
    """Recursive exponential means ``m = decay*m + (1-decay)*x`` as plain windows.

    ``columns`` maps each input column to the name of its mean. The recursion is a
    weighted prefix sum once each row is scaled by ``decay**-k``. Rows are cut into
    segments short enough for the scale to stay finite; across a segment border
    only the value at its end is carried. ``seed_weight`` starts the recursion at
    the first value instead of at zero.
    """
    decay = decay if isinstance(decay, Column) else F.lit(float(decay))
    segment = segment if isinstance(segment, Column) else F.lit(int(segment))
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_n", F.row_number().over(w) - 1)
    df = df.withColumn("_seg", F.floor(F.col("_n") / segment)).withColumn(
        "_k", (F.col("_n") - F.col("_seg") * segment).cast("double")
    )
    weight = F.when((F.col("_n") == 0) & F.lit(seed_weight), 1.0).otherwise(1 - decay)
    # The segment number rises with the order, so this sort also serves ``w``.
    inside = Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    scale = F.pow(decay, F.col("_k"))
    df = df.withColumns(
        {f"_local_{v}": F.sum(weight * F.col(v) / scale).over(inside) * scale for v in columns}
    )
    last_in_segment = F.col("_k") == segment - 1
    means = {}
    for v, out in columns.items():
        carry = F.last(F.when(last_in_segment, F.col(f"_local_{v}")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        )
        means[out] = F.col(f"_local_{v}") + scale * decay * F.coalesce(carry, F.lit(0.0))
    return df.withColumns(means).drop("_seg", "_k", "_n", *[f"_local_{v}" for v in columns])


def add_wilder_rsi(df: DataFrame, period: int = 14) -> DataFrame:
    w = series()
    change = F.coalesce(F.col("close") - F.lag("close", 1).over(w), F.lit(0.0))
    df = df.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_dn": F.greatest(-change, F.lit(0.0))})
    df = ewm_mean(df, {"_up": "_gain", "_dn": "_loss"}, 1 - 1 / period)
    rs = F.col("_gain") / F.greatest(F.col("_loss"), F.lit(1e-12))
    return df.withColumn(f"rsi_{period}", 100 - 100 / (1 + rs)).drop("_up", "_dn", "_gain", "_loss")


def ohlcv_features(bars: DataFrame) -> DataFrame:
    """All bar features, wide.

    The recursion sorts its rows by segment and back, so it comes first, while rows are narrow.
    """
    df = add_wilder_rsi(bars)
    df = add_returns(df)
    df = add_realized_vol(df)
    df = add_ma_flag(df)
    df = add_forward_label(df)
    return df.select(*[c for c in df.columns if c != "rsi_14"], "rsi_14")


def to_long(wide: DataFrame, features=OHLCV_FEATURES, keys=("ticker", "effective_date")) -> DataFrame:
    """(keys, feature_name, feature_value) with undefined values dropped.

    Rows that are partitioned by a key stay so, which an unpivot would not promise.
    """
    each = F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("feature_value")) for f in features])
    long = wide.select(*keys, F.inline(each))
    return long.where(F.col("feature_value").isNotNull() & ~F.isnan("feature_value"))


def known_features(wide: DataFrame, features=OHLCV_FEATURES, label: str = "ret_fwd_10d", horizon: int = FORWARD_ROWS) -> DataFrame:
    """Long rows with the date each value becomes known: its own date, for the label
    the date of the row ``horizon`` rows later."""
    closes = F.lead("effective_date", horizon).over(series())
    keys = ("ticker", "effective_date", "_known")
    long = to_long(wide.withColumn("_known", closes), features, keys)
    known = F.when(F.col("feature_name") == label, F.col("_known")).otherwise(F.col("effective_date"))
    return long.select("ticker", "effective_date", known.alias("knowledge_date"), "feature_name", "feature_value")


def ewma_normalise(long: DataFrame, clip: float = 4.0) -> DataFrame:
    """Exponentially weighted z-score per (ticker, feature), clipped to +-clip.

    The variance is the recursion ``v = d*(v + a*(x - previous mean)**2)`` with
    the finite-sample correction of its weights; both passes share one exchange.
    """
    half_life = F.coalesce(
        F.create_map(*[F.lit(x) for kv in HALF_LIVES.items() for x in kv])[F.col("feature_name")],
        F.lit(DEFAULT_HALF_LIFE),
    )
    keys = ("ticker", "feature_name")
    w = series(*keys)
    df = long.withColumn("_hl", half_life)
    df = df.withColumn("_d", F.pow(F.lit(0.5), 1.0 / F.col("_hl"))).withColumn(
        "_len", F.col("_hl") * 600
    )
    d, seg = F.col("_d"), F.col("_len")
    df = ewm_mean(df, {"feature_value": "ewm_mean"}, d, keys, segment=seg)
    surprise = F.col("feature_value") - F.lag("ewm_mean", 1).over(w)
    df = df.withColumn("_s2", F.coalesce(d * surprise * surprise, F.lit(0.0)))
    df = ewm_mean(df, {"_s2": "_v"}, d, keys, segment=seg, seed_weight=False)
    df = df.withColumn("_t", (F.row_number().over(w) - 1).cast("double"))
    tail = F.pow(d, 2 * F.col("_t"))
    sum_w2 = F.pow(1 - d, 2) * (1 - tail) / (1 - d * d) + tail
    var = F.when(F.col("_t") > 0, F.col("_v") / (1 - sum_w2))
    floor = 1e-24 * (1 + F.col("ewm_mean") * F.col("ewm_mean"))
    z = F.when(var > floor, (F.col("feature_value") - F.col("ewm_mean")) / F.sqrt(var)).otherwise(0.0)
    return df.select(
        "ticker", "effective_date", "feature_name", "feature_value", "ewm_mean",
        F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z"),
    )


def rolling_prior_share(
    df: DataFrame, value: str = "value", out: str = "vix_percentile_63d", rows: int = 63,
    keys=("ticker",),
) -> DataFrame:
    """Share of the previous ``rows`` values at or below the current one."""
    prior = F.collect_list(value).over(series(*keys).rowsBetween(-rows, -1))
    df = df.withColumn("_prior", prior)
    at_or_below = F.size(F.filter("_prior", lambda x: x <= F.col(value)))
    return df.withColumn(out, F.when(F.size("_prior") == rows, at_or_below / F.lit(float(rows)))).drop("_prior")


def rate_of_change(
    df: DataFrame, value: str = "value", out: str = "hy_spread_roc_21d", rows: int = 21,
    keys=("ticker",),
) -> DataFrame:
    before = F.lag(value, rows).over(series(*keys))
    return df.withColumn(out, (F.col(value) - before) / F.greatest(F.abs(before), F.lit(1e-9)))


def macro_slope(macro: DataFrame, long_id: str = "DGS10", short_id: str = "DGS2") -> DataFrame:
    """Long minus short rate on the dates that carry both."""
    pick = lambda sid, name: macro.where(F.col("series_id") == sid).select(
        "effective_date", F.col("value").alias(name)
    )
    return (
        pick(long_id, "long_rate")
        .join(pick(short_id, "short_rate"), "effective_date")
        .select("effective_date", (F.col("long_rate") - F.col("short_rate")).alias("yield_curve_slope"))
    )


def macro_features(macro: DataFrame) -> DataFrame:
    """Wide macro features by date: slope, spread momentum and volatility rank."""
    roc = rate_of_change(
        macro.where(F.col("series_id") == "BAMLH0A0HYM2"), keys=("series_id",)
    ).select("effective_date", "hy_spread_roc_21d")
    vix = rolling_prior_share(
        macro.where(F.col("series_id") == "VIXCLS"), keys=("series_id",)
    ).select("effective_date", "vix_percentile_63d")
    return macro_slope(macro).join(roc, "effective_date", "full").join(vix, "effective_date", "full")


def add_trend_spread(df: DataFrame) -> DataFrame:
    ma50 = full_window(F.col("close"), 50, F.avg)
    ma200 = full_window(F.col("close"), 200, F.avg)
    return df.withColumn("ma_spread_50_200d", F.when(ma200 != 0, (ma50 - ma200) / ma200))


def add_atr_pct(df: DataFrame, rows: int = 21) -> DataFrame:
    prev = F.lag("close", 1).over(series())
    true_range = F.when(
        prev.isNotNull(),
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        ),
    )
    df = df.withColumn("_tr", true_range)
    atr = full_window(F.col("_tr"), rows, F.avg)
    return df.withColumn(
        f"atr_pct_{rows}d", F.when(F.col("close") != 0, atr / F.col("close"))
    ).drop("_tr")


def add_volume_norm(df: DataFrame, rows: int = 21) -> DataFrame:
    mean = full_window(F.col("volume"), rows, F.avg)
    return df.withColumn(
        f"volume_norm_{rows}d",
        F.when(mean.isNotNull(), F.col("volume") / F.greatest(mean, F.lit(1e-12))),
    )


def sector_relative_return(bars: DataFrame, sectors: DataFrame, etf_bars: DataFrame, steps: int = 251) -> DataFrame:
    """Return over ``steps`` rows minus that of the paired sector series on the same date.

    Each side is measured on its own rows, then paired by date, so a ticker with
    missing days is never compared over a shortened sector window.
    """
    own = F.col("close") / F.lag("close", steps).over(series()) - 1
    asset = bars.select("ticker", "effective_date", own.alias("asset_ret"))
    sector = etf_bars.select(F.col("ticker").alias("etf"), "effective_date", own.alias("etf_ret"))
    return (
        asset.join(sectors, "ticker")
        .join(sector, ["etf", "effective_date"], "left")
        .select(
            "ticker", "effective_date", "etf", "asset_ret", "etf_ret",
            (F.col("asset_ret") - F.col("etf_ret")).alias("sector_relative_ret_252d"),
        )
    )


def amihud(df: DataFrame, floor: float = 1e4) -> DataFrame:
    """Absolute log return per dollar traded."""
    log_ret = F.log(F.col("close") / F.lag("close", 1).over(series()))
    dollars = F.greatest(F.col("close") * F.col("volume"), F.lit(floor))
    return df.withColumn("amihud", F.abs(log_ret) / dollars)


def corwin_schultz(df: DataFrame) -> DataFrame:
    """Two-bar high-low spread estimate, floored at zero."""
    w = series()
    h0, l0 = F.lag("high", 1).over(w), F.lag("low", 1).over(w)
    c = 3.0 - 2.0 * math.sqrt(2.0)
    df = df.withColumns(
        {
            "_beta": F.pow(F.log(h0 / l0), 2) + F.pow(F.log(F.col("high") / F.col("low")), 2),
            "_gamma": F.pow(
                F.log(
                    F.greatest(h0, F.col("high"))
                    / F.greatest(F.least(l0, F.col("low")), F.lit(1e-12))
                ),
                2,
            ),
        }
    )
    alpha = (F.sqrt(2.0 * F.col("_beta")) - F.sqrt("_beta")) / c - F.sqrt(F.col("_gamma") / c)
    df = df.withColumn("_alpha", F.when(h0.isNotNull(), alpha))
    spread = 2.0 * (F.exp("_alpha") - 1.0) / (1.0 + F.exp("_alpha"))
    return df.withColumn(
        "cs_spread", F.when(F.col("_alpha").isNotNull(), F.greatest(spread, F.lit(0.0)))
    ).drop("_beta", "_gamma", "_alpha")


def longest_gap_run(bars: DataFrame, max_days: int = 3) -> DataFrame:
    """Per ticker, the longest run of consecutive intervals above ``max_days``."""
    w = series()
    df = bars.select("ticker", "effective_date").withColumn(
        "_gap",
        (F.datediff("effective_date", F.lag("effective_date", 1).over(w)) > max_days).cast("int"),
    )
    df = df.withColumn("_gap", F.coalesce("_gap", F.lit(0)))
    df = df.withColumn(
        "_island", F.sum(1 - F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = df.groupBy("ticker", "_island").agg(F.sum("_gap").alias("run"))
    return runs.groupBy("ticker").agg(F.max("run").alias("n_consec_gaps"))


def training_windows(
    bars: DataFrame, lookback: int = 90, predict: int = 10, stride: int = 5, clip: float = 5.0,
    min_rows: int = 120,
) -> DataFrame:
    """Sliding windows per ticker, z-scored per window and channel, with calendar stamps."""
    size = lookback + predict + 1
    channels = ("open", "high", "low", "close", "volume", "amount")
    w = series()
    df = bars.dropna(subset=["open", "high", "low", "close", "volume"]).withColumn(
        "amount", F.col("volume") * F.col("close")
    )
    df = df.withColumns(
        {
            "_n": F.row_number().over(w) - 1,
            "_rows": F.count("*").over(Window.partitionBy("ticker")),
        }
    )
    # Each row goes to the windows it stands in, at most size / stride of them, and every
    # window is collected once; the ticker's exchange serves both steps.
    last = F.floor((F.col("_rows") - size) / stride) * stride
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - (size - 1)) / stride) * stride)
    until = F.least(F.floor(F.col("_n") / stride) * stride, last)
    held = df.where((F.col("_rows") >= F.greatest(F.lit(min_rows), F.lit(size))) & (first <= until))
    spread_out = held.withColumn("_start", F.explode(F.sequence(first.cast("long"), until.cast("long"), F.lit(stride).cast("long"))))
    moments = []
    for c in channels:
        moments += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    df = spread_out.groupBy("ticker", "_start").agg(
        F.array_sort(F.collect_list(F.struct("effective_date", *channels))).alias("_window"), *moments
    )

    def scaled(c: str):
        return lambda r: F.greatest(
            F.lit(-clip),
            F.least(F.lit(clip), (r[c] - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + 1e-5)),
        ).cast("float")

    return df.select(
        "ticker",
        F.col("_start").alias("start_row"),
        F.col("_window")[0]["effective_date"].alias("start_date"),
        *[F.transform("_window", scaled(c)).alias(c) for c in channels],
        F.transform(
            "_window",
            lambda r: F.struct(
                F.weekday(r["effective_date"]).alias("weekday"),
                F.dayofmonth(r["effective_date"]).alias("day"),
                F.month(r["effective_date"]).alias("month"),
            ),
        ).alias("stamps"),
    )


def column_moments(df: DataFrame, columns, keys=()) -> DataFrame:
    """Training moments, one row per key: mu_<c> and sd_<c>, a zero spread read as 1."""
    aggs = []
    for c in columns:
        sd = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"mu_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def winsorise(df: DataFrame, columns, cap: float = 4.0, keys=(), moments: DataFrame | None = None) -> DataFrame:
    """Clip each column to mean +- cap spreads, by own or by stored moments."""
    moments = moments if moments is not None else column_moments(df, columns, keys)
    if keys:
        joined = df.join(moments, list(keys))
    else:
        # Without keys the moments are a single row by construction.
        joined = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(moments.withColumn("_one", F.lit(1))), "_one"
        )
    clipped = {
        c: F.when(
            F.col(c).isNotNull(),
            F.greatest(
                F.col(f"mu_{c}") - cap * F.col(f"sd_{c}"),
                F.least(F.col(f"mu_{c}") + cap * F.col(f"sd_{c}"), F.col(c)),
            ),
        )
        for c in columns
    }
    return joined.withColumns(clipped).select(*df.columns)


def finite_mean(*columns: Column) -> Column:
    """Mean of the values present, NULL when none is."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


# fixed values: inputs of the options dimension, any of which may be absent
OPTIONS_INPUTS = ("vix_9d", "vix_1m", "vix_3m", "skew_index", "put_call_ratio")


def feature_vector(
    bars: DataFrame, sectors: DataFrame, etf_bars: DataFrame, macro: DataFrame, options: DataFrame | None = None,
) -> DataFrame:
    """Nine averaged dimensions per (ticker, date); macro and options are read as of the date.

    ``options`` has effective_date and some of ``OPTIONS_INPUTS``; with both the three
    and the one month volatility, their difference counts as one more input. Without
    it the volatility index of ``macro`` stands for the one month.
    """
    df = add_returns(bars, (1, 5, 21))
    df = add_trend_spread(df)
    df = add_atr_pct(df)
    df = add_volume_norm(df)
    df = df.withColumn("_vol", full_window(F.col("ret_1d"), 21, F.stddev_samp))
    relative = sector_relative_return(bars, sectors, etf_bars).select(
        "ticker", "effective_date", "sector_relative_ret_252d"
    )
    breadth = breadth_by_date(bars).select("effective_date", "breadth_ma50")
    # One row per date: the latest value each series had by then.
    dates = bars.select("effective_date").distinct()
    macro_wide = macro.groupBy("effective_date").pivot(
        "series_id", ["BAMLH0A0HYM2", "BAMLC0A0CM", "DGS10", "DGS2", "VIXCLS"]
    ).agg(F.first("value"))
    change = rate_of_change(macro.where(F.col("series_id") == "DGS10"), out="_roc10", keys=("series_id",)).select("effective_date", "_roc10")
    if options is None:
        options = macro_wide.select("effective_date", F.col("VIXCLS").alias("vix_1m"))
    given = [c for c in OPTIONS_INPUTS if c in options.columns]
    # The spine holds one row per calendar date, whatever the size of the bars.
    spine = (
        dates.join(macro_wide, "effective_date", "full").join(change, "effective_date", "full")
        .join(options.select("effective_date", *given), "effective_date", "full").withColumn("_all", F.lit("market"))
    )
    as_of = Window.partitionBy("_all").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(as_of)
    inputs = [latest(c) for c in given]
    if {"vix_3m", "vix_1m"} <= set(given):
        inputs.append(latest("vix_3m") - latest("vix_1m"))
    by_date = spine.select(
        "effective_date",
        finite_mean(
            latest("BAMLH0A0HYM2"), latest("BAMLC0A0CM"), latest("DGS10") - latest("DGS2"), latest("_roc10")
        ).alias("macro"),
        (finite_mean(*inputs) if inputs else F.lit(None).cast("double")).alias("options_proxy"),
    )
    return (
        df.join(relative, ["ticker", "effective_date"], "left")
        .join(by_date, "effective_date", "left")
        .join(breadth, "effective_date", "left")
        .select(
            "ticker",
            "effective_date",
            finite_mean(
                F.col("ret_1d"), F.col("ret_5d"), F.col("ret_21d"), F.col("ma_spread_50_200d")
            ).alias("trend"),
            finite_mean(F.col("_vol"), F.col("atr_pct_21d")).alias("volatility"),
            F.col("breadth_ma50").alias("breadth"),
            F.col("volume_norm_21d").alias("liquidity"),
            "macro",
            F.lit(None).cast("double").alias("correlation"),
            "options_proxy",
            F.col("sector_relative_ret_252d").alias("sector_relative_return"),
            F.lit(None).cast("double").alias("fundamental"),
        )
    )


def breadth_by_date(bars: DataFrame) -> DataFrame:
    """Share of tickers above their own 20- and 50-row means, per date."""
    df = add_ma_flag(add_ma_flag(bars, 20), 50)
    return df.groupBy("effective_date").agg(
        F.avg("pct_above_ma20").alias("breadth_ma20"),
        F.avg("pct_above_ma50").alias("breadth_ma50"),
        F.count("pct_above_ma50").alias("n_tickers"),
    )


def sector_correlation(sector_bars: DataFrame, rows: int = 63) -> DataFrame:
    """Mean pairwise correlation of sector returns over the trailing rows, per date.

    The sector list is fixed and small, so pairing it with itself adds a constant
    number of rows per date.
    """
    r = add_returns(sector_bars, (1,)).select("ticker", "effective_date", "ret_1d").dropna()
    pairs = r.select("effective_date", F.col("ticker").alias("a"), F.col("ret_1d").alias("ra")).join(
        r.select("effective_date", F.col("ticker").alias("b"), F.col("ret_1d").alias("rb")),
        "effective_date",
    ).where("a < b")
    w = Window.partitionBy("a", "b").orderBy("effective_date").rowsBetween(1 - rows, 0)
    corr = F.when(F.count("*").over(w) == rows, F.corr("ra", "rb").over(w))
    return (
        pairs.select("effective_date", corr.alias("corr"))
        .where(F.col("corr").isNotNull())
        .groupBy("effective_date")
        .agg(F.avg("corr").alias("sector_correlation"), F.count("*").alias("n_pairs"))
    )


def market_history(long: DataFrame, features, fill_forward=()) -> DataFrame:
    """Universe mean per (date, feature), pivoted, incomplete dates dropped.

    ``fill_forward`` columns take their last known value first.
    """
    wide = long.groupBy("effective_date").pivot("feature_name", list(features)).agg(
        F.avg("feature_value")
    )
    if fill_forward:
        one = wide.withColumn("_all", F.lit("market"))
        w = Window.partitionBy("_all").orderBy("effective_date").rowsBetween(
            Window.unboundedPreceding, 0
        )
        wide = one.withColumns(
            {c: F.last(c, ignorenulls=True).over(w) for c in fill_forward}
        ).drop("_all")
    return wide.dropna(subset=list(features))
