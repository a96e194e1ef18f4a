"""Column contracts of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, D, F64, I32, I64, B, TS = (
    T.StringType(),
    T.DateType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)

BARS = _schema(
    ticker=S, effective_date=D, open=F64, high=F64, low=F64, close=F64, volume=F64
)
FEATURES_PIT = _schema(
    ticker=S,
    effective_date=D,
    knowledge_date=D,
    feature_name=S,
    feature_value=F64,
    feature_version=S,
    source=S,
    pit_verified=B,
)
FEATURE_BATCH = ("ticker", "effective_date", "knowledge_date", "feature_name", "feature_value")
REGISTRY = _schema(
    model_id=S, app_mode=S, trained_at=TS, n_dimensions=I32, k_selected=I32, oos_log_likelihood=F64, validation_status=S,
    walk_forward_sharpe=F64, deflated_sharpe=F64, retired_at=TS, retired_reason=S,
)
FETCH_AUDIT = _schema(
    ticker=S, fetch_date=D, fetched_at=TS, status=S, n_rows=I64, n_bad_rows=I64,
    n_consec_gaps=I64, note=S, app_mode=S,
)
DELISTED = _schema(ticker=S, termination_date=D, termination_reason=S, terminal_return=F64)
JOURNAL = _schema(
    entry_id=S, ticker=S, entry_date=D, direction=S, thesis=S, primary_catalyst=S,
    invalidation=S, expected_horizon=I32, confidence_self=I32, market_state_id=I32,
    analog_hit_rate=F64, analog_n=I32, contradictions=S, unknowns_present=B,
    exit_date=D, pnl_pct=F64, thesis_validated=B, exit_reason=S,
)
EXECUTION_LOG = _schema(
    execution_id=S, layer_name=S, function_name=S, executed_at=TS, git_sha=S, hyperparameters=S
)
VALIDATION_REPORT = _schema(
    report_id=S, layer_name=S, as_of=D, status=S, production_ready=B, payload=S
)
PREDICTIONS = _schema(
    prediction_id=S, ticker=S, knowledge_date=D, horizon_days=I32, pred_p50=F64, pred_p5=F64,
    pred_p95=F64, pred_hit_prob=F64, pred_sizing=F64, effective_n=F64,
)

# fixed values: reasons a delisting may carry
TERMINATION_REASONS = ("merger", "bankruptcy", "acquisition", "voluntary", "unknown")


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: columns the stored rows lack are read as NULL."""
    from pyspark.sql import functions as F

    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
