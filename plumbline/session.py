"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Settings the jobs rely on. Shuffle partition counts are left to the caller:
# AQE coalesces them on small inputs and splits skewed ones on large inputs.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Lost executors only cost the re-read of a file, not of the plan behind it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


@contextmanager
def small_splits(spark: SparkSession, most: int = 32 << 20):
    """Files are read in splits of ``most`` bytes meanwhile, unless the session has a size of its own.

    A map-side combine holds a task's groups in memory; where nearly every row is one, a split of
    Spark's usual 128 MB holds more of them than fit, and each is spilled.
    """
    before = spark.conf.get(SPLIT_BYTES)
    if before.upper() not in ("128MB", "134217728", "134217728B"):
        yield
        return
    spark.conf.set(SPLIT_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_BYTES, before)


_STORED: dict[tuple, tuple[str, StructType]] = {}


def _state(spark: SparkSession, name: str, inputs: list[str]) -> tuple:
    # One row, however many files there are.
    state = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    files = spark.read.format("binaryFile").load(inputs).select(state.alias("h"), "length")
    return (spark.sparkContext.applicationId, name, tuple(inputs), tuple(files.agg(F.count("h"), F.sum("h"), F.sum("length")).first()))


def _held(spark: SparkSession, key: tuple) -> DataFrame | None:
    if key not in _STORED:
        return None
    path, schema = _STORED[key]
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def stored_once(spark: SparkSession, name: str, inputs: Iterable[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that many jobs read, written to the shared folder by the first of them.

    It is built anew when a file of ``inputs`` has another time or length, and in
    every new application.
    """
    key = _state(spark, name, list(inputs))
    held = _held(spark, key)
    if held is not None:
        return held
    with small_splits(spark):
        df = build()
        path = scratch(spark, name)
        df.write.parquet(path)
    _STORED[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)


def stored_or(spark: SparkSession, name: str, inputs: Iterable[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of :func:`stored_once` where a job has written it; else ``build``'s rows, and nothing is written.

    For jobs that go through a table once and need few of its columns or rows.
    """
    held = _held(spark, _state(spark, name, list(inputs)))
    return build() if held is None else held


# Bytes of the files behind a table that one task of a window or a grouped fit is given.
TASK_BYTES = 32 << 20


def read_bytes(df: DataFrame) -> int:
    """Length of the files that ``df`` is read from, 0 where there are none."""
    files = df.inputFiles()
    if not files:
        return 0
    return df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0


def tasks(df: DataFrame, wider: int = 1) -> int:
    """The number of partitions that :func:`spread` deals ``df`` to."""
    return max(_tasks(df, wider))


def _tasks(df: DataFrame, wider: int = 1) -> tuple[int, int]:
    """The configured number of partitions, and the number that the files behind ``df`` ask for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read_bytes(df) * wider // TASK_BYTES)


def spread(df: DataFrame, *keys: str, wider: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of partitions, or more where the data are large.

    For grouped fits, whose cost is far above their bytes: an explicit number keeps
    AQE from folding the small groups into a few tasks, and the grouping that
    follows reuses this partitioning. So it does for chains of windows, whose sorts hold
    rows that are ``wider`` times those of the files.
    """
    return df.repartition(tasks(df, wider), *keys)


def enough_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, hash-partitioned by ``keys`` only where the configured number of partitions is too small for it.

    A sort whose share of the data does not fit a task's memory spills; AQE splits no
    partition under a window.
    """
    configured, wanted = _tasks(df)
    return df if wanted <= configured else df.repartition(wanted, *keys)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, for rows that hold matrices."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
