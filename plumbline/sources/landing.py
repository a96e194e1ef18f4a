"""Readers for landed files: bars, macro CSV, put/call CSV, calendars, maps, feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dates import iso_date
from plumbline.operators.quality import SUPPRESSIONS
from plumbline.schemas import BARS

# fixed values: header names, lower case
HEADER_MEANING = {
    "date": "pc_date", "tradingday": "pc_date",
    "totalputcall": "ratio", "totalputcallratio": "ratio", "putcallratio": "ratio",
}
# fixed values: the sector funds a map may point to
SECTOR_ETFS = ("XLK", "XLF", "XLV", "XLY", "XLP", "XLE", "XLI", "XLB", "XLRE", "XLU", "XLC")
TITLE_CHARS = 500
SUMMARY_CHARS = 2000


def read_bars(spark: SparkSession, path: str, tickers=None, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """Typed OHLCV rows; ticker and date filters reach the scan."""
    reader = spark.read.schema(BARS)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    if tickers is not None:
        df = df.where(F.col("ticker").isin(list(tickers)))
    if start is not None:
        df = df.where(F.col("effective_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("effective_date") <= F.lit(end).cast("date"))
    return df.where(F.col("close").isNotNull())


def wide_to_bars(wide: DataFrame, tickers) -> DataFrame:
    """One row per date with columns <ticker>_<field>, turned into bar rows.

    Rows whose every field is missing are dropped.
    """
    fields = ("open", "high", "low", "close", "volume")
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("ticker"),
                *[F.col(f"`{t}_{f}`").cast("double").alias(f) for f in fields],
            )
            for t in tickers
        ]
    )
    return wide.select("effective_date", F.inline(rows)).dropna("all", subset=list(fields))


def read_macro_csv(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """(series_id, effective_date, value). The first column is the date, the last the
    value; "." and anything that is no number is dropped."""
    raw = spark.read.option("header", True).option("nullValue", ".").csv(path)
    date, value = raw.columns[0], raw.columns[-1]
    tag = F.lit(series_id if series_id is not None else value)
    return raw.select(
        tag.alias("series_id"), iso_date(F.col(f"`{date}`")).alias("effective_date"),
        F.expr(f"try_cast(`{value}` as double)").alias("value"),
    ).where(F.col("value").isNotNull() & F.col("effective_date").isNotNull())


def read_put_call(spark: SparkSession, path: str) -> DataFrame:
    """(pc_date, ratio) from a CSV whose headers drift; bad rows are dropped.

    A layout without a known date and ratio column yields no rows.
    """
    raw = spark.read.option("header", True).csv(path)
    columns: dict[str, str] = {}
    for header in raw.columns:
        meaning = HEADER_MEANING.get(re.sub(r"[\s_]+", "", header).lower())
        columns.setdefault(meaning, header)
    if not {"pc_date", "ratio"} <= columns.keys():
        return spark.createDataFrame([], "pc_date date, ratio double")
    date, ratio = columns["pc_date"], columns["ratio"]
    text = F.col(f"`{date}`")
    parsed = F.coalesce(iso_date(text), F.try_to_date(text, "M/d/yyyy"))
    return raw.select(
        parsed.alias("pc_date"), F.expr(f"try_cast(`{ratio}` as double)").alias("ratio")
    ).dropna()


def parse_calendar(lines: DataFrame, column: str = "value") -> DataFrame:
    """(event_date, event, position) from JSON objects {date: [events]}.

    Unreadable dates and unknown events are skipped.
    """
    parsed = lines.select(
        F.explode(F.from_json(column, "map<string,array<string>>")).alias("day", "events")
    )
    return (
        parsed.select(iso_date(F.col("day")).alias("event_date"), F.posexplode("events").alias("position", "event"))
        .where(F.col("event_date").isNotNull() & F.col("event").isin(list(SUPPRESSIONS)))
    )


def parse_sector_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ticker, etf) from "ticker: fund" lines; blanks and comments are skipped."""
    text = F.trim(F.col(column))
    parts = F.split(text, ":", 2)
    return lines.where(~text.startswith("#") & text.contains(":")).select(
        F.trim(parts[0]).alias("ticker"), F.trim(parts[1]).alias("etf")
    )


def sector_map_problems(tickers: DataFrame, sectors: DataFrame, etfs=SECTOR_ETFS) -> DataFrame:
    """(problem, item): tickers without a sector, funds outside the known set."""
    unmapped = tickers.select("ticker").distinct().join(sectors, "ticker", "left_anti")
    unknown = sectors.where(~F.col("etf").isin(list(etfs))).select("etf").distinct()
    return unmapped.select(F.lit("unmapped_ticker").alias("problem"), F.col("ticker").alias("item")).union(
        unknown.select(F.lit("unknown_etf"), "etf")
    )


def validate_sector_map(tickers: DataFrame, sectors: DataFrame, etfs=SECTOR_ETFS) -> None:
    first = sector_map_problems(tickers, sectors, etfs).limit(10).collect()
    if first:
        raise ValueError(f"sector map problems: {[tuple(r) for r in first]}")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


ENTRY_SCHEMA = """
id string, title string, summary string, published string,
author array<struct<name: string>>, link array<struct<_href: string, _rel: string>>, topic string
"""


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries from landed XML, one row per <entry>."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)
    alternate = F.filter("link", lambda x: x["_rel"] == "alternate")
    return raw.where(F.trim("id") != "").select(
        F.trim("id").alias("entry_id"),
        "topic",
        F.left(collapse_spaces(F.coalesce("title", F.lit(""))), F.lit(TITLE_CHARS)).alias("title"),
        F.array_join(F.transform("author", lambda a: F.trim(a["name"])), ", ").alias("authors"),
        iso_date(F.col("published")).alias("published"),
        F.coalesce(F.element_at(alternate, -1)["_href"], F.trim("id")).alias("url"),
        F.left(collapse_spaces(F.coalesce("summary", F.lit(""))), F.lit(SUMMARY_CHARS)).alias("summary"),
    )


def refresh_papers(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by entry: known entries only take the new topic and fetch time."""
    latest = batch.groupBy("entry_id").agg(
        F.max_by(F.struct(*[c for c in batch.columns if c != "entry_id"]), "fetched_at").alias("_new")
    )
    joined = cache.join(latest, "entry_id", "full")
    kept = [c for c in cache.columns if c not in ("entry_id", "topic", "fetched_at")]
    known = F.col("fetched_at").isNotNull()
    return joined.select(
        "entry_id",
        F.coalesce("_new.topic", "topic").alias("topic"),
        *[F.when(known, F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in kept],
        F.coalesce("_new.fetched_at", "fetched_at").alias("fetched_at"),
    )
