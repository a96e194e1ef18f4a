"""The table with versions: reloads, readers and writers next to each other, compaction and vacuum."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from plumbline.schemas import FEATURES_PIT
from plumbline.sources import store as st
from plumbline.sources import versioned
from plumbline.sources.versioned import VersionedTable

DAY = dt.date(2024, 1, 2)


def batch(spark, *pairs):
    """(ticker, value) rows of one feature."""
    return spark.createDataFrame(
        [(t, DAY, DAY, "f", float(v)) for t, v in pairs],
        "ticker string, effective_date date, knowledge_date date, feature_name string, feature_value double",
    )


def held(df):
    return sorted((r.source, r.ticker, r.feature_value) for r in df.collect())


def test_an_empty_reload_empties_the_source(spark, tmp_path):
    path = str(tmp_path / "t")
    st.write_features(batch(spark, ("A", 1), ("B", 2)), path, "one")
    st.write_features(batch(spark, ("A", 3)), path, "two")
    assert st.replace_source(batch(spark), path, "one") == 0
    assert held(st.read_features(spark, path)) == [("two", "A", 3.0)]
    assert st.replace_source(batch(spark), path, "two") == 0
    assert held(st.read_features(spark, path)) == []
    assert held(st.read_features(spark, path, version=2)) == [("one", "A", 1.0), ("one", "B", 2.0), ("two", "A", 3.0)]


def test_a_ticker_reload_writes_its_own_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    st.write_features(batch(spark, ("A", 1), ("B", 2), ("C", 3), (None, 4)), path, "one")
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    asked = spark.createDataFrame([("A",), ("B",), ("A",), (None,)], "ticker string")
    assert st.replace_ticker_source(batch(spark, ("A", 9)), path, "one", "v2", asked) == 1
    assert held(st.read_features(spark, path).na.fill("-", ["ticker"])) == [("one", "-", 4.0), ("one", "A", 9.0), ("one", "C", 3.0)]
    after = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    assert before.items() <= after.items()
    new = {p.split("/data/")[1].split("/")[0] for p in after.keys() - before.keys() if "/data/" in p}
    assert len(new) == 1
    assert {r.ticker for r in spark.read.parquet(f"{path}/data/{new.pop()}").collect()} == {"A"}
    # Reloaded once more, and rows that were added in between go as well.
    st.write_features(batch(spark, ("B", 5), ("A", 6)), path, "one")
    st.replace_ticker_source(batch(spark, ("B", 7)), path, "one")
    assert held(st.read_features(spark, path, source="one").dropna(subset=["ticker"])) == [("one", "A", 6.0), ("one", "A", 9.0), ("one", "B", 7.0), ("one", "C", 3.0)]


def test_a_reader_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    st.write_features(batch(spark, ("A", 1), ("B", 2)), path, "one")
    early = st.read_features(spark, path)
    st.replace_source(batch(spark, ("Z", 8)), path, "one")
    st.replace_ticker_source(batch(spark), path, "one", tickers=spark.createDataFrame([("Z",)], "ticker string"))
    assert held(early) == [("one", "A", 1.0), ("one", "B", 2.0)]
    assert held(st.read_features(spark, path)) == []


def test_what_is_not_committed_is_not_seen(spark, tmp_path):
    """A writer that went away after its files, and one that went away within its manifest."""
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, FEATURES_PIT)
    table.append(st.stamp_features(batch(spark, ("A", 1)), "one"), "one")
    table._write(st.stamp_features(batch(spark, ("X", 0)), "one"))
    with open(f"{path}/versions/{2:012d}.json", "w") as f:
        f.write('{"version": 2, "segments": [')
    assert held(table.read()) == [("one", "A", 1.0)] and table.versions() == [1]
    table.append(st.stamp_features(batch(spark, ("B", 2)), "one"), "one")
    assert table.versions() == [1, 3] and held(table.read()) == [("one", "A", 1.0), ("one", "B", 2.0)]


def test_writers_next_to_each_other(spark, tmp_path, monkeypatch):
    """Another writer commits between the look at the newest manifest and the creation of the next one."""
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, FEATURES_PIT)
    table.append(st.stamp_features(batch(spark, ("A", 1)), "one"), "one")
    create, others = versioned.create_once, [("append", "two", ("B", 2)), ("replace", "one", ("C", 3))]

    def slow(session, place, text):
        if others:
            how, source, row = others.pop(0)
            getattr(VersionedTable(spark, path, FEATURES_PIT), how)(st.stamp_features(batch(spark, row), source), source)
        return create(session, place, text)

    monkeypatch.setattr(versioned, "create_once", slow)
    table.append(st.stamp_features(batch(spark, ("D", 4)), "one"), "one")
    assert held(table.read()) == [("one", "C", 3.0), ("one", "D", 4.0), ("two", "B", 2.0)]
    assert table.versions() == [1, 2, 3, 4]
    monkeypatch.setattr(versioned, "create_once", lambda *_: False)
    with pytest.raises(versioned.Conflict):
        table.append(st.stamp_features(batch(spark, ("E", 5)), "one"), "one")


def test_compaction_keeps_rows_and_later_changes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, FEATURES_PIT)
    monkeypatch.setattr(versioned, "MOST_SEGMENTS", 3)
    for k in range(7):
        table.append(st.stamp_features(batch(spark, (f"T{k}", k)), "one"), "one")
        if k == 2:
            table.replace_tickers(st.stamp_features(batch(spark, ("T0", 10)), "one"), "one", spark.createDataFrame([("T0",), ("T1",)], "ticker string"))
    want = [("one", "T0", 10.0)] + [("one", f"T{k}", float(k)) for k in range(2, 7)]
    assert held(table.read()) == want and len(table.manifest()["segments"]) <= 3
    # Tickers hidden while the compaction runs stay hidden.
    write = table._write

    def meanwhile(rows):
        found = write(rows)
        monkeypatch.setattr(table, "_write", write)
        table.replace_tickers(st.stamp_features(batch(spark), "one"), "one", spark.createDataFrame([("T2",)], "ticker string"))
        return found

    monkeypatch.setattr(table, "_write", meanwhile)
    table.compact("one")
    assert held(table.read()) == [w for w in want if w[1] != "T2"]
    # A reload while it runs wins.
    def reloaded(rows):
        found = write(rows)
        monkeypatch.setattr(table, "_write", write)
        table.replace(st.stamp_features(batch(spark, ("N", 1)), "one"), "one")
        return found

    monkeypatch.setattr(table, "_write", reloaded)
    table.compact("one")
    assert held(table.read()) == [("one", "N", 1.0)]


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, FEATURES_PIT)
    for k in range(3):
        table.replace(st.stamp_features(batch(spark, ("A", k)), "one"), "one")
    assert table.vacuum(keep=2) == 1 and table.versions() == [2, 3]
    assert held(table.read(version=2)) == [("one", "A", 1.0)] and held(table.read()) == [("one", "A", 2.0)]
    with pytest.raises(Exception):
        table.manifest(1)
