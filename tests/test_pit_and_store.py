from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions.asof import asof_join
from plumbline.operators import pit
from plumbline.operators import quality as ql
from plumbline.sources import landing as ld
from plumbline.sources import store as st

D = dt.date


def feature_rows(spark, rows):
    return spark.createDataFrame(
        rows, "ticker string, effective_date date, knowledge_date date, feature_name string, feature_value double"
    )


def ask(spark, *as_of):
    return spark.createDataFrame([("A", "f", d) for d in as_of], "ticker string, feature_name string, as_of date")


def test_lookup_is_strictly_before_knowledge(spark):
    facts = feature_rows(spark, [("A", D(2024, 1, 2), D(2024, 1, 3), "f", 1.0)])
    got = pit.as_of_lookup(ask(spark, D(2024, 1, 3), D(2024, 1, 4)), facts).orderBy("as_of").collect()
    assert [r.feature_value for r in got] == [None, 1.0]


def test_lookup_returns_the_revision_known_then(spark):
    facts = feature_rows(
        spark,
        [("A", D(2024, 1, 4), D(2024, 1, 5), "f", 0.01), ("A", D(2024, 1, 4), D(2024, 1, 8), "f", 0.02)],
    )
    got = pit.as_of_lookup(ask(spark, D(2024, 1, 7), D(2024, 1, 9)), facts).orderBy("as_of").collect()
    assert [r.feature_value for r in got] == [0.01, 0.02]


def test_lookup_ignores_values_effective_later(spark):
    facts = feature_rows(spark, [("A", D(2024, 2, 1), D(2024, 1, 1), "f", 9.0), ("A", D(2023, 12, 1), D(2023, 12, 2), "f", 1.0)])
    got = pit.as_of_lookup(ask(spark, D(2024, 1, 10), D(2024, 2, 1)), facts).orderBy("as_of").collect()
    assert [r.feature_value for r in got] == [1.0, 9.0]


def test_history_respects_each_lag_and_collapses_revisions(spark):
    facts = feature_rows(
        spark,
        [
            ("A", D(2024, 1, 2), D(2024, 1, 2), "rsi_14", 1.0),
            ("A", D(2024, 1, 2), D(2024, 1, 9), "rsi_14", 2.0),
            ("A", D(2024, 1, 8), D(2024, 1, 8), "revenue_growth_yoy", 3.0),
            ("A", D(2024, 1, 2), D(2024, 1, 2), "revenue_growth_yoy", 4.0),
        ],
    )
    got = pit.feature_history(facts, ["rsi_14", "revenue_growth_yoy"], "2024-01-01", "2024-01-31", "2024-01-10")
    rows = {r.effective_date: r for r in got.collect()}
    assert rows[D(2024, 1, 2)]["rsi_14"] == 2.0 and rows[D(2024, 1, 2)]["revenue_growth_yoy"] == 4.0
    assert D(2024, 1, 8) not in rows


def test_lagged_factors_never_look_ahead(spark, factor_data):
    factors, assets, f, y, _ = factor_data
    names = factors.columns[1:]
    aligned = pit.lagged_factors(factors, assets, names)
    assert aligned.count() == 599
    check = pit.assert_lagged(aligned).first()
    assert check.n_violations == 0
    leaky = aligned.withColumn("factor_date", F.col("effective_date"))
    assert pit.assert_lagged(leaky).first().n_violations == 599


def test_asof_join_spreads_one_hot_key(spark):
    base = dt.datetime(2024, 1, 1)
    right = spark.createDataFrame(
        [("hot", base + dt.timedelta(minutes=90 * i), i, float(i)) for i in range(50)],
        "ticker string, ts timestamp_ntz, id long, v double",
    )
    left = spark.createDataFrame(
        [(k, "hot" if k else "none", base + dt.timedelta(minutes=37 * k - 10)) for k in range(100)],
        "k int, ticker string, at timestamp_ntz",
    )
    got = {r.k: r.v for r in asof_join(left, right, "ticker", "at", "ts", ["v"], "id").collect()}
    for k in range(100):
        minute = 37 * k - 10
        want = None if k == 0 or minute < 0 else float(min(minute // 90, 49))
        assert got[k] == want


def test_null_keys_deduplicate(spark):
    feed = spark.createDataFrame([(None, "s", "b")], "ticker string, source string, body string")
    batch = spark.createDataFrame([(None, "s", "b"), ("A", "s", "b")], feed.schema)
    assert [r.ticker for r in pit.new_rows(batch, feed, ["ticker", "source", "body"]).collect()] == ["A"]


def test_store_write_counts_replaces_and_checks_columns(spark, tmp_path):
    path = str(tmp_path / "features")
    batch = feature_rows(spark, [("A", D(2024, 1, 2), D(2024, 1, 2), "f", 1.0), ("B", D(2024, 1, 2), D(2024, 1, 2), "g", 2.0)])
    assert st.write_features(batch, path, "one") == 2
    assert st.write_features(batch, path, "two") == 2
    assert st.replace_source(batch.where("ticker = 'A'"), path, "one", "v2") == 1
    rows = st.read_features(spark, path)
    assert rows.where("source = 'two'").count() == 2
    assert rows.where("source = 'one' AND feature_name = 'f'").first()["feature_version"] == "v2"
    with pytest.raises(ValueError):
        st.write_features(batch.drop("feature_value"), path, "one")


def test_snapshot_of_a_missing_path_is_none(spark, tmp_path):
    assert st.load_snapshot(spark, str(tmp_path / "none")) is None
    df = spark.createDataFrame([(1, 1.5), (2, 2.5), (3, 3.5)], "x int, y double")
    st.save_snapshot(df, str(tmp_path / "s"))
    assert st.load_snapshot(spark, str(tmp_path / "s")).count() == 3


def test_upsert_keeps_the_latest_and_ties_go_to_the_batch(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 2, "y"), ("c", 1, "y")], old.schema)
    got = {r.k: r.s for r in st.upsert(old, new, ["k"], "v").collect()}
    assert got == {"a": "y", "b": "x", "c": "y"}
    assert [r.k for r in st.insert_absent(old, new, ["k"]).collect()] == ["c"]


def test_bars_survive_the_archive(spark, ohlcv):
    back = st.features_to_bars(st.bars_to_features(ohlcv), 70)
    assert back.count() == 140
    assert st.features_to_bars(st.bars_to_features(ohlcv.where("effective_date > '2024-06-01'"))).count() == 0


def test_live_edge_adds_only_newer_bars(spark, ohlcv):
    cut = ohlcv.where("ticker = 'BBB' OR effective_date <= '2024-06-20'")
    got = st.with_live_edge(cut, ohlcv)
    assert got.where("live_edge").count() == 1
    assert got.where("live_edge").first()["effective_date"] == D(2024, 6, 28)


def test_macro_csv_drops_missing_values(spark, tmp_path):
    (tmp_path / "m.csv").write_text("observation_date,DGS10\n2024-01-02,3.95\n2024-01-03,3.91\n2024-01-04,.\n")
    got = ld.read_macro_csv(spark, str(tmp_path / "m.csv")).orderBy("effective_date").collect()
    assert [(r.series_id, r.value) for r in got] == [("DGS10", 3.95), ("DGS10", 3.91)]


def test_put_call_headers_and_unknown_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Trading Day,Total Put Call Ratio\n1/3/2024,0.9\n2024-01-04,bad\n")
    assert [tuple(r) for r in ld.read_put_call(spark, str(tmp_path / "a.csv")).collect()] == [(D(2024, 1, 3), 0.9)]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert ld.read_put_call(spark, str(tmp_path / "b.csv")).count() == 0


def test_bad_bars_gaps_and_missing_tickers_in_the_audit(spark):
    good = [("OK", D(2024, 1, 1) + dt.timedelta(days=i), 100.0, 101.0, 99.0, 100.5, 1.0) for i in range(5)]
    bad = [("BAD", D(2024, 1, 1) + dt.timedelta(days=i), 100.0, 98.0 if i == 2 else 101.0, 99.0, 100.5, 1.0) for i in range(5)]
    gap = [("GAP", D(2024, 1, 1) + dt.timedelta(days=10 * i), 100.0, 98.0 if i == 0 else 101.0, 99.0, 100.5, 1.0) for i in range(7)]
    bars = spark.createDataFrame(
        good + bad + gap, "ticker string, effective_date date, open double, high double, low double, close double, volume double"
    )
    asked = spark.createDataFrame([("OK",), ("BAD",), ("GAP",), ("NONE",)], "ticker string")
    got = {r.ticker: r for r in ql.fetch_audit(asked, bars, "2024-02-01").collect()}
    assert {t: r.status for t, r in got.items()} == {"OK": "OK", "BAD": "BAD_ROWS", "GAP": "GAP_WARNING", "NONE": "MISSING"}
    assert got["BAD"].n_bad_rows == 1 and got["BAD"].n_rows == 4


@pytest.mark.parametrize("symbol,ok", [("AAPL", True), ("BRK.B", True), ("RDS-A", True), ("aapl", False), ("TOOLONGNAME1", False), ("", False), ("1A", False)])
def test_ticker_symbols(spark, symbol, ok):
    df = spark.createDataFrame([(symbol,)], "s string")
    assert df.select(ql.valid_ticker(F.col("s"))).first()[0] is ok


def test_capped_requests_of_a_hot_key_are_dealt_to_tasks(spark):
    """All (as_of, cap) pairs of one key, answered alike by one task and by many."""
    facts = feature_rows(spark, [(None if k % 7 == 3 else "A", D(2024, 1, 1 + k % 20), D(2024, 1, 1 + (k * 5) % 25), "f", float(k)) for k in range(40)])
    days = [D(2024, 1, d) for d in range(1, 30)]
    requests = spark.createDataFrame([(t, "f", a, c) for t in ("A", None, "Z") for a in days for c in days], "ticker string, feature_name string, as_of date, effective_cap date")
    one, many = (
        sorted((tuple(r) for r in pit.as_of_lookup_capped(requests, facts, most=n).collect()), key=str) for n in (10**6, 50)
    )
    assert one == many and len(one) == 3 * 29 * 29 and sum(r[-1] is not None for r in one) > 500


def test_factors_are_broadcast_and_rows_stay_where_they_are(spark, factor_data):
    """However large the factor table looks, the asset rows are shuffled once, by ticker, for windows and fits alike."""
    from plumbline.operators import risk as rk

    factors, assets, *_ = factor_data
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = pit.lagged_factors(factors, assets.repartition(3, "ticker"), list(rk.FACTOR_ORDER))
        plan = rk.factor_regressions(aligned, methods=("ew_ols",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_asked_keys_are_stored_before_they_meet_the_facts(spark, monkeypatch):
    import datetime as dt

    stored, write = [], pit.materialise
    monkeypatch.setattr(pit, "materialise", lambda df, label: stored.append(label) or write(df, label))
    day = dt.date(2024, 1, 5)
    requests = spark.createDataFrame([("A", "f", day, day)], "ticker string, feature_name string, as_of date, effective_cap date")
    facts = spark.createDataFrame(
        [("A", "f", dt.date(2024, 1, 2), dt.date(2024, 1, 1), 1.5)], "ticker string, feature_name string, knowledge_date date, effective_date date, feature_value double")
    assert pit.as_of_lookup_capped(requests, facts).first().feature_value == 1.5
    assert stored == ["capped-keys", "capped-requests"]


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    from plumbline import session

    spark.range(20_000).selectExpr("id % 100 AS k", "rand(1) AS v").write.parquet(f"{tmp_path}/rows")
    rows, configured = spark.read.parquet(f"{tmp_path}/rows"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.spread(rows, "k").rdd.getNumPartitions() == configured and session.enough_tasks(rows, "k") is rows
    monkeypatch.setattr(session, "TASK_BYTES", 10_000)
    wanted = -(-session.read_bytes(rows) // 10_000)
    assert wanted > configured
    assert {session.spread(rows, "k").rdd.getNumPartitions(), session.enough_tasks(rows, "k").rdd.getNumPartitions()} == {wanted}


def _supplier_tables(spark, folder):
    """Three suppliers, two of one name, one without; the last nation twice."""
    spark.range(900).selectExpr(
        "id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "id % 7 AS l_partkey", "id % 3 + id div 600 * 2 AS l_suppkey",
        "date_add(DATE '2024-01-01', CAST(id % 120 AS INT)) AS l_shipdate", "id * 37 % 101 + 1.5 AS l_extendedprice", "CAST(2 AS DOUBLE) AS l_quantity",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(0, "S0", 1), (1, "S1", 1), (2, "S1", 2), (3, None, 2)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(1, "N1", 0), (2, "N2", 0), (2, "N2", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "R0")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")


def test_closes_are_those_of_the_bars(spark, tmp_path):
    from plumbline.sources import tables as tb

    _supplier_tables(spark, tmp_path)
    kept = ["ticker", "effective_date", "close"]
    assert sorted(tb.closes(spark, str(tmp_path)).collect()) == sorted(tb.bars(spark, str(tmp_path)).select(*kept).collect())


def test_feature_windows_sort_in_tasks_of_an_explicit_number(spark, tmp_path, monkeypatch):
    from plumbline import session
    from plumbline.plans.feature_plans import fresh

    _supplier_tables(spark, tmp_path)
    stored = set(session._STORED)
    plan = fresh(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert set(session._STORED) == stored  # the daily bars are not written for it
    assert "REPARTITION_BY_NUM" in plan and "max_by" in plan and "min_by" not in plan
    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    rows = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    assert session.spread(rows, "l_suppkey", wider=8).rdd.getNumPartitions() == -(-session.read_bytes(rows) * 8 // 1000)


def test_stored_tables_are_built_from_small_splits(spark, tmp_path):
    from plumbline import session

    spark.range(10).write.parquet(f"{tmp_path}/rows")
    before, seen = spark.conf.get(session.SPLIT_BYTES), []

    def build():
        seen.append(spark.conf.get(session.SPLIT_BYTES))
        return spark.read.parquet(f"{tmp_path}/rows")

    assert session.stored_once(spark, "split-rows", [f"{tmp_path}/rows"], build).count() == 10
    assert seen == [str(32 << 20)] and spark.conf.get(session.SPLIT_BYTES) == before
    with pytest.raises(ValueError), session.small_splits(spark):
        raise ValueError
    assert spark.conf.get(session.SPLIT_BYTES) == before
    spark.conf.set(session.SPLIT_BYTES, "1000000")
    try:
        with session.small_splits(spark):
            assert spark.conf.get(session.SPLIT_BYTES) == "1000000"
    finally:
        spark.conf.set(session.SPLIT_BYTES, before)


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_of_asked_tickers_are_shuffled_once_while_wide(spark, tmp_path):
    """Nothing is stored for a lookup, and its long rows stay where their windows left them."""
    from plumbline import session
    from plumbline.plans import catalogue
    from plumbline.plans.store_plans import pit_rows

    _supplier_tables(spark, tmp_path)
    spark.range(60).selectExpr(
        "id AS o_orderkey", "id div 3 % 3 AS o_custkey", "CAST('O' AS STRING) AS o_orderstatus", "date_add(DATE '2024-01-20', CAST(id AS INT)) AS o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "Supplier#000000001", 1), (1, "Supplier#000000002", 1), (2, "Supplier#000000900", 2)], "s_suppkey long, s_name string, s_nationkey int").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    stored, plan = set(session._STORED), catalogue()["as_of_lookup"]
    got = plan.run(spark, str(tmp_path))
    text = _executed(got)
    assert set(session._STORED) == stored
    facts = text[text.index("Union"):text.index("Exchange hashpartitioning(ticker", text.index("Union"))]
    assert "Generate inline" in facts and "Exchange" not in facts and "Expand" not in text
    rows = pit_rows(spark, str(tmp_path)).collect()  # of every ticker, stored
    want = {}
    for r in got.collect():
        known = [(f.knowledge_date, f.effective_date, f.feature_value) for f in rows if (f.ticker, f.feature_name) == (r.ticker, r.feature_name)
                 and f.knowledge_date < D.fromisoformat(r.as_of) and f.effective_date <= D.fromisoformat(r.as_of)]
        want[r.request_id] = round(max(known)[2], 6) if known else None
    found = {r.request_id: r.feature_value for r in got.collect()}
    assert len(found) == 60 and found == pytest.approx(want) and sum(v is not None for v in found.values()) > 9
    again = {r.request_id: r.feature_value for r in plan.run(spark, str(tmp_path)).collect()}  # from the stored features
    assert again == pytest.approx(want)


def test_revised_rows_come_in_one_pass(spark):
    from plumbline.plans.store_plans import pit_rows

    long = spark.createDataFrame([("A", D(2024, 1, 5), "f", 2.0), (None, D(2024, 1, 6), "f", 3.0), ("B", None, "f", 4.0)], "ticker string, effective_date date, feature_name string, feature_value double")
    rows = pit_rows(spark, None, long)
    assert sorted(map(tuple, rows.select("ticker", "knowledge_date", "feature_value").collect()), key=str) == sorted(
        [("A", D(2024, 1, 6), 2.0), ("A", D(2024, 1, 9), 2.02), (None, D(2024, 1, 7), 3.0), ("B", None, 4.0)], key=str)
    assert "Union" not in _executed(rows)


def test_candles_are_merged_where_their_bars_are(spark, tmp_path):
    """One exchange by ticker, of bars; neither bars nor archive rows are written or shuffled for the candles."""
    from plumbline import session
    from plumbline.plans import catalogue
    from plumbline.sources import tables as tb

    _supplier_tables(spark, tmp_path)
    stored = set(session._STORED)
    got = catalogue()["candles_from_archive"].run(spark, str(tmp_path))
    text = _executed(got)
    assert set(session._STORED) == stored
    above = text[:text.index("REPARTITION_BY_NUM")]
    assert above.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(ticker" in above
    assert "Expand" not in text and "pivotfirst" not in text and "SortAggregate" not in text
    kept = ["ticker", "effective_date", "open", "close", "volume"]
    bars = tb.bars(spark, str(tmp_path)).select(*kept).selectExpr("ticker", "CAST(effective_date AS string) AS effective_date", "open", "close", "volume")
    want = bars.groupBy("ticker").count().where("count >= 60").join(bars, "ticker").select(*kept)
    # S1 is the name of two suppliers, whose days may fall together: those are one candle.
    once = lambda rows: sorted({(r.ticker, r.effective_date) for r in rows.collect()})
    assert once(got) == once(want) and len(once(got)) == got.count() > 0
    single = want.groupBy("ticker", "effective_date").count().where("count = 1").join(want, ["ticker", "effective_date"]).select(*kept)
    assert single.exceptAll(got).isEmpty() and not single.isEmpty()


def test_candles_take_the_first_row_of_a_name(spark):
    """A NULL that comes first leaves the candle out, as does a missing part; other names do not matter."""
    rows = []
    for day in range(1, 5):
        rows += [("A", D(2024, 1, day), f"px_{c}", float(day)) for c in st.PX_COLUMNS]
    rows[5] = ("A", D(2024, 1, 2), "px_open", None)
    rows += [("A", D(2024, 1, 2), "px_open", 9.0), ("A", D(2024, 1, 3), "px_open", None), ("A", D(2024, 1, 3), "rsi_14", 1.0)]
    rows += [("A", D(2024, 1, 9), f"px_{c}", 1.0) for c in st.PX_COLUMNS[1:]]
    archive = spark.createDataFrame(rows, "ticker string, effective_date date, feature_name string, feature_value double").coalesce(1)
    got = st.features_to_bars(archive, lookback=9, min_rows=1).orderBy("effective_date").collect()
    assert [(r.effective_date.day, r.open, r.volume) for r in got] == [(1, 1.0, 1.0), (3, 3.0, 3.0), (4, 4.0, 4.0)]


def test_closes_start_from_stored_bars_where_there_are_some(spark, tmp_path):
    from plumbline.sources import tables as tb

    _supplier_tables(spark, tmp_path)
    kept, d = ["ticker", "effective_date", "close"], str(tmp_path)
    straight = sorted(tb.closes(spark, d).select(*kept).collect())
    assert "lineitem" in " ".join(tb.closes(spark, d).inputFiles())
    tb.bars(spark, d)
    stored = tb.closes(spark, d)
    assert all("daily-bars" in f for f in stored.inputFiles()) and sorted(stored.select(*kept).collect()) == straight


def test_contradictions_store_the_columns_of_their_pairs_only(spark, tmp_path):
    from plumbline import session
    from plumbline.plans import catalogue
    from plumbline.plans.feature_plans import wide
    from plumbline.plans.governance_plans import PAIRS, pair_rows

    _supplier_tables(spark, tmp_path)
    d, before = str(tmp_path), set(session._STORED)
    plan = catalogue()["contradiction_counts"]
    got = sorted(plan.run(spark, d).collect())
    assert [k[1] for k in set(session._STORED) - before] == ["pair-features"]
    assert set(pair_rows(spark, d).columns) == {f for p in PAIRS for f in p} | {"ret_fwd_10d"}
    assert wide(spark, d).count() == pair_rows(spark, d).count()
    assert sorted(plan.run(spark, d).collect()) == got and sum(r.high_hits + r.low_hits for r in got) > 0  # from the stored features


def test_data_health_needs_the_returns_only(spark, tmp_path):
    from plumbline import session
    from plumbline.plans.feature_plans import wide
    from plumbline.plans.store_plans import health

    _supplier_tables(spark, tmp_path)
    spark.range(60).selectExpr(
        "id AS o_orderkey", "date_add(DATE '2024-01-20', CAST(id AS INT)) AS o_orderdate", "'1-URGENT' AS o_orderpriority", "CAST(id AS DOUBLE) AS o_totalprice",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).selectExpr("id AS event_id", "id % 3 AS user_id", "TIMESTAMP '2024-02-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    d, before = str(tmp_path), set(session._STORED)
    straight = sorted(map(str, health(spark, d).collect()))
    assert set(session._STORED) == before and len(straight) == 3
    wide(spark, d)
    assert sorted(map(str, health(spark, d).collect())) == straight
