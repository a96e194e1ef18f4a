"""Vector codes against a plain version that compares every part with every entry, and against SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from plumbline.llm import vector_codes
from plumbline.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, near long, x int, place string"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, code, error) and the digest of the codebooks, in Python integers."""
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((vec_id, label, [math.floor(4096 * c) for c in v]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = next((len(r[2]) for r in kept if r[2]), 0)
    fit = [r for r in kept if dim and len(r[2]) == dim]
    cut = [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]
    books = [[r[2][a:b] for r in fit[:entries]] for a, b in cut]

    def nearest(p, v):
        a, b = cut[p]
        return min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, r[2])[1] for p in range(parts)] for r in fit]
        for p, (a, b) in enumerate(cut):
            for e in range(len(books[p])):
                mine = [r[2][a:b] for r, f in zip(fit, found) if f[p] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    out = []
    for vec_id, label, v in kept:
        each = [nearest(p, v) for p in range(parts)] if dim and len(v) == dim else None
        out.append((vec_id, label, "".join(f"{e:02x}" for _, e in each) if each else None, sum(d for d, _ in each) if each else None))
    numbers = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(numbers.encode()).hexdigest()


def as_query(rows, parts=8, entries=16, rounds=6):
    out, digest = plain(rows, parts, entries, rounds)
    total = {}
    for _, label, _, error in out:
        if error is not None:
            total[label] = total.get(label, 0) + error
    return sorted(((i, c, e, total.get(label), digest) for i, label, c, e in out), key=str)


def odd_vectors(n=60, dim=24, seed=5):
    """Few distinct values, so that distances tie; hot, null and repeated ids and labels; vectors of every bad kind."""
    draw = np.random.default_rng(seed)
    rows = [(k, [float(c) / 4 for c in draw.integers(-3, 4, dim)], int(draw.integers(0, 3)) if k % 4 else None) for k in range(n)]
    rows += [rows[3], rows[3], (5, rows[4][1], 2), (None, rows[2][1], 1), (None, rows[1][1], None)]
    rows += [(90, None, 1), (91, [], 1), (92, [0.5] * (dim - 1), 2), (-5, [None] + [0.1] * (dim - 1), 0)]
    rows += [(-4, [float("nan")] * dim, 0), (-3, [float("inf")] + [0.0] * (dim - 1), 0), (-2, [-0.00001] * dim, 0)]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1, 2, "here") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_codes_are_those_of_full_rescans(spark, seed):
    rows = odd_vectors(seed=seed)
    assert run(spark, rows) == as_query(rows)


def test_codes_do_not_depend_on_partitions(spark):
    rows = odd_vectors(seed=8)
    df = spark.createDataFrame([(*r, "clash", 1, 2, "here") for r in rows[::-1]], SCHEMA).repartition(7)
    assert sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=str) == as_query(rows)


def test_few_rows_and_widths_that_differ(spark):
    rows = odd_vectors(n=5, dim=11, seed=7)[:7]
    assert run(spark, rows) == as_query(rows)
    assert run(spark, rows, parts=3, entries=4, rounds=2) == as_query(rows, 3, 4, 2)
    assert run(spark, [(1, [0.5], 1), (2, [], None)]) == as_query([(1, [0.5], 1), (2, [], None)])


def test_tables_without_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 2)]) == []
    assert [r[:4] for r in run(spark, [(1, [], 2)])] == [(1, None, None, None)]


def test_components_beyond_the_bound_end_the_job(spark):
    with pytest.raises(Exception, match="2\\^26"):
        run(spark, [(1, [1e9] * 8, 1)])


def test_kept_distances_give_what_a_rescan_gives():
    """One assignment after entries moved, for every pattern of moved entries, with many ties."""
    draw = np.random.default_rng(3)
    for _ in range(200):
        x, before = draw.integers(-2, 3, (40, 2)), draw.integers(-2, 3, (6, 2))
        none = np.full(40, -1)
        code, near = vector_codes.assign(x, before, none, np.zeros(40, dtype=np.int64), np.ones(6, dtype=bool))
        after = np.where(draw.random((6, 1)) < 0.4, draw.integers(-2, 3, (6, 2)), before)
        got = vector_codes.assign(x, after, code, near, (after != before).any(axis=1))
        full = ((x[:, None] - after[None]) ** 2).sum(axis=2)
        assert (got[0] == full.argmin(axis=1)).all() and (got[1] == full.min(axis=1)).all()


def test_vectors_come_back_near(spark):
    rows = [(k, [float(c) for c in np.random.default_rng(k % 10).normal(0, 1, 16)], 0) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.fit(df)
    got = {r.vec_id: r.vector for r in vector_codes.decoded(coded, books).collect()}
    near = {r.vec_id: sum(r.near) for r in coded.collect()}
    for k, v, _ in rows:
        whole = np.floor(np.array(v) * 4096)
        assert np.isclose(((whole - np.array(got[k]) * 4096) ** 2).sum(), near[k])


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op11_vector_codes"](spark, SF_DIR).collect())) == sorted(con.sql(SQL["op11_vector_codes"]).fetchall())
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", odd_vectors())
    assert sorted(con.sql(SQL["op11_vector_codes"]).fetchall(), key=str) == as_query(odd_vectors())
