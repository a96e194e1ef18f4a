"""Candidates through the gate: reports, promotion, what is validated, and changes next to each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import gate as gt
from plumbline.operators import regime as rg
from plumbline.sources import versioned

MODELS = "series_id string, k int, log_likelihood double"
GRADED = "series_id string, sharpe double, p30 double, deflated_sharpe double, n_trials int"


def book_of(spark, tmp_path):
    return gt.ModelRegistry(spark, str(tmp_path / "registry"))


def state(book):
    return {r.model_id: (r.validation_status, r.walk_forward_sharpe, r.retired_reason) for r in book.rows().collect()}


def test_only_what_passes_is_promoted(spark, tmp_path):
    book = book_of(spark, tmp_path)
    fitted = spark.createDataFrame([("A", 2, -5.0), ("B", 3, -6.0), ("C", 2, -7.0), ("D", 2, -8.0)], MODELS)
    graded = spark.createDataFrame([("A", 0.5, 0.1, 0.0, 2000), ("B", 0.49, 0.1, 0.9, 2000), ("C", 2.0, 0.1, -0.1, 2000)], GRADED)
    new = gt.candidates(fitted, 3, "2024-02-01")
    book.register(new)
    reports = gt.gate_reports(new, graded, "2024-02-02")
    assert {r.app_mode: r.passed for r in reports.collect()} == {"A": True, "B": False, "C": False, "D": False}
    book.promote(reports, "2024-02-02")
    assert state(book) == {
        "A-k2": ("lite_survivorship", 0.5, None), "B-k3": ("candidate", None, None), "C-k2": ("candidate", None, None), "D-k2": ("candidate", None, None)
    }
    assert [r.series_id for r in book.validated().collect()] == ["A"]
    # The next candidate that passes takes over, and the gate run again changes nothing.
    later = gt.candidates(fitted.where("series_id = 'A'").withColumn("k", F.lit(4)), 3, "2024-03-01")
    book.register(later)
    assert book.validated().count() == 0  # the newest model of the mode is not yet promoted
    for _ in range(2):
        book.promote(gt.gate_reports(later, graded, "2024-03-02"), "2024-03-02")
        assert state(book)["A-k2"][2] == "superseded" and state(book)["A-k4"][0] == "lite_survivorship"
        assert [r.series_id for r in book.validated().collect()] == ["A"]
    # A model that is registered again is a candidate again.
    book.register(later)
    assert state(book)["A-k4"] == ("candidate", None, None)
    assert book.rows(version=1).count() == 4


def test_two_promotions_next_to_each_other_both_count(spark, tmp_path, monkeypatch):
    book = book_of(spark, tmp_path)
    fitted = spark.createDataFrame([("A", 2, -5.0), ("B", 2, -6.0)], MODELS)
    graded = spark.createDataFrame([("A", 1.0, 0.1, 0.5, 2000), ("B", 1.0, 0.1, 0.5, 2000)], GRADED)
    new = gt.candidates(fitted, 3, "2024-02-01")
    book.register(new)
    reports = gt.gate_reports(new, graded, "2024-02-02")
    create, waiting = versioned.create_once, [reports.where("app_mode = 'B'")]

    def slow(session, place, text):
        if waiting:
            book.promote(waiting.pop(), "2024-02-03")
        return create(session, place, text)

    monkeypatch.setattr(versioned, "create_once", slow)
    book.promote(reports.where("app_mode = 'A'"), "2024-02-02")
    assert {m: s[0] for m, s in state(book).items()} == {"A-k2": "lite_survivorship", "B-k2": "lite_survivorship"}


def test_what_is_said_of_a_model(spark):
    rows = spark.createDataFrame([(True, 1.0), (False, 0.314), (False, None)], "v boolean, s double")
    got = [r[0] for r in rows.select(rg.disclosure(F.col("v"), F.col("s"))).collect()]
    assert got[0] is None and "Sharpe 0.31 < 0.50 floor;" in got[1] and "has not passed Layer 0 predictive sign-off;" in got[2]
