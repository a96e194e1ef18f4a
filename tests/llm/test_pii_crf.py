"""Personal data: patterns against plain regular expressions, the field against enumeration, spans on lines held out."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from plumbline.llm import pii_crf
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import no_documents, odd_documents

SF_DIR = "/root/testdata/sf0.001"
KINDS = list(pii_crf.KINDS)


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


def by_patterns(text):
    """The patterns as they are written down."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns_on_random_texts():
    draw = random.Random(1)
    for _ in range(6000):
        text = "".join(draw.choice("012345  ..--@@ab(+)é\n") for _ in range(draw.randint(0, 60)))
        assert pii_crf.base_spans(text) == by_patterns(text), text
    for text, _ in pii_crf.made_lines(["déjà", "word"], 400, seed=2):
        assert pii_crf.base_spans(text) == by_patterns(text), text
    for text in ("a" * 3000, "1" * 3000, "1." * 500, "a@" * 500, "000000255.1.1.0001", "1.1.1.256 " + "9" * 4000 + ".1.1.1"):
        assert pii_crf.base_spans(text) == by_patterns(text)


def test_long_runs_do_not_take_long(field):
    for text in ("a" * 400_000, "1" * 400_000, "1." * 5_000, "a@" * 20_000, "+" * 200_000, "at " * 60_000):
        pii_crf.all_spans(text, field)


def ways(lattice):
    """All ways to cut an island into segments, as lists of (start, end, kind)."""
    ending = {}
    for s, e, kinds, _ in lattice.segments:
        ending.setdefault(s, []).extend((e, y) for y in kinds)

    def after(t):
        if t == len(lattice.plain):
            yield []
            return
        for e, y in [(t + 1, pii_crf.NONE), *ending.get(t, [])]:
            for rest in after(e):
                yield [(t, e, y), *rest]

    return list(after(0))


def score(field, lattice, way):
    features = {(s, e): f for s, e, _, f in lattice.segments}
    total, before = 0.0, pii_crf.NONE
    for s, e, y in way:
        rows = [field.place[f] for f in (lattice.plain[s] if y == pii_crf.NONE else features[s, e]) if f in field.place]
        total += field.weight[rows, y].sum() + field.step[before, y]
        before = y
    return total


PIECES = ["+1 (017) 555-7713 7.8.9.10", "4 3012 9.8.7.6 1234567", "a.b@c.de", "x at y dot com", "(212) 555 1234", ""]


def test_best_cut_and_likelihood_are_those_of_enumeration():
    draw = np.random.default_rng(5)
    for text in PIECES:
        lattice = pii_crf.Lattice(text, 0, len(text))
        names = sorted({f for s in lattice.segments for f in s[3]} | {f for fs in lattice.plain for f in fs})
        field = pii_crf.SemiCrf(names)
        for _ in range(5):
            field.weight[:], field.step[:] = draw.normal(0, 1, field.weight.shape), draw.normal(0, 1, field.step.shape)
            every = ways(lattice)
            scores = [score(field, lattice, w) for w in every]
            best = every[int(np.argmax(scores))]
            want = [(y, lattice.starts[s], lattice.ends[e - 1]) for s, e, y in best if y != pii_crf.NONE]
            assert field.decode(lattice) == want
            gold = [w for w in every[-1] if w[2] != pii_crf.NONE]
            graph, weight, step = field.graph(lattice), np.zeros_like(field.weight), np.zeros_like(field.step)
            got = field.gradient(graph, gold, weight, step)
            total = max(scores) + math.log(sum(math.exp(v - max(scores)) for v in scores))
            assert math.isclose(got, scores[-1] - total, abs_tol=1e-9)
            for table, slope in ((field.weight, weight), (field.step, step)):
                for at in itertools.islice(zip(*np.nonzero(slope)), 0, 200, 37):
                    kept, move = table[at], 1e-5
                    table[at] = kept + move
                    up = field.gradient(graph, gold, np.zeros_like(weight), np.zeros_like(step))
                    table[at] = kept - move
                    down = field.gradient(graph, gold, np.zeros_like(weight), np.zeros_like(step))
                    table[at] = kept
                    assert math.isclose((up - down) / (2 * move), slope[at], abs_tol=1e-5)


def test_lines_held_out(field):
    right = wanted = found = 0
    for text, spans in pii_crf.made_lines("alpha Beta gamma déjà über año".split(), 500, seed=77):
        got = {(KINDS[y], s, e) for lo, hi in pii_crf.islands(text) for y, s, e in field.decode(pii_crf.Lattice(text, lo, hi))}
        right, wanted, found = right + len(got & set(spans)), wanted + len(spans), found + len(got)
    assert right >= 0.97 * wanted and right >= 0.97 * found


@pytest.mark.parametrize("text, want", [
    ("x 7536784127813050 4845168114407329 y", ["card:2:18", "card:19:35"]),
    ("x +1 (826) 555-4081 190.137.223.204 y", ["ip:20:35", "phone:2:19"]),
    ("write to jane.doe [at] example [dot] com!", ["email:9:40"]),
    ("call (212) 555-0199 now", ["phone:5:19"]),
    ("order 7536784127813051 of 2024-01-15", []),
    ("Version 2.0. Year 1999-2005, 12,345,678 items", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', []),
    ("thened at estien. Blenton. Thnt", []),
])
def test_what_the_field_adds(field, text, want):
    base, every = pii_crf.all_spans(text, field)
    assert set(base) <= set(every)
    checked = [f"{k}:{s}:{e}" for k, s, e in every if k != "card" or pii_crf.luhn(pii_crf.digits_of(text[s:e]))]
    assert checked == want and len(every) == len(want)


def test_query_against_patterns_and_clean_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_personal_data"](spark, SF_DIR).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        r, base = rows[doc_id], by_patterns(text or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        written = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}
        if not re.search(r"[0-9]{5}|[0-9][. -][0-9]|@", text or ""):
            assert r.spans == ""


def test_odd_documents(spark, field):
    docs = odd_documents(spark)
    got = sorted(map(tuple, pii_crf.personal_data(docs, field).collect()), key=str)
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r[1:] == (0, 0, 0, 0, none, "") for r in got)
    assert pii_crf.personal_data(no_documents(spark)).collect() == []


def test_redacted_texts(spark, field):
    docs = spark.createDataFrame([(1, "to a.b@c.de, +1 (826) 555-4081 10.0.0.1"), (2, None), (None, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_crf.redacted(docs, field).collect()}
    assert got == {1: "to [email], [phone] [ip]", 2: None, None: "plain"}
