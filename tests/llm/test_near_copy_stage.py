"""The near-copy stage of the pipeline: links against brute force, and which row of a component stays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import shingle_copies
from plumbline.llm.common import table
from tests.llm.fixtures import DOCS, no_documents, odd_documents, sentence

SF_DIR = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_roots(texts):
    """Number of the first text of each text's component, from all pairs."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    links = []
    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 5 >= either * 4:
                links.append((i, j))
    while True:
        before = root[:]
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def edited(seed, n, changes):
    """A text of n unlike words and a copy with ``changes`` words replaced."""
    draw = np.random.default_rng(seed)
    words = [f"w{k}" for k in draw.integers(0, 10**6, n)]
    other = list(words)
    for k in draw.choice(n, changes, replace=False):
        other[k] = f"x{k}"
    return " ".join(words), " ".join(other)


def test_links_are_those_of_all_pairs(spark):
    texts = [r.text for r in table(spark, SF_DIR, "documents").collect()] + [r.text for r in odd_documents(spark).collect()]
    for seed in range(60):
        texts += edited(seed, 60 + 15 * seed, 1 + seed % 25)
    docs = spark.createDataFrame([(k, t, "en", "s", 1, None, None, None) for k, t in enumerate(texts)], DOCS)
    roots = plain_roots(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect())
    assert got == sorted(set(roots)) and len(got) < len(texts) - 30


def test_a_large_cell_in_blocks(spark, monkeypatch):
    whole = shingle_copies.rest_groups
    monkeypatch.setattr(shingle_copies, "rest_groups", lambda *args: whole(*args, most=8))
    words = edited(5, 200, 0)[0].split()
    texts = [" ".join([*words[:k], f"y{k}", *words[k + 1 :]]) for k in range(60)]
    docs = spark.createDataFrame([(k, t, None, None, 1, None, None, None) for k, t in enumerate(texts)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()] == [0]


@pytest.mark.parametrize("a, b, same", [(4, 5, True), (5, 4, True), (79, 100, False), (80, 100, True), (0, 0, True), (0, 1, False)])
def test_the_bound_is_exact(a, b, same):
    assert shingle_copies.alike(np.arange(a, dtype=np.uint64), np.arange(b, dtype=np.uint64)) == same


@pytest.mark.parametrize("how", [{}, {"most": 4}, {"most_bytes": 4000}])
def test_members_joined_to_the_smallest_still_meet_the_rest(spark, monkeypatch, how):
    """Chains: each text is near the next ones, few are near the smallest set of their cell."""
    whole = shingle_copies.rest_groups
    monkeypatch.setattr(shingle_copies, "rest_groups", lambda *args: whole(*args, **how))
    texts = []
    for seed in range(6):
        words = edited(seed, 260, 0)[0].split()
        texts += [" ".join(words[4 * k : 4 * k + 150]) for k in range(20)]
    docs = spark.createDataFrame([(k, t, None, None, 1, None, None, None) for k, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect())
    assert got == sorted(set(plain_roots(texts)))


def test_columns_with_the_names_of_helpers_come_back(spark):
    names = ["_text", "_row", "_doc", "node", "root", "first", "size", "key", "keys", "rest", "shingles"]
    docs = odd_documents(spark)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in kept.collect()) and kept.count() > 5


def test_no_documents(spark):
    assert corpus_pipeline.drop_near_copies(spark, no_documents(spark), SF_DIR).count() == 0


def test_texts_of_null_and_repeated_ids(spark):
    text = [edited(k, 80, 0)[0] for k in range(6)]
    near = text[0].split()
    near = " ".join([*near[:79], "other"])
    rows = [(None, t, "en", "s", 1, None, None, None) for t in text[:4]]
    rows += [(None, near, "en", "s", 1, None, None, None), (9, text[4], "en", "s", 1, None, None, None)]
    rows += [(9, text[5], "en", "s", 1, None, None, None), (9, text[5], "en", "s", 1, None, None, None)]
    rows += [(7, text[3], "en", "s", 1, None, None, None), (8, text[3], "en", "s", 1, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = [
        sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(n), SF_DIR).collect())
        for n in (1, 5)
    ]
    assert found[0] == found[1]  # the same row of a component in every run
    assert len(found[0]) == 6
    got = set(found[0])
    assert {(0, text[1]), (0, text[2]), (9, text[4]), (9, text[5]), (7, text[3])} < got
    assert len(got & {(0, text[0]), (0, near)}) == 1


def test_sets_of_linked_fingerprints_meet(spark):
    """SimHash alone brings near copies together; what it brings together is still compared exactly."""
    texts = [t for seed in range(4) for t in edited(seed, 2500, 1)] + ["one two", "a b c d e f", None]
    docs = spark.createDataFrame([(k, t, None, None, 1, None, None, None) for k, t in enumerate(texts)], DOCS)
    every = shingle_copies.sketched(docs)
    without = every.withColumn("keys", F.array().cast("array<long>"))
    bits = {r.doc_id: r.bits for r in every.collect()}
    near = [k for k in range(0, 8, 2) if bin((bits[k] ^ bits[k + 1]) & (2**64 - 1)).count("1") <= 3]
    nodes = {r.doc_id: r.node for r in every.collect()}
    got = {r.node: r.root for r in shingle_copies.roots(docs, without).collect()}
    assert near and got == {max(nodes[k], nodes[k + 1]): min(nodes[k], nodes[k + 1]) for k in near}
    far = every.withColumn("keys", F.array().cast("array<long>")).withColumn("bits", F.lit(5).cast("long"))
    assert len(shingle_copies.roots(docs, far).collect()) == 4
