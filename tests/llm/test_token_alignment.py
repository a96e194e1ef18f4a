"""Aligned tokens against a plain version in Python loops, and both encoders against their libraries."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import token_alignment
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import no_documents, odd_documents

SF_DIR = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(BYTES, PIECES)


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = token_alignment.byte_characters()
    entries = {k: bytes(shown[c] for c in t) for t, k in json.load(open(BYTES))["model"]["vocab"].items() if not t.startswith("<|")}

    def piece(k):
        return bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()

    def groups(text):
        whole = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [entries[k] for k in ids_a], [piece(k) for k in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []

        def ends(parts):
            return [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 400 else np.cumsum(list(map(len, parts))).tolist()

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        shared, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in shared:
            left, right = [], []
            while i < len(ids_a) and ends_a[i] <= end:
                left.append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends_b[j] <= end:
                right.append(ids_b[j])
                j += 1
            out.append((left, right))
        return out

    return groups


def by_loops(rows, plain):
    """The contract in plain loops over all link occurrences."""
    cut = [(doc_id, plain(text)) for doc_id, text in rows]
    count = Counter()
    for _, groups in cut:
        count.update({(x, y) for left, right in groups for x in left for y in right})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in cut:
        links = [(x, y) for left, right in groups for x in left for y in right]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def run(docs):
    return sorted(map(tuple, token_alignment.alignment(docs, BYTES, PIECES).collect()), key=str)


def test_query_is_what_loops_give(spark, plain):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op13_token_alignment"](spark, SF_DIR).collect()), key=str) == by_loops(rows, plain)


def test_odd_texts(spark, plain):
    docs = odd_documents(spark)
    more = ["a\x00b", "  two  spaces ", "▁ mark", "<s> </s> <unk> <0x41>", "xyx" * 50, "ab" * 3000, "ﬁne  x", "\n\n\t", "é"]
    extra = docs.sparkSession.createDataFrame([(100 + k, t, *[None] * 6) for k, t in enumerate(more)], docs.schema)
    docs = docs.unionByName(extra)
    assert run(docs) == by_loops([(r.doc_id, r.text) for r in docs.collect()], plain)
    assert run(docs.repartition(9)) == run(docs)


def test_table_without_rows_or_texts(spark):
    assert run(no_documents(spark)) == []
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert run(docs) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_every_character_is_cut_as_by_the_library(aligner):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 0x4000):
        texts = [f" a{chr(c)}B1{chr(c) * 2}. {chr(c)}  {chr(c)}'s\n" for c in points[lo : lo + 0x4000]]
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [aligner.a.encode(t) for t in texts] == want
    text = " <|endoftext|> it's<|endoftext|>"
    assert aligner.a.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pairs_of_a_long_group_are_counted_before_they_are_made(aligner):
    """Random groups: distinct pairs times their counts are all pairs of occurrences."""
    draw = random.Random(4)
    for _ in range(30):
        size = draw.randint(1, 6)
        a, b = [[draw.randint(0, 3) for _ in range(draw.randint(1, 5))] for _ in range(size)], [
            [draw.randint(0, 3) for _ in range(draw.randint(1, 5))] for _ in range(size)
        ]
        wanted = np.array([draw.random() < 0.7 for _ in range(size)])
        flat = [np.array([t for g in side for t in g], dtype=np.int64) for side in (a, b)]
        group = [np.repeat(np.arange(size), list(map(len, side))) for side in (a, b)]
        got = Counter()
        for g, x, y, n in zip(*map(np.ndarray.tolist, aligner._pairs(wanted, group[0], flat[0], group[1], flat[1]))):
            got[g, x, y] += n
        assert got == Counter((g, x, y) for g in range(size) if wanted[g] for x in a[g] for y in b[g])


def test_groups_and_counts_as_tables(spark, plain):
    docs = odd_documents(spark).filter("doc_id > 2 AND doc_id <> 8")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in token_alignment.aligned_groups(docs, BYTES, PIECES).collect()}
    assert got == {doc_id: plain(text) for doc_id, text in rows}
    count = Counter()
    for _, text in rows:
        count.update({(x, y) for left, right in plain(text) for x in left for y in right})
    found = token_alignment.pair_counts(docs, BYTES, PIECES).collect()
    assert len(found) == len(count) and {(r.a_id, r.b_id): r.n_docs for r in found} == dict(count)
