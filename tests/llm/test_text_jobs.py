"""Tokens, shards, archives, fingerprints: against the libraries, brute force and exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from plumbline.llm import piecewise, simhash, speculative_bpe, token_shards, warc
from plumbline.llm.chunks import ChunkEncoder, forget
from plumbline.llm.queries import QUERIES
from tests.llm.fixtures import no_documents, odd_documents

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return speculative_bpe.SpeculativeBpe(PATH)


def texts_of(name="documents"):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/{name}.parquet'").fetchall())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


# ---- BPE --------------------------------------------------------------------------------------


def test_tokens_are_those_of_the_library(spark, library):
    rows = QUERIES["op4_speculative_bpe"](spark, SF_DIR).collect()
    texts = texts_of()
    assert len(rows) == len(texts)
    assert all(tuple(r)[1:] == digests(library, texts[r.doc_id]) for r in rows)


def test_tokens_of_odd_texts(spark, library):
    docs = odd_documents(spark)
    want = sorted(digests(library, r.text) for r in docs.collect())
    assert sorted(tuple(r)[1:] for r in speculative_bpe.token_digests(docs, PATH).collect()) == want
    assert speculative_bpe.token_digests(no_documents(spark), PATH).count() == 0


def test_ids_and_text_go_round(spark, library):
    docs = odd_documents(spark).filter("doc_id > 5")
    tokens = speculative_bpe.token_ids(docs, PATH)
    got = {r.doc_id: r.text for r in speculative_bpe.decoded_text(tokens, PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == library.decode(ids, skip_special_tokens=False)


def test_every_kind_of_character(library, bpe):
    encode = ChunkEncoder(bpe.encode_chunks)
    for lo in range(0, 0x30000, 0x4000):
        texts = ["a" + chr(c) + "B" + chr(c) * 2 + "." for c in range(lo, lo + 0x4000) if not 0xD800 <= c < 0xE000]
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        got = [e.tolist() for e in encode.each(pa.array(texts))]
        assert got == want


def test_seams_say_which_words_need_exact_merging(bpe):
    draw = random.Random(3)
    words = ["".join(draw.choice("thenigraos") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    exact = bpe.merge_exactly(words)
    flat = [(a, b) for w in exact for a, b in zip(w, w[1:])]
    assert bpe.compatible(*map(np.array, zip(*flat))).all()
    proposed = [bpe.propose(w) for w in words]
    for p, e in zip(proposed, exact):
        passes = len(p) == 1 or bpe.compatible(np.array(p[:-1]), np.array(p[1:])).all()
        assert passes == (p == e)
    assert [bpe._merge_long(bpe.letters(w)) for w in words] == exact


def test_long_words_and_a_full_memory(library, bpe):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdeth") for _ in range(n)) for n in (63, 64, 65, 66, 700, 20_000)]
    encode = ChunkEncoder(bpe.encode_chunks, remembered=3)
    for w in words * 2:
        assert encode(pa.array([w]))[0].tolist() == library.encode(w, add_special_tokens=False).ids
    known = {b"a": 1, b"bb": 2, b"cccc": 3, b"ddddd": 4}
    forget(known, 3)
    assert set(known) == {b"a", b"bb"}


# ---- shards -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_byte_code_goes_round(n):
    draw = np.random.default_rng(n)
    ranks = draw.choice([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], n).astype("<u4")
    control, data = token_shards.pack(ranks)
    assert len(control) == -(-n // 4)
    assert token_shards.unpack(control, data, n).tolist() == ranks.tolist()


def test_library_encoder_takes_any_chunk(library):
    encode, _ = token_shards._encoder(PATH)
    for text in ("İi. ΑΣ ΣΑΣ, x's' oreng's 'Ll ab--", "é. ﬁ Å Å. H̱h", "<|endoftext|>A <|ENDOFTEXT|>", "日本語。 ab\x1cc\u0085d", "a" * 400):
        assert encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_hold_all_ids_in_order(spark, library):
    texts, start, want = texts_of(), 0, {}
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = QUERIES["op5_token_shards"](spark, SF_DIR).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_shards_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 4096)  # several shards
    docs = odd_documents(spark)
    rows = sorted(token_shards.shard_round_trip(docs, PATH).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert token_shards.shard_round_trip(no_documents(spark), PATH).count() == 0


# ---- archives ---------------------------------------------------------------------------------


def pages_frame(spark):
    draw = random.Random(1)
    long = "".join(draw.choice("<p>äö\r\n\r\nWARC/1.1 x") for _ in range(60_000))
    copy = "c" * 1000
    rows = [
        (1, "http://a/", long, "x"), (2, None, None, "x"), (3, "http://b/\r\nq: 1", "", None), (4, "u", copy, "x"), (5, "u", copy, "x"),
        (9, "u", copy, "x"), (9, "u", copy, "x"), (None, "u", copy, "x"), (6, "u", "short", "x"), (7, "u", "short", "x"),
        (8, "u", "c" * 999, "x"), (11, "u", "c" * 999, "x"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives_go_round(spark):
    pages = pages_frame(spark)
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=str)
    want = []
    for page_id, _, html, _ in pages.collect():
        payload = (html or "").encode()
        to = 9 if html == "c" * 1000 and page_id != 9 else None
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.archive_round_trip(empty).count() == 0


def test_segments_are_cut_put_together_and_checked():
    payload = bytes(range(256)) * 300
    digest = hashlib.sha1(payload).hexdigest()
    records = warc.page_records("7:0.0", 7, "http://a/", payload, digest, None, segment=5000)
    archive = b"".join(r + b"\r\n\r\n" for r in records)
    found = list(warc.split_records(archive))
    assert len(found) == len(records) > 10
    assert {f["warc-type"] for f, _ in found[1:]} == {"continuation"}
    assert all(f["warc-segment-origin-id"] == found[0][0]["warc-record-id"] for f, _ in found[1:])
    block = b"".join(b for _, b in found)
    assert len(block) == int(found[-1][0]["warc-segment-total-length"])
    assert warc.payload_of(block) == payload
    with pytest.raises(ValueError):
        list(warc.split_records(archive[:-30]))
    with pytest.raises(ValueError):
        warc._checked(block.replace(b"\x01\x02", b"\x02\x02", 1), f"sha1:{digest}")


def test_a_missing_or_short_segment_is_an_error():
    kind = pa.list_(pa.struct([("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())]))
    one, two = ({"number": k, "total": t, "digest": "sha1:x", "block": b"ab"} for k, t in ((1, None), (2, 5)))
    for segments in ([two], [one, two]):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([segments], kind)], ["page_id", "segments"])
        with pytest.raises(ValueError):
            list(warc._reassemble(iter([batch])))


def test_archive_files_are_archives(spark, tmp_path):
    warc.write_archives(pages_frame(spark), f"{tmp_path}/w")
    kinds = []
    for f in sorted((tmp_path / "w").glob("part-*")):
        kinds += [r["warc-type"] for r, _ in warc.split_records(gzip.decompress(f.read_bytes()))]
    assert kinds.count("revisit") == 3 and kinds.count("response") == 9 and kinds.count("continuation") > 3


# ---- SimHash ----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, bits, distance=3):
    """Smallest id reachable; a null id stands for none."""
    bits = np.array(bits, dtype=np.uint64)
    root = list(range(len(bits)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits) <= distance):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    least = {}
    for k in range(len(bits)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return [least.get(find(k)) for k in range(len(bits))]


def check_near_copies(rows, texts):
    bits = [plain_fingerprint(t) for _, t in texts]
    want = sorted(zip((i for i, _ in texts), (f"{b:016x}" for b in bits), plain_components([i for i, _ in texts], bits)), key=str)
    assert sorted(map(tuple, rows), key=str) == want


def test_near_copies_of_supplied_and_odd_texts(spark):
    check_near_copies(QUERIES["op8_simhash_near_copies"](spark, SF_DIR).collect(), list(texts_of().items()))
    docs = odd_documents(spark)
    check_near_copies(simhash.near_copies(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_copies(no_documents(spark)).count() == 0
    assert [tuple(r) for r in simhash.near_copies(docs.filter("doc_id = 1")).collect()] == [(1, "0" * 16, 1)]


def dense_bits(n=3000, seed=2):
    """A large group within a few bits of each other, chains, and others."""
    draw = np.random.default_rng(seed)
    centre, out = 0x0123456789ABCDEF, []
    for _ in range(n // 2):
        x = centre
        for b in draw.choice(64, draw.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    x = int(draw.integers(1 << 62))
    for k in range(60):
        x ^= 7 << k  # a chain
        out.append(x)
    return out + [int(v) for v in draw.integers(0, 1 << 63, n - len(out), dtype=np.int64)]


@pytest.mark.parametrize("index", [None, "four", "two", "three"])
def test_links_connect_what_brute_force_connects(spark, index, monkeypatch):
    from plumbline.llm import blocks
    from plumbline.llm.components import components

    bits = sorted(set(dense_bits()))
    signed = [simhash._signed(b) for b in bits]
    array = np.array(bits, dtype=np.uint64)
    whole = list(range(64))
    chosen = {
        None: simhash.plan_index(array[:: len(array) // 500], len(array)),
        "four": [(whole[k::4], 0) for k in range(4)], "two": [(whole[:32], 1), (whole[32:], 1)],
        "three": [(whole[:20], 0), (whole[20:44], 1), (whole[44:], 0)],
    }[index]
    assert sum(t + 1 for _, t in chosen) == 4
    small = blocks.cell_groups
    monkeypatch.setattr(simhash, "cell_groups", lambda rows, cell, row: small(rows, cell, row, most=64))
    distinct = spark.createDataFrame([(b,) for b in signed], "bits long")
    stars = {r.node: r.root for r in components(simhash.links(distinct, chosen), "node", "root").collect()}
    mine = {}
    for b in signed:
        mine.setdefault(stars.get(b, b), set()).add(b)
    plain = {}
    for b, c in zip(signed, plain_components(signed, bits)):
        plain.setdefault(c, set()).add(b)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_thresholds_are_allotted_at_least_cost():
    costs = [[0, 5, 50], [0, 1, 2], [0, 9, 90]]
    best = min(
        (costs[0][a] + costs[1][b] + costs[2][c], [a - 1, b - 1, c - 1])
        for a in range(3) for b in range(3) for c in range(3) if a + b + c == 4
    )
    assert simhash.allot(costs, 4) == best
    assert simhash.allot([[0, 1]], 4)[0] == float("inf")


# ---- piecewise hashing ------------------------------------------------------------------------


def plain_near_edits(rows):
    """rows: (doc_id, text) in the order of the job."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((
            doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), piecewise.fingerprint(text.encode()),
            piecewise.fingerprint(changed.encode()),
        ))
    return out


def test_edits_and_fingerprints(spark):
    rows = QUERIES["op10_piecewise_hashes"](spark, SF_DIR).collect()
    want = plain_near_edits(sorted(texts_of().items(), reverse=True))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    long = [r for r in rows if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_edits_of_odd_texts(spark):
    docs = odd_documents(spark).filter("doc_id IS NOT NULL")
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] or ""), reverse=True)
    rows = piecewise.near_edits(odd_documents(spark).filter("doc_id IS NOT NULL")).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(plain_near_edits(order))
    assert piecewise.near_edits(odd_documents(spark)).count() == docs.count() + 1
    assert piecewise.near_edits(no_documents(spark)).count() == 0
    only = piecewise.near_edits(docs.filter("doc_id = 6")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_fingerprints_change_near_an_edit_only(spark):
    draw = random.Random(6)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    pieces = [(text, text[:14000] + "XYZ" + text[14000:]), (text, text[14000:] + text[:14000]), (text, text), ("", ""), ("", text)]
    pairs = [(piecewise.fingerprint(a.encode()), piecewise.fingerprint(b.encode())) for a, b in pieces]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(piecewise.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] > 0.9 and got[2] == 1 and got[3] == 1 and got[4] == 0


def test_blocks_do_not_change_the_hash(monkeypatch):
    data = np.frombuffer(" ".join(str(k * k) for k in range(3000)).encode(), dtype=np.uint8)
    whole = piecewise.cuts(data, 6)
    monkeypatch.setattr(piecewise, "_BLOCK", 100)
    parts = piecewise.cuts(data, 6)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    assert piecewise.fingerprint(b"") == "3::"


def test_shards_past_part_99999_keep_their_order(spark, tmp_path):
    """Part numbers of six digits come after those of five, whatever their names' order as text."""
    os.makedirs(tmp_path / "shards")
    spark.createDataFrame([(k, k) for k in range(8)], "rank int, id int").write.parquet(f"{tmp_path}/ranks")
    parts = [("part-99998-a.txt", 3, [1, 2]), ("part-99999-a.txt", 5, [3]), ("part-100000-a.txt", 8, [4, 5, 6]), ("part-1000000-a.txt", 9, [7])]
    for name, doc_id, ranks in parts:
        with open(tmp_path / "shards" / name, "wb") as f:
            f.write(token_shards.as_record(doc_id, np.array(ranks, dtype=np.uint32)) + b"\n")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_shards.read_shards(spark, str(tmp_path)).collect())
    assert got == [(3, 0, 2), (5, 2, 1), (8, 3, 3), (9, 6, 1)]
