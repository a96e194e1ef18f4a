"""Aligning the tokens of two tokenizers: byte offsets where both end cut a text into groups, pairs within a group are linked.

Both tokenizers cut the same bytes, a space and the text. A group with one token on
either side holds the same bytes twice, and nearly always the two ids are those that
a map made once from the two vocabularies names: A id to the B id of the same bytes.
Such links are told by the A id alone, so how many documents hold them is counted in
vectors as long as A's vocabulary, one per task. Only links that the map does not
name are exploded into rows (document, pair) and counted by a shuffle with map-side
combine.

Texts are cut once. A written table keeps, per document, the distinct A ids of the
identity links and the distinct other pairs, each with its number of occurrences;
the second pass reads counts into it: those of the identity links from a vector, the
others by a join on the pair, which AQE turns into a broadcast where its size is
small or splits where a pair is in a large part of the documents. In a group, equal
tokens are counted before pairs are made, so a long group costs its distinct ids.

Defined results: null and empty texts, and texts whose joined token bytes on either
side differ from space and text, have no tokens, zeros and '' for a digest; strings
of special tokens in a text are plain text; every row is returned and counted as a
document of its own, rows with null or repeated doc_id among them; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.common import bounded_batches
from plumbline.session import materialise

# Texts aligned at a time; a longer text is a batch of its own.
TEXT_BATCH_BYTES = 1 << 20
# How the byte-level tokenizer cuts a text before it merges bytes: its published pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level BPE vocabulary file; ``bytes`` of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, byte = spec["model"]["vocab"], byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, k in vocabulary.items():
            self.bytes[k] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        merges = (m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"])
        made = [vocabulary[m.replace(" ", "")] for m in merges]
        pre = spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if plain and made == sorted(set(made)) and not spec["model"].get("ignore_merges"):
            # Ids in the order of the merges are ranks: the faster of two encoders with equal results.
            ranks = {b: k for k, b in enumerate(self.bytes) if b and k not in special.values()}
            self.encode = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A sentencepiece model file; ``bytes`` of every id, U+2581 standing for a space."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.fallback = [self._model.is_byte(k) for k in ids]
        self.bytes = [
            bytes([int(self._model.id_to_piece(k)[3:5], 16)]) if self.fallback[k]
            else self._model.id_to_piece(k).replace("▁", " ").encode() for k in ids
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Aligned(NamedTuple):
    """Texts cut into groups; lists of one text stand at [at[k], at[k + 1])."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    own: np.ndarray
    own_n: np.ndarray
    own_at: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    pair_at: np.ndarray


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the exact sums of their weights."""
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(weight, first) if len(first) else weight


def _widths(values: list[bytes]) -> np.ndarray:
    return np.array(list(map(len, values)), dtype=np.int64)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.width_a, self.width_b = _widths(self.a.bytes), _widths(self.b.bytes)
        # The B id of the same bytes, a whole piece before a single byte; -1 where there is none.
        by_bytes = {v: k for k, v in reversed(list(enumerate(self.b.bytes))) if self.b.fallback[k]}
        by_bytes |= {v: k for k, v in reversed(list(enumerate(self.b.bytes))) if not self.b.fallback[k]}
        self.same = np.array([by_bytes.get(v, -1) if v else -1 for v in self.a.bytes], dtype=np.int64)
        # How an id is written: within a side, at the end of side A, at the end of a group.
        self._shown = [
            *(b"%d," % k for k in range(len(self.a.bytes))), *(b"%d|" % k for k in range(len(self.a.bytes))),
            *(b"%d," % k for k in range(len(self.b.bytes))), *(b"%d;" % k for k in range(len(self.b.bytes))),
        ]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers, none where the bytes of either are not those of space and text."""
        a = [self.a.encode(" " + t) if t else [] for t in texts]
        b = self.b.encode([t or "" for t in texts])
        for k, text in enumerate(texts):
            whole = (" " + text).encode() if text else b""
            if b"".join(map(self.a.bytes.__getitem__, a[k])) != whole or b"".join(map(self.b.bytes.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group number of each token of A and of B; texts that follow each other may be given as one."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)

    def align(self, texts: list[str | None]) -> Aligned:
        of_a, of_b = self.tokens(texts)
        n, size_b = len(texts), len(self.b.bytes)
        n_a, n_b = np.array(list(map(len, of_a)), dtype=np.int64), np.array(list(map(len, of_b)), dtype=np.int64)
        a = np.fromiter((t for ids in of_a for t in ids), dtype=np.int64, count=n_a.sum())
        b = np.fromiter((t for ids in of_b for t in ids), dtype=np.int64, count=n_b.sum())
        group_a, group_b = self.groups(a, b)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text = np.repeat(np.arange(n), n_a)[first_a]  # of each group
        # Identity links: one token on either side, and the map names the pair.
        known = (in_a == 1) & (in_b == 1)
        known[known] = self.same[a[first_a[known]]] == b[first_b[known]]
        at, left, right, times = self._pairs(~known, group_a, a, group_b, b)
        named = self.same[left] == right
        own, own_n = _summed(
            np.concatenate([text[known] * len(self.same) + a[first_a[known]], text[at[named]] * len(self.same) + left[named]]),
            np.concatenate([np.ones(np.count_nonzero(known), dtype=np.int64), times[named]]),
        )
        other = ~named
        pair, pair_n = _summed((text[at[other]] * len(self.same) + left[other]) * size_b + right[other], times[other])
        of_pair, left, right = pair // size_b // len(self.same), pair // size_b % len(self.same), pair % size_b
        return Aligned(
            n_a, n_b, np.bincount(text, minlength=n), np.bincount(text, in_a * in_b, minlength=n).astype(np.int64),
            self._digests(n_a + n_b, a, b, group_a, group_b, first_b, first_a + in_a),
            own % len(self.same), own_n, np.searchsorted(own // len(self.same), np.arange(n + 1)),
            left << 32 | right, pair_n, np.searchsorted(of_pair, np.arange(n + 1)),
        )

    def _pairs(self, wanted, group_a, a, group_b, b):
        """Distinct pairs of each wanted group: group, A id, B id, how many times."""
        sides = []
        for group, ids, size in ((group_a, a, len(self.a.bytes)), (group_b, b, len(self.b.bytes))):
            mine = wanted[group]
            key, times = _summed(group[mine] * size + ids[mine], np.ones(np.count_nonzero(mine), dtype=np.int64))
            sides.append((key // size, key % size, times))
        (ga, ia, ta), (gb, ib, tb) = sides
        start, end = np.searchsorted(gb, ga), np.searchsorted(gb, ga, side="right")
        left = np.repeat(np.arange(len(ga)), end - start)
        right = np.arange(len(left)) - np.repeat(np.cumsum(end - start) - end, end - start)
        return ga[left], ia[left], ib[right], ta[left] * tb[right]

    def _digests(self, lengths, a, b, group_a, group_b, before_b, after_a) -> list[str]:
        """SHA-256 of the groups as text, for each text."""
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        # A token comes after all tokens of the groups before, and B's after A's of the same group.
        shown[np.arange(len(a)) + before_b[group_a]] = a + size_a * (np.diff(group_a, append=-1) != 0)
        shown[np.arange(len(b)) + after_a[group_b]] = 2 * size_a + b + size_b * (np.diff(group_b, append=-1) != 0)
        out, end = [], 0
        for length in lengths.tolist():
            start, end = end, end + length
            whole = b"".join(map(self._shown.__getitem__, shown[start:end].tolist()))
            out.append(hashlib.sha256(whole[:-1]).hexdigest() if whole else "")
        return out


@lru_cache(maxsize=2)
def _worker(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_CUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "own array<int>, own_n array<long>, pair array<long>, pair_n array<long>"
)


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def cut_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One written row per document: its counts, digest, identity links and other pairs, and a number of its own."""
    bounded_batches(docs.sparkSession, TEXT_BATCH_BYTES)

    def run(batches):
        aligner = _worker(byte_path, piece_path)
        for batch in batches:
            r = aligner.align(batch.column("text").to_pylist())
            counts = [pa.array(v, pa.int64()) for v in (r.n_a, r.n_b, r.n_groups, r.n_links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(r.digests, pa.string()),
                 _lists(r.own_at, r.own, pa.int32()), _lists(r.own_at, r.own_n, pa.int64()),
                 _lists(r.pair_at, r.pair, pa.int64()), _lists(r.pair_at, r.pair_n, pa.int64())],
                [c.split()[0] for c in _CUT.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CUT)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned-texts")


def _own_counts(batches, size: int):
    """Documents of the task per A id of their identity links."""
    count = np.zeros(size, dtype=np.int64)
    for batch in batches:
        count += np.bincount(batch.column("own").flatten().to_numpy(zero_copy_only=False), minlength=size)
    found = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(count[found], pa.int64())], ["a_id", "n_docs"])


def counts_of(cut: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents per identity link (a_id, n_docs; at most one row per id) and per other pair (pair, n_docs)."""
    own = cut.select("own").mapInArrow(lambda batches: _own_counts(batches, size), "a_id int, n_docs long")
    own = own.groupBy("a_id").agg(F.sum("n_docs").alias("n_docs"))
    pairs = cut.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    return materialise(own, "identity-counts"), materialise(pairs, "pair-counts")


def _left(pair):
    return F.shiftright(pair, 32).cast("int")


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """a_id, b_id, n_docs: how many documents link the two ids, for all pairs that any document links."""
    same = _worker(byte_path, piece_path).same
    own, pairs = counts_of(cut_texts(docs, byte_path, piece_path), len(same))
    named = docs.sparkSession.createDataFrame([(k, b) for k, b in enumerate(same.tolist()) if b >= 0], "a_id int, b_id int")
    return own.join(named, "a_id").select("a_id", "b_id", "n_docs").unionByName(
        pairs.select(_left("pair").alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n_docs")
    )


def aligned_groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id and its groups, each with the ids of either side in order."""
    bounded_batches(docs.sparkSession, TEXT_BATCH_BYTES)

    def run(batches):
        aligner = _worker(byte_path, piece_path)
        for batch in batches:
            out = []
            for a, b in zip(*aligner.tokens(batch.column("text").to_pylist())):
                of_a, of_b = aligner.groups(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
                count = int(of_a[-1]) + 1 if len(of_a) else 0
                out.append([
                    {"a": list(compress(a, of_a == k)), "b": list(compress(b, of_b == k))} for k in range(count)
                ])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>"
    )


def _own_sums(batches, counts: np.ndarray, best: np.ndarray):
    """Of each document's identity links: how many have their A id's highest count, and the sum of counts."""
    for batch in batches:
        own, times = batch.column("own"), batch.column("own_n").flatten().to_numpy(zero_copy_only=False)
        ids = own.flatten().to_numpy(zero_copy_only=False)
        at = own.offsets.to_numpy() - own.offsets[0].as_py()
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[ids], times * counts[ids])]
        kept = [c for c in batch.schema.names if c not in ("own", "own_n")]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, kept), *(pa.array(np.diff(s[at]), pa.int64()) for s in sums)], [*kept, "own_best", "own_sum"]
        )


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """op13: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    size = len(_worker(byte_path, piece_path).same)
    cut = cut_texts(docs, byte_path, piece_path)
    own, pairs = counts_of(cut, size)
    highest = own.unionByName(pairs.select(_left("pair").alias("a_id"), "n_docs")).groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    # Vectors over A's vocabulary: documents per identity link, and whether that is its id's highest count.
    counts, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for r in own.join(highest, "a_id").collect():
        counts[r.a_id], best[r.a_id] = r.n_docs, r.n_docs == r._most
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kept = cut.select(*plain).schema.add("own_best", "long").add("own_sum", "long")
    mine = cut.select(*plain, "own", "own_n").mapInArrow(lambda batches: _own_sums(batches, counts, best), kept)
    scored = pairs.join(highest, _left(F.col("pair")) == F.col("a_id")).select(
        "pair", "n_docs", (F.col("n_docs") == F.col("_most")).cast("long").alias("top")
    )
    links = cut.select("row", F.inline(F.arrays_zip("pair", "pair_n"))).join(scored, "pair")
    other = links.groupBy("row").agg(
        F.sum(F.col("pair_n") * F.col("top")).alias("best"), F.sum(F.col("pair_n") * F.col("n_docs")).alias("sum")
    )
    zero = F.lit(0).cast("long")
    return mine.join(other, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("own_best") + F.coalesce("best", zero)).alias("n_best"),
        (F.col("own_sum") + F.coalesce("sum", zero)).alias("count_sum"), "groups_sha256",
    )
