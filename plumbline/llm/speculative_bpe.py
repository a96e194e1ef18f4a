"""BPE by speculation: longest matches are proposed, adjacent pairs verified, the rest merged exactly.

A sequence of tokens is what merging by rank gives if and only if no adjacent pair
of it would have merged otherwise. So every new word gets the tokens of greedy
longest match; all adjacent pairs of a batch are tested at once with numpy, by
undoing merges from both sides of the seam and asking whether a pair across it
would have been merged earlier; only words with a failing pair are merged rank by
rank. Decoding joins the tokens' strings.

Defined results: null and empty texts, and texts of white space, have no tokens
(the digest of nothing); every row is encoded, repeated or not; a null doc_id is
kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from plumbline.llm.chunks import ChunkEncoder, forget
from plumbline.llm.common import bounded_batches

END = "</w>"
# Longer words are merged one by one.
LONG_WORD = 64
# Words remembered per worker, beside the chunks.
REMEMBERED_WORDS = 100_000

def word_pattern(splitter) -> regex.Pattern:
    """Contractions, runs of letters, single digits, runs of other marks.

    ``regex`` may know a later Unicode version than the tokenizers library; where
    the two may differ, the library's splitter says what is a letter or a digit.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    doubtful = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    runs: list[list[int]] = []
    for c in (ord(c) for c in doubtful if len(splitter.pre_tokenize_str("!" + c)) == 1):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    marks = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) or "!"
    return regex.compile(
        r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[%s]]+|[\p{N}--[%s]]|[[^\s\p{L}\p{N}]||[%s]]+" % (marks, marks, marks)
    )


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class SpeculativeBpe:
    """A word-end BPE vocabulary whose merged tokens are numbered in the order of their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.ids: dict[str, int] = stored["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in (*self.ids.items(), *self.special.items()):
            self.strings[i] = token
        # The two halves of each token; a character is its own half.
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, made = [], []
        for a, b in stored["model"]["merges"]:
            i = self.ids[a + b]
            self.left[i], self.right[i] = self.ids[a], self.ids[b]
            pairs.append(self.ids[a] * size + self.ids[b])
            made.append(i)
        if made != sorted(made):
            raise ValueError("merged tokens must be numbered in the order of their merges")
        self.size = size
        self.merged = dict(zip(pairs, made, strict=True))
        order = np.argsort(pairs)
        self.pairs, self.made = np.array(pairs)[order], np.array(made)[order]
        self.longest = max(len(t) for t in self.ids)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.characters = byte_characters()
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.word = word_pattern(library.pre_tokenizer)
        self.known: dict[str, bytes] = {}
        self.checked = {"words": 0, "merged exactly": 0}

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word in byte characters."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while True:
                i = ids.get(word[at:end] + END if end == n else word[at:end])
                if i is not None:
                    break
                end -= 1
            out.append(i)
            at = end
        return out

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], self.size + 1)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens, whether merging by rank leaves the seam between them."""
        ok = np.ones(len(left), dtype=bool)
        rows, a, b = np.arange(len(left)), left.copy(), right.copy()
        limit = np.full(len(left), self.size)  # merges from here on come too late to cross the seam
        while rows.size:
            crossing = self._merge_of(a, b) < limit
            ok[rows[crossing]] = False
            # Undo the later of the two merges that made a and b; when that one is a character, the other.
            undo_a = (a > b) & (self.right[a] != a) | (self.left[b] == b)
            done = crossing | ((self.right[a] == a) & (self.left[b] == b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            rows, a, b, limit = rows[~done], a[~done], b[~done], limit[~done]
        return ok

    def merge_exactly(self, words: list[str]) -> list[list[int]]:
        """Merging by rank, the leftmost first: many words of similar length at a time, long ones one by one."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        short = [k for k in order if len(words[k]) <= LONG_WORD]
        for lo in range(0, len(short), 4096):
            some = short[lo : lo + 4096]
            for k, tokens in zip(some, self._merge_table([self.letters(words[k]) for k in some]), strict=True):
                out[k] = tokens
        for k in order[len(short) :]:
            out[k] = self._merge_long(self.letters(words[k]))
        return out

    def letters(self, word: str) -> list[int]:
        return [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + END]]

    def _merge_table(self, words: list[list[int]]) -> Iterator[list[int]]:
        n, width = len(words), max(map(len, words)) + 2
        none = self.size + 1
        tokens = np.full((n, width), -1, dtype=np.int64)
        for row, word in enumerate(words):
            tokens[row, : len(word)] = word
        made = np.where(tokens[:, 1:] >= 0, self._merge_of(tokens[:, :-1], tokens[:, 1:]), none)
        columns, live, done = np.arange(width - 1), np.arange(n), np.zeros_like(tokens)
        while live.size:
            row, at = np.arange(live.size), made.argmin(axis=1)
            first = made[row, at]
            ended = first >= self.size
            if ended.any():
                done[live[ended]] = tokens[ended]
                live, tokens, made, at, first = live[~ended], tokens[~ended], made[~ended], at[~ended], first[~ended]
                row = np.arange(live.size)
            if not live.size:
                break
            tokens[row, at] = first
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            tokens[:, :-1] = np.take_along_axis(tokens, moved, axis=1)
            tokens[:, -1] = -1
            made = np.take_along_axis(made, np.minimum(columns + (columns >= at[:, None]), width - 2), axis=1)
            made[:, -1] = none
            for seam in (at - 1, at):
                inside = seam >= 0
                a, b = tokens[row[inside], seam[inside]], tokens[row[inside], seam[inside] + 1]
                made[row[inside], seam[inside]] = np.where(b >= 0, self._merge_of(a, b), none)
        return ([t for t in r if t >= 0] for r in done.tolist())

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap, for a word of any length."""
        n, none = len(tokens), self.size
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, k) for k in range(n - 1) if (m := self.merged.get(tokens[k] * self.size + tokens[k + 1], none)) < none]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            right = after[k]
            if tokens[k] < 0 or right >= n or self.merged.get(tokens[k] * self.size + tokens[right]) != m:
                continue  # one of the two has been merged since
            tokens[k], tokens[right], after[k] = m, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n:
                    made = self.merged.get(tokens[a] * self.size + tokens[after[a]], none)
                    if made < none:
                        heapq.heappush(heap, (made, a))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words in byte characters."""
        proposed = [self.propose(w) for w in words]
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        failing = np.unique(owner[seam[~self.compatible(flat[seam], flat[seam + 1])]])
        for k, tokens in zip(failing, self.merge_exactly([words[k] for k in failing])):
            proposed[k] = tokens
        self.checked["words"] += len(words)
        self.checked["merged exactly"] += len(failing)
        return proposed

    def pieces(self, text: str) -> list[int | str]:
        """Special ids and words in byte characters, in order."""
        out: list[int | str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                lowered = part.lower() if part.isascii() else self.normalise(part)
                for word in [lowered] if lowered.isascii() and lowered.isalpha() else self.word.findall(lowered):
                    plain = word.isascii() and word.isprintable()
                    out.append(word if plain else "".join(map(self.characters.__getitem__, word.encode())))
        return out

    def encode_chunks(self, chunks: pa.Array) -> list[bytes]:
        pieces = list(map(self.pieces, chunks.to_pylist()))
        known = self.known
        forget(known, REMEMBERED_WORDS)
        words = list({p for ps in pieces for p in ps if isinstance(p, str) and p not in known})
        known.update((w, np.array(t, dtype="<u4").tobytes()) for w, t in zip(words, self.encode_words(words), strict=True))
        return [
            b"".join(known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps) for ps in pieces
        ]

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def _worker(path: str) -> tuple[SpeculativeBpe, ChunkEncoder]:
    bpe = SpeculativeBpe(path)
    return bpe, ChunkEncoder(bpe.encode_chunks)


def encode_column(batches, path: str, emit):
    bpe, encoder = _worker(path)
    for batch in batches:
        yield emit(bpe, batch, encoder.each(batch.column("text")))


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        def emit(bpe, batch, encoded):
            ids = pa.array([e.astype(np.int32) for e in encoded], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

        return encode_column(batches, path, emit)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded_text(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids (null: empty)."""
    bounded_batches(tokens.sparkSession)

    def run(batches):
        bpe, _ = _worker(path)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """op4: encode every text, decode the ids, and digest both, in one pass over the texts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        def emit(bpe, batch, encoded):
            counts, of_ids, of_text = [], [], []
            for ids in encoded:
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return encode_column(batches, path, emit)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
