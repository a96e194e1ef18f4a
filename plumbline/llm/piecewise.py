"""Context-triggered piecewise hashing of whole texts, and the likeness of two fingerprints.

A rolling hash over eight bytes cuts a text where its value is small; what lies
between two cuts gives one character of a signature. A fingerprint is
``size:signature:signature``, the second at twice the block size. Cuts depend on
eight bytes only, so an edit changes the characters near it and no others.
Signatures are compared by edit distance at equal or doubled block size.

Every text is also compared with itself after an edit: its second half replaced by
the beginning of the next document (descending doc_id). Texts are dealt by ranges
of doc_id and each task streams through its range once; only the first and last
text of each task are brought together afterwards.

Defined results: null counts as empty; an empty text has the fingerprint
``3::`` and likeness 1 to another empty one, 0 to others; rows with the same doc_id
follow each other by text; a null doc_id is the lowest; a table of one row has
itself as next document; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches
from plumbline.session import materialise

SMALLEST = 3
LONGEST = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# One run of this many common characters is asked of two signatures that have as many.
COMMON = 7

_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 32, 256, dtype=np.uint32)
_STEP = 0x9E3779B1
_BLOCK = 1 << 18


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last eight bytes at each place: sum of their values times powers of an odd number."""
    h = _BYTE_VALUES[data]
    for reach in (1, 2, 4):
        factor = np.uint32(pow(_STEP, reach, 1 << 32))
        longer = h.copy()
        longer[reach:] += h[:-reach] * factor
        h = longer
    return h


def cuts(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the text is cut at block size ``size``, and the hashes there, in blocks of bounded memory."""
    most = np.uint32((1 << 32) // size)
    places, values = [], []
    for lo in range(0, len(data), _BLOCK):
        from_ = max(0, lo - 7)
        h = rolling(data[from_ : lo + _BLOCK])[lo - from_ :]
        at = np.flatnonzero(h < most)
        places.append(at + lo)
        values.append(h[at])
    return (np.concatenate(places), np.concatenate(values)) if places else (np.zeros(0, int), np.zeros(0, np.uint32))


def signature(data: bytes, places: np.ndarray, longest: int) -> str:
    """One letter per piece; the last letter covers all that is left."""
    at, out = 0, []
    for end in places[: longest - 1].tolist():
        out.append(LETTERS[zlib.crc32(data[at : end + 1]) & 63])
        at = end + 1
    if at < len(data):
        out.append(LETTERS[zlib.crc32(data[at:]) & 63])
    return "".join(out)


def fingerprint(data: bytes) -> str:
    array = np.frombuffer(data, dtype=np.uint8)
    size = SMALLEST
    while size * LONGEST < len(data):
        size *= 2
    places, values = cuts(array, max(SMALLEST, size // 2))  # cuts at twice a size are among those at the size
    if size > SMALLEST:
        larger = values < np.uint32((1 << 32) // size)
        if np.count_nonzero(larger) + 1 < LONGEST // 2:
            size //= 2
        else:
            places, values = places[larger], values[larger]
    double = places[values < np.uint32((1 << 32) // (2 * size))]
    return f"{size}:{signature(data, places, LONGEST)}:{signature(data, double, LONGEST // 2)}"


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many from the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _common_run(a, b):
    """True if both are shorter than ``COMMON`` or share a run of that length."""
    def grams(s):
        return F.transform(F.sequence(F.lit(1), F.length(s) - (COMMON - 1)), lambda k: F.substr(s, k, F.lit(COMMON)))

    short = (F.length(a) < COMMON) | (F.length(b) < COMMON)
    return F.when(short, True).otherwise(F.arrays_overlap(grams(a), grams(b)))


def likeness(a, b):
    """Column of 0..1: 1 for equal fingerprints, else from the edit distance of signatures of one block size."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size = [s.getItem(0).cast("long") for s in (x, y)]

    def near(p, q):
        longest = F.greatest(F.length(p), F.length(q))
        score = 1 - F.levenshtein(p, q) / longest
        return F.when((F.length(p) == 0) | (F.length(q) == 0) | ~_common_run(p, q), 0.0).otherwise(score)

    return (
        F.when(a == b, 1.0)
        .when(size[0] == size[1], F.greatest(near(x.getItem(1), y.getItem(1)), near(x.getItem(2), y.getItem(2))))
        .when(size[0] == 2 * size[1], near(x.getItem(1), y.getItem(2)))
        .when(2 * size[0] == size[1], near(x.getItem(2), y.getItem(1)))
        .otherwise(0.0)
    )


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "next_fingerprint string, part int, edge string, text string"
)


def _described(doc_id, text: str, of_text: str, following: str, of_following: str) -> tuple:
    changed = edited(text, following).encode()
    return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), of_text, fingerprint(changed), of_following, None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _in_order(batches):
    """Rows come in descending doc_id; each is described once its next is known. The task's edges keep their texts."""
    part, last, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            own = fingerprint(text.encode())
            if last is None:
                rows.append((doc_id, None, None, own, None, None, part, "first", text))
            else:
                rows.append(_described(*last, text, own))
            last = (doc_id, text, own)
        yield _batch(rows)
        rows = []
    if last is not None:
        yield _batch([(last[0], None, None, last[2], None, None, part, "last", last[1])])


def _at_edges(batches):
    for batch in batches:
        yield _batch([_described(*r) for r in zip(*(c.to_pylist() for c in batch.columns))])


def near_edits(docs: DataFrame) -> DataFrame:
    """op10: fingerprints of every text and its edit, and their likeness to each other and to the next text's."""
    bounded_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.desc("doc_id")).sortWithinPartitions(
        F.desc("doc_id"), F.desc("text")
    )
    found = materialise(ordered.mapInArrow(_in_order, COLUMNS), "piecewise")
    # One first and one last row per task: the next of a last row is the first row of the following task.
    parts = found.filter(F.col("edge") == "first").select("part")
    following = parts.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    first = found.filter(F.col("edge") == "first").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    last = found.filter(F.col("edge") == "last").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(
        first, "next_part"
    )
    edges = last.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_at_edges, COLUMNS)
    every = found.filter(F.col("edge").isNull()).unionByName(edges)
    return every.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
