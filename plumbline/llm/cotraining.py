"""A quality classifier of two views that teach each other.

One view reads the whole text (shape of words, lines and characters), the other
what is known about it besides (source, language, length). Each is a logistic
model. In every round both score a pool of unlabelled documents, and each hands the
documents it is most sure of, good and bad in the proportion of the labels, to the
other as labelled ones. Then each view is calibrated on labels that neither has
seen, the calibrated log-odds are combined, and all documents are scored.

Models have a few dozen weights; they are fitted with numpy on a bounded sample of
labelled rows and a bounded pool, both fixed by a hash of doc_id. Texts are reduced
to features where they are read; nothing is shuffled but labels and features of
the sample.

Defined results: null texts count as empty; unknown metadata have a bucket of
their own; labels without quality are ignored, several labels of a document vote
(a tie is bad); with no labels, or labels of one kind, every document gets the
share of good labels (0.5 without any) and is kept; every row is scored, repeated
or not; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, hash_below

# Bounds of what the models are fitted on.
LABELLED, POOL = 20_000, 20_000
ROUNDS = 4
# Share of the pool that a view may hand over in a round, and how sure it must be.
HANDED, SURE = 0.05, 0.95
KEEP = 0.5

TEXT_FEATURES = 16
LANG_BUCKETS, SOURCE_BUCKETS, LENGTH_BUCKETS = 8, 32, 8


def _kinds() -> np.ndarray:
    """Kind of each byte: other, upper, lower, digit, white space, mark of a sentence, bang, bar, symbol, not ASCII."""
    out = np.zeros(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58] = 1, 2, 3
    out[[9, 10, 11, 12, 13, 32]] = 4
    for kind, marks in ((5, b".,;:?'\"()-"), (6, b"!"), (7, b"|"), (8, b"#$%&*@^~+=<>{}[]\\/_`")):
        out[list(marks)] = kind
    out[128:] = 9
    return out


KINDS = _kinds()


def text_view(text: bytes) -> list[float]:
    """Shape of a whole UTF-8 text."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    kinds = np.bincount(KINDS[np.frombuffer(text, dtype=np.uint8)], minlength=10)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, kinds[1] + kinds[2])
    return [
        np.log1p(len(words)), size / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), kinds[1] / letters,
        kinds[3] / size, kinds[5] / size, min(1.0, 20 * kinds[6] / size), min(1.0, 20 * kinds[7] / size),
        min(1.0, 20 * kinds[8] / size), kinds[9] / size, kinds[0] / size, sum(len(w) <= 3 for w in words) / n,
        float(not words),
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """One-hot buckets."""
    out = [0.0] * (LANG_BUCKETS + SOURCE_BUCKETS + LENGTH_BUCKETS)
    out[0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANG_BUCKETS - 1)] = 1.0
    out[LANG_BUCKETS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCE_BUCKETS - 1))] = 1.0
    length = 0 if n_chars is None else 1 + min(LENGTH_BUCKETS - 2, max(0, n_chars).bit_length() // 2)
    out[LANG_BUCKETS + SOURCE_BUCKETS + length] = 1.0
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self._columns(x)
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-6
        self.weights = np.zeros(z.shape[1])
        for _ in range(25):
            p = _chance(z @ self.weights)
            slope = z.T @ (p - y) + penalty * self.weights
            bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            self.weights -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _columns(self, x):
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._columns(x) @ self.weights, -20, 20)


def _chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Quality:
    """Two views, their calibrations, and the model that combines them; or one constant."""

    views: tuple[Logistic, Logistic] | None
    calibrations: tuple[Logistic, Logistic] | None
    combined: Logistic | None
    constant: float = 0.5
    handed: tuple[int, ...] = ()

    def score(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a good document: combined, by text, by metadata."""
        if self.views is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        odds = [c.log_odds(v.log_odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, metadata))]
        return _chance(self.combined.log_odds(np.stack(odds, axis=1))), _chance(odds[0]), _chance(odds[1])


def most_sure(chance: np.ndarray, free: np.ndarray, share_good: float, most: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pool a view hands over, good and bad ones, in the proportion of the labels."""
    order = np.argsort(chance, kind="stable")
    order = order[free[order]]
    bad = order[: max(1, round(most * (1 - share_good)))]
    good = order[::-1][: max(1, round(most * share_good))]
    return good[chance[good] >= sure], bad[chance[bad] <= 1 - sure]


def cotrain(text, metadata, label, calibrate, pool_text, pool_metadata, rounds: int = ROUNDS) -> Quality:
    """``label`` of the rows of ``text`` and ``metadata``; rows marked in ``calibrate`` are kept for calibration."""
    if len(set(label.tolist())) < 2:
        return Quality(None, None, None, float(label.mean()) if len(label) else 0.5)
    if len(set(label[calibrate].tolist())) < 2 or len(set(label[~calibrate].tolist())) < 2:
        calibrate = np.zeros(len(label), dtype=bool)  # too few labels to keep some aside
    taught = ~calibrate
    seen = calibrate if calibrate.any() else taught
    own, pool = (text[taught], metadata[taught]), (pool_text, pool_metadata)
    given: list[tuple[list, list]] = [([], []), ([], [])]  # pool rows and labels that each view was handed
    free = [np.ones(len(pool_text), dtype=bool) for _ in pool]
    share, handed = float(label[taught].mean()), []

    def fitted(k):
        rows, labels = given[k]
        x = np.concatenate([own[k], pool[k][rows]]) if rows else own[k]
        return Logistic().fit(x, np.concatenate([label[taught], labels]) if rows else label[taught])

    views = [fitted(0), fitted(1)]
    for _ in range(rounds if len(pool_text) else 0):
        count = 0
        for k in (0, 1):
            other = 1 - k
            good, bad = most_sure(_chance(views[k].log_odds(pool[k])), free[other], share, max(2, int(HANDED * len(pool_text))))
            free[other][good] = free[other][bad] = False
            given[other][0].extend([*good, *bad])
            given[other][1].extend([1.0] * len(good) + [0.0] * len(bad))
            count += len(good) + len(bad)
        handed.append(count)
        if not count:
            break
        views = [fitted(0), fitted(1)]
    odds = [v.log_odds(x[seen]) for v, x in zip(views, (text, metadata))]
    calibrations = tuple(Logistic().fit(o[:, None], label[seen]) for o in odds)
    calibrated = np.stack([c.log_odds(o[:, None]) for c, o in zip(calibrations, odds)], axis=1)
    return Quality(tuple(views), calibrations, Logistic().fit(calibrated, label[seen]), handed=tuple(handed))


def _views(batch, prefix: str = "_") -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column(f"{prefix}text").cast(pa.binary()).to_pylist()
    rows = zip(*(batch.column(f"{prefix}{c}").to_pylist() for c in ("lang", "source", "n_chars")))
    text = np.array([text_view(t or b"") for t in texts], dtype=np.float64).reshape(-1, TEXT_FEATURES)
    metadata = np.array([metadata_view(*r) for r in rows], dtype=np.float64)
    return text, metadata.reshape(-1, LANG_BUCKETS + SOURCE_BUCKETS + LENGTH_BUCKETS)


def _read(docs: DataFrame) -> list:
    return [F.col(c).alias(f"_{c}") for c in ("text", "lang", "source")] + [F.col("n_chars").cast("long").alias("_n_chars")]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Quality:
    bounded_batches(docs.sparkSession)
    votes = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg("quality") > 0.5).cast("double").alias("_label")
    )
    n_labels, n_docs = votes.count(), docs.count()
    rate, pool_rate = min(1.0, labelled / max(1, n_labels)), min(1.0, pool / max(1, n_docs))
    key = F.col("doc_id")
    wide = docs.filter(key.isNotNull() & hash_below(key, max(rate, pool_rate)))
    some = wide.join(votes, "doc_id", "left").filter(
        F.col("_label").isNotNull() & hash_below(key, rate) | F.col("_label").isNull() & hash_below(key, pool_rate)
    )

    def run(batches):
        for batch in batches:
            text, metadata = _views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(list(text.astype("<f8")), pa.list_(pa.float64())),
                 pa.array(list(metadata), pa.list_(pa.float64()))],
                ["doc_id", "label", "text", "metadata"],
            )

    found = some.select("doc_id", "_label", *_read(some)).mapInArrow(
        run, "doc_id long, label double, text array<double>, metadata array<double>"
    ).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * (labelled + pool)).toArrow()  # however often a document is repeated
    if not found.num_rows:
        return Quality(None, None, None)
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    text, metadata = (np.array(found[c].to_pylist())[order] for c in ("text", "metadata"))
    label, doc = found["label"].to_numpy()[order], found["doc_id"].to_numpy()[order]
    has = ~np.isnan(label)
    aside = np.array([zlib.crc32(b"calibrate %d" % d) % 4 == 0 for d in doc[has]], dtype=bool)
    return cotrain(text[has], metadata[has], label[has], aside, text[~has], metadata[~has])


def with_quality(docs: DataFrame, model: Quality, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with quality_score, text_score, metadata_score; ``columns`` must not hold these."""
    bounded_batches(docs.sparkSession)
    names = ("quality_score", "text_score", "metadata_score")

    def run(batches):
        for batch in batches:
            scores = model.score(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(s) for s in scores], [*columns, *names])

    schema = docs.select(*columns).schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select(*columns, *_read(docs)).mapInArrow(run, schema)


def quality_of(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """op2: doc_id, quality_score, kept, and the score of each view."""
    scored = with_quality(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= keep).alias("kept"), "text_score", "metadata_score")
