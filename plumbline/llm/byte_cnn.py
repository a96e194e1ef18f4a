"""Language identification by a convolutional network over bytes.

A text is read as UTF-8 bytes in windows of fixed length that overlap by the
longest filter less one, so no byte sequence is lost. Filters of widths 2, 3 and 4
over one-hot byte classes, the maximum of each filter over the window, and softmax
give a window's probabilities; a text has the mean over its windows, weighted by
their letters. The network is trained with numpy on the driver, on windows of a
bounded sample of labelled texts; prediction adds rows of a table per byte pair.

Defined results: null texts and texts without a letter are ``und`` with score 0, as
is everything when no labelled text can be learned from; a single known language
is always predicted; every row is predicted, repeated or not; rows whose crc32 of
doc_id modulo 4 is 2, or whose doc_id is null, are never learned from; other columns
are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches
from plumbline.session import materialise

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
# Bound of what is learned from: labelled texts, evenly over the languages, and windows of each.
LEARNED_TEXTS = 6000
WINDOWS_PER_TEXT = 3
EPOCHS = 8
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"

_LETTER = re.compile(rb"[A-Za-z]")


def byte_classes() -> np.ndarray:
    """Letters without case, one class for white space, digits and other marks each, bytes from 128 on as they are."""
    out = np.full(256, 28, dtype=np.uint8)
    for k in range(26):
        out[65 + k] = out[97 + k] = k
    out[[9, 10, 11, 12, 13, 32]] = 26
    out[48:58] = 27
    out[128:] = np.arange(29, 157)
    return out


CLASSES = byte_classes()
N_CLASSES = 157
BLANK = 26


def windows(text: bytes) -> np.ndarray:
    """Byte classes of the windows of a text, the last one filled up with blanks."""
    n = max(1, -(-(len(text) - (WINDOW - STEP)) // STEP))
    padded = np.full(n * STEP + WINDOW - STEP, BLANK, dtype=np.uint8)
    padded[: len(text)] = CLASSES[np.frombuffer(text, dtype=np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode()))


class ByteCnn:
    def __init__(self, languages: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [draw.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), dtype=np.float32)
        self._pairs = None

    def __getstate__(self):
        return {**self.__dict__, "_pairs": None}

    def _weights(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, seed: int = 11) -> None:
        """Adam on cross-entropy, every language weighing the same."""
        draw = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.languages)) / len(y)
        weight = (1 / np.maximum(share, 1e-9) / len(self.languages)).astype(np.float32)
        mean, square, t = [np.zeros_like(w) for w in self._weights()], [np.zeros_like(w) for w in self._weights()], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                t += 1
                for w, g, m, v in zip(self._weights(), self._gradients(x[rows], y[rows], weight), mean, square):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x, y, weight):
        n, pooled, places = len(x), [], []
        for w, f in zip(WIDTHS, self.filters):
            response = f[0][x[:, : WINDOW - w + 1]]
            for k in range(1, w):
                response += f[k][x[:, k : WINDOW - w + 1 + k]]
            at = response.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(response, at[:, None], axis=1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        slope = _softmax(h @ self.out + self.out_bias)
        slope[np.arange(n), y] -= 1
        slope *= (weight[y] / n)[:, None]
        back = (slope @ self.out.T) * (h > 0)
        filters = []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g, mine = np.zeros_like(f), back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, places[i] + k, axis=1), np.arange(FILTERS)), mine)
            filters.append(g)
        return [*filters, back.sum(axis=0), h.T @ slope, slope.sum(axis=0)]

    def pair_table(self) -> np.ndarray:
        """For each byte pair: the width 2 filter, the first two bytes of widths 3 and 4, the last two of width 4."""
        if self._pairs is None:
            f2, f3, f4 = self.filters
            halves = [(f2[0], f2[1]), (f3[0], f3[1]), (f4[0], f4[1]), (f4[2], f4[3])]
            table = np.concatenate([a[:, None, :] + b[None, :, :] for a, b in halves], axis=2)
            self._pairs = np.ascontiguousarray(table.reshape(N_CLASSES * N_CLASSES, -1))
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window, a bounded number of windows at a time."""
        table, last, out = self.pair_table(), self.filters[1][2], []
        for lo in range(0, len(x), 64):
            c = x[lo : lo + 64].astype(np.int32)
            a = table.take(c[:, :-1] * N_CLASSES + c[:, 1:], axis=0)
            f = FILTERS
            two = a[:, :, :f].max(axis=1)
            three = (a[:, :-1, f : 2 * f] + last.take(c[:, 2:], axis=0)).max(axis=1)
            four = (a[:, :-2, 2 * f : 3 * f] + a[:, 2:, 3 * f :]).max(axis=1)
            h = np.maximum(np.concatenate([two, three, four], axis=1) + self.bias, 0)
            out.append(_softmax(h @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), dtype=np.float32)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        for group in _groups(known, texts):
            each = [windows(texts[k]) for k in group]
            x = np.concatenate(each)
            letters = np.count_nonzero((x < 26) | (x > 28), axis=1) + 1e-6
            weighed = self.probabilities(x) * letters[:, None]
            starts = np.cumsum([0, *map(len, each)])[:-1]
            total = np.add.reduceat(weighed, starts, axis=0) / np.add.reduceat(letters, starts)[:, None]
            for k, row in zip(group, total):
                best = int(row.argmax())
                out[k] = (self.languages[best], float(min(1.0, row[best])))
        return out


def _groups(known, texts, most: int = 1 << 20):
    """Runs of texts of about ``most`` bytes together."""
    group, size = [], 0
    for k in known:
        group.append(k)
        size += len(texts[k])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id):
    """Column: the rows that are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learned_windows(docs: DataFrame, bound: int = LEARNED_TEXTS) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of the sample, fixed by a hash of doc_id; at most about ``bound`` texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("langs", F.count(F.lit(1)).over(Window.partitionBy()))
    rate = F.lit(float(bound)) / F.col("langs") / F.col("n")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Which documents: decided without texts, at most about ``bound`` ids, so the texts are not shuffled.
    picked = materialise(labelled.select("doc_id", "lang").join(counts, "lang").filter(place < rate).select("doc_id").distinct(), "learned")
    if picked.count() > 4 * bound:
        raise ValueError("the sample is larger than its bound")
    sample = labelled.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "lang")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
            ):
                if has_letter(text):
                    found = windows(text)
                    picked = np.unique(np.linspace(0, len(found) - 1, WINDOWS_PER_TEXT).astype(int))
                    rows += [(doc_id, found[k].tobytes(), lang) for k in picked]
            columns = zip(*rows) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()))], ["doc_id", "window", "lang"]
            )

    found = sample.mapInArrow(cut, "doc_id long, window binary, lang string")
    # Repeated documents cannot make the sample larger either.
    found = found.orderBy(F.xxhash64("doc_id", "window", "lang"), "doc_id").limit(2 * bound * WINDOWS_PER_TEXT)
    rows = sorted(map(tuple, found.collect()))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return x, [r[2] for r in rows]


def train(docs: DataFrame, bound: int = LEARNED_TEXTS) -> ByteCnn | None:
    x, lang = learned_windows(docs, bound)
    if not len(x):
        return None
    languages = sorted(set(lang))
    model = ByteCnn(languages)
    number = {name: k for k, name in enumerate(languages)}
    model.fit(x, np.array([number[name] for name in lang]))
    return model


def with_language(docs: DataFrame, model: ByteCnn | None, columns: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` of ``docs`` with the prediction from ``text``; ``columns`` must not hold the two new names."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*columns, F.col("text").alias("_read"))

    def run(batches):
        for batch in batches:
            texts = batch.column("_read").cast(pa.binary()).to_pylist()
            found = model.predict(texts) if model else [(UNKNOWN, 0.0)] * len(texts)
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, pred, score])

    schema = docs.select(*columns).schema.add(pred, "string").add(score, "double")
    return kept.mapInArrow(run, schema)


def languages_of(docs: DataFrame) -> DataFrame:
    """op7: doc_id, held_out, lang_pred, score."""
    found = with_language(docs, train(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
