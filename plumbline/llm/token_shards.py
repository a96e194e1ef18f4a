"""Token ids in binary shards: frequency ranks in one to four bytes, lengths in separate control bytes.

Texts are encoded once and kept as ids; the ids' counts over all documents give
each id a rank, so that frequent ids take one byte. Shards are plain binary files
in ascending doc_id order, each a run of records

    header   doc_id int64, 1 if doc_id is null uint8, n_tokens uint64, data bytes uint64
    control  two bits per token, its length - 1, four tokens to a byte
    data     the ranks, little endian
    line end one byte

beside a table that turns ranks back into ids. Reading splits records by their
headers, finds each rank's place from a 256-row table of lengths and sums, and
gathers the bytes with numpy.

Memory: a shard is about ``SHARD_BYTES`` (more only if one document is longer);
the rank table has one row per id of the vocabulary.

Defined results: null and empty texts hold the end id alone; a null doc_id comes
first; rows with the same doc_id follow each other, shorter first; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.chunks import ChunkEncoder
from plumbline.llm.common import bounded_batches
from plumbline.session import materialise, shared_dir

# A shard is read as one row: small enough for executors of any size.
SHARD_BYTES = 4 << 20
# Chunks that a worker remembers, and text sent to it at a time: the larger, the fewer
# chunks are encoded again.
REMEMBERED = 700_000
TEXT_BATCH_BYTES = 8 << 20
HEADER = struct.Struct("<qBQQ")


# ---- encoding texts ---------------------------------------------------------------------------


def id_type(vocabulary: int) -> np.dtype:
    """Ids are kept in two bytes where the vocabulary allows it."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class LibraryEncoder:
    """Ids of chunks from the tokenizers library, many chunks in one call.

    Tokens that end a word tell where each chunk of letters alone ends; for all
    others token offsets do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = id_type(size)
        self.ends_word = np.array([self.tokenizer.id_to_token(k).endswith("</w>") for k in range(size)])

    def by_offsets(self, chunks: list[str]):
        for lo in range(0, len(chunks), 500):
            part = chunks[lo : lo + 500]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            yield from self._cut(found.ids, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in part])))

    def by_word_ends(self, words: list[str]):
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            yield from self._cut(ids, cuts) if len(cuts) == len(part) else self.by_offsets(part)

    def _cut(self, ids: list[int], cuts: np.ndarray):
        raw, width = np.array(ids, dtype=self.kind).tobytes(), self.kind.itemsize
        at = (cuts * width).tolist()
        return (raw[a:b] for a, b in zip([0, *at[:-1]], at))

    def __call__(self, chunks: pa.Array) -> list[bytes]:
        word = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        out = np.empty(len(chunks), dtype=object)
        for rows, how in ((np.flatnonzero(word), self.by_word_ends), (np.flatnonzero(~word), self.by_offsets)):
            out[rows] = list(how(chunks.take(pa.array(rows)).to_pylist()))
        return out.tolist()


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[ChunkEncoder, np.dtype]:
    library = LibraryEncoder(path)
    return ChunkEncoder(library, library.kind, remembered=REMEMBERED), library.kind


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little endian, the end id last)."""
    bounded_batches(docs.sparkSession, TEXT_BATCH_BYTES)

    def run(batches):
        encoder, kind = _encoder(path)
        end = np.array([end_id], dtype=kind)
        for batch in batches:
            ids = [np.concatenate([e, end]) for e in encoder.each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


# ---- ranks ------------------------------------------------------------------------------------


def ranks_by_frequency(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """id, rank: one row per id in use, the most frequent first. Every task adds up its own counts."""

    def count(batches):
        totals = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                seen = np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind))
                if len(seen) > len(totals):
                    totals = np.concatenate([totals, np.zeros(len(seen) - len(totals), dtype=np.int64)])
                totals[: len(seen)] += seen
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return counts.select("id", rank.cast("long").alias("rank"))


# ---- the byte code ----------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


# The lengths of the four values behind each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


def unpack(control, data, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    start = np.cumsum(lengths) - lengths
    data = np.frombuffer(data, dtype=np.uint8)
    out = data[start].astype(np.uint32) if n else np.zeros(0, dtype=np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def as_record(doc_id: int | None, ranks: np.ndarray) -> bytes:
    """A record without the line end that follows it."""
    control, data = pack(ranks)
    return HEADER.pack(doc_id or 0, doc_id is None, len(ranks), len(data)) + control + data


def records_of(shard):
    """(doc_id, ranks) of each record of a shard."""
    at = 0
    while at < len(shard):
        doc_id, is_null, n, size = HEADER.unpack_from(shard, at)
        at += HEADER.size
        middle = at - (-n // 4)
        yield None if is_null else doc_id, unpack(shard[at:middle], shard[middle : middle + size], n)
        at = middle + size + 1


# ---- files ------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, end_id: int, out: str) -> None:
    """Write ``out``/shards (files part-* in ascending doc_id order) and ``out``/ranks."""
    kind = id_type(Tokenizer.from_file(path).get_vocab_size())
    tokens = materialise(encoded(docs, path, end_id), "token-ids")
    ranks_by_frequency(tokens, kind).coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = _lookup(tokens.sparkSession, out, "id", "rank")
    words = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-2 * words // SHARD_BYTES))  # a token takes one to two bytes

    def run(batches):
        for batch in batches:
            records = []
            for doc_id, ids in zip(batch.column("doc_id"), batch.column("ids")):
                records.append(as_record(doc_id.as_py(), rank_of[np.frombuffer(ids.as_buffer(), dtype=kind)]))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = (
        tokens.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
        .mapInArrow(run, "record binary")
    )
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{out}/shards")


def _lookup(spark: SparkSession, out: str, key: str, value: str) -> np.ndarray:
    """The rank table as an array; its size is that of the vocabulary."""
    rows = spark.read.parquet(f"{out}/ranks").select(key, value).toArrow()
    keys, values = rows[key].to_numpy(), rows[value].to_numpy()
    found = np.zeros(keys.max(initial=-1) + 1, dtype=np.uint32)
    found[keys] = values
    return found


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files alone."""
    id_of = _lookup(spark, out, "rank", "id")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                before, rows = 0, []
                for doc_id, ranks in records_of(memoryview(content.as_buffer())):
                    ids = id_of[ranks].astype("<u4")
                    rows.append((path.as_py(), doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    names, kinds = ("path", "doc_id", "inside", "n_tokens", "ids_crc32"), (pa.string(), *[pa.int64()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/shards").select("path", "content")
    rows = materialise(
        files.mapInArrow(run, "path string, doc_id long, inside long, n_tokens long, ids_crc32 long"), "token-rows"
    )
    # By the number of the part, which has more than five digits in a large corpus, not by the text of its name.
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    before = Window.orderBy(number, "path").rowsBetween(Window.unboundedPreceding, -1)
    per_file = rows.groupBy("path").agg(F.sum("n_tokens").alias("n")).select(
        "path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return rows.join(per_file, "path").select(
        "doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def shard_round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """op5: write the shards of ``docs`` to the shared folder and report what reading them back gives."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, end_id, out)
    return read_shards(spark, out)
