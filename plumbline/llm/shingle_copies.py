"""Near copies by exact Jaccard similarity of word shingles, found by SimHash and MinHash bands.

A text is the set of its shingles of five words. Texts of one set count once. A set's
SimHash is linked to others by the index of op8, and the sets of linked fingerprints
meet in a cell. SimHash within three bits misses most pairs near the bound (README),
so each set also has BANDS keys, each made of ROWS minima; two sets of similarity s meet in some
cell with probability 1 - (1 - s^5)^25, 0.99995 at s = 0.8 and more above. What
meets is linked only if the exact similarity of the two sets is 0.8 or more.

Only sets that meet another one are built again, and first each is compared with the
smallest of its cells only, once per such pair whatever the number of cells they
share. Cells whose members are then all joined are done. In the others the members
that are not joined to the smallest meet all members, the joined ones do not meet
each other: a group of copies costs its size, and no link is lost. Blocks of a cell
are bounded by rows and by bytes, sets are sorted arrays in one buffer, and links
leave a block as a spanning forest.

Defined results: null, empty and white texts have the empty set and are copies of
one another; a text of fewer than five words is one shingle; every row belongs to
the component of its text, whether its doc_id is null, repeated or neither; an empty
table gives no rows; texts of any length are taken whole; other columns are returned
as they are, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.blocks import Forest, pairs, rest_groups, whole_groups
from plumbline.llm.common import bounded_batches
from plumbline.llm.components import components
from plumbline.session import materialise

WORDS, SEED = 5, 42
# Least similarity, as a fraction of whole numbers so that the test is exact.
SHARE, OF = 4, 5
BANDS, ROWS = 25, 5
_CHUNK = 1 << 12

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    found = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(found) - words + 1)
    parts = [joined[a:b] for a, b in zip(starts[:last].tolist(), ends[min(words, len(found)) - 1 :].tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=last))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none for the empty set."""
    if not hashes.size:
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), _CHUNK):
        mixed = _TIMES[:, None] * hashes[None, lo : lo + _CHUNK] + _PLUS[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least SHARE / OF, of two sorted arrays of distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * OF < len(large) * SHARE:
        return False
    if not len(small):
        return True
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = np.count_nonzero(large[at] == small)
    return both * OF >= (len(small) + len(large) - both) * SHARE


def _sketched(batches):
    for batch in batches:
        nodes, keys, sizes, bits = [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = shingles(text or b"")
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if found.size else 0)
            keys.append(band_keys(found))
            sizes.append(found.nbytes)
            bits.append(simhash.fingerprint_of(found))
        node, bits = (pa.array(np.array(v, dtype=np.uint64).view(np.int64), pa.int64()) for v in (nodes, bits))
        kept = [batch.column(c) for c in ("doc_id", "_text", "_row")]
        yield pa.RecordBatch.from_arrays(
            [*kept, node, pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), bits],
            ["doc_id", "_text", "_row", "node", "keys", "size", "bits"],
        )


def _sets(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = pa.array([shingles(t or b"").tobytes() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), found], ["node", "shingles"])


def _views(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Sets of a binary column, without copying it."""
    return [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in column]


def _like_first(batches):
    """(node, root) of the rows whose two sets are alike."""
    for batch in batches:
        hit = [alike(a, b) for a, b in zip(_views(batch.column("shingles")), _views(batch.column("other")))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("first")], ["node", "root"]).filter(pa.array(hit, pa.bool_()))


def _linked(batches):
    """(node, root) rows that join all pairs of a group that are alike; pairs already joined are not compared."""
    for table, group in whole_groups(batches, ["key"]):
        sets, forest = _views(table["shingles"]), Forest(table.num_rows)
        low, high, side, root = (table[c].to_numpy() for c in ("_low", "_high", "_side", "root"))
        # Rows joined before stand together from the start, within their group.
        order = np.lexsort([root, group])
        same = (group[order][1:] == group[order][:-1]) & (root[order][1:] == root[order][:-1])
        forest.join(order[1:][same], order[:-1][same])
        before = forest.root.copy()
        for i, j in pairs(group, low, high, side):
            apart = forest.root[i] != forest.root[j]
            i, j = i[apart], j[apart]
            hit = np.fromiter((alike(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
            forest.join(i[hit], j[hit])
        moved = np.flatnonzero(forest.root != before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(root[moved], pa.int64()), pa.array(root[forest.root[moved]], pa.int64())], ["node", "root"]
        ).filter(pa.array(root[moved] != root[forest.root[moved]]))


def keyed(docs: DataFrame) -> DataFrame:
    """text, _text, a digest of it, _row, a hash of the whole row, doc_id, and the row itself as _doc."""
    whole = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    return docs.select(
        F.struct(*docs.columns).alias("_doc"), "doc_id", "text", whole.alias("_row"), F.coalesce(F.md5("text"), F.lit("")).alias("_text")
    )


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _row, the set's ``node``, band keys and SimHash ``bits`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(
        keyed(docs).select("doc_id", "_text", "_row", "text").mapInArrow(
            _sketched, f"doc_id {kind}, _text string, _row long, node long, keys array<long>, size long, bits long"
        ),
        "sketches",
    )


def fingerprint_cells(every: DataFrame) -> DataFrame:
    """node, size, key: the sets whose fingerprints op8's index links share a key; the empty set is left out."""
    sets = materialise(every.where("size > 0").select("node", "size", "bits").distinct(), "set-fingerprints")
    stars = simhash.linked(materialise(sets.select("bits").distinct(), "fingerprints"))
    if stars is not None:
        sets = sets.join(stars.withColumnRenamed("node", "bits"), "bits", "left").withColumn("bits", F.coalesce("root", "bits"))
    return sets.select("node", "size", F.xxhash64(F.lit("fingerprint"), "bits").alias("key"))


def roots(docs: DataFrame, every: DataFrame) -> DataFrame:
    """(node, root) of the sets of ``every`` that are not the smallest of their component."""
    bands = every.select("node", "size", F.explode("keys").alias("key")).distinct()
    cells = materialise(bands.unionByName(fingerprint_cells(every)), "sketch-cells")
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("first")).filter(F.col("_n") > 1)
    met = materialise(cells.join(shared.drop("_n"), "key"), "shared-cells")
    # One text of each set that meets another.
    wanted = every.groupBy("node").agg(F.min("_text").alias("_text")).join(met.select("node").distinct(), "node", "left_semi")
    texts = keyed(docs).select("_text", "text").join(wanted, "_text").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialise(texts.mapInArrow(_sets, "node long, shingles binary"), "shingle-sets")
    # Every member against the smallest of its cell; its set travels once per such pair.
    firsts = met.filter("node <> first").select("node", "first").distinct()
    other = sets.select(F.col("node").alias("first"), F.col("shingles").alias("other"))
    found = firsts.join(sets, "node").join(other, "first").select("node", "first", "shingles", "other")
    stars = materialise(found.mapInArrow(_like_first, "node long, root long"), "first-links")
    joined = components(stars, "node", "root")
    # What is still apart within a cell.
    named = met.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "named-cells")
    apart = named.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).filter("_least <> _most").select("key")
    core = named.filter("node = first").select("key", F.col("root").alias("_core"))
    rest = materialise(
        named.join(apart, "key").join(core, "key").select("key", "node", "size", "root", (F.col("root") != F.col("_core")).alias("rest")),
        "cells-apart",
    )
    # The sets join last, so that they travel once.
    keys = ["key", "_low", "_high"]
    grouped = rest_groups(rest, ["key"], "node", "rest", "size").join(sets, "node")
    links = grouped.select(*keys, "_side", "root", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    more = materialise(links.mapInArrow(_linked, "node long, root long"), "rest-links")
    if more.isEmpty():
        return joined
    return components(joined.unionByName(more), "node", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component: least doc_id, nulls last, then by digest of the text and hash of the row."""
    every = sketched(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text", "_row")
    best = every.groupBy("node").agg(F.min(order).alias("k")).join(roots(docs, every), "node", "left")
    kept = best.groupBy(F.coalesce("root", "node")).agg(F.min("k").alias("k")).select("k._text", "k._row")
    # Rows that agree in both are repeats of one row.
    return keyed(docs).join(kept, ["_text", "_row"], "left_semi").dropDuplicates(["_text", "_row"]).select("_doc.*")
