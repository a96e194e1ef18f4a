"""Near-duplicates by SimHash: links at few differing bits found by a generalised pigeonhole index.

The 64 bits are grouped into partitions so that correlated bits stand together.
If the thresholds t of the partitions add up to distance - partitions + 1, two
fingerprints within the distance differ by at most t in some partition. Which
thresholds (-1: the partition is not used) cost least is found by dynamic
programming over candidate counts estimated from a sample; the estimate steers
cost only, the result is exact for any choice. Every fingerprint is filed under its
bits of each partition, and under those bits with up to t of them changed; what
meets is verified.

Texts of one fingerprint count once before anything is compared, and a cell links
its members by a spanning forest, so a group of copies costs its size, not its
square.

Defined results: null, empty and white texts have fingerprint zero and are linked
like others; every row of a repeated document is returned; a null doc_id takes the
component of its text, and null if no document there has an id; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import cell_groups, linked_in_groups
from plumbline.llm.common import bounded_batches
from plumbline.llm.components import components
from plumbline.session import materialise

WORDS, SEED, DISTANCE = 3, 42, 3
# Fingerprints that the grouping of bits and the cost estimate look at.
SAMPLE = 2048
# Filing a fingerprint once more costs about as much as verifying this many candidates.
FILING = 20
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the shingles of a UTF-8 text."""
    found = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(found) - words + 1)
    starts, ends = starts[:last].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, last, _CHUNK):
        parts = [joined[a:b] for a, b in zip(starts[lo : lo + _CHUNK], ends[lo : lo + _CHUNK])]
        ones += _ones(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(parts)))
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of hashed shingles, zero without any."""
    ones = sum((_ones(hashes[lo : lo + _CHUNK]) for lo in range(0, len(hashes), _CHUNK)), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of nearly equal width, each grown by the bit most correlated with it."""
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tie = np.abs(centred.T @ centred) / max(1, len(bits))
    free, groups = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - k)
        rest = sorted(free)
        first = max(rest, key=lambda b: (tie[b, rest].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 with sum(t + 1) = ``total`` of least cost; costs[i][s] is that of t = s - 1 in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for s, c in enumerate(row):
                if spent + s <= total and (spent + s not in step or cost + c < step[spent + s][0]):
                    step[spent + s] = (cost + c, [*chosen, s - 1])
        best = step
    return best.get(total, (float("inf"), []))


def plan_index(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to file under, for ``n`` fingerprints like those of ``sample``."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    i, j = np.triu_indices(len(sample), 1)
    differ = sample[i] ^ sample[j]
    differ = differ[np.bitwise_count(differ) > distance]  # links are candidates under any choice
    for parts in range(distance // 2 + 1, distance + 2):
        groups, costs = group_bits(sample, parts), []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            apart = np.bitwise_count(differ & mask)
            row = [0.0]
            for t in (0, 1):
                met = (np.count_nonzero(apart <= t) + 0.5) / (len(differ) + 1)
                filed = 1 + (len(group) / 2 if t else 0)
                row.append(n * (n - 1) / 2 * met + FILING * n * filed)
            costs.append(row)
        cost, chosen = allot(costs, distance + 1)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _cell(part: int, key):
    return F.struct(F.lit(part).alias("part"), key.alias("key"))


def filed(distinct: DataFrame, index: list[tuple[list[int], int]]) -> DataFrame:
    """One row per fingerprint, partition and probe: part, key, bits.

    Of two fingerprints that differ in one bit of a partition, the one without the
    bit is filed under the other's key as well.
    """
    cells = []
    for part, (group, t) in enumerate(index):
        key = F.col("bits").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
        keys = F.array(key)
        if t:
            flips = [F.lit(_signed(1 << b)) for b in group]
            probes = [F.when(F.col("bits").bitwiseAND(f) == 0, key.bitwiseOR(f)) for f in flips]
            keys = F.array_compact(F.array(key, *probes))
        cells.append(F.transform(keys, partial(_cell, part)))
    return distinct.select("bits", F.explode(F.flatten(F.array(*cells))).alias("c")).select("bits", "c.part", "c.key")


def links(distinct: DataFrame, index: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """(node, root) rows that connect all fingerprints within the distance."""
    cell = ["part", "key"]

    def within(table: pa.Table):
        bits = table["bits"].to_numpy().view(np.uint64)
        return lambda i, j: np.bitwise_count(bits[i] ^ bits[j]) <= distance

    return cell_groups(filed(distinct, index), cell, "bits").mapInArrow(
        lambda batches: linked_in_groups(batches, cell, "bits", within), "node long, root long"
    )


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame | None:
    """(node, root) of the fingerprints ``bits`` that are linked to a smaller one; none where there is only one."""
    n = distinct.count()
    if n < 2:
        return None
    sample = [r[0] for r in distinct.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE).collect()]
    index = plan_index(np.array(sample, dtype=np.int64).view(np.uint64), n, distance)
    return components(links(distinct, index, distance), "node", "root")


def near_copies(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """op8: doc_id, fingerprint in hex, component_id."""
    every = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(every.groupBy("bits").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    stars = linked(distinct, distance)
    if stars is not None:
        # Only linked fingerprints are in the stars; the others are their own component.
        root = F.coalesce("root", "bits").alias("root")
        members = distinct.join(stars, F.col("bits") == F.col("node"), "left").select("bits", "first_doc", root)
        names = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        named = members.select("bits", "root").join(names, "root").select("bits", "component_id")
    else:
        named = distinct.select("bits", F.col("first_doc").alias("component_id"))
    return every.join(named, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
