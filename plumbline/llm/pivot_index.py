"""Near-duplicate vectors through an index of pivot permutations.

A vector is described by its nearest reference points, the nearest first. Inverted
lists are kept per label and pair of pivots, so two vectors meet where they share
at least two of their nearest pivots; a pair that shares more is counted only on
the list of its two smallest shared pivots. What meets and shares enough pivots is
verified by cosine in double precision.

Pivots come from a bounded sample, each unlike those before it, and are filled up
with random directions; every row is indexed. Equal vectors of a label are one
entry with a count. Long lists are cut into blocks that meet in pairs, so neither a
hot label nor a large group of near copies gathers in one task, and links leave a
list as counts and a spanning forest, not as pairs.

Recall of links at cosine 0.98, against all pairs: 0.999 or more on the supplied
tables (tests measure it); pairs below the threshold are never linked.

Defined results: a null label, and a vector that is null, empty, zero or holds null
or non-finite numbers, links with nothing; vectors of different length do not link;
rows of one vec_id are separate vectors that count as one node; a row without
vec_id takes the least vec_id of its component, null if there is none; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import Forest, cell_groups, pairs, whole_groups
from plumbline.llm.common import bounded_batches
from plumbline.llm.components import components
from plumbline.session import materialise

COSINE = 0.98
# Nearest pivots that describe a vector, and how many two vectors must share.
NEAREST, SHARED = 4, 2
SAMPLE = 8192
UNLIKE = 0.7
FEWEST_PIVOTS, MOST_PIVOTS = 64, 2048
CELL = ["label", "dim", "p", "q"]


def pivot_count(n: int) -> int:
    """Grows with the square root of the vectors, so that the lists of pivot pairs keep their length."""
    return int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, round(n**0.5 / 4))))


def choose_pivots(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Up to ``count`` sample vectors, each below ``UNLIKE`` to those before it, then random directions."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = np.zeros((count, sample.shape[1]))
    k = 0
    for v in unit:
        if k == count:
            break
        if not k or (chosen[:k] @ v).max() < UNLIKE:
            chosen[k] = v
            k += 1
    rest = np.random.default_rng(seed).normal(size=(count - k, sample.shape[1]))
    chosen[k:] = rest / np.linalg.norm(rest, axis=1, keepdims=True)
    return chosen


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first; ties by number."""
    near = unit @ pivots.T
    some = np.sort(np.argpartition(-near, nearest - 1, axis=1)[:, :nearest], axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def entries(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and the class of equal vectors (first, second: its hashes; null: links with nothing)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & some
    return vectors.select(
        "vec_id", F.col("label").cast("long").alias("label"), "embedding",
        F.when(usable, F.xxhash64("label", "embedding")).alias("first"),
        F.when(usable, F.xxhash64(F.lit("again"), "embedding", "label")).alias("second"),
    )


def posted(classes: DataFrame, pivots: dict[int, np.ndarray], count: int) -> DataFrame:
    """One row per class and pair of its nearest pivots: CELL, node, n, top (pivots, ascending), vector."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = np.array(some.column("embedding").to_pylist(), dtype=np.float64).reshape(-1, dim)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = pivots.get(int(dim))
                if own is None:
                    own = choose_pivots(np.zeros((0, dim)), count)
                top = np.sort(nearest_pivots(unit, own), axis=1).astype(np.int32)
                a, b = np.triu_indices(NEAREST, 1)
                each = len(a)
                repeat = np.repeat(np.arange(len(x)), each)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("label").take(pa.array(repeat)), pa.array(np.full(len(repeat), dim, dtype=np.int32)),
                        pa.array(top[:, a].ravel()), pa.array(top[:, b].ravel()),
                        some.column("node").take(pa.array(repeat)), some.column("n").take(pa.array(repeat)),
                        pa.array([t.tobytes() for t in top[repeat]], pa.binary()),
                        pa.array([x[k].tobytes() for k in repeat], pa.binary()),
                    ],
                    [*CELL, "node", "n", "top", "vector"],
                )

    return classes.select("node", "n", "label", "dim", "embedding").mapInArrow(
        run, "label long, dim int, p int, q int, node long, n long, top binary, vector binary"
    )


def _links_of_cells(batches, cosine: float):
    for table, group in whole_groups(batches, CELL):
        size = table.num_rows
        low, high, side = (table[c].to_numpy() for c in ("_low", "_high", "_side"))
        p, q, n, node, dim = (table[c].to_numpy() for c in ("p", "q", "n", "node", "dim"))
        top = np.frombuffer(b"".join(table["top"].to_pylist()), dtype=np.int32).reshape(size, NEAREST)
        vectors = [np.frombuffer(v) for v in table["vector"].to_pylist()]
        unit = np.zeros((size, int(dim.max())))
        for k, v in enumerate(vectors):
            unit[k, : len(v)] = v / np.sqrt(v @ v)
        forest, links = Forest(size), np.zeros(size, dtype=np.int64)
        for i, j in pairs(group, low, high, side):
            shared = (top[i][:, :, None] == top[j][:, None, :]).any(axis=2)
            counts = np.cumsum(shared, axis=1)
            # The list of the two smallest shared pivots.
            here = (np.take_along_axis(top[i], (counts == 1).argmax(axis=1)[:, None], axis=1)[:, 0] == p[i]) & (
                np.take_along_axis(top[i], (counts == 2).argmax(axis=1)[:, None], axis=1)[:, 0] == q[i]
            )
            here &= counts[:, -1] >= SHARED
            i, j = i[here], j[here]
            hit = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[hit], j[hit]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            forest.join(i, j)
        used = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[used], pa.int64()), pa.array(node[forest.root[used]], pa.int64()), pa.array(links[used], pa.int64())],
            ["node", "root", "links"],
        )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """op6: vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    every = materialise(entries(vectors), "vectors")
    classes = materialise(
        every.filter(F.col("first").isNotNull()).groupBy("first", "second").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ).withColumn("node", F.coalesce("first_id", "first")).withColumn("dim", F.size("embedding")),
        "vector-classes",
    )
    count = pivot_count(classes.count())
    sample = classes.orderBy(F.xxhash64("second"), "second").select("embedding").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    pivots = {dim: choose_pivots(np.array(x, dtype=np.float64), count) for dim, x in by_dim.items()}

    found = materialise(
        cell_groups(posted(classes, pivots, count), CELL, "node").mapInArrow(
            lambda batches: _links_of_cells(batches, cosine), "node long, root long, links long"
        ),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found, "node", "root").withColumnRenamed("node", "_node")
    named = classes.select("first", "second", "first_id", "n", "node").join(links, "node", "left").join(
        stars, F.col("node") == F.col("_node"), "left"
    ).withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least"))
    of_class = named.join(least, "root").select(
        "first", "second", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least"
    )
    rows = every.select("vec_id", "first", "second").join(of_class, ["first", "second"], "left")
    component = F.when(F.col("first").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def vectors_sql(cosine: float = COSINE) -> str:
    """DuckDB SQL for op6, by comparing all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {cosine}),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(component_id AS BIGINT) AS component_id,
  vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""
