"""Vector codes by a product quantiser: one small codebook per part of a vector, fitted by active-entry Lloyd rounds.

Components become whole numbers, vectors are cut into parts, and every part position
has its own codebook. A round assigns each part to the nearest entry and moves each
entry to the floor of its parts' mean; all arithmetic is on whole numbers, so every
run and every partitioning gives the same codes.

Between rounds a vector keeps the assigned entry of each part and its exact
distance. Where the assigned entry did not move, the kept distance still holds and
no entry that stayed put can have come nearer: only the moved entries are compared
with it. Where it moved, all entries are compared. Ties go to the lower index in
both cases. Rounds end early once no entry moves, since the rest would repeat.

Vectors and their codes are written to the shared folder once a round, in one pass
that also gives the sums per (part, entry) of each task; only those sums meet. The
driver holds the codebooks, parts x entries x width numbers, and nothing else.

Defined results: rows whose vector is null or holds a null or non-finite component
are dropped. The dimension is that of the smallest vec_id with a vector that is not
empty; rows of another dimension, the empty vector among them, get null code and
error and are not learned from. A null vec_id comes after all others, equal vec_ids
are ordered by their components; repeated rows all count and are all returned. With
fewer rows than entries the codebooks are as long as there are rows. Parts are equal
where their number divides the dimension, else their widths differ by one. An empty
table gives no rows. Other columns are not looked at. Scaled components must lie
within 2^26; larger ones end the job with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches
from plumbline.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Distances of parts up to 2^8 wide stay exact within 64 bits.
LARGEST = 1 << 26
_CHUNK = 1 << 13
_STATE = "vec_id long, label {label}, x array<int>, code array<tinyint>, near array<long>"


def bounds(dim: int, parts: int) -> list[int]:
    """Where each part begins, and the last ends."""
    return [k * dim // parts for k in range(parts + 1)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact."""
    out = np.empty((len(x), len(entries)), dtype=np.int64)
    for k, entry in enumerate(entries):
        apart = x - entry
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray, near: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its distance for the parts ``x``, given those of the round before and which entries moved since.

    A code of -1 is a part that was never assigned.
    """
    code, near = code.copy(), near.copy()
    stays = (code >= 0) & ~moved[code]
    rescan = np.flatnonzero(~stays)
    if len(rescan):
        found = distances(x[rescan], book)
        code[rescan] = found.argmin(axis=1)  # the first of equals
        near[rescan] = found[np.arange(len(rescan)), code[rescan]]
    active, fixed = np.flatnonzero(moved), np.flatnonzero(stays)
    if len(active) and len(fixed):
        found = distances(x[fixed], book[active])
        best = found.argmin(axis=1)
        least, index = found[np.arange(len(fixed)), best], active[best]
        better = (least < near[fixed]) | ((least == near[fixed]) & (index < code[fixed]))
        code[fixed[better]], near[fixed[better]] = index[better], least[better]
    return code, near


def whole_vectors(vectors: DataFrame, label_type: str) -> DataFrame:
    """vec_id, label and the scaled whole components ``x`` of the rows that are kept."""
    component = F.col("v").cast("array<double>")
    kept = vectors.select("vec_id", F.col("label").cast(label_type).alias("label"), F.col("embedding").alias("v")).filter(
        F.col("v").isNotNull()
        & F.forall(component, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    scaled = F.transform(component, lambda c: F.floor(c * SCALE))
    checked = F.transform(scaled, lambda c: F.when(F.abs(c) <= LARGEST, c).otherwise(
        F.raise_error(F.lit("a scaled vector component lies beyond 2^26")).cast("long")))
    return kept.select("vec_id", "label", checked.cast("array<int>").alias("x"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _round(batches, books: list[np.ndarray], moved: np.ndarray, dim: int, parts: int):
    """State rows with their parts assigned anew."""
    at = bounds(dim, parts)
    for whole in batches:
        for lo in range(0, whole.num_rows, _CHUNK):
            batch = whole.slice(lo, _CHUNK)
            x = _matrix(batch.column("x"), dim, np.int64)
            code, near = _matrix(batch.column("code"), parts, np.int64), _matrix(batch.column("near"), parts, np.int64)
            for p in range(parts):
                code[:, p], near[:, p] = assign(x[:, at[p] : at[p + 1]], books[p], code[:, p], near[:, p], moved[p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"),
                 _lists(code.astype(np.int8), pa.int8()), _lists(near, pa.int64())],
                ["vec_id", "label", "x", "code", "near"],
            )


def _sums(batches, dim: int, parts: int, entries: int):
    """One row per (part, entry) of the task: how many parts, and their sum."""
    at = bounds(dim, parts)
    count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((entries, dim), dtype=np.int64)
    for batch in batches:
        x, code = _matrix(batch.column("x"), dim, np.int64), _matrix(batch.column("code"), parts, np.int64)
        for p in range(parts):
            count[p] += np.bincount(code[:, p], minlength=entries)
            order = np.argsort(code[:, p], kind="stable")
            used, first = np.unique(code[order, p], return_index=True)
            if len(used):
                total[used, at[p] : at[p + 1]] += np.add.reduceat(x[order, at[p] : at[p + 1]], first, axis=0)
    rows = [(p, e) for p in range(parts) for e in range(entries) if count[p, e]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()),
         pa.array([int(count[r]) for r in rows], pa.int64()),
         pa.array([total[e, at[p] : at[p + 1]].tolist() for p, e in rows], pa.list_(pa.int64()))],
        ["part", "entry", "n", "total"],
    )


def moved_books(state: DataFrame, books: list[np.ndarray], dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codebooks with every used entry at the floor of its parts' mean, and which entries changed by that."""
    parts, entries = len(books), len(books[0])
    sums = state.select("x", "code").mapInArrow(
        lambda batches: _sums(batches, dim, parts, entries), "part int, entry int, n long, total array<long>"
    )
    each = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "value"))
    summed = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    new = [b.copy() for b in books]
    for r in summed.collect():  # at most entries x dimension rows
        if r.place is not None:
            new[r.part][r.entry, r.place] = r.value // r.n
    return new, np.array([(a != b).any(axis=1) for a, b in zip(new, books)])


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows vec_id, label, x, code, near with the final codes, and the codebook of each part."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    label = vectors.schema["label"].dataType.simpleString()
    kept = materialise(whole_vectors(vectors, label), "whole-vectors")
    uncoded = kept.select("*", F.lit(None).cast("array<tinyint>").alias("code"), F.lit(None).cast("array<long>").alias("near"))
    ordered = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x")
    first = ordered.filter(F.size("x") > 0).limit(1).collect()
    if not first:
        return uncoded, []
    dim = len(first[0].x)
    fits = F.size("x") == dim
    x = np.array([r.x for r in ordered.filter(fits).limit(entries).collect()], dtype=np.int64)
    at = bounds(dim, parts)
    books = [x[:, a:b].copy() for a, b in zip(at[:-1], at[1:])]
    moved = np.ones((parts, len(x)), dtype=bool)
    state = kept.filter(fits).select(
        "*", F.array_repeat(F.lit(-1).cast("tinyint"), parts).alias("code"), F.array_repeat(F.lit(0).cast("long"), parts).alias("near")
    )
    schema = _STATE.format(label=label)
    for k in range(rounds + 1):
        state = materialise(
            state.mapInArrow(lambda batches, b=books, m=moved: _round(batches, b, m, dim, parts), schema), "vector-codes"
        )
        if k == rounds:
            break
        books, moved = moved_books(state, books, dim)
        if not moved.any():
            break
    return state.unionByName(uncoded.filter(~fits)), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    numbers = ",".join(str(v) for book in books for v in book.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def decoded(coded: DataFrame, books: list[np.ndarray], scale: float = SCALE) -> DataFrame:
    """vec_id and the vector that its code stands for, as array<double>; null where there is no code."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(v / scale) for v in e)) for e in b.tolist())) for b in books))
    pieces = F.transform("code", lambda c, p: F.element_at(F.element_at(tables, p + 1), c.cast("int") + 1))
    return coded.select("vec_id", F.flatten(pieces).alias("vector"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """op11: vec_id, code, error, label_error, codebooks_sha256."""
    state, books = fit(vectors, parts, entries, rounds)
    byte = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    rows = state.select("vec_id", "label", F.array_join(byte, "").alias("code"),
                        F.aggregate("near", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    per_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same over ``embeddings`` by comparing every part with every entry in every round."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)""",
        f"""parts AS MATERIALIZED (
  SELECT r, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v
  FROM kept, range({parts}) t(p) WHERE len(x) = (SELECT len(x) FROM kept WHERE len(x) > 0 ORDER BY r LIMIT 1)
)""",
        f"book0 AS (SELECT p, e, v AS c FROM parts WHERE e < {entries})",
    ]
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, any_value(v) AS v, min(struct_pack(d := CAST({apart} AS BIGINT), e := book{k}.e)) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM (
    SELECT p, e, place, sum(value) AS s, count(*) AS n FROM (
      SELECT p, best.e AS e, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM near{k}
    ) GROUP BY p, e, place
  ) GROUP BY p, e
)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)""")
    return "WITH " + ",\n".join(steps) + f""",
final AS (
  SELECT r, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept LEFT JOIN final USING (r)"""
