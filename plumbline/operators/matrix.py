"""Moment matrices of wide panels, summed up from per-task partial matrices.

A panel row is one date with a value per name of a bounded universe. Each task
reduces its rows to one matrix with numpy; only matrices are shuffled, so neither
pairs of names nor a whole panel ever pass through one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.linalg import robust_covariance
from plumbline.session import materialise

MAX_NAMES = 2000


def panel(long: DataFrame, names: list[str], keys=("effective_date",), name: str = "ticker", value: str = "ret") -> DataFrame:
    """(keys, x): the values of ``names`` in order, NULL where a name is missing."""
    if len(names) > MAX_NAMES:
        raise ValueError(f"a universe of {len(names)} names exceeds {MAX_NAMES}")
    held = long.where(F.col(name).isin(list(names)))
    lookup = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("_m"))
    return lookup.select(*keys, F.array(*[F.col("_m")[n].cast("double") for n in names]).alias("x"))


# Rows of the matrix that travel and are added up together.
BLOCK = 64


def moment_matrices(rows: DataFrame, d: int, key: str) -> DataFrame:
    """(key, i, j, n, sx, sxx, sxy) over the rows where both i and j are present.

    Every task adds its rows up to one matrix per key and sends it as blocks of
    ``BLOCK`` of its rows; blocks of one place are added one after the other. Only
    the result is spread out to d x d rows per key.
    """
    schema = f"{key} string, block int, sums binary"

    def reduce(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby(key, dropna=False):
                x = np.array([np.asarray(v, dtype=float) for v in part["x"]])
                m = np.isfinite(x).astype(float)
                x = np.where(m > 0, x, 0.0)
                stack = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
                totals[k] = totals.get(k, 0) + stack
        for k, s in totals.items():
            for block, lo in enumerate(range(0, d, BLOCK)):
                yield pd.DataFrame({key: [k], "block": [block], "sums": [np.ascontiguousarray(s[:, lo : lo + BLOCK]).tobytes()]})

    def add(batches):
        place, total = None, None
        for pdf in batches:
            for k, block, sums in zip(pdf[key], pdf["block"], pdf["sums"]):
                if (k, block) != place:
                    if place is not None:
                        yield cells(place, total)
                    place, total = (k, block), 0
                total = total + np.frombuffer(sums)
        if place is not None:
            yield cells(place, total)

    def cells(place, total):
        k, block = place
        n, sx, sxx, sxy = total.reshape(4, -1, d)
        i, j = np.indices(n.shape)
        return pd.DataFrame({
            key: k, "i": (i + block * BLOCK).ravel(), "j": j.ravel(),
            "n": n.ravel(), "sx": sx.ravel(), "sxx": sxx.ravel(), "sxy": sxy.ravel(),
        })

    partial = rows.select(key, "x").mapInPandas(reduce, schema)
    matrix = partial.repartition(key, "block").sortWithinPartitions(key, "block").mapInPandas(
        add, f"{key} string, i int, j int, n double, sx double, sxx double, sxy double"
    )
    # Stored because every user reads them next to their transpose.
    return materialise(matrix, "moments")


def covariance_cells(moments: DataFrame, key: str) -> DataFrame:
    """(key, i, j, n, cov, corr) from moment matrices; d x d rows per key."""
    other = moments.select(
        key, F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy")
    )
    m = moments.join(other, [key, "i", "j"])
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return m.where(F.col("n") >= 2).select(
        key, "i", "j", F.col("n").cast("long").alias("n"),
        (cxy / (F.col("n") - 1)).alias("cov"),
        F.when((cxx > 0) & (cyy > 0), cxy / F.sqrt(cxx * cyy)).alias("corr"),
    )


def complete(rows: DataFrame) -> DataFrame:
    return rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def sample_covariance(rows: DataFrame, d: int, key: str) -> DataFrame:
    """Covariance cells over complete rows, centred on the key's mean for accuracy."""
    whole = complete(rows)
    means = whole.groupBy(key).agg(*[F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(d)])
    centred = whole.join(means, key).select(
        key, F.array(*[F.col("x")[i] - F.col(f"_m{i}") for i in range(d)]).alias("x")
    )
    return covariance_cells(moment_matrices(centred, d, key), key)


def robust_cells(rows: DataFrame, d: int, key: str, min_rows_per_name: int = 5) -> DataFrame:
    """Robust covariance per key over complete rows. One group is one key's dates."""
    schema = f"{key} string, i int, j int, n long, cov double, method string"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])
        cov, method = robust_covariance(x, min_rows_per_name)
        i, j = np.indices((d, d))
        return pd.DataFrame(
            {
                key: pdf[key].iloc[0], "i": i.ravel(), "j": j.ravel(), "n": len(x),
                "cov": np.asarray(cov).ravel(), "method": method,
            }
        )

    return complete(rows).select(key, "x").groupBy(key).applyInPandas(solve, schema)


def dense(cells: DataFrame, d: int) -> np.ndarray:
    """(i, j, cov) rows of one matrix on the driver: d x d numbers of a universe of at most MAX_NAMES."""
    if d > MAX_NAMES:
        raise ValueError(f"a universe of {d} names exceeds {MAX_NAMES}")
    rows = cells.select("i", "j", F.col("cov").cast("double").alias("cov")).toArrow()
    out = np.full((d, d), np.nan)
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["cov"].to_numpy()
    return out


def portfolio_vols(df: DataFrame, columns: dict[str, str], cov: np.ndarray) -> DataFrame:
    """Adds sqrt(w' C w) for each array column of weights; the matrix reaches each task once, batches are one product."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(out, T.DoubleType()) for out in columns.values()]])
    names = [f.name for f in schema]

    def run(batches):
        for pdf in batches:
            for w, out in columns.items():
                held = pdf[w].notna().to_numpy()
                vol = np.full(len(pdf), np.nan)
                if held.any():
                    x = np.stack(pdf[w][held].to_numpy()).astype(float)
                    vol[held] = np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", x, cov, x, optimize=True), 0.0))
                pdf[out] = pd.Series(vol, index=pdf.index).astype(object).where(held, None)
            yield pdf[names]

    return df.mapInPandas(run, schema)
