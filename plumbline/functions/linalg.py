"""Small dense kernels that run inside tasks on one group's matrix at a time."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def shrink(emp: np.ndarray, n: np.ndarray, norm4: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ledoit-Wolf towards a scaled identity for a stack of covariances.

    ``emp`` is the population covariance, ``norm4`` the sum over rows of the
    fourth power of the centred row norm.
    """
    d = emp.shape[-1]
    trace = np.trace(emp, axis1=-2, axis2=-1)
    mu = trace / d
    square = np.sum(emp * emp, axis=(-2, -1))
    spread = (square - 2 * mu * trace + d * mu * mu) / d
    noise = np.minimum((norm4 / n - square) / (d * n), spread)
    weight = np.where(spread > 0, noise / np.where(spread > 0, spread, 1.0), 0.0)
    eye = np.eye(d)
    out = (1 - weight)[..., None, None] * emp + (weight * mu)[..., None, None] * eye
    return out, weight


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=0)
    n = len(x)
    emp = centred.T @ centred / n
    norm4 = float(np.sum(np.sum(centred**2, axis=1) ** 2))
    return shrink(emp[None], np.array([float(n)]), np.array([norm4]))[0][0]


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


@lru_cache
def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, dof + 20.0 * math.sqrt(2.0 * dof) + 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(dof / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


# A concentration step that lowers the log-determinant by less has come to its end.
STEPS, STILL = 60, 1e-9
MIN_ROWS_PER_FEATURE = 20


def support_size(n: int, d: int) -> int:
    """Rows that the robust estimate concentrates on."""
    return min(n, int(math.ceil(0.5 * (n + d + 1))))


def _squared_distance(x, loc, cov):
    diff = x - loc
    return np.einsum("ij,ij->i", diff @ np.linalg.pinv(cov, hermitian=True), diff)


def _nearest(dist: np.ndarray, h: int) -> np.ndarray:
    """Positions of the h smallest; the earlier of equals."""
    return np.sort(np.argsort(dist, kind="stable")[:h])


def _scatter(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    loc = part.mean(axis=0)
    diff = part - loc
    cov = diff.T @ diff / len(part)
    sign, logdet = np.linalg.slogdet(cov)
    return loc, cov, logdet if sign > 0 else -np.inf


def robust_starts(x: np.ndarray) -> list[np.ndarray]:
    """Squared distances that the concentration starts from: by medians and absolute deviations, and by mean and covariance."""
    mid = np.median(x, axis=0)
    mad = np.median(np.abs(x - mid), axis=0)
    loc, cov, _ = _scatter(x)
    return [np.sum(((x - mid) / np.where(mad > 0, mad, 1.0)) ** 2, axis=1), _squared_distance(x, loc, cov)]


def concentrate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Location, covariance and log-determinant of the half of the rows with the least determinant, over both starts."""
    h, best = support_size(*x.shape), None
    for dist in robust_starts(x):
        before = np.inf
        for _ in range(STEPS):
            loc, cov, logdet = _scatter(x[_nearest(dist, h)])
            dist = _squared_distance(x, loc, cov)
            if logdet == -np.inf or before - logdet < STILL:
                break
            before = logdet
        if best is None or logdet < best[2]:
            best = loc, cov, logdet
    return best


def min_cov_det(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Reweighted minimum covariance determinant of one group's rows, the same in every run, and how many rows it keeps."""
    d = x.shape[1]
    loc, cov, _ = concentrate(x)
    dist = _squared_distance(x, loc, cov)
    dist = dist / (np.median(dist) / chi2_quantile(0.5, d))
    kept = x[dist < chi2_quantile(0.975, d)]
    return _scatter(kept)[1], len(kept)


def robust_fit(x: np.ndarray, min_rows_per_feature: int = MIN_ROWS_PER_FEATURE) -> tuple[np.ndarray, str, int]:
    """Minimum covariance determinant where the rows allow it, else Ledoit-Wolf; its name, and the rows it rests on."""
    n, d = x.shape
    if n >= min_rows_per_feature * d and n > d + 1:
        cov, kept = min_cov_det(x)
        if np.all(np.isfinite(cov)):
            return cov, "mcd", kept
    return ledoit_wolf(x), "ledoit_wolf", n


# ---- the same for many leading parts of one matrix at a time

# Numbers in one array of a batch of leading parts.
_BATCH = 1 << 22


def _scatters(x: np.ndarray, mask: np.ndarray, size: np.ndarray):
    """Location, covariance, log-determinant and deviations of all rows, for the rows that each mask marks."""
    with np.errstate(invalid="ignore", divide="ignore"):
        loc = mask @ x / size[:, None]
        diff = x[None] - loc[:, None, :]
        cov = np.swapaxes(diff * mask[:, :, None], 1, 2) @ diff / size[:, None, None]
        sign, logdet = np.linalg.slogdet(cov)
    return loc, cov, np.where(sign > 0, logdet, -np.inf), diff


def _squared_distances(diff: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("bni,bni->bn", diff @ np.linalg.pinv(cov, hermitian=True), diff)


def _nearest_masks(dist: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks the h smallest of each row; the earlier of equals."""
    edge = np.take_along_axis(np.sort(dist, axis=1), (h - 1)[:, None], axis=1)
    mask = dist <= edge
    for b in np.flatnonzero(mask.sum(axis=1) > h):
        ties = np.flatnonzero(dist[b] == edge[b])
        mask[b, ties[h[b] - np.count_nonzero(dist[b] < edge[b]) :]] = False
    return mask.astype(float)


def _medians(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians along the last axis of the first n; what follows them is infinite."""
    ranked = np.sort(values, axis=-1)
    shape = (len(n),) + (1,) * (values.ndim - 1)
    low, high = (np.take_along_axis(ranked, np.broadcast_to(k.reshape(shape), values.shape[:-1] + (1,)), axis=-1)[..., 0] for k in ((n - 1) // 2, n // 2))
    return (low + high) / 2


def _min_cov_dets(x: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``min_cov_det`` of the first n rows of ``x``, for each n."""
    d, b = x.shape[1], len(n)
    valid = np.arange(len(x)) < n[:, None]
    h = np.minimum(n, np.ceil(0.5 * (n + d + 1)).astype(int))
    columns = np.where(valid[:, None, :], x.T[None], np.inf)
    mid = _medians(columns, n)
    mad = _medians(np.where(valid[:, None, :], np.abs(x.T[None] - mid[:, :, None]), np.inf), n)
    by_median = np.sum(((x[None] - mid[:, None, :]) / np.where(mad > 0, mad, 1.0)[:, None, :]) ** 2, axis=2)
    _, cov, _, diff = _scatters(x, valid.astype(float), n)
    dist = np.concatenate([by_median, _squared_distances(diff, cov)])
    valid2, h2 = np.concatenate([valid, valid]), np.concatenate([h, h])
    dist[~valid2] = np.inf
    loc, cov, logdet = np.zeros((2 * b, d)), np.zeros((2 * b, d, d)), np.zeros(2 * b)
    live, before = np.arange(2 * b), np.full(2 * b, np.inf)
    for _ in range(STEPS):
        loc[live], cov[live], logdet[live], diff = _scatters(x, _nearest_masks(dist[live], h2[live]), h2[live])
        still = (logdet[live] == -np.inf) | (before[live] - logdet[live] < STILL)
        before[live] = logdet[live]
        live, diff = live[~still], diff[~still]
        if not live.size:
            break
        dist[live] = np.where(valid2[live], _squared_distances(diff, cov[live]), np.inf)
    best = np.arange(b) + np.where(logdet[b:] < logdet[:b], b, 0)
    dist = np.where(valid, _squared_distances(x[None] - loc[best][:, None, :], cov[best]), np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = dist / (_medians(dist, n) / chi2_quantile(0.5, d))[:, None]
        kept = valid & (scaled < chi2_quantile(0.975, d))
    size = kept.sum(axis=1)
    return list(zip(_scatters(x, kept.astype(float), size)[1], size.tolist()))


def robust_fits(x: np.ndarray, ends: np.ndarray, min_rows_per_feature: int = MIN_ROWS_PER_FEATURE) -> list[tuple[np.ndarray, str, int]]:
    """``robust_fit`` of the first ``end`` rows of ``x``, for each of ``ends``."""
    d = x.shape[1]
    enough = np.flatnonzero((ends >= min_rows_per_feature * d) & (ends > d + 1))
    found = {}
    if enough.size and np.isfinite(x).all():
        step = max(1, _BATCH // (2 * int(ends.max()) * d))
        for lo in range(0, len(enough), step):
            part = enough[lo : lo + step]
            for k, (cov, kept) in zip(part, _min_cov_dets(x[: ends[part].max()], ends[part])):
                if np.all(np.isfinite(cov)):
                    found[k] = cov, "mcd", kept
                else:
                    found[k] = ledoit_wolf(x[: ends[k]]), "ledoit_wolf", int(ends[k])
    return [found[k] if k in found else robust_fit(x[:end], min_rows_per_feature) for k, end in enumerate(ends)]


def robust_covariance(x: np.ndarray, min_rows_per_feature: int = MIN_ROWS_PER_FEATURE) -> tuple[np.ndarray, str]:
    return robust_fit(x, min_rows_per_feature)[:2]


def whitening(cov: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Per matrix of a stack: the upper triangle R with RtR the pseudo-inverse,
    row by row, followed by R q. The distance to q is then the norm of R x - R q."""
    d = cov.shape[-1]
    values, vectors = np.linalg.eigh(cov)
    floor = np.abs(values).max(axis=-1, keepdims=True) * d * np.finfo(float).eps
    root = np.where(values > floor, 1.0 / np.sqrt(np.where(values > floor, values, 1.0)), 0.0)
    r = np.linalg.qr(root[..., :, None] * np.swapaxes(vectors, -1, -2), mode="r")
    rows, cols = np.triu_indices(d)
    return np.concatenate([r[:, rows, cols], np.einsum("nij,nj->ni", r, q)], axis=1)
