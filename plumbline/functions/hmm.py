"""Gaussian hidden Markov model of one series, with full covariances."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-3


def winsorise(x: np.ndarray, cap: float, mu=None, sd=None):
    mu = x.mean(axis=0) if mu is None else mu
    sd = x.std(axis=0, ddof=1) if sd is None else sd
    sd = np.where(sd > 0, sd, 1.0)
    return np.clip(x, mu - cap * sd, mu + cap * sd), mu, sd


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for s, (m, c) in enumerate(zip(means, covs)):
        chol = np.linalg.cholesky(c)
        z = np.linalg.solve(chol, (x - m).T)
        out[:, s] = -0.5 * (np.sum(z * z, axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(chol)).sum()
    return out


def forward(logp: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """Scaled forward pass: filtered probabilities, step scales, log-likelihood."""
    peak = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - peak)
    alpha, scale = np.empty_like(p), np.empty(len(p))
    state = start * p[0]
    for t in range(len(p)):
        if t:
            state = (state @ trans) * p[t]
        total = state.sum()
        scale[t] = total if total > 0 else 1e-300
        state = state / scale[t]
        alpha[t] = state
    return alpha, scale, p, float(np.log(scale).sum() + peak.sum())


def posteriors(alpha, scale, p, trans):
    """Smoothed state probabilities and expected transition counts."""
    k = alpha.shape[1]
    beta = np.ones(k)
    gamma, counts = np.empty_like(alpha), np.zeros((k, k))
    gamma[-1] = alpha[-1]
    for t in range(len(alpha) - 2, -1, -1):
        weighted = p[t + 1] * beta / scale[t + 1]
        counts += alpha[t][:, None] * trans * weighted[None, :]
        beta = trans @ weighted
        gamma[t] = alpha[t] * beta
    return gamma / gamma.sum(axis=1, keepdims=True), counts


def _start(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spread-out seeds followed by a few k-means rounds."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        gap = np.min([np.sum((x - c) ** 2, axis=1) for c in centres], axis=0)
        total = gap.sum()
        centres.append(x[rng.choice(len(x), p=gap / total if total > 0 else None)])
    means = np.array(centres)
    for _ in range(20):
        label = np.argmin([np.sum((x - c) ** 2, axis=1) for c in means], axis=0)
        means = np.array([x[label == s].mean(axis=0) if np.any(label == s) else means[s] for s in range(k)])
    return means


def fit(x: np.ndarray, k: int, seed: int = 42, max_iter: int = 200, tol: float = 1e-2) -> dict:
    rng = np.random.default_rng(seed)
    n, d = x.shape
    means = _start(x, k, rng)
    base = np.atleast_2d(np.cov(x, rowvar=False, bias=True)) + FLOOR * np.eye(d)
    covs = np.repeat(base[None], k, axis=0)
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1))
    if k == 1:
        trans = np.ones((1, 1))
    previous, ll, rounds = -np.inf, -np.inf, 0
    for rounds in range(1, max_iter + 1):
        alpha, scale, p, ll = forward(log_density(x, means, covs), start, trans)
        if ll - previous < tol and rounds > 1:
            break
        previous = ll
        gamma, counts = posteriors(alpha, scale, p, trans)
        weight = gamma.sum(axis=0)
        start = gamma[0] / gamma[0].sum()
        rows = counts.sum(axis=1, keepdims=True)
        trans = np.where(rows > 0, counts / np.where(rows > 0, rows, 1.0), 1 / k)
        means = (gamma.T @ x) / np.maximum(weight, 1e-12)[:, None]
        for s in range(k):
            diff = x - means[s]
            covs[s] = (gamma[:, s, None] * diff).T @ diff / max(weight[s], 1e-12) + FLOOR * np.eye(d)
    return {"start": start, "trans": trans, "means": means, "covs": covs, "ll": ll, "rounds": rounds}


def score(x, model) -> float:
    return forward(log_density(x, model["means"], model["covs"]), model["start"], model["trans"])[3]


def viterbi(x: np.ndarray, model) -> np.ndarray:
    logp = log_density(x, model["means"], model["covs"])
    with np.errstate(divide="ignore"):
        start, trans = np.log(model["start"]), np.log(model["trans"])
    best, back = start + logp[0], np.empty(logp.shape, dtype=int)
    for t in range(1, len(x)):
        reach = best[:, None] + trans
        back[t] = reach.argmax(axis=0)
        best = reach.max(axis=0) + logp[t]
    path = np.empty(len(x), dtype=int)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
