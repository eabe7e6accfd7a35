"""Guarded linear algebra on small matrices, in numpy."""

from __future__ import annotations

import numpy as np


def safe_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of a symmetric system by its eigenvalues above a relative floor."""
    if not len(a):
        return np.zeros_like(b)
    w, v = np.linalg.eigh((a + a.T) / 2)
    kept = np.abs(w) > np.sqrt(np.finfo(float).eps) * max(np.abs(w).max(), 1e-300)
    return v[:, kept] @ ((v[:, kept].T @ b).T / w[kept]).T


def conditioned_solver(a: np.ndarray, solver: str = "auto"):
    """A function that solves with a fixed matrix: eigen (minimum norm), qr, or by condition number."""
    if solver == "auto":
        solver = "qr" if len(a) and np.linalg.cond(a) < 1e5 else "eigen"
    if solver == "qr":
        q, r = np.linalg.qr(a)
        return lambda b: np.linalg.solve(r, q.T @ b)
    if solver == "eigen":
        return lambda b: safe_solve(a, b)
    raise ValueError(f"no solver {solver}")


def safe_cholesky(m: np.ndarray) -> np.ndarray:
    """Lower factor, with growing jitter and at last by floored eigenvalues."""
    m = (m + m.T) / 2
    for jitter in (0, 1e-8, 1e-6, 1e-4):
        try:
            return np.linalg.cholesky(m + jitter * np.eye(len(m)))
        except np.linalg.LinAlgError:
            continue
    w, v = np.linalg.eigh(m)
    return np.linalg.qr((v * np.sqrt(np.maximum(w, 1e-10))).T)[1].T


def safe_inverse(m: np.ndarray) -> np.ndarray:
    half = np.linalg.inv(safe_cholesky(m))
    return half.T @ half


def root(m: np.ndarray) -> np.ndarray:
    """Symmetric square root."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, 1e-12))) @ v.T


def normal_draw(rng: np.random.Generator, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    return mean + safe_cholesky(covariance) @ rng.standard_normal(len(mean))


def precision_draw(rng: np.random.Generator, precision: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """A draw from the normal with this precision whose mean solves precision x = linear."""
    l = safe_cholesky(precision)
    mean = np.linalg.solve(l.T, np.linalg.solve(l, linear))
    return mean + np.linalg.solve(l.T, rng.standard_normal(len(linear)))


def rank_one_draw(rng: np.random.Generator, diagonal: np.ndarray, factor: float, w: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """A draw as precision_draw makes for the precision diag(diagonal) + factor w w', in linear time."""
    z, z1 = rng.standard_normal(len(w)), rng.standard_normal()
    scaled = w / diagonal
    total = float(w @ scaled)
    if factor > 0:  # noise of the precision itself is a sum of two parts, and is solved with the linear term
        right = linear + np.sqrt(diagonal) * z + np.sqrt(factor) * w * z1
        return right / diagonal - scaled * (factor * float(scaled @ right) / (1 + factor * total))
    gain = -factor / (1 + factor * total)
    return linear / diagonal + scaled * (gain * float(scaled @ linear)) + z / np.sqrt(diagonal) + np.sqrt(max(gain, 0.0)) * scaled * z1


def wishart(rng: np.random.Generator, scale: np.ndarray, df: float) -> np.ndarray:
    """By Bartlett's decomposition."""
    p = len(scale)
    a = np.tril(rng.standard_normal((p, p)), -1)
    a[np.diag_indices(p)] = np.sqrt(rng.chisquare(df - np.arange(p)))
    half = safe_cholesky(scale) @ a
    return half @ half.T


def inverse_gamma(rng: np.random.Generator, shape: float, rate: float, current: float = 1.0, low: float = 1e-8, high: float = np.inf) -> float:
    """A draw within bounds; the current value where the parameters are unusable."""
    if not (np.isfinite(shape) and np.isfinite(rate) and shape > 0 and rate > 0):
        return current
    return float(np.clip(rate / rng.gamma(shape), low, high))


def procrustes(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The orthogonal matrix that brings source nearest to target."""
    u, _, v = np.linalg.svd(source.T @ target)
    return u @ v


def rebalance(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the same product with equal lengths and orthogonal columns."""
    qu, ru = np.linalg.qr(u)
    qv, rv = np.linalg.qr(v)
    a, s, b = np.linalg.svd(ru @ rv.T)
    return qu @ a * np.sqrt(s), qv @ b.T * np.sqrt(s)


def truncate(m: np.ndarray, rank: int, symmetric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the best approximation of this rank; symmetric: by size of eigenvalue, with signs in the second factor."""
    if symmetric:
        w, v = np.linalg.eigh((m + m.T) / 2)
        top = np.argsort(-np.abs(w), kind="stable")[:rank]
        u = v[:, top] * np.sqrt(np.abs(w[top]))
        return u, u * np.sign(w[top])
    u, s, v = np.linalg.svd(m, full_matrices=False)
    return u[:, :rank] * np.sqrt(s[:rank]), v[:rank].T * np.sqrt(s[:rank])


def align_series(x: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rotates (n, r, t) arrays jointly, each period onto the one before, which keeps products of the first two."""
    arrays = [a.copy() for a in (x, *others)]
    for t in range(1, x.shape[2]):
        q = procrustes(np.vstack([a[:, :, t] for a in arrays]), np.vstack([a[:, :, t - 1] for a in arrays]))
        for a in arrays:
            a[:, :, t] = a[:, :, t] @ q
    return tuple(arrays)


def align_bipartite(u: np.ndarray, v: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotates u and v on their own and turns each period's g back, so every u_t g_t v_t' stays; a static g becomes one per period."""
    n_t = u.shape[2]
    g = np.repeat(g[:, :, None], n_t, axis=2) if g.ndim == 2 else g.copy()
    u, v = u.copy(), v.copy()
    for t in range(1, n_t):
        qu, qv = procrustes(u[:, :, t], u[:, :, t - 1]), procrustes(v[:, :, t], v[:, :, t - 1])
        u[:, :, t], v[:, :, t], g[:, :, t] = u[:, :, t] @ qu, v[:, :, t] @ qv, qu.T @ g[:, :, t] @ qv
    return u, v, g
