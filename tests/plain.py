"""Plain versions of what the library computes as folds over arrays."""

import math

import numpy as np


def psis_point(loglik: np.ndarray) -> tuple[float, float]:
    """Leave-one-out density of one point and its Pareto shape (Vehtari, Gelman and Gabry, 2017)."""
    ratios = -loglik - np.max(-loglik)
    n = len(ratios)
    tail = int(min(0.2 * n, 3 * math.sqrt(n)))
    k = float("nan")
    weights = ratios.copy()
    if tail >= 5:
        order = np.argsort(ratios, kind="stable")
        cut = ratios[order[-tail - 1]]
        excess = np.exp(ratios[order[-tail:]]) - math.exp(cut)
        if excess[0] > 0 or excess[-1] > 0:
            k, sigma = _pareto(np.maximum(excess, 1e-300))
            p = (np.arange(tail) + 0.5) / tail
            fitted = -sigma * np.log1p(-p) if abs(k) < 1e-9 else sigma * ((1 - p) ** -k - 1) / k
            weights[order[-tail:]] = np.minimum(np.log(fitted + math.exp(cut)), 0.0)
    weights -= np.log(np.sum(np.exp(weights - weights.max()))) + weights.max()
    terms = weights + loglik
    return float(np.log(np.sum(np.exp(terms - terms.max()))) + terms.max()), k


def _pareto(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto by the estimate of Zhang and Stephens (2009), with its weak prior on the shape."""
    n = len(x)
    m = 30 + int(math.sqrt(n))
    theta = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * max(x[int(n / 4 + 0.5) - 1], 1e-300))
    shape = np.mean(np.log1p(-theta[:, None] * x[None, :]), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        profile = n * (np.log(-theta / shape) - shape - 1)
    w = np.array([1 / np.sum(np.exp(np.minimum(profile - p, 700))) for p in profile])
    t = np.nansum(theta * w) / np.nansum(w)
    k = float(np.mean(np.log1p(-t * x)))
    return (n * k + 5) / (n + 10), -k / t


def chain_ess(x: np.ndarray) -> float:
    n = len(x)
    if n < 4 or np.var(x) == 0:
        return float(n)
    c = x - x.mean()
    rho = np.array([(c[: n - k] * c[k:]).mean() for k in range(n)]) / (c * c).mean()
    pairs = rho[1 : n - (n - 1) % 2].reshape(-1, 2).sum(1)
    pairs = pairs[: int(np.argmax(pairs < 0))] if (pairs < 0).any() else pairs
    return float(min(n, n / max(1e-12, 1 + 2 * np.minimum.accumulate(pairs).sum()))) if len(pairs) else float(n)
