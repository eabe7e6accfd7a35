"""Normal, count and importance-sampling functions in numpy, and the few that queries need as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def ndtr(x) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def log_ndtr(x) -> np.ndarray:
    """Its logarithm, also far in the lower tail, where Laplace's continued fraction takes over."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.empty_like(x)
    deep = x < -8
    with np.errstate(divide="ignore"):
        out[~deep] = np.log(ndtr(x[~deep]))
    t = -x[deep]
    fraction = t.copy()
    for k in range(40, 0, -1):
        fraction = t + k / fraction
    out[deep] = -0.5 * t * t - 0.5 * math.log(2 * math.pi) - np.log(fraction)
    return out


def dnorm_log(x, mean=0.0, sd=1.0) -> np.ndarray:
    z = (np.asarray(x, float) - mean) / sd
    return -0.5 * z * z - np.log(sd) - 0.5 * math.log(2 * math.pi)


def ndtri(p) -> np.ndarray:
    """The normal quantile function: a start from the tail expansion, then Halley steps."""
    p = np.asarray(p, float)
    q = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    t = np.sqrt(-2 * np.log(q))
    x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
    for _ in range(3):
        density = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        r = (0.5 * np.asarray(_erfc(x / math.sqrt(2)), float) - q) / np.maximum(density, 1e-300)
        x = x + r / (1 - 0.5 * x * r)
    return np.where(p < 0.5, -x, x)


def log_ndtr_difference(high, low) -> np.ndarray:
    """log(Phi(high) - Phi(low)), from whichever tail keeps the digits."""
    high, low = np.broadcast_arrays(np.asarray(high, float), np.asarray(low, float))
    flip = low > 0
    a, b = np.where(flip, -high, low), np.where(flip, -low, high)
    lb, la = log_ndtr(b.ravel()), log_ndtr(a.ravel())
    with np.errstate(divide="ignore", invalid="ignore"):
        out = lb + np.log1p(-np.exp(np.minimum(la - lb, 0.0)))
    return np.where(np.isneginf(la), lb, out).reshape(high.shape)


def truncated_normal(rng: np.random.Generator, mean, sd, low, high) -> np.ndarray:
    """Normal draws within bounds; the far tails by the Rayleigh proposal's inverse, whose error is below its rejection rate there."""
    mean, sd, low, high = np.broadcast_arrays(*(np.asarray(v, float) for v in (mean, sd, low, high)))
    a, b = (low - mean) / sd, (high - mean) / sd
    flip = a > 0
    a, b = np.where(flip, -b, a), np.where(flip, -a, b)
    u = rng.random(mean.shape)
    pa, pb = ndtr(a), ndtr(b)
    x = ndtri(np.clip(pa + u * (pb - pa), 1e-300, 1 - 1e-16))
    deep = b < -7
    if deep.any():
        bb, aa = b[deep], np.maximum(a[deep], -1e6)
        least = np.exp(np.clip((bb * bb - aa * aa) / 2, -700, 0))
        x = np.array(x)
        x[deep] = -np.sqrt(bb * bb - 2 * np.log(np.clip(least + (1 - least) * u[deep], 1e-300, 1)))
    x = np.clip(x, a, b)
    return mean + sd * np.where(flip, -x, x)


def log_gamma(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def poisson_log(y, log_rate) -> np.ndarray:
    y = np.asarray(y, float)
    return y * log_rate - np.exp(np.minimum(log_rate, 700)) - log_gamma(y + 1)


@lru_cache(maxsize=8)
def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the expectation under a standard normal."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return x * math.sqrt(2), w / math.sqrt(math.pi)


def poisson_marginal_log(y, eta, variance: float, nodes: int = 20) -> np.ndarray:
    """log of the Poisson density with a normal error on the log rate, by quadrature centred at each mode."""
    y, eta = np.asarray(y, float), np.asarray(eta, float)
    mode = eta.copy()
    for _ in range(12):
        rate = np.exp(np.minimum(mode, 30))
        mode = mode - np.clip((rate - y + (mode - eta) / variance) / (rate + 1 / variance), -2, 2)
    sd = 1 / np.sqrt(np.exp(np.minimum(mode, 30)) + 1 / variance)
    x, w = gauss_hermite(nodes)
    z = mode[..., None] + sd[..., None] * x
    logs = poisson_log(y[..., None], z) + dnorm_log(z, eta[..., None], math.sqrt(variance)) - dnorm_log(z, mode[..., None], sd[..., None]) + np.log(w)
    top = logs.max(-1)
    return top + np.log(np.exp(logs - top[..., None]).sum(-1))


def halton(n: int, base: int, burn: int = 30, shift: float = 0.0) -> np.ndarray:
    """A low-discrepancy sequence in (0, 1): digits of the index in the base, mirrored at the point; shifted modulo one."""
    k = np.arange(burn + 1, burn + n + 1)
    out, scale = np.zeros(n), 1.0
    while k.any():
        scale /= base
        out += scale * (k % base)
        k = k // base
    return np.clip((out + shift) % 1.0, 1e-12, 1 - 1e-12)


def radical_inverse(k: Column, base: int, digits: int = 40) -> Column:
    """The k-th point of the van der Corput sequence of a base, as a fold over the digits of k."""
    step = lambda total, p: total + F.pmod(F.floor(k / F.pow(F.lit(float(base)), p)), F.lit(base)) / F.pow(F.lit(float(base)), p + 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0.0), step)


def primes() -> Iterator[int]:
    found: list[int] = []
    k = 2
    while True:
        if all(k % p for p in found if p * p <= k):
            found.append(k)
            yield k
        k += 1


def rank_probability_log(eta: np.ndarray, order: np.ndarray, n_mc: int = 64, shift: float = 0.0, free: np.ndarray | None = None) -> float:
    """log P(z[order[0]] > z[order[1]] > ... and the last of them above all `free` ones), z normal around eta.

    By simulating the chain from the top with a low-discrepancy sequence, each item truncated above by the one before.
    """
    bases = primes()
    weight, above = np.zeros(n_mc), np.full(n_mc, np.inf)
    for item in order:
        log_p = log_ndtr(np.minimum(above - eta[item], 40.0))
        weight += log_p
        u = halton(n_mc, next(bases), shift=shift)
        above = np.minimum(eta[item] + ndtri(np.clip(u * np.exp(log_p), 1e-300, 1 - 1e-16)), above)
    if free is not None and len(free):
        weight += log_ndtr((above[:, None] - eta[free][None, :]).ravel()).reshape(n_mc, -1).sum(1)
    top = weight.max()
    return float(top + np.log(np.mean(np.exp(weight - top))))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) as plain arithmetic: Abramowitz and Stegun 26.2.17, absolute error below 1.5e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = series * t + c
    return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-a * a / 2) * series * t)


def normal_cdf(z: Column) -> Column:
    """Phi(z) as plain arithmetic, absolute error below 1e-7."""
    half = two_sided_p(z) / 2
    return F.when(z < 0, half).otherwise(1 - half)


def log_normal_cdf(z: Column) -> Column:
    """log Phi(z): of the arithmetic above, and below -5 by the asymptotic series, whose relative error there is below 1e-4."""
    q = 1 / (z * z)
    tail = -0.5 * z * z - F.log(-z) - 0.9189385332046727 + F.log(1 - q * (1 - 3 * q * (1 - 5 * q * (1 - 7 * q))))
    return F.when(z < -5, tail).otherwise(F.log(normal_cdf(z)))


def inverse_link(family: str, eta: Column, link: str | None = None) -> Column:
    """The mean of the response: identity, normal or logistic distribution function, exponential; ranks and ordinals stay on the link scale."""
    if family in ("binary", "cbin"):
        return 1 / (1 + F.exp(-eta)) if link == "logit" else normal_cdf(eta)
    return F.exp(eta) if family == "poisson" else eta
