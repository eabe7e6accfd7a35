"""Gibbs sampling of additive and multiplicative effects models, one chain per call.

z_t = X_t beta_t + a_t 1' + 1 b_t' + u_t G_t v_t' + e_t, where the errors of a pair
and its opposite have correlation rho in square networks, and y is z seen through
the family's link. Static parts are one value for all periods; dynamic ones are
paths with autoregressive priors, drawn whole from their joint precision.

Unobserved cells are drawn with the rest of z, so every other step sees full
arrays but for the diagonal of square networks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from relata.functions import distributions as dist
from relata.functions.linear import inverse_gamma, normal_draw, precision_draw, rank_one_draw, safe_cholesky, safe_inverse, wishart
from relata.plans.arrays import Draws, Panel

FAMILIES = ("normal", "binary", "ordinal", "cbin", "frn", "poisson")
ALIASES = {"nrm": "normal", "bin": "binary", "ord": "ordinal", "pois": "poisson", "poi": "poisson"}


@dataclass
class Options:
    """What is sampled, for how long, and what is kept."""

    family: str = "normal"
    symmetric: bool = False
    rank: int = 0
    rank_col: int | None = None
    row_effects: bool = True
    col_effects: bool = True
    reciprocity: bool = True
    burn: int = 500
    scan: int = 2000
    thin: int = 25
    seed: int = 29
    odmax: int | None = None
    dynamic_ab: bool = False
    dynamic_beta: tuple[str, ...] | bool = False
    beta_kind: str = "ar1"
    dynamic_uv: str | bool = False
    dynamic_g: bool = False
    dynamic_rho: bool = False
    time_index: tuple[float, ...] | None = None
    exposure: tuple[float, ...] | None = None
    keep_ab: bool = True
    keep_uv: bool = True
    keep_loglik: bool = False
    keep_gof: bool = True
    min_obs: int = 0
    cutpoints: str = "data"
    pool_beta: bool = False
    actor_slope: str | None = None
    actor_side: str = "row"
    max_seconds: float | None = None
    prior: dict = field(default_factory=dict)

    def __post_init__(self):
        self.family = ALIASES.get(self.family, self.family)
        if self.family not in FAMILIES:
            raise ValueError(f"no family {self.family}")
        if self.symmetric and self.family in ("cbin", "frn"):
            raise ValueError(f"{self.family} has no symmetric form")
        if self.cutpoints not in ("data", "explicit"):
            raise ValueError("cutpoints come from the data or are explicit")
        if self.actor_side not in ("row", "col"):
            raise ValueError("slopes are those of row or col actors")
        if self.exposure is not None and self.family != "poisson":
            raise ValueError("an exposure needs the poisson family")
        if self.time_index is not None and any(b <= a for a, b in zip(self.time_index, self.time_index[1:])):
            raise ValueError("the time index increases strictly")


def ar1_precision(n: int, rho: float, sigma2: float = 1.0, gaps: np.ndarray | None = None) -> np.ndarray:
    """Precision of a stationary AR(1) path, or of one with unequal gaps between its points."""
    gaps = np.ones(n - 1) if gaps is None else np.asarray(gaps, float)
    q = np.zeros((n, n))
    q[0, 0] = (1 - rho * rho) / sigma2
    for k in range(1, n):
        r = np.sign(rho) ** gaps[k - 1] * abs(rho) ** gaps[k - 1] if rho else 0.0
        v = sigma2 * (1 - r * r) / max(1 - rho * rho, 1e-10)
        q[k - 1, k - 1] += r * r / v
        q[k, k] += 1 / v
        q[k - 1, k] -= r / v
        q[k, k - 1] -= r / v
    return q


def path_precision(n: int, kind: str, rho: float = 0.9, sigma2: float = 1.0, times: np.ndarray | None = None, length: float | None = None, level: float = 0.01) -> np.ndarray:
    """Prior precision of a path: ar1, rw1, rw2 or matern32; the improper ones get a small precision of the level."""
    if n == 1:
        return np.array([[1 / sigma2]])
    if kind == "ar1":
        return ar1_precision(n, rho, sigma2, None if times is None else np.diff(times))
    if kind in ("rw1", "rw2"):
        d = np.diff(np.eye(n), 1 if kind == "rw1" or n < 3 else 2, axis=0)
        return d.T @ d / sigma2 + level * np.eye(n)
    if kind == "matern32":
        times = np.arange(n, dtype=float) if times is None else np.asarray(times, float)
        s = np.sqrt(3) * np.abs(times[:, None] - times[None, :]) / (length or max(2.0, n / 4))
        return safe_inverse(sigma2 * (1 + s) * np.exp(-s) + 1e-8 * np.eye(n))
    raise ValueError(f"no path prior {kind}")


def path_step(kind: str, rho: float = 1.0, periods: int = 3) -> tuple[float, float]:
    """What the next value of a path has of its last two, before noise; walks of second order need three periods."""
    if kind == "ar1":
        return rho, 0.0
    return (2.0, -1.0) if kind == "rw2" and periods >= 3 else (1.0, 0.0)


def ar1_update(rng, paths: np.ndarray, rho: float, shape: float = 2.0, scale: float = 1.0, low: float = 0.0, high: float = 0.995, mean: float = 0.9, sd: float = 0.1, weights: np.ndarray | None = None, begins: bool = True) -> tuple[float, float]:
    """rho and the innovation variance of paths (k, T), with weights of the transitions (0: not part of the process).

    With `begins` paths start in their stationary distribution, whose variance depends on both.
    """
    a, b = paths[:, :-1].ravel(), paths[:, 1:].ravel()
    w = np.ones(len(a)) if weights is None else weights.ravel()
    first = (paths[:, 0] ** 2).sum()
    more = (len(paths) / 2, (1 - rho * rho) * first / 2) if begins else (0.0, 0.0)
    sigma2 = inverse_gamma(rng, shape + (w > 0).sum() / 2 + more[0], scale + (w * (b - rho * a) ** 2).sum() / 2 + more[1])
    precision = (w * a * a).sum() / sigma2 + 1 / sd**2
    centre = ((w * a * b).sum() / sigma2 + mean / sd**2) / precision
    new = float(dist.truncated_normal(rng, centre, precision**-0.5, low, high))
    if begins:
        at_start = lambda r: 0.5 * len(paths) * np.log(max(1 - r * r, 1e-12)) - (1 - r * r) * first / (2 * sigma2)
        if np.log(rng.random()) >= at_start(new) - at_start(rho):
            new = rho
    return new, sigma2


class Chain:
    """State and steps of one chain."""

    def __init__(self, panel: Panel, options: Options, chain: int = 0, start: dict | None = None):
        self.p, self.o, self.chain = panel, options, chain
        self.rng = np.random.default_rng([options.seed, chain])
        self.n, self.m, self.T = panel.shape
        self.square = panel.square
        self.off = ~np.eye(self.n, dtype=bool) if self.square else np.ones((self.n, self.m), bool)
        self.K = panel.x.shape[2]
        self.rank, self.rank_col = options.rank, options.rank if self.square or options.rank_col is None else options.rank_col
        self.use_rho = self.square and options.reciprocity and not options.symmetric
        self.fixed_scale = options.family in ("binary", "ordinal", "cbin", "frn")
        self.log_exposure = np.log(np.asarray(options.exposure, float)) if options.exposure is not None else np.zeros(self.T)
        self.rho, self.s2 = np.zeros(self.T), 1.0
        self.beta = np.zeros((self.K, self.T))
        self.a, self.b = np.zeros((self.n, self.T)), np.zeros((self.m, self.T))
        self.u = self.rng.normal(0, 0.1, (self.n, self.rank, self.T))
        self.v = self.u.copy() if options.symmetric else self.rng.normal(0, 0.1, (self.m, self.rank_col, self.T))
        if not options.dynamic_uv:
            self.u[:] = self.u[:, :, :1]
            self.v[:] = self.v[:, :, :1]
        self.g = np.repeat(np.eye(self.rank, self.rank_col)[:, :, None], self.T, 2)
        self.sign = np.ones(self.rank)
        self.sab = np.eye(2)
        self.suv = (np.ones(self.rank), np.ones(self.rank_col))
        self.rho_ab = self.rho_uv = 0.9
        self.sig_ab = self.sig_uv = 0.1
        self.rho_beta, self.sig_beta = np.full(self.K, 0.9), np.full(self.K, 0.1)
        self.rho_g, self.sig_g = 0.9, 0.1
        self.snap_u, self.snap_v = np.zeros((self.n, self.T)), np.zeros((self.m, self.T))
        self.lam_u, self.lam_v = np.ones((self.n, self.T)), np.ones((self.m, self.T))
        self.pi_snap = 0.1
        self.levels = np.unique(panel.y[panel.seen]) if options.family == "ordinal" else None
        self.alpha, self.cut_step, self.cut_taken = None, 0.1, []
        if options.family == "ordinal" and options.cutpoints == "explicit":
            share = np.array([(panel.y[panel.seen] <= v).mean() for v in self.levels[:-1]])
            self.alpha = dist.ndtri(np.clip(share, 1e-3, 1 - 1e-3))
        self.swept = 0
        self.theta = np.zeros((self.n if options.actor_side == "row" else self.m, self.T))
        self.slope_at = panel.names.index(options.actor_slope) if options.actor_slope else None
        self.rho_actor, self.sig_actor = 0.8, 0.1
        self.beta_scale, self.beta_mean = 1.0, 0.9
        moving = options.dynamic_beta
        self.moving = np.array([moving is True or (moving is not False and (n in moving or any(n.endswith(f"_{s}") for s in moving if s in ("row", "col", "dyad")))) for n in panel.names], bool)
        # priors of moving coefficients are on the scale of their covariates
        mean_square = (panel.x**2).mean((0, 1, 3)) if self.K else np.zeros(0)
        self.scale = np.sqrt(np.where(mean_square > 0, mean_square, 1.0))
        self.z = self._start()
        self.xx = np.einsum("ijkt,ijlt->klt", self.x_off, self.x_off)
        self.xxt = np.einsum("ijkt,jilt->klt", self.x_off, self.x_off) if self.square else None
        for k, value in (start or {}).items():
            setattr(self, k, np.array(value) if isinstance(value, (list, np.ndarray)) else value)

    @property
    def x_off(self) -> np.ndarray:
        return self.p.x * self.off[:, :, None, None]

    def _start(self) -> np.ndarray:
        y, f = self.p.y, self.o.family
        if f == "normal":
            z = y.copy()
        elif f == "poisson":
            z = np.log1p(y) - self.log_exposure
        else:
            z = np.full_like(y, np.nan)
            for t in range(self.T):
                seen = ~np.isnan(y[:, :, t])
                values = y[:, :, t][seen]
                if not len(values):
                    continue
                order = np.argsort(np.argsort(values, kind="stable"), kind="stable") + 1.0
                for v in np.unique(values):
                    order[values == v] = order[values == v].mean()
                score = dist.ndtri(order / (1 + len(values)))
                if f != "ordinal":
                    top, low = score[values == 0], score[values > 0]
                    score = score - ((top.max() if len(top) else 0) + (low.min() if len(low) else 0)) / 2
                z[:, :, t][seen] = score
        with np.errstate(invalid="ignore"):
            mean = np.nanmean(z) if np.isfinite(z).any() else 0.0
        z = np.where(np.isnan(z), mean, z)
        self.s2 = max(float(z[np.broadcast_to(self.off[:, :, None], z.shape)].var()), 1e-3) if not self.fixed_scale else 1.0
        return z

    def linear(self) -> np.ndarray:
        return np.einsum("ijkt,kt->ijt", self.p.x, self.beta) if self.K else np.zeros(self.p.shape)

    def additive(self) -> np.ndarray:
        return self.a[:, None, :] + self.b[None, :, :]

    def multiplicative(self) -> np.ndarray:
        if not self.rank:
            return np.zeros(self.p.shape)
        if self.square:
            v = self.u * self.sign[None, :, None] if self.o.symmetric else self.v
            return np.einsum("irt,jrt->ijt", self.u, v)
        return np.einsum("irt,rst,jst->ijt", self.u, self.g, self.v)

    def ahead(self, x: np.ndarray) -> np.ndarray:
        """Positions one period on from x (n, r): drift, and resets or heavy tails where the model has them."""
        kind = self.o.dynamic_uv if isinstance(self.o.dynamic_uv, str) else "ar1"
        noise = self.sig_uv**0.5 * self.rng.standard_normal(x.shape)
        if kind == "t":
            nu = float(self.o.prior.get("nu", 4.0))
            noise /= np.sqrt(self.rng.gamma(nu / 2, 2 / nu, (len(x), 1)))
        new = self.rho_uv * x + noise
        if kind == "snap":
            again = self.rng.random((len(x), 1)) < self.pi_snap
            new = np.where(again, float(self.o.prior.get("kappa", 1.0)) * self.rng.standard_normal(x.shape), new)
        return new

    def coefficients_ahead(self) -> np.ndarray:
        """Coefficients of the period after the last, on the covariates' own scale."""
        now = self.beta[:, -1].copy()
        for k in np.flatnonzero(self.moving):
            last, before = path_step(self.o.beta_kind, self.rho_beta[k], self.T)
            noise = self.sig_beta[k] ** 0.5 / self.scale[k] * self.rng.standard_normal()
            now[k] = last * self.beta[k, -1] + before * self.beta[k, max(self.T - 2, 0)] + noise
        return now

    def additive_ahead(self) -> tuple[np.ndarray, np.ndarray]:
        """Effects of the period after the last; one draw for both sides of a symmetric network, none for absent ones."""
        a, b = self.a[:, -1], self.b[:, -1]
        if not self.o.dynamic_ab:
            return a, b
        step = lambda x: self.rho_ab * x + self.sig_ab**0.5 * self.rng.standard_normal(len(x))
        a = step(a) if self.o.row_effects else a
        if self.o.symmetric:
            return a, a
        return a, step(b) if self.o.col_effects else b

    def multiplicative_ahead(self) -> np.ndarray:
        """The products of positions in the period after the last, drawn from their process if they move."""
        if not self.rank or not self.o.dynamic_uv:
            return self.multiplicative()[:, :, -1]
        u = self.ahead(self.u[:, :, -1])
        if self.o.symmetric:
            return u @ (u * self.sign[None, :]).T
        v = self.ahead(self.v[:, :, -1])
        return u @ v.T if self.square else u @ self.g[:, :, -1] @ v.T

    def slopes_ahead(self, x: np.ndarray) -> np.ndarray:
        """What actors' own slopes add in the period after the last, whose covariates are x (n, m, K)."""
        if self.slope_at is None:
            return np.zeros(x.shape[:2])
        theta = self.rho_actor * self.theta[:, -1] + self.sig_actor**0.5 * self.rng.standard_normal(len(self.theta))
        return x[:, :, self.slope_at] * (theta[:, None] if self.o.actor_side == "row" else theta[None, :])

    def slopes(self) -> np.ndarray:
        """What actors' own slopes of one covariate add."""
        if self.slope_at is None:
            return np.zeros(self.p.shape)
        x = self.p.x[:, :, self.slope_at]
        return x * (self.theta[:, None, :] if self.o.actor_side == "row" else self.theta[None, :, :])

    def eta(self) -> np.ndarray:
        return self.linear() + self.slopes() + self.additive() + self.multiplicative()

    def whitener(self, t: int) -> tuple[float, float]:
        """c and d such that c E + d E' has independent cells of variance one."""
        s = self.s2**0.5
        if not self.use_rho:
            return 1 / s, 0.0
        p, q = (1 + self.rho[t]) ** -0.5, (1 - self.rho[t]) ** -0.5
        return (p + q) / 2 / s, (p - q) / 2 / s

    # latent response ------------------------------------------------------------------------

    def bounds(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each latent cell given the response and, for ranks, the other latent cells."""
        y, z, f = self.p.y[:, :, t], self.z[:, :, t], self.o.family
        low, high = np.full(y.shape, -np.inf), np.full(y.shape, np.inf)
        seen = ~np.isnan(y)
        if f == "binary":
            low[seen & (y > 0)], high[seen & (y <= 0)] = 0.0, 0.0
        elif f == "ordinal" and self.alpha is not None:
            cuts = np.concatenate([[-np.inf], self.alpha, [np.inf]])
            k = np.searchsorted(self.levels, y[seen])
            low[seen], high[seen] = cuts[k], cuts[k + 1]
        elif f == "ordinal":
            levels = np.unique(y[seen])
            for k, v in enumerate(levels):
                at = seen & (y == v)
                if k:
                    low[at] = self.z[:, :, t][seen & (y == levels[k - 1])].max()
                if k + 1 < len(levels):
                    high[at] = self.z[:, :, t][seen & (y == levels[k + 1])].min()
        else:
            full = np.nansum(y > 0, axis=1) >= self.odmax
            masked = np.where(seen, z, np.nan)
            with np.errstate(all="ignore"):
                worst = np.nanmin(np.where(y > 0, masked, np.inf), axis=1)
                best_other = np.nanmax(np.where(seen & (y == 0), masked, -np.inf), axis=1)
            rows = np.broadcast_to(np.arange(y.shape[0])[:, None], y.shape)
            zero, tie = seen & (y == 0), seen & (y > 0)
            high[zero] = np.where(full[rows[zero]], worst[rows[zero]], np.minimum(0.0, worst[rows[zero]]))
            low[tie] = np.maximum(0.0, best_other[rows[tie]])
            if f == "frn":
                for v in np.unique(y[tie]):
                    at = tie & (y == v)
                    below = np.where(tie & (y < v), z, -np.inf).max(axis=1)
                    above = np.where(tie & (y > v), z, np.inf).min(axis=1)
                    low[at] = np.maximum(low[at], below[rows[at]])
                    high[at] = np.minimum(high[at], above[rows[at]])
        return low, high

    @property
    def odmax(self) -> float:
        return self.o.odmax if self.o.odmax is not None else float(np.nanmax(np.nansum(self.p.y > 0, axis=1)))

    def draw_z(self, eta: np.ndarray) -> None:
        """Cells above the diagonal given those below, then the other way round; diagonals and rectangles at once."""
        for t in range(self.T):
            rho = self.rho[t] if self.use_rho else 0.0
            parts = [np.triu(np.ones((self.n, self.n), bool), 1), np.tril(np.ones((self.n, self.n), bool), -1)] if self.square else [np.ones((self.n, self.m), bool)]
            for part in parts:
                z, e = self.z[:, :, t], eta[:, :, t]
                mean = e + rho * (z.T - e.T) if self.square else e
                sd = (self.s2 * (1 - rho * rho)) ** 0.5
                y = self.p.y[:, :, t]
                if self.o.family == "normal":
                    at = part & np.isnan(y)
                    z[at] = mean[at] + sd * self.rng.standard_normal(at.sum())
                elif self.o.family == "poisson":
                    self._poisson(z, mean, sd, y, part, self.log_exposure[t])
                else:
                    low, high = self.bounds(t)
                    z[part] = dist.truncated_normal(self.rng, mean[part], sd, low[part], high[part])
            if self.square:
                d = np.arange(self.n)
                self.z[d, d, t] = eta[d, d, t]
            if self.o.symmetric:
                upper = np.triu(self.z[:, :, t], 1)
                self.z[:, :, t] = upper + upper.T + np.diag(np.diag(eta[:, :, t]))

    def _poisson(self, z, mean, sd, y, part, log_exposure) -> None:
        at = part & ~np.isnan(y)
        lost = part & np.isnan(y)
        z[lost] = mean[lost] + sd * self.rng.standard_normal(lost.sum())
        now, m, count = z[at], mean[at], y[at]
        step = 1 / np.sqrt(1 / sd**2 + np.maximum(count, 0.5))
        new = now + 2.0 * step * self.rng.standard_normal(len(now))
        target = lambda x: dist.poisson_log(count, x + log_exposure) - 0.5 * ((x - m) / sd) ** 2
        z[at] = np.where(np.log(self.rng.random(len(now))) < target(new) - target(now), new, now)

    def draw_cutpoints(self, eta: np.ndarray, adapt: bool) -> None:
        """Metropolis step on the first cutpoint and the log gaps, with the latent response integrated out (Cowles, 1996)."""
        seen = self.p.seen & self.off[:, :, None]
        y, e = np.searchsorted(self.levels, self.p.y[seen]), eta[seen]

        def log_target(delta: np.ndarray) -> tuple[float, np.ndarray]:
            alpha = np.cumsum(np.concatenate([delta[:1], np.exp(delta[1:])]))
            cuts = np.concatenate([[-np.inf], alpha, [np.inf]])
            return float(dist.log_ndtr_difference(cuts[y + 1] - e, cuts[y] - e).sum() - (delta**2).sum() / 200), alpha

        now = np.concatenate([self.alpha[:1], np.log(np.maximum(np.diff(self.alpha), 1e-8))])
        new = now + self.cut_step * self.rng.standard_normal(len(now))
        (old_log, _), (new_log, alpha) = log_target(now), log_target(new)
        taken = np.log(self.rng.random()) < new_log - old_log
        if taken:
            self.alpha = alpha
        self.cut_taken.append(taken)
        if adapt and len(self.cut_taken) % 25 == 0:
            self.cut_step *= 1.2 if np.mean(self.cut_taken[-25:]) > 0.35 else 0.8

    def draw_slopes(self, e: np.ndarray) -> None:
        """Paths of actors' own slopes, with mean zero over actors in every period; e: z without all other parts."""
        x = self.p.x[:, :, self.slope_at] * self.off[:, :, None]
        side = 1 if self.o.actor_side == "row" else 0
        gram, linear = (x * x).sum(side) / self.s2, (x * e).sum(side) / self.s2
        prior = ar1_precision(self.T, self.rho_actor, self.sig_actor)
        precision = prior + np.einsum("it,ts->its", gram, np.eye(self.T))
        mean = np.linalg.solve(precision, linear[:, :, None])
        noise = np.linalg.solve(np.linalg.cholesky(precision).transpose(0, 2, 1), self.rng.standard_normal(mean.shape))
        self.theta = (mean + noise)[:, :, 0]
        self.theta -= self.theta.mean(0)
        if self.T > 1:
            self.rho_actor, self.sig_actor = ar1_update(self.rng, self.theta, self.rho_actor)
        else:
            self.sig_actor = inverse_gamma(self.rng, 2 + self.theta.size / 2, 1 + (self.theta**2).sum() / 2)

    # scales ---------------------------------------------------------------------------------

    def pair_sums(self, e: np.ndarray, t: int) -> tuple[float, float, int]:
        full = e[:, :, t] * self.off
        return float((full * full).sum()), float((full * full.T).sum()) / 2, self.n * (self.n - 1) // 2

    def draw_scale(self, e: np.ndarray) -> None:
        if not self.fixed_scale:
            ss, cells = 0.0, 0
            for t in range(self.T):
                if self.o.symmetric:
                    i, j = np.triu_indices(self.n, 1)
                    ss, cells = ss + (e[i, j, t] ** 2).sum(), cells + len(i)
                elif self.square:
                    s, c, n = self.pair_sums(e, t)
                    ss, cells = ss + (s - 2 * self.rho[t] * c) / (1 - self.rho[t] ** 2), cells + 2 * n
                else:
                    ss, cells = ss + (e[:, :, t] ** 2).sum(), cells + self.n * self.m
            self.s2 = inverse_gamma(self.rng, (1 + cells) / 2, (1 + ss) / 2, self.s2)
        if self.use_rho:
            grid = np.linspace(-0.995, 0.995, 399)
            sums = np.array([self.pair_sums(e, t) for t in range(self.T)])
            groups = [[t] for t in range(self.T)] if self.o.dynamic_rho else [list(range(self.T))]
            for g in groups:
                s, c, n = sums[g].sum(0)
                log_p = -0.5 * n * np.log(1 - grid**2) - (s - 2 * grid * c) / (2 * self.s2 * (1 - grid**2))
                p = np.exp(log_p - log_p.max())
                self.rho[g] = np.clip(self.rng.choice(grid, p=p / p.sum()) + self.rng.uniform(-0.0025, 0.0025), -0.995, 0.995)

    # coefficients and additive effects --------------------------------------------------------

    def draw_beta(self, e: np.ndarray) -> None:
        """e: z without additive and multiplicative effects."""
        if not self.K:
            return
        k, n_t = self.K, self.T
        xx, xe = np.zeros((k, k, n_t)), np.zeros((k, n_t))
        x = self.x_off
        for t in range(n_t):
            c, d = self.whitener(t)
            et = e[:, :, t] * self.off
            if self.o.symmetric:
                xx[:, :, t], xe[:, t] = self.xx[:, :, t] / (2 * self.s2), np.einsum("ijk,ij->k", x[:, :, :, t], et) / (2 * self.s2)
            elif self.square:
                xx[:, :, t] = (c * c + d * d) * self.xx[:, :, t] + c * d * (self.xxt[:, :, t] + self.xxt[:, :, t].T)
                xe[:, t] = np.einsum("ijk,ij->k", x[:, :, :, t], (c * c + d * d) * et + 2 * c * d * et.T)
            else:
                xx[:, :, t], xe[:, t] = c * c * self.xx[:, :, t], c * c * np.einsum("ijk,ij->k", x[:, :, :, t], et)
        fixed = np.flatnonzero(~self.moving)
        moving = np.flatnonzero(self.moving)
        if len(fixed):
            rest = xe - np.einsum("klt,lt->kt", xx[:, moving], self.beta[moving]) if len(moving) else xe
            g = float(self.o.prior.get("g", self.p.seen.sum()))
            total = xx[np.ix_(fixed, fixed)].sum(2)
            drawn = precision_draw(self.rng, total * (1 + 1 / g) + 1e-8 * np.eye(len(fixed)), rest[fixed].sum(1))
            self.beta[fixed] = drawn[:, None]
        if len(moving):
            rest = xe - np.einsum("klt,lt->kt", xx[:, fixed], self.beta[fixed]) if len(fixed) else xe
            q = len(moving)
            precision = np.zeros((q * n_t, q * n_t))
            for r, kk in enumerate(moving):
                precision[r * n_t : (r + 1) * n_t, r * n_t : (r + 1) * n_t] = path_precision(n_t, self.o.beta_kind, self.rho_beta[kk], self.sig_beta[kk] / self.scale[kk] ** 2, self.o.time_index, level=0.01 * self.scale[kk] ** 2)
                for s, ll in enumerate(moving):
                    block = precision[r * n_t : (r + 1) * n_t, s * n_t : (s + 1) * n_t]
                    block[np.diag_indices(n_t)] += xx[kk, ll]
            self.beta[moving] = precision_draw(self.rng, precision, rest[moving].ravel()).reshape(q, n_t)
            for kk in moving:
                if n_t < 2:
                    continue
                if self.o.beta_kind == "ar1":
                    self.rho_beta[kk], self.sig_beta[kk] = ar1_update(self.rng, self.scale[kk] * self.beta[kk][None], self.rho_beta[kk], scale=self.beta_scale, low=-0.995, mean=self.beta_mean)
                else:
                    unit = path_precision(n_t, self.o.beta_kind, 0.9, 1.0, self.o.time_index, level=0.0)
                    self.sig_beta[kk] = inverse_gamma(self.rng, 2 + n_t / 2, 1 + self.scale[kk] ** 2 * (self.beta[kk] @ unit @ self.beta[kk]) / 2)

        if self.o.pool_beta and len(moving) > 1:  # what the moving coefficients have in common
            k = len(moving)
            self.beta_scale = float(self.rng.gamma(2 + 2 * k, 1 / (0.5 + (1 / self.sig_beta[moving]).sum())))
            centre = (self.rho_beta[moving].sum() / 0.01 + 0.9 / 0.04) / (k / 0.01 + 1 / 0.04)
            self.beta_mean = float(centre + self.rng.standard_normal() * (k / 0.01 + 1 / 0.04) ** -0.5)

    def draw_additive(self, e: np.ndarray) -> None:
        """e: z without linear and multiplicative part."""
        if not (self.o.row_effects or self.o.col_effects):
            return
        if self.o.dynamic_ab and self.T > 1:
            self._dynamic_additive(e)
            return
        n, m = self.n, self.m
        if self.o.symmetric:
            r = (e * self.off[:, :, None]).sum((1, 2)) / self.s2
            d = self.T / self.s2
            precision = d * ((n - 2) * np.eye(n) + np.ones((n, n))) + np.eye(n) / self.sab[0, 0]
            self.a[:] = precision_draw(self.rng, precision, r)[:, None]
            self.b[:] = self.a
            self.sab[0, 0] = self.sab[1, 1] = inverse_gamma(self.rng, (1 + n) / 2, (1 + (self.a[:, 0] ** 2).sum()) / 2, self.sab[0, 0])
        elif self.square:
            # cells give kron(within, I) + kron(between, J): means and deviations separate
            within, between, linear = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((2, n))
            for t in range(self.T):
                c, d = self.whitener(t)
                white = (c * e[:, :, t] + d * e[:, :, t].T) * self.off
                turn = np.array([[c, d], [d, c]])
                within += turn.T @ np.array([[n - 1, -1], [-1, n - 1]]) @ turn
                between += turn.T @ np.array([[0, 1], [1, 0]]) @ turn
                linear += turn.T @ np.stack([white.sum(1), white.sum(0)])
            both = self.o.row_effects and self.o.col_effects
            use = [0, 1] if both else [0] if self.o.row_effects else [1]
            within = within + (safe_inverse(self.sab) if both else np.diag(1 / np.diag(self.sab)))
            within, between, linear = within[np.ix_(use, use)], between[np.ix_(use, use)], linear[use]
            noise = self.rng.standard_normal(linear.shape)
            deviations = np.linalg.solve(within, linear) + np.linalg.solve(safe_cholesky(within).T, noise)
            deviations -= deviations.mean(1)[:, None]
            centre = precision_draw(self.rng, within + n * between, linear.sum(1) / n**0.5) / n**0.5
            drawn = np.zeros((2, n))
            drawn[use] = deviations + centre[:, None]
            self.a[:], self.b[:] = drawn[0][:, None], drawn[1][:, None]
            ab = np.stack([self.a[:, 0], self.b[:, 0]])
            if both:
                self.sab = safe_inverse(wishart(self.rng, safe_inverse(4 * np.eye(2) * float(self.o.prior.get("sab", 0.25)) + ab @ ab.T), 4 + n))
            else:
                k = 0 if self.o.row_effects else 1
                self.sab[k, k] = inverse_gamma(self.rng, (1 + n) / 2, (1 + (ab[k] ** 2).sum()) / 2)
        else:
            for which, axis, size, other in (("a", 1, n, m), ("b", 0, m, n)):
                if not (self.o.row_effects if which == "a" else self.o.col_effects):
                    continue
                rest = e - (self.b[None, :, :] if which == "a" else self.a[:, None, :])
                k = 0 if which == "a" else 1
                precision = self.T * other / self.s2 + 1 / self.sab[k, k]
                drawn = rest.sum((axis, 2)) / self.s2 / precision + self.rng.standard_normal(size) * precision**-0.5
                setattr(self, which, np.repeat(drawn[:, None], self.T, 1))
                self.sab[k, k] = inverse_gamma(self.rng, (1 + size) / 2, (1 + (drawn**2).sum()) / 2)
        if self.o.min_obs > 1 and not self.o.symmetric:
            seen = self.p.seen
            self.a *= np.minimum(1.0, seen.sum((1, 2)) / self.o.min_obs)[:, None]
            self.b *= np.minimum(1.0, seen.sum((0, 2)) / self.o.min_obs)[:, None]

    def _draw_additive_paths(self, e: np.ndarray, prior: np.ndarray) -> None:
        """Row paths, then column paths; the paths of a symmetric network meet in every dyad, so they are drawn one actor after the other."""
        if self.o.symmetric:
            precision = prior + np.eye(self.T) * (self.n - 1) / self.s2
            half, inverse = np.linalg.cholesky(precision), np.linalg.inv(precision)
            for i in range(self.n):
                sums = ((e[i] - self.a) * self.off[i][:, None]).sum(0) / self.s2
                self.a[i] = inverse @ sums + np.linalg.solve(half.T, self.rng.standard_normal(self.T))
            self.b = self.a.copy()
            return
        for which in ("a", "b"):
            if not (self.o.row_effects if which == "a" else self.o.col_effects):
                continue
            size, other = (self.n, self.m) if which == "a" else (self.m, self.n)
            rest = (e - (self.b[None, :, :] if which == "a" else self.a[:, None, :])) * self.off[:, :, None]
            sums = rest.sum(1 if which == "a" else 0) / self.s2
            precision = prior + np.eye(self.T) * (other - (1 if self.square else 0)) / self.s2
            half = np.linalg.cholesky(precision)
            mean = np.linalg.solve(precision, sums.T)
            setattr(self, which, (mean + np.linalg.solve(half.T, self.rng.standard_normal((self.T, size)))).T)

    def _dynamic_additive(self, e: np.ndarray) -> None:
        gaps = None if self.o.time_index is None else np.diff(self.o.time_index)
        self._draw_additive_paths(e, ar1_precision(self.T, self.rho_ab, self.sig_ab, gaps))
        paths = self.a if self.o.symmetric or not self.o.col_effects else (np.vstack([self.a, self.b]) if self.o.row_effects else self.b)
        self.rho_ab, self.sig_ab = ar1_update(self.rng, paths, self.rho_ab)
        both = np.cov(self.a.ravel(), self.b.ravel()) if self.square else np.diag([self.a.var(), self.b.var()])
        self.sab = both

    # multiplicative effects --------------------------------------------------------------------

    def draw_multiplicative(self, e: np.ndarray) -> None:
        """e: z without linear and additive part."""
        if not self.rank:
            return
        if self.o.dynamic_uv and self.T > 1:
            self._dynamic_factors(e)
        elif self.square and self.o.symmetric:
            self._symmetric_factors(e)
        elif self.square:
            self._square_factors(e)
        else:
            self._static_bipartite(e)
        if not self.square:
            self._mixing(e)
        if not self.o.dynamic_uv:
            for k, x in ((0, self.u[:, :, 0]), (1, self.v[:, :, 0])):
                if k and self.o.symmetric:
                    continue
                self.suv[k][:] = [inverse_gamma(self.rng, (2 + len(x)) / 2, (1 + (x[:, r] ** 2).sum()) / 2) for r in range(x.shape[1])]

    def _square_factors(self, e: np.ndarray) -> None:
        """A whole column of positions at a time. Its precision is a diagonal plus a multiple of one outer product:
        own cells give the diagonal, and opposite cells, whose errors correlate, the product."""
        u, v = self.u[:, :, 0].copy(), self.v[:, :, 0].copy()
        cd = [self.whitener(t) for t in range(self.T)]
        weight, cross = sum(c * c + d * d for c, d in cd), sum(2 * c * d for c, d in cd)
        white = [(c * e[:, :, t] + d * e[:, :, t].T) * self.off for t, (c, d) in enumerate(cd)]
        along = sum(c * w + d * w.T for w, (c, d) in zip(white, cd))
        back = sum(c * w.T + d * w for w, (c, d) in zip(white, cd))
        for mine, other, data, variance in ((u, v, along, self.suv[0]), (v, u, back, self.suv[1])):
            linear, gram = data @ other, other.T @ other
            for r in range(self.rank):
                w = other[:, r]
                rest = linear[:, r]
                for s in range(self.rank):
                    if s != r:
                        own = mine[:, s] * other[:, s] * w
                        rest = rest - weight * (gram[r, s] * mine[:, s] - own) - cross * ((w @ mine[:, s]) * other[:, s] - own)
                diagonal = weight * (gram[r, r] - w * w) + 1 / variance[r] - cross * w * w
                mine[:, r] = rank_one_draw(self.rng, diagonal, cross, w, rest)
        self.u[:], self.v[:] = u[:, :, None], v[:, :, None]

    def _symmetric_factors(self, e: np.ndarray) -> None:
        u = self.u[:, :, 0].copy()
        total = (e * self.off[:, :, None]).sum(2) / self.s2
        for i in range(self.n):
            w = u * self.sign
            w[i] = 0
            u[i] = precision_draw(self.rng, self.T * w.T @ w / self.s2 + np.diag(1 / self.suv[0]), total[i] @ w)
        i, j = np.triu_indices(self.n, 1)
        for r in range(self.rank):
            rest = total[i, j] - self.T / self.s2 * ((u[i] * u[j]) @ self.sign - self.sign[r] * u[i, r] * u[j, r])
            x = u[i, r] * u[j, r]
            gain = 2 * (rest * x).sum()
            self.sign[r] = 1.0 if self.rng.random() < 1 / (1 + np.exp(-np.clip(gain, -35, 35))) else -1.0
        self.u[:] = u[:, :, None]
        self.v = self.u * self.sign[None, :, None]

    def _static_bipartite(self, e: np.ndarray) -> None:
        for which in ("u", "v"):
            w = [self.v[:, :, t] @ self.g[:, :, t].T if which == "u" else self.u[:, :, t] @ self.g[:, :, t] for t in range(self.T)]
            prior = np.diag(1 / self.suv[0 if which == "u" else 1])
            precision = sum(x.T @ x for x in w) / self.s2 + prior
            linear = sum((e[:, :, t] if which == "u" else e[:, :, t].T) @ w[t] for t in range(self.T)) / self.s2
            half = np.linalg.cholesky(precision)
            drawn = np.linalg.solve(precision, linear.T).T + np.linalg.solve(half.T, self.rng.standard_normal(linear.T.shape)).T
            setattr(self, which, np.repeat(drawn[:, :, None], self.T, 2))

    def _mixing(self, e: np.ndarray) -> None:
        r, s, n_t = self.rank, self.rank_col, self.T
        parts = [(np.kron(self.v[:, :, t].T @ self.v[:, :, t], self.u[:, :, t].T @ self.u[:, :, t]) / self.s2, (self.u[:, :, t].T @ e[:, :, t] @ self.v[:, :, t]).ravel("F") / self.s2) for t in range(n_t)]
        if self.o.dynamic_g and n_t > 1:
            precision = np.kron(ar1_precision(n_t, self.rho_g, self.sig_g), np.eye(r * s))
            for t, (p, _) in enumerate(parts):
                precision[t * r * s : (t + 1) * r * s, t * r * s : (t + 1) * r * s] += p
            path = precision_draw(self.rng, precision, np.concatenate([x for _, x in parts])).reshape(n_t, r * s)
            for t in range(n_t):
                self.g[:, :, t] = path[t].reshape(r, s, order="F")
            self.rho_g, self.sig_g = ar1_update(self.rng, path.T, self.rho_g)
        else:
            drawn = precision_draw(self.rng, sum(p for p, _ in parts) + np.eye(r * s), sum(x for _, x in parts))
            self.g[:] = drawn.reshape(r, s, order="F")[:, :, None]

    def _dynamic_factors(self, e: np.ndarray) -> None:
        """Whole paths of each actor's position: drift with ar1 innovations, resets (snap) or heavy tails (t)."""
        kind, n_t = (self.o.dynamic_uv if isinstance(self.o.dynamic_uv, str) else "ar1"), self.T
        kappa2, nu = float(self.o.prior.get("kappa", 1.0)) ** 2, float(self.o.prior.get("nu", 4.0))
        masked = e * self.off[:, :, None]
        for which in ("u",) if self.o.symmetric else ("u", "v"):
            mine, other = (self.u, self.v) if which == "u" else (self.v, self.u)
            snap, lam = (self.snap_u, self.lam_u) if which == "u" else (self.snap_v, self.lam_v)
            r = mine.shape[1]
            if self.square:
                w = other * self.sign[None, :, None] if self.o.symmetric else other
            elif which == "u":
                w = np.einsum("jst,rst->jrt", other, self.g)
            else:
                w = np.einsum("irt,rst->ist", other, self.g)
            grams = np.einsum("jrt,jst->rst", w, w)
            rows = masked if which == "u" else masked.transpose(1, 0, 2)
            linear = np.einsum("ijt,jrt->irt", rows, w) / self.s2
            for i in range(len(mine)):
                precision = np.zeros((n_t * r, n_t * r))
                for t in range(n_t):
                    gram = grams[:, :, t] - (np.outer(w[i, :, t], w[i, :, t]) if self.square else 0)
                    s = slice(t * r, (t + 1) * r)
                    precision[s, s] += gram / self.s2
                    if t == 0:
                        precision[s, s] += np.eye(r) * (1 - self.rho_uv**2) / self.sig_uv
                    elif kind == "snap" and snap[i, t]:
                        precision[s, s] += np.eye(r) / kappa2
                    else:
                        q = (lam[i, t] if kind == "t" else 1.0) / self.sig_uv
                        before = slice((t - 1) * r, t * r)
                        precision[s, s] += q * np.eye(r)
                        precision[before, before] += self.rho_uv**2 * q * np.eye(r)
                        precision[s, before] -= self.rho_uv * q * np.eye(r)
                        precision[before, s] -= self.rho_uv * q * np.eye(r)
                drawn = precision_draw(self.rng, precision, linear[i].T.ravel())
                mine[i] = drawn.reshape(n_t, r).T
                if self.o.symmetric:
                    w[i] = mine[i] * self.sign[:, None]
            step = mine[:, :, 1:] - self.rho_uv * mine[:, :, :-1]
            ss = (step**2).sum(1)
            if kind == "snap":
                drift = -0.5 * (ss / self.sig_uv + r * np.log(self.sig_uv))
                reset = -0.5 * ((mine[:, :, 1:] ** 2).sum(1) / kappa2 + r * np.log(kappa2))
                odds = np.clip(np.log(self.pi_snap / (1 - self.pi_snap)) + reset - drift, -35, 35)
                snap[:, 1:] = self.rng.random(odds.shape) < 1 / (1 + np.exp(-odds))
            elif kind == "t":
                lam[:, 1:] = self.rng.gamma((nu + r) / 2, 2 / (nu + ss / self.sig_uv))
        if self.o.symmetric:
            self.v = self.u * self.sign[None, :, None]
        stack = [(self.u, self.snap_u, self.lam_u)] + ([] if self.o.symmetric else [(self.v, self.snap_v, self.lam_v)])
        paths = np.concatenate([x.transpose(0, 1, 2).reshape(-1, n_t) for x, *_ in stack])
        weights = np.concatenate([np.repeat((lam if kind == "t" else 1.0 - snap)[:, None, 1:], x.shape[1], 1).reshape(-1, n_t - 1) for x, snap, lam in stack])
        self.rho_uv, self.sig_uv = ar1_update(self.rng, paths, self.rho_uv, weights=weights)
        if kind == "snap":
            total = sum(s[:, 1:].sum() for _, s, _ in stack)
            cells = sum(s[:, 1:].size for _, s, _ in stack)
            self.pi_snap = float(np.clip(self.rng.beta(1 + total, 9 + cells - total), 1e-4, 0.5))

    # a sweep, and output ----------------------------------------------------------------------

    def sweep(self) -> None:
        eta = self.eta()
        if self.alpha is not None:
            self.draw_cutpoints(eta, adapt=self.swept < self.o.burn)
        self.draw_z(eta)
        self.draw_scale(self.z - eta)
        self.draw_beta(self.z - self.slopes() - self.additive() - self.multiplicative())
        if self.slope_at is not None:
            self.draw_slopes(self.z - self.linear() - self.additive() - self.multiplicative())
        fixed = self.linear() + self.slopes()
        self.draw_additive(self.z - fixed - self.multiplicative())
        self.draw_multiplicative(self.z - fixed - self.additive())
        self._centre()
        self.swept += 1

    def _centre(self) -> None:
        """Means of the additive effects belong to the intercept, where there is one."""
        if self.o.symmetric or "intercept" not in self.p.names or self.moving.any() or self.o.dynamic_ab:
            return
        k = self.p.names.index("intercept")
        for x in (self.a, self.b):
            mean = x.mean(0)
            x -= mean
            self.beta[k] += mean

    def response(self, eta: np.ndarray) -> np.ndarray:
        if self.o.family in ("binary", "cbin"):
            return dist.ndtr(eta)
        return np.exp(np.minimum(eta + self.s2 / 2, 15)) * np.exp(self.log_exposure) if self.o.family == "poisson" else eta

    def simulate(self, eta: np.ndarray) -> np.ndarray:
        """A new response, with its diagonal and unobserved cells missing as in the data."""
        e = self.rng.standard_normal(eta.shape)
        if self.o.symmetric:
            e = np.triu(e.transpose(2, 0, 1), 1)
            e = (e + e.transpose(0, 2, 1)).transpose(1, 2, 0)
        elif self.use_rho:
            p, q = (1 + self.rho) ** 0.5, (1 - self.rho) ** 0.5
            e = (p + q) / 2 * e + (p - q) / 2 * e.transpose(1, 0, 2)
        return observed(eta + self.s2**0.5 * e, self.o.family, self.p, self.odmax if self.o.family in ("cbin", "frn") else None, self.rng, self.log_exposure)

    def loglik(self, eta: np.ndarray) -> np.ndarray:
        return pointwise(self.p.y, eta, self.o.family, self.s2, self.log_exposure)

    def state(self) -> dict:
        """All that it takes to go on with the chain."""
        names = ("z", "beta", "a", "b", "u", "v", "g", "sign", "sab", "rho", "s2", "rho_ab", "sig_ab", "rho_uv", "sig_uv", "rho_beta", "sig_beta", "snap_u", "snap_v", "lam_u", "lam_v", "pi_snap", "rho_g", "sig_g")
        return {k: getattr(self, k) for k in names}

    def run(self) -> Draws:
        import time

        out, began, kept = Draws(self.chain), time.monotonic(), 0
        total = np.zeros(self.p.shape)
        fitted = np.zeros(self.p.shape)
        if self.o.keep_gof:
            self._gof(out, 0, self.p.y, "gof_observed")
        for s in range(1, self.o.burn + self.o.scan + 1):
            self.sweep()
            if s > self.o.burn and (s - self.o.burn) % self.o.thin == 0:
                kept += 1
                eta = self.eta()
                total += eta
                fitted += self.response(eta)
                self._keep(out, kept, eta)
            if self.o.max_seconds and time.monotonic() - began > self.o.max_seconds and kept:
                break
        if kept:
            i, j, t = np.nonzero(np.broadcast_to(self.off[:, :, None], self.p.shape))
            cell = dict(t=[self.p.periods[k] for k in t], i=[self.p.rows[k] for k in i], j=[self.p.columns[k] for k in j])
            out.add(0, "eta_mean", "eta", total[i, j, t] / kept, **cell)
            out.add(0, "fitted_mean", "fitted", fitted[i, j, t] / kept, **cell)
            out.add(0, "latent_mean", "z", self.z[i, j, t], **cell)
        return out

    def _keep(self, out: Draws, k: int, eta: np.ndarray) -> None:
        p, times = self.p, self.p.periods
        for c, name in enumerate(p.names):
            if self.moving[c]:
                out.add(k, "beta", name, self.beta[c], t=times)
                out.add(k, "vc", [f"rho_beta:{name}", f"sigma2_beta:{name}"], [self.rho_beta[c], self.sig_beta[c] / self.scale[c] ** 2])
            else:
                out.add(k, "beta", name, self.beta[c, 0])
        out.add(k, "vc", ["va", "cab", "vb", "ve"], [self.sab[0, 0], self.sab[0, 1], self.sab[1, 1], self.s2])
        if self.alpha is not None:
            out.add(k, "vc", [f"cut_{x + 1}" for x in range(len(self.alpha))], self.alpha)
        if self.slope_at is not None:
            labels = p.rows if self.o.actor_side == "row" else p.columns
            for t in range(self.T):
                out.add(k, "slope", self.o.actor_slope, self.theta[:, t], t=times[t], i=labels)
        if self.o.dynamic_rho:
            out.add(k, "vc", "rho", self.rho, t=times)
        else:
            out.add(k, "vc", "rho", self.rho[0] if self.square else 0.0)
        if self.o.dynamic_ab:
            out.add(k, "vc", ["rho_ab", "sigma2_ab"], [self.rho_ab, self.sig_ab])
        if self.o.dynamic_uv:
            out.add(k, "vc", ["rho_uv", "sigma2_uv", "pi_snap"], [self.rho_uv, self.sig_uv, self.pi_snap])
        if self.o.keep_ab:
            for block, x, labels, moving in (("a", self.a, p.rows, self.o.dynamic_ab), ("b", self.b, p.columns, self.o.dynamic_ab)):
                for t in range(self.T if moving else 1):
                    out.add(k, block, block, x[:, t], t=times[t] if moving else None, i=labels)
        if self.rank and self.o.keep_uv:
            for block, x, labels in (("u", self.u, p.rows), ("v", self.v, p.columns)):
                for t in range(self.T if self.o.dynamic_uv else 1):
                    for r in range(x.shape[1]):
                        out.add(k, block, str(r + 1), x[:, r, t], t=times[t] if self.o.dynamic_uv else None, i=labels)
            if not self.square:
                for t in range(self.T if self.o.dynamic_g else 1):
                    out.add(k, "g", [f"{r + 1},{s + 1}" for r in range(self.rank) for s in range(self.rank_col)], self.g[:, :, t], t=times[t] if self.o.dynamic_g else None)
            if self.o.dynamic_uv == "snap":
                for side, x, labels in (("snap_u", self.snap_u, p.rows), ("snap_v", self.snap_v, p.columns)):
                    for t in range(1, self.T):
                        out.add(k, side, "snap", x[:, t], t=times[t], i=labels)
        if self.o.keep_loglik:
            i, j, t = np.nonzero(p.seen)
            out.add(k, "loglik", "ll", self.loglik(eta)[i, j, t], t=[times[x] for x in t], i=[p.rows[x] for x in i], j=[p.columns[x] for x in j])
        if self.o.keep_gof:
            self._gof(out, k, self.simulate(eta), "gof")

    def _gof(self, out: Draws, k: int, y: np.ndarray, block: str) -> None:
        for t in range(self.T):
            found = matrix_statistics(y[:, :, t], self.square)
            out.add(k, block, list(found), list(found.values()), t=self.p.periods[t])


def observed(z: np.ndarray, family: str, panel: Panel, odmax: float | None, rng: np.random.Generator, log_exposure: np.ndarray) -> np.ndarray:
    """The response that a latent array shows. Ranks: the largest value is the strongest."""
    lost = np.isnan(panel.y)
    if family == "normal":
        y = z.copy()
    elif family == "binary":
        y = (z > 0).astype(float)
    elif family == "poisson":
        y = rng.poisson(np.minimum(np.exp(np.minimum(z + log_exposure, 14)), 1e6)).astype(float)
    elif family == "ordinal":
        y = np.full(z.shape, np.nan)
        for t in range(z.shape[2]):
            seen = ~lost[:, :, t]
            levels, counts = np.unique(panel.y[:, :, t][seen], return_counts=True)
            if len(levels):
                cuts = np.quantile(z[:, :, t][seen], np.cumsum(counts)[:-1] / counts.sum())
                y[:, :, t] = levels[np.searchsorted(cuts, z[:, :, t])]
    else:
        y = np.zeros(z.shape)
        hidden = np.where(lost, -np.inf, z)
        for t in range(z.shape[2]):
            rank = np.argsort(np.argsort(-hidden[:, :, t], axis=1, kind="stable"), axis=1, kind="stable")
            tie = (rank < odmax) & (hidden[:, :, t] > 0)
            y[:, :, t] = np.where(tie, (tie.sum(1)[:, None] - rank) if family == "frn" else 1, 0)
    y[lost] = np.nan
    return y


def pointwise(y: np.ndarray, eta: np.ndarray, family: str, s2: float, log_exposure: np.ndarray | float = 0.0) -> np.ndarray:
    """Log densities of observed cells given the linear predictor; nan elsewhere. Cells count as independent given it."""
    out, seen = np.full(y.shape, np.nan), ~np.isnan(y)
    if family == "normal":
        out[seen] = dist.dnorm_log(y[seen], eta[seen], s2**0.5)
    elif family == "poisson":
        out[seen] = dist.poisson_marginal_log(y[seen], (eta + log_exposure)[seen], s2)
    elif family in ("binary", "cbin"):
        out[seen] = dist.log_ndtr(np.where(y[seen] > 0, eta[seen], -eta[seen]))
    elif family == "ordinal":
        for t in range(y.shape[2]):
            s = seen[:, :, t]
            levels, counts = np.unique(y[:, :, t][s], return_counts=True)
            share = np.clip(np.cumsum(counts)[:-1] / max(counts.sum(), 1), 1e-6, 1 - 1e-6)
            spread = (1 + eta[:, :, t][s].var()) ** 0.5 if s.any() else 1.0
            cuts = np.concatenate([[-np.inf], eta[:, :, t][s].mean() + spread * dist.ndtri(share), [np.inf]]) if len(levels) else np.array([-np.inf, np.inf])
            k = np.searchsorted(levels, y[:, :, t][s])
            out[:, :, t][s] = dist.log_ndtr_difference(cuts[k + 1] - eta[:, :, t][s], cuts[k] - eta[:, :, t][s])
    else:
        for t in range(y.shape[2]):
            for i in range(y.shape[0]):
                s = np.flatnonzero(seen[i, :, t])
                ties = s[y[i, s, t] > 0]
                order = ties[np.argsort(-y[i, ties, t], kind="stable")]
                total = dist.rank_probability_log(eta[i, :, t], order, free=s[y[i, s, t] == 0]) if len(s) else 0.0
                out[i, s, t] = total / max(len(s), 1)
    return out


def matrix_statistics(y: np.ndarray, square: bool) -> dict[str, float]:
    """The statistics of one network as a dense matrix."""
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            rows, cols = np.nanmean(y, 1), np.nanmean(y, 0)
            out = {"sd_row": float(np.nanstd(rows, ddof=1)), "sd_col": float(np.nanstd(cols, ddof=1))}
            if not square:
                b = np.nan_to_num(y) != 0
                c = (b.astype(float) @ b.T.astype(float))[np.triu_indices(len(b), 1)]
                return {k: float(np.nan_to_num(v)) for k, v in (out | {"four_cycles": float((c * (c - 1) / 2).sum())}).items()}
            seen = ~np.isnan(y)
            both = seen & seen.T
            out["dyad_dep"] = float(np.corrcoef(y[both], y.T[both])[0, 1]) if both.sum() > 2 else 0.0
            e = np.nan_to_num(y - np.nanmean(y))
            d, cube = seen.astype(float), np.nanstd(y, ddof=1) ** 3
            out["cycle_dep"] = float(np.sum((e @ e) * e.T) / (np.sum((d @ d) * d.T) * cube))
            out["trans_dep"] = float(np.sum((e @ e.T) * e.T) / (np.sum((d @ d.T) * d.T) * cube))
    return {k: float(np.nan_to_num(v)) for k, v in out.items()}


def new_positions(rng: np.random.Generator, u: np.ndarray, rho: float, sigma2: float) -> np.ndarray:
    return rho * u + sigma2**0.5 * rng.standard_normal(u.shape)


def draw_effects(rng: np.random.Generator, covariance: np.ndarray, n: int) -> np.ndarray:
    return np.stack([normal_draw(rng, np.zeros(len(covariance)), covariance) for _ in range(n)])
