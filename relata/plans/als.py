"""Point estimates of additive and multiplicative effects models by block coordinate descent.

The working response is fitted by weighted least squares in blocks: coefficients,
additive effects, and factors, each solved exactly given the others. Static
blocks are one value; dynamic ones are paths under a penalty on their
transitions, which also carries heavy-tailed weights (t) and the responsibilities
of resets (snap). Non-normal families reweight the response around the fit (IRLS).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from relata.functions import distributions as dist
from relata.functions.links import deviance, working_response
from relata.functions.linear import align_series, procrustes, rebalance, safe_solve, truncate
from relata.operators.regression import degrees_of_freedom
from relata.plans.arrays import Panel
from relata.plans.gibbs import ALIASES, path_precision


#: Times that a step which raises the deviance is halved.
HALVINGS = 8


@dataclass
class AlsOptions:
    family: str = "normal"
    symmetric: bool = False
    rank: int = 0
    rank_col: int | None = None
    method: str = "irls"
    link: str = "probit"
    lowrank: str = "mm"
    max_iter: int = 200
    tol: float = 1e-7
    irls_max: int = 8
    irls_tol: float = 1e-5
    starts: int = 1
    seed: int = 29
    dynamic_ab: bool = False
    dynamic_beta: tuple[str, ...] | bool = False
    beta_kind: str = "rw1"
    dynamic_uv: str | bool = False
    dynamic_g: bool = False
    lambda_ab: float | None = None
    lambda_beta: float | None = None
    lambda_uv: float | None = None
    rho: float = 0.95
    nu: float = 4.0
    kappa: float = 1.0
    pi_snap: float = 0.1
    damping: float = 1.0

    def __post_init__(self):
        self.family = ALIASES.get(self.family, self.family)
        if self.family not in ("normal", "binary", "poisson"):
            raise ValueError("point estimates are for normal, binary and poisson")
        if self.dynamic_uv == "snap" and self.family != "normal":
            raise ValueError("snap estimates are for normal responses")


def working(y: np.ndarray, family: str) -> np.ndarray:
    """The transformed response: y, log(y + 1), or normal scores per period parted at zero."""
    if family == "normal":
        return y.copy()
    if family == "poisson":
        return np.log1p(y)
    z = np.full_like(y, np.nan)
    for t in range(y.shape[2]):
        seen = ~np.isnan(y[:, :, t])
        v, n = y[:, :, t][seen] > 0, seen.sum()
        if not n:
            continue
        zeros = n - v.sum()
        score = dist.ndtri(np.array([(zeros + 1) / 2, zeros + (v.sum() + 1) / 2]) / (n + 1))
        shift = score.mean() if 0 < zeros < n else 0.0
        z[:, :, t][seen] = np.where(v, score[1], score[0]) - shift
    return z


class Als:
    """One fit; `run` leaves mu, beta (p, T), a (n, T), b (m, T), factors (., R, T), g, and q (responsibilities) behind."""

    def __init__(self, panel: Panel, options: AlsOptions, seed: int | None = None):
        self.p, self.o = panel, options
        self.n, self.m, self.T = panel.shape
        self.square, self.sym = panel.square, options.symmetric
        self.rng = np.random.default_rng(options.seed if seed is None else seed)
        self.names = [k for k in panel.names if k != "intercept"]
        self.x = panel.x[:, :, [panel.names.index(k) for k in self.names], :]
        self.has_mu = True
        self.y = panel.y.copy()
        if self.sym:
            back = self.y.transpose(1, 0, 2)
            both = np.where(np.isnan(self.y), back, np.where(np.isnan(back), self.y, (self.y + back) / 2))
            self.y = both
        self.k = len(self.names)
        self.r, self.s = options.rank, options.rank if self.square or options.rank_col is None else options.rank_col
        self.mu, self.beta = 0.0, np.zeros((self.k, self.T))
        self.mu_path = np.zeros(self.T)
        self.a, self.b = np.zeros((self.n, self.T)), np.zeros((self.m, self.T))
        self.u, self.v = np.zeros((self.n, self.r, self.T)), np.zeros((self.m, self.s, self.T))
        self.g = np.repeat(np.eye(self.r, self.s)[:, :, None], self.T, 2)
        self.q_u, self.q_v = np.zeros((self.n, self.T)), np.zeros((self.m, self.T))
        self.w_u, self.w_v = np.ones((self.n, self.T)), np.ones((self.m, self.T))
        self.sig_uv, self.pi = 0.25, options.pi_snap
        moving = options.dynamic_beta
        self.moving = np.array([moving is True or (moving is not False and (n in moving)) for n in ["intercept", *self.names]], bool)
        seen = ~np.isnan(self.y)
        degree = seen.sum((1, 2)) / max(self.T, 1)
        self.l_ab = options.lambda_ab if options.lambda_ab is not None else max(1.0, float(np.median(degree)) / 4)
        self.l_uv = options.lambda_uv if options.lambda_uv is not None else max(1.0, float(np.median(degree)) / 4)
        self.l_beta = options.lambda_beta if options.lambda_beta is not None else max(1.0, float(np.median(seen.sum((0, 1)))) ** 0.5)
        self.here_u = panel.here_rows
        self.here_v = panel.here_columns
        self.iterations, self.converged = 0, False

    # parts of the predictor
    def linear(self):
        return self.mu_path[None, None, :] + np.einsum("ijkt,kt->ijt", self.x, self.beta)

    def additive(self):
        return self.a[:, None, :] + self.b[None, :, :]

    def product(self):
        if not self.r:
            return np.zeros(self.p.shape)
        if self.square:
            return np.einsum("irt,jrt->ijt", self.u, self.v)
        return np.einsum("irt,rst,jst->ijt", self.u, self.g, self.v)

    def eta(self):
        return self.linear() + self.additive() + self.product()

    def run(self) -> Als:
        if self.o.family == "normal" or self.o.method == "transform":
            z = working(self.y, self.o.family)
            self.descend(np.nan_to_num(z), (~np.isnan(z)).astype(float))
            return self
        z = working(self.y, self.o.family)
        seen = (~np.isnan(self.y)).astype(float)
        self.descend(np.nan_to_num(z), seen, max(20, self.o.max_iter // 4))
        y, link = np.nan_to_num(self.y), self.o.link if self.o.family == "binary" else None
        best, kept = deviance(self.y, self.eta(), self.o.family, link), self.save()
        for _ in range(self.o.irls_max):
            z, w = working_response(y, self.eta(), self.o.family, link)
            self.descend(z, w * seen, max(20, self.o.max_iter // 4))
            now = deviance(self.y, self.eta(), self.o.family, link)
            for _ in range(HALVINGS):
                if np.isfinite(now) and now <= best:
                    break
                self.load({k: (v + getattr(self, k)) / 2 for k, v in kept.items()})
                now = deviance(self.y, self.eta(), self.o.family, link)
            if not (np.isfinite(now) and now < best):
                break
            gain, best, kept = (best - now) / (abs(best) + 1e-12), now, self.save()
            if gain < self.o.irls_tol:
                break
        self.load(kept)
        return self

    def save(self) -> dict:
        return {k: np.copy(getattr(self, k)) for k in ("mu_path", "beta", "a", "b", "u", "v", "g", "q_u", "q_v", "w_u", "w_v")}

    def load(self, kept: dict) -> None:
        for k, v in kept.items():
            setattr(self, k, v)

    def descend(self, z, w, max_iter: int | None = None) -> None:
        self._start_factors(z, w)
        last = np.inf
        for it in range(max_iter or self.o.max_iter):
            self._coefficients(z - self.additive() - self.product(), w)
            self._additive(z - self.linear() - self.product(), w)
            if self.r:
                self._factors(z - self.linear() - self.additive(), w)
            sse = float((w * (z - self.eta()) ** 2).sum())
            self.iterations = it + 1
            if abs(last - sse) <= self.o.tol * (abs(sse) + 1e-12):
                self.converged = True
                break
            last = sse
        self.sse = sse

    def _coefficients(self, e, w) -> None:
        n = self.k + 1
        x = np.concatenate([np.ones((self.n, self.m, 1, self.T)), self.x], axis=2)
        if self.square:
            x = x * (~np.eye(self.n, dtype=bool))[:, :, None, None]
        wx = x * w[:, :, None, :]
        xx, xe = np.einsum("ijkt,ijlt->klt", wx, x), np.einsum("ijkt,ijt->kt", wx, e)
        if not self.moving.any():
            drawn = safe_solve(xx.sum(2), xe.sum(1))
            self.mu_path[:], self.beta[:] = drawn[0], drawn[1:, None]
            return
        fixed, moving = np.flatnonzero(~self.moving), np.flatnonzero(self.moving)
        size, t = len(moving), self.T
        at = np.zeros((n, t), int)
        at[fixed] = np.arange(len(fixed))[:, None]
        at[moving] = len(fixed) + np.arange(size * t).reshape(size, t)
        a, b = np.zeros((len(fixed) + size * t,) * 2), np.zeros(len(fixed) + size * t)
        for period in range(t):
            a[np.ix_(at[:, period], at[:, period])] += xx[:, :, period]
            b[at[:, period]] += xe[:, period]
        penalty = self.l_beta * path_precision(t, self.o.beta_kind, self.o.rho, 1.0, level=0.0)
        for k in moving:
            a[np.ix_(at[k], at[k])] += penalty
        path = safe_solve(a, b)[at]
        self.mu_path, self.beta = path[0], path[1:]

    def _additive(self, e, w) -> None:
        counts_r, counts_c = w.sum(1), w.sum(0)
        if self.o.dynamic_ab and self.T > 1:
            penalty = self.l_ab * path_precision(self.T, "ar1", self.o.rho, 1.0)
            for _ in range(10):
                old = self.a.copy()
                for which in ("a", "b"):
                    rest = (w * (e - (self.b[None] if which == "a" else self.a[:, None]))).sum(1 if which == "a" else 0)
                    counts = counts_r if which == "a" else counts_c
                    system = penalty + np.einsum("it,ts->its", counts, np.eye(self.T))
                    setattr(self, which, np.linalg.solve(system, rest[:, :, None])[:, :, 0])
                    if self.sym:
                        self.a = (self.a + self.b) / 2 if which == "b" else self.a
                        self.b = self.a.copy()
                if np.abs(self.a - old).max() < 1e-9:
                    break
        else:
            rows, cols, both = counts_r.sum(1), counts_c.sum(1), w.sum(2)
            er, ec = (w * e).sum((1, 2)), (w * e).sum((0, 2))
            if self.sym:
                a = safe_solve(both + np.diag(rows), er)
                self.a[:] = self.b[:] = a[:, None]
            else:
                system = np.block([[np.diag(rows), both], [both.T, np.diag(cols)]])
                solved = safe_solve(system, np.concatenate([er, ec]))
                self.a[:], self.b[:] = solved[: self.n, None], solved[self.n :, None]
        for x, active in ((self.a, self.here_u), (self.b, self.here_v)):
            mean = (x * active).sum() / max(active.sum(), 1)
            x -= mean
            self.mu_path = self.mu_path + mean

    def _start_factors(self, z, w) -> None:
        if not self.r or self.u.any():
            return
        e = w * (z - (w * z).sum() / max(w.sum(), 1))
        mean = e.sum(2) / np.maximum(w.sum(2), 1)
        if self.o.dynamic_uv:
            for t in range(self.T):
                self._truncate(e[:, :, t] * 0.5 + mean * 0.5, t)
            if self.square:
                self.u, self.v = align_series(self.u, self.v)
        else:
            for t in range(self.T):
                self._truncate(mean, t)
        if self.o.starts > 1:
            self.u += 0.1 * self.rng.standard_normal(self.u.shape[:2])[:, :, None]
            self.v += 0.1 * self.rng.standard_normal(self.v.shape[:2])[:, :, None]

    def _truncate(self, m, t) -> None:
        size = min(self.r, self.s) if not self.square else self.r
        u, v = truncate(m, size, self.sym)
        self.u[:, : u.shape[1], t], self.v[:, : v.shape[1], t] = u, v

    def _factors(self, e, w) -> None:
        if self.o.dynamic_uv and self.T > 1:
            self._factor_paths(e, w)
            if not self.square:
                self._mixing(e, w)
            return
        c = w.sum(2)
        mean = (w * e).sum(2) / np.maximum(c, 1e-12)
        if not self.square:
            self._bipartite(mean, c)
            return
        prior = 0.0 if self.o.family == "normal" else 1.0
        if (self.o.lowrank == "als" or prior) and not self.sym:
            u, v = self.u[:, :, 0], self.v[:, :, 0]
            for _ in range(5):
                u = self._weighted_rows(mean, c, v, prior + 1e-6)
                v = self._weighted_rows(mean.T, c.T, u, prior + 1e-6)
            u, v = rebalance(u, v)
        else:
            o = self.product()[:, :, 0]
            share = c / max(c.max(), 1e-12)
            for _ in range(5):
                u, v = truncate(o + share * (mean - o), self.r, self.sym)
                size = np.sqrt((u * u).sum(0) * (v * v).sum(0))
                shrink = np.sqrt(np.maximum(1 - prior / np.maximum(c.max() * size, 1e-12), 0))
                u, v = u * shrink, v * shrink
                o = u @ v.T
        self.u[:], self.v[:] = u[:, :, None], v[:, :, None]

    @staticmethod
    def _weighted_rows(target, c, other, ridge: float = 1e-6):
        gram = np.einsum("ij,jr,js->irs", c, other, other) + ridge * np.eye(other.shape[1])
        return np.linalg.solve(gram, ((c * target) @ other)[:, :, None])[:, :, 0]

    def _bipartite(self, mean, c) -> None:
        u, v, g = self.u[:, :, 0], self.v[:, :, 0], self.g[:, :, 0]
        for _ in range(3):
            ridge = 1e-4 if self.o.family == "normal" else 1.0
            u = self._weighted_rows(mean, c, v @ g.T, ridge)
            v = self._weighted_rows(mean.T, c.T, u @ g, ridge)
            u, v = (x / max((x * x).mean() ** 0.5, 1e-12) for x in (u, v))
            g = self._solve_g(mean, c, u, v)
        self.u[:], self.v[:], self.g[:] = u[:, :, None], v[:, :, None], g[:, :, None]

    def _solve_g(self, target, c, u, v, prior=None, rhs=None):
        uv = np.einsum("ir,js->ijrs", u, v).reshape(-1, self.r * self.s)
        cw = c.ravel()[:, None]
        a = uv.T @ (cw * uv) + (1e-6 * np.eye(uv.shape[1]) if prior is None else prior)
        return safe_solve(a, uv.T @ (cw[:, 0] * target.ravel()) + (0 if rhs is None else rhs)).reshape(self.r, self.s)

    def _mixing(self, e, w) -> None:
        if not self.o.dynamic_g:
            parts = [(np.einsum("ir,js->ijrs", self.u[:, :, t], self.v[:, :, t]).reshape(-1, self.r * self.s), w[:, :, t].ravel(), e[:, :, t].ravel()) for t in range(self.T)]
            a = sum(x.T @ (c[:, None] * x) for x, c, _ in parts) + 1e-6 * np.eye(self.r * self.s)
            self.g[:] = safe_solve(a, sum(x.T @ (c * y) for x, c, y in parts)).reshape(self.r, self.s)[:, :, None]
            return
        for t in range(self.T):
            near = [self.g[:, :, s].ravel() for s in (t - 1, t + 1) if 0 <= s < self.T]
            prior = self.l_uv * len(near) * np.eye(self.r * self.s)
            self.g[:, :, t] = self._solve_g(e[:, :, t], w[:, :, t], self.u[:, :, t], self.v[:, :, t], prior, self.l_uv * sum(near))

    def _factor_paths(self, e, w) -> None:
        kind, t = (self.o.dynamic_uv if isinstance(self.o.dynamic_uv, str) else "ar1"), self.T
        rho = self.o.rho
        for which in ("u", "v"):
            mine, other = (self.u, self.v) if which == "u" else (self.v, self.u)
            q, heavy, here = (self.q_u, self.w_u, self.here_u) if which == "u" else (self.q_v, self.w_v, self.here_v)
            r = mine.shape[1]
            if self.square:
                side = other
            elif which == "u":
                side = np.einsum("jst,rst->jrt", other, self.g)
            else:
                side = np.einsum("irt,rst->ist", other, self.g)
            ww, ee = (w, e) if which == "u" else (w.transpose(1, 0, 2), e.transpose(1, 0, 2))
            gram = np.einsum("ijt,jrt,jst->itrs", ww, side, side)
            rhs = np.einsum("ijt,jrt->itr", ww * ee, side)
            stays = here[:, 1:] & here[:, :-1]
            pull = np.where(stays, self.l_uv * (1 - q[:, 1:]) * heavy[:, 1:], 0.0)
            size = len(mine)
            system = np.zeros((size, t * r, t * r))
            for s in range(t):
                at = slice(s * r, (s + 1) * r)
                level = 1e-6 + (np.where(stays[:, s - 1], q[:, s] / self.o.kappa**2, 0.0) if s else 0.0)
                diagonal = level + (pull[:, s - 1] if s else 0.0) + (rho * rho * pull[:, s] if s + 1 < t else 0.0)
                system[:, at, at] += gram[:, s] + np.reshape(diagonal, (-1, 1, 1)) * np.eye(r)
                if s:
                    before = slice((s - 1) * r, s * r)
                    off = -(rho * pull[:, s - 1])[:, None, None] * np.eye(r)
                    system[:, at, before] += off
                    system[:, before, at] += off
            solved = np.linalg.solve(system, rhs.reshape(size, t * r, 1))[:, :, 0].reshape(size, t, r)
            mine[:] = solved.transpose(0, 2, 1)
            if self.sym:
                self.v = self.u.copy()
            self._transitions(kind, mine, q, heavy, stays, system.reshape(size, t * r, t * r))
            if self.sym:
                self.q_v, self.w_v = self.q_u.copy(), self.w_u.copy()
                break

    def _transitions(self, kind, x, q, heavy, stays, system) -> None:
        """Weights of t innovations, or responsibilities of resets with the position's own uncertainty integrated out."""
        r, t = x.shape[1], self.T
        step = x[:, :, 1:] - self.o.rho * x[:, :, :-1]
        ss = (step**2).sum(1)
        if kind == "t":
            scale = max(float(np.median(ss[stays])) / max(r, 1), 1e-8) if stays.any() else 1.0
            heavy[:, 1:] = np.where(stays, np.minimum((self.o.nu + r) / (self.o.nu + ss / scale), 10), 1.0)
        elif kind == "snap":
            drift_weight = stays * (1 - q[:, 1:])
            self.sig_uv = max(float((drift_weight * ss).sum() / max(r * drift_weight.sum(), 1e-8)), 1e-4)
            k2 = self.o.kappa**2
            local = np.stack([[np.linalg.slogdet(np.linalg.inv(system[i, s * r : (s + 1) * r, s * r : (s + 1) * r]) / v + np.eye(r))[1] for v in (self.sig_uv, k2)] for i in range(len(x)) for s in range(1, t)]).reshape(len(x), t - 1, 2)
            drift = -0.5 * (ss / self.sig_uv + r * np.log(self.sig_uv) + local[:, :, 0])
            reset = -0.5 * ((x[:, :, 1:] ** 2).sum(1) / k2 + r * np.log(k2) + local[:, :, 1])
            odds = np.clip(np.log(self.pi / (1 - self.pi)) + reset - drift, -35, 35)
            new = np.where(stays, 1 / (1 + np.exp(-odds)), 0.0)
            q[:, 1:] = (1 - self.o.damping) * q[:, 1:] + self.o.damping * new
            self.pi = float(np.clip((1 + q[:, 1:][stays].sum()) / (10 + stays.sum()), 1e-3, 0.5))
            self.l_uv = float(np.clip(self.residual_variance() / self.sig_uv, 1e-3, 1e4))

    def residual_variance(self) -> float:
        e = (self.y - self.eta()) ** 2
        return max(float(np.nanmean(e)), 1e-10) if np.isfinite(e).any() else 1.0

    # results
    def components(self) -> dict[str, float]:
        e = self.y - self.eta() if self.o.family == "normal" else working(self.y, self.o.family) - self.eta()
        out = {"va": float(self.a.mean(1).var(ddof=1)), "vb": float(self.b.mean(1).var(ddof=1)), "cab": 0.0, "rho": 0.0}
        if self.square:
            out["cab"] = float(np.cov(self.a.mean(1), self.b.mean(1))[0, 1])
            i, j = np.triu_indices(self.n, 1)
            x, z = e[i, j].ravel(), e[j, i].ravel()
            ok = ~np.isnan(x) & ~np.isnan(z)
            if ok.sum() > 2 and not self.sym:
                both = np.concatenate([x[ok], z[ok]]), np.concatenate([z[ok], x[ok]])
                out["rho"] = float(np.corrcoef(*both)[0, 1])
        seen = (~np.isnan(e)).sum() / (2 if self.sym else 1)
        df = degrees_of_freedom(self.k, int(self.here_u.any(1).sum()), int(self.here_v.any(1).sum()), self.r, self.sym)
        out["ve"] = float(np.nansum(e * e) / (2 if self.sym else 1) / max(seen - df, 1))
        return out

    def sandwich(self, cluster: str = "dyad") -> np.ndarray:
        """Covariance of (intercept, coefficients) given the other blocks, scores summed over both directions and all periods of a pair."""
        e = np.nan_to_num(self.y - self.eta())
        seen = ~np.isnan(self.y)
        x = np.concatenate([np.ones((self.n, self.m, 1, self.T)), self.x], axis=2) * seen[:, :, None, :]
        bread = np.linalg.pinv(np.einsum("ijkt,ijlt->kl", x, x))
        if cluster == "none":
            s = np.einsum("ijkt,ijt->ijtk", x, e).reshape(-1, self.k + 1)
        else:
            s = np.einsum("ijkt,ijt->ijk", x, e)
            s = (s + s.transpose(1, 0, 2))[np.triu_indices(self.n, 1)] if self.square else s.reshape(-1, self.k + 1)
        return bread @ (s.T @ s) @ bread

    def node_slopes(self, w: np.ndarray, side: str = "row") -> np.ndarray:
        """Regression of mean effects on [1, nodal covariates] over active actors."""
        effect, active = (self.a.mean(1), self.here_u.any(1)) if side == "row" else (self.b.mean(1), self.here_v.any(1))
        x = np.column_stack([np.ones(len(effect)), w])[active]
        return safe_solve(x.T @ x, x.T @ effect[active])

    def simulate(self, rng: np.random.Generator, new_effects: bool = True) -> np.ndarray:
        """A response like the fitted one, with fresh effects if asked, and the same cells unobserved."""
        vc, eta = self.components(), self.eta()
        if new_effects and not self.o.dynamic_ab:
            cov = np.array([[vc["va"], vc["cab"]], [vc["cab"], vc["vb"]]]) if self.square else np.diag([vc["va"], vc["vb"]])
            w, q = np.linalg.eigh(cov)
            half = q * np.sqrt(np.maximum(w, 0))
            a = half @ rng.standard_normal((2, self.n))
            b = a if self.square else half @ rng.standard_normal((2, self.m))
            eta = eta - self.additive() + (a[0] if not self.sym else a[0])[:, None, None] + (a[0] if self.sym else b[1])[None, :, None]
        if self.o.family == "binary":
            p = dist.ndtr(eta) if self.o.link == "probit" else 1 / (1 + np.exp(-eta))
            y = (rng.random(eta.shape) < p).astype(float)
        elif self.o.family == "poisson":
            y = rng.poisson(np.minimum(np.exp(np.clip(eta, -20, 14)), 1e6)).astype(float)
        else:
            noise = rng.standard_normal(eta.shape)
            if self.square and not self.sym:
                rho = np.clip(vc["rho"], -0.99, 0.99)
                p, q = (1 + rho) ** 0.5, (1 - rho) ** 0.5
                noise = (p + q) / 2 * noise + (p - q) / 2 * noise.transpose(1, 0, 2)
            y = eta + vc["ve"] ** 0.5 * noise
        if self.sym:
            upper = np.triu(y.transpose(2, 0, 1), 1)
            y = (upper + upper.transpose(0, 2, 1)).transpose(1, 2, 0)
        y[np.isnan(self.p.y)] = np.nan
        return y


def best_of_starts(panel: Panel, options: AlsOptions) -> Als:
    fits = [Als(panel, options, options.seed + 7919 * k).run() for k in range(max(1, options.starts))]
    return min(fits, key=lambda f: f.sse)


def bootstrap_replicate(panel: Panel, options: AlsOptions, base: Als, replicate: int, kind: str = "parametric", block: int = 1) -> Als:
    """A refit to simulated responses, or to periods drawn in circular blocks."""
    rng = np.random.default_rng([options.seed, 1, replicate])
    quick = replace(options, max_iter=min(options.max_iter, 60), starts=1)
    if kind == "parametric":
        return Als(panel.with_y(base.simulate(rng)), quick).run()
    if kind != "block":
        raise ValueError("the bootstrap is parametric or block")
    t = panel.shape[2]
    picked = np.concatenate([(s + np.arange(block)) % t for s in rng.integers(0, t, -(-t // block))])[:t]
    return Als(Panel(panel.y[:, :, picked], panel.x[:, :, :, picked], panel.rows, panel.columns, panel.periods, panel.names, panel.square), quick).run()


def orthogonal_distance(u: np.ndarray, v: np.ndarray) -> float:
    """Root mean square of u brought onto v by a rotation."""
    return float((((u @ procrustes(u, v)) - v) ** 2).mean() ** 0.5)
