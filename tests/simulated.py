"""Simulated networks with known parameters."""

import numpy as np
import pandas as pd

from relata.plans.arrays import Panel
from relata.plans.gibbs import observed


def panel(n=20, m=None, periods=1, family="normal", symmetric=False, rank=0, seed=1, slope=0.8, sd=0.5, noise=0.7, paths=False):
    rng = np.random.default_rng(seed)
    square, m = m is None, n if m is None else m
    x = rng.normal(size=(n, m, periods))
    if symmetric:
        x = (x + x.transpose(1, 0, 2)) / 2**0.5
    a, b = rng.normal(0, sd, n), rng.normal(0, sd, m)
    if symmetric:
        b = a
    slopes = np.linspace(-1, 1, periods) if paths else np.full(periods, slope)
    eta = 0.3 + slopes * x + a[:, None, None] + b[None, :, None]
    if rank:
        u, v = rng.normal(0, 1, (n, rank)), rng.normal(0, 1, (m, rank))
        eta = eta + (u @ (u if symmetric else v).T)[:, :, None]
    e = rng.normal(size=(n, m, periods))
    if symmetric:
        e = np.triu(e.transpose(2, 0, 1), 1)
        e = (e + e.transpose(0, 2, 1)).transpose(1, 2, 0)
    z = eta + noise * e
    rows = [f"a{k:03d}" for k in range(n)]
    design = np.stack([np.ones_like(x), x], axis=2)
    blank = Panel(np.zeros_like(z), design, rows, rows if square else [f"b{k:03d}" for k in range(m)], list(range(1, periods + 1)), ["intercept", "x_dyad"], square)
    if family == "ordinal":
        y = np.digitize(z, [-0.5, 0.5, 1.5]).astype(float)
    else:
        y = observed(z, family, blank, 4, rng, np.zeros(periods))
    if square:
        y[np.arange(n), np.arange(n)] = np.nan
    return Panel(y, design, blank.rows, blank.columns, blank.periods, blank.names, square), slopes


def frame(spark, p):
    i, j, t = np.meshgrid(np.arange(len(p.rows)), np.arange(len(p.columns)), np.arange(len(p.periods)), indexing="ij")
    i, j, t = i.ravel(), j.ravel(), t.ravel()
    pdf = pd.DataFrame({"t": np.array(p.periods)[t], "i": np.array(p.rows)[i], "j": np.array(p.columns)[j], "y": p.y[i, j, t], "x": p.x[i, j, 1, t]})
    rows = [(int(a), b, c, None if np.isnan(d) else float(d), float(e)) for a, b, c, d, e in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "t int, i string, j string, y double, x double")
