"""The distributed additive fit against dense least squares."""

import numpy as np
from pyspark.sql import functions as F
from simulated import frame, panel

from relata.plans.distributed import additive_fit


def test_against_dense_least_squares(spark):
    p, _ = panel(9, 7, periods=2, seed=40)
    y = p.y.copy()
    y[2, 3, 0] = y[5, 1, 1] = np.nan
    cells = frame(spark, p.with_y(y)).withColumn("intercept", F.lit(1.0))
    fit = additive_fit(cells, ["intercept", "x"], 30, 1e-10)
    i, j, t = np.nonzero(~np.isnan(y))
    x = np.zeros((len(i), 2 + 9 + 7))
    x[:, 0], x[:, 1] = 1, p.x[i, j, 1, t]
    x[np.arange(len(i)), 2 + i], x[np.arange(len(i)), 11 + j] = 1, 1
    dense = x @ np.linalg.lstsq(x, y[i, j, t], rcond=None)[0]
    assert fit.converged and abs(fit.sse - ((y[i, j, t] - dense) ** 2).sum()) < 1e-6
    got = fit.residuals(cells).where("residual is not null").agg(F.sum(F.col("residual") ** 2)).first()[0]
    assert abs(got - fit.sse) < 1e-6
    assert abs(fit.rows.agg(F.avg("effect")).first()[0]) < 1e-9
