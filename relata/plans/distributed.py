"""The additive model for networks that no worker could hold: the block fit without factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from relata.plans.blocks import BlockFit, block_fit


@dataclass
class AdditiveFit:
    beta: dict[str, float]
    rows: DataFrame
    columns: DataFrame
    sse: float
    sweeps: int
    converged: bool
    blocks: BlockFit

    def residuals(self, cells: DataFrame) -> DataFrame:
        return self.blocks.residuals(cells)


def additive_fit(cells: DataFrame, names: list[str], max_sweeps: int = 50, tol: float = 1e-8) -> AdditiveFit:
    """Least squares of y on the named columns (with an intercept among them) and centred effects of senders and receivers.

    Effects are solved side by side, each from one pass over the cells, then the coefficients.
    """
    fit = block_fit(cells, names, sweeps=max_sweeps, tol=tol)
    return AdditiveFit(fit.beta, fit.rows.drop("position"), fit.columns.drop("position"), fit.objective, fit.sweeps, fit.converged, fit)
