"""The dense view of one network panel inside a grouped task, and the fan-out of a panel to many tasks.

Sequential fits cannot be distributed step by step at a sane cost, so a panel is
one task and tasks are chains, replicates, starts, splits or panels. A panel's
rows reach its tasks by a shuffle on the task's number; nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Panel:
    """y (n, m, T) with nan for unobserved cells, x (n, m, p, T), and labels."""

    y: np.ndarray
    x: np.ndarray
    rows: list[str]
    columns: list[str]
    periods: list[int]
    names: list[str]
    square: bool
    here_rows: np.ndarray = field(default=None)
    here_columns: np.ndarray = field(default=None)

    def __post_init__(self):
        seen = ~np.isnan(self.y)
        if self.here_rows is None:
            self.here_rows, self.here_columns = seen.any(1), seen.any(0)
            if self.square:
                self.here_rows = self.here_columns = self.here_rows | self.here_columns

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.y.shape

    @property
    def seen(self) -> np.ndarray:
        return ~np.isnan(self.y)

    @classmethod
    def from_frame(cls, pdf: pd.DataFrame, names: Sequence[str], square: bool) -> Panel:
        names = list(names)
        periods = sorted(int(t) for t in pdf["t"].unique())
        if square:
            rows = columns = sorted(set(pdf["i"]) | set(pdf["j"]))
        else:
            rows, columns = sorted(set(pdf["i"])), sorted(set(pdf["j"]))
        at = lambda values, labels: pd.Categorical(values, categories=labels).codes
        i, j, t = at(pdf["i"], rows), at(pdf["j"], columns), at(pdf["t"], periods)
        y = np.full((len(rows), len(columns), len(periods)), np.nan)
        y[i, j, t] = pdf["y"].to_numpy(float)
        x = np.zeros((len(rows), len(columns), len(names), len(periods)))
        for k, n in enumerate(names):
            x[i, j, k, t] = np.nan_to_num(pdf[n].to_numpy(float))
        if square:
            d = np.arange(len(rows))
            y[d, d, :] = np.nan
        return cls(y, x, rows, columns, periods, names, square)

    def with_y(self, y: np.ndarray) -> Panel:
        return Panel(y, self.x, self.rows, self.columns, self.periods, self.names, self.square, self.here_rows, self.here_columns)


def fan_out(design: DataFrame, tasks: DataFrame, names: Sequence[str], fit: Callable[[Panel, dict], pd.DataFrame], schema: str, square: bool, key: str = "task") -> DataFrame:
    """fit(panel, settings) for each row of tasks, whose column `key` tells them apart; other columns are the settings.

    A design with a column `panel` is several panels, and each task row names its own.
    """
    names, settings = list(names), [c for c in tasks.columns if c not in (key, "panel")]
    columns = ["t", "i", "j", "y", *names]
    many = "panel" in design.columns and "panel" in tasks.columns
    rows = design.select(*(["panel"] if many else []), *columns)
    joined = rows.join(tasks, "panel") if many else rows.crossJoin(F.broadcast(tasks))  # a list of tasks that the driver made

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return fit(Panel.from_frame(pdf, names, square), {key: first[key]} | {c: first[c] for c in settings})

    # by range, so that each task has a partition of its own; hashes of few keys would put two chains into one
    return joined.repartitionByRange(max(1, tasks.count()), key).groupBy(key).applyInPandas(run, schema)


DRAWS = "chain int, draw int, block string, term string, t int, i string, j string, value double"


class Draws:
    """Collects a long table of draws as columns."""

    def __init__(self, chain: int):
        self.chain, self.parts = chain, []

    def add(self, draw: int, block: str, terms, values, t=None, i=None, j=None) -> None:
        values = np.atleast_1d(np.asarray(values, float)).ravel()
        fill = lambda v: [v] * len(values) if v is None or isinstance(v, (str, int)) else list(v)
        self.parts.append(pd.DataFrame({"draw": draw, "block": block, "term": fill(terms), "t": pd.array(fill(t), "Int32"), "i": fill(i), "j": fill(j), "value": values}))

    def frame(self) -> pd.DataFrame:
        out = pd.concat(self.parts, ignore_index=True) if self.parts else pd.DataFrame(columns=["draw", "block", "term", "t", "i", "j", "value"])
        out.insert(0, "chain", self.chain)
        return out
