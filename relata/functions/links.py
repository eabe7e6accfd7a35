"""Generalised linear models by their definition: mean, variance and derivative of the mean under a link.

Reweighting needs two numbers a cell: the weight w = m'(eta)^2 / V(m) and the
score s = (y - m) m'(eta) / V(m). The working response is eta + s / w. Both are
given in forms that neither overflow nor cancel in the tails, so nothing is
clipped; a step that overshoots shows in the deviance, and the caller halves it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.functions.distributions import log_ndtr

LOG_ROOT_2PI = 0.5 * float(np.log(2 * np.pi))


def weight_and_score(y, eta, family: str, link: str | None = None):
    """Arrays of weight and score."""
    y, eta = np.asarray(y, float), np.asarray(eta, float)
    if family == "poisson":
        mean = np.exp(eta)
        return mean, y - mean
    if link == "logit":
        tail = np.exp(-np.abs(eta))
        mean = np.where(eta < 0, tail, 1.0) / (1 + tail)
        return tail / (1 + tail) ** 2, y - mean
    density, below, above = -0.5 * eta * eta - LOG_ROOT_2PI, log_ndtr(eta), log_ndtr(-eta)
    return np.exp(2 * density - below - above), y * np.exp(density - below) - (1 - y) * np.exp(density - above)


def working_response(y, eta, family: str, link: str | None = None):
    """Arrays of working response and weight; a cell whose weight vanishes keeps its predictor."""
    weight, score = weight_and_score(y, eta, family, link)
    return eta + np.divide(score, weight, out=np.zeros_like(score), where=weight > 0), weight


def deviance(y, eta, family: str, link: str | None = None) -> float:
    """Twice the log ratio to the saturated fit, over cells that are seen; the sum of squares for a normal response."""
    seen = ~np.isnan(y)
    y, eta = y[seen], eta[seen]
    if family == "normal":
        return float(((y - eta) ** 2).sum())
    if family == "poisson":
        return float(2 * (np.where(y > 0, y * (np.log(np.maximum(y, 1)) - eta), 0.0) - y + np.exp(eta)).sum())
    if link == "logit":
        return float(2 * (np.logaddexp(0, eta) - y * eta).sum())
    return float(-2 * (y * log_ndtr(eta) + (1 - y) * log_ndtr(-eta)).sum())


def weight_and_score_columns(y: Column, eta: Column, family: str, link: str | None = "logit") -> tuple[Column, Column]:
    """The same as columns, for the log and logit links."""
    if family == "poisson":
        return F.exp(eta), y - F.exp(eta)
    if link != "logit":
        raise ValueError("as columns there are the log link of counts and the logit link of binary responses")
    tail = F.exp(-F.abs(eta))
    return tail / ((1 + tail) * (1 + tail)), y - F.when(eta < 0, tail).otherwise(1.0) / (1 + tail)


def working_columns(y: Column, eta: Column, family: str, link: str | None = "logit") -> tuple[Column, Column]:
    """Columns of working response and weight."""
    weight, score = weight_and_score_columns(y, eta, family, link)
    return eta + F.when(weight > 0, score / weight).otherwise(0.0), weight


def deviance_column(y: Column, eta: Column, family: str) -> Column:
    """The deviance of one cell."""
    if family == "normal":
        return (y - eta) * (y - eta)
    if family == "poisson":
        return 2 * (F.when(y > 0, y * (F.log(y) - eta)).otherwise(0.0) - y + F.exp(eta))
    return 2 * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta)
