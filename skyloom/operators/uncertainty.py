"""What a fit knows: Fisher information, covariances, and what they mean for predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import dot
from skyloom.operators.base import KEYS
from skyloom.operators.evidence import matrices, prior_root
from skyloom.operators.inference import noise_model
from skyloom.operators.linear import factor_of
from skyloom.plans.space import Forward, ParameterSpace, literal


@dataclass(frozen=True)
class FlatMatrix:
    """A symmetric matrix over latents side by side."""

    space: ParameterSpace
    names: tuple[str, ...]
    value: np.ndarray

    def span(self, name: str) -> slice:
        at = 0
        for n in self.names:
            w = self.space.latent(n).width
            if n == name:
                return slice(at, at + w)
            at += w
        raise ParameterError(f"no latent {name} here")

    def block(self, a: str, b: str) -> np.ndarray:
        return self.value[self.span(a), self.span(b)]

    def sigma(self, name: str) -> np.ndarray:
        """Standard deviations, of a covariance."""
        return np.sqrt(np.diag(self.block(name, name)))


def information_rows(rows: DataFrame, a: str, sigma: str, slope: str) -> DataFrame:
    """_a, _s: rows whose squares over _s sum to the information: derivatives of the prediction and, where the spread depends on it, of its logarithm."""
    spread = F.transform(a, lambda x: x * F.col(slope) * F.col(sigma) * 2**0.5)
    both = F.when(F.col(slope) == 0, F.array(F.col(a))).otherwise(F.array(F.col(a), spread))
    return rows.select(F.explode(both).alias("_a"), F.col(sigma).alias("_s"))


def information_triangle(forward: Forward, noise, names: str | Sequence[str] | None = None, at: Sequence[float] | None = None, flag: Column | None = None) -> np.ndarray:
    """R with R'R the information of the data: as wide as the latents, whose condition isn't squared."""
    model = noise_model(noise, flag)
    j, mu = forward.jacobian(names, at)
    rows = forward.cells.select("*", j.alias("_j"), mu.alias("_mu"))
    rows = rows.select("_j", model.std(F.col("_mu")).alias("_sd"), model.log_slope(F.col("_mu")).alias("_l"))
    return matrices(factor_of(information_rows(rows, "_j", "_sd", "_l").withColumn("_y", F.lit(0.0)), "_a", "_y", "_s", width=len(forward.space.places(names))))[0]


def fisher_information(forward: Forward, noise, names: str | Sequence[str] | None = None, at: Sequence[float] | None = None, flag: Column | None = None, prior: bool = False) -> FlatMatrix:
    """J'WJ, with what a spread that depends on the signal tells, and, if asked, the precision of normal priors."""
    space = forward.space
    r = information_triangle(forward, noise, names, at, flag)
    value = r.T @ r
    if prior:
        root = prior_root(space.gaussian(space.places(names), at)[1], len(value))
        value = value + root.T @ root
    some = [n for n in space.names if names is None or n in ([names] if isinstance(names, str) else names)]
    return FlatMatrix(space, tuple(some), value)


def parameter_covariance(fisher: FlatMatrix, jitter: float = 0.0) -> FlatMatrix:
    m = fisher.value + jitter * np.eye(len(fisher.value))
    if not np.isfinite(m).all() or np.linalg.eigvalsh(m)[0] <= 0:
        raise ParameterError("the information isn't positive: not all parameters are determined")
    return FlatMatrix(fisher.space, fisher.names, np.linalg.inv(m))


def propagated(a: Column, covariance: np.ndarray) -> Column:
    """The standard deviation of the sum of a times parameters of this covariance, an expression of the row."""
    rows = F.array(*(literal(r) for r in np.asarray(covariance, float)))
    return F.sqrt(F.greatest(F.lit(0.0), dot(a, F.transform(rows, lambda r: dot(r, a)))))


def propagate_covariance(forward: Forward, covariance: FlatMatrix, at: Sequence[float] | None = None) -> DataFrame:
    """The cells' keys and std: the spread of the prediction, to first order."""
    j, _ = forward.jacobian(covariance.names, at)
    return forward.cells.select(*KEYS, j.alias("_j")).select(*KEYS, propagated(F.col("_j"), covariance.value).alias("std"))


def push_forward(forward: Forward, draws: DataFrame) -> DataFrame:
    """The cells' keys, mean, std (of the population) and n of the predictions of draws (draw_id, theta)."""
    many = forward.many(draws)
    return many.groupBy(*KEYS).agg(F.avg("data").alias("mean"), F.stddev_pop("data").alias("std"), F.count("*").alias("n"))
