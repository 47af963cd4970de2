"""What the data can tell: identifiability, Jeffreys' prior, and where a systematic floor ends the gain of more epochs.

All start from the triangle of a matrix with many rows, which partitions compress side by side (see evidence); what reaches the driver
is one triangle as wide as the parameters. Nothing is squared on the way, so ranks hold down to the precision of numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.operators.evidence import matrices
from skyloom.operators.linear import factor_of
from skyloom.operators.uncertainty import information_triangle
from skyloom.plans.space import Forward


def jacobian_triangle(rows: DataFrame, columns: list[str], sigma: Column | float = 1.0) -> np.ndarray:
    """R with R'R = J' N^-1 J for the rows' columns J; rows whose sigma is null or infinite count for nothing."""
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    slim = rows.select(*columns, s.alias("_sigma"), F.lit(0.0).alias("_zero"))
    return matrices(factor_of(slim, columns, "_zero", "_sigma"))[0]


@dataclass(frozen=True)
class Identifiability:
    columns: tuple[str, ...]
    singular: np.ndarray
    #: Rows are directions in scaled parameters, by falling singular value.
    directions: np.ndarray
    rank: int

    @property
    def nullity(self) -> int:
        return len(self.columns) - self.rank

    @property
    def weakest_identified(self) -> np.ndarray:
        if not self.rank:
            raise ParameterError("no direction is identified")
        return self.directions[self.rank - 1]

    def participation(self) -> dict[str, float]:
        """The share of each parameter that lies in directions the data don't see."""
        return dict(zip(self.columns, (self.directions[self.rank :] ** 2).sum(axis=0).tolist()))


def identifiability(rows: DataFrame, columns: list[str], sigma: Column | float = 1.0, rtol: float = 1e-8) -> Identifiability:
    """Of the Jacobian with its columns scaled to length one; a column of zeros is never identified."""
    return _identified(jacobian_triangle(rows, columns, sigma), tuple(columns), rtol)


def _identified(r: np.ndarray, columns: tuple[str, ...], rtol: float) -> Identifiability:
    length = np.linalg.norm(r, axis=0)
    _, s, v = np.linalg.svd(r / np.where(length > 0, length, 1.0))
    return Identifiability(columns, s, v, int((s > rtol * s.max(initial=0.0)).sum()) if s.max(initial=0.0) > 0 else 0)


def plan_identifiability(forward: Forward, names: list[str] | None = None, at: np.ndarray | None = None, rtol: float = 1e-8) -> Identifiability:
    """Of the latents of a plan: their Jacobian's columns over the cells. Latents that are rows count by element."""
    j, _ = forward.jacobian(names, at)
    space = forward.space
    some = [n for n in space.names if names is None or n in names]
    labels = [n if space.latent(n).width == 1 else f"{n}[{i}]" for n in some for i in range(space.latent(n).width)]
    rows = forward.cells.select(j.alias("_j"), F.lit(0.0).alias("_y"), F.lit(1.0).alias("_s"))
    return _identified(matrices(factor_of(rows, "_j", "_y", "_s", width=len(labels)))[0], tuple(labels), rtol)


def jeffreys_half_log_det(rows: DataFrame, columns: list[str], sigma: Column | float = 1.0, rank_rtol: float = 1e-8) -> float:
    """Half the logarithm of the determinant of the information on the columns' parameters; refuses a singular one."""
    return _half_log_det(jacobian_triangle(rows, columns, sigma), rank_rtol)


def _half_log_det(r: np.ndarray, rank_rtol: float) -> float:
    s = np.linalg.svd(r, compute_uv=False)
    if s.min(initial=np.inf) <= rank_rtol * s.max(initial=0.0):
        raise ParameterError("the information is singular: Jeffreys' prior isn't defined")
    return float(np.log(s).sum())


@dataclass(frozen=True)
class JeffreysPrior:
    """Over some latents of a plan under a noise model: the root of the determinant of their information, the others held."""

    forward: Forward
    noise: object
    over: tuple[str, ...]
    rank_rtol: float = 1e-8

    def information(self, at: np.ndarray | None = None) -> np.ndarray:
        r = self._triangle(at)
        return r.T @ r

    def _triangle(self, at: np.ndarray | None) -> np.ndarray:
        return information_triangle(self.forward, self.noise, list(self.over), at)

    def log_density(self, at: np.ndarray | None = None) -> float:
        """Up to a constant. Singular values of the triangle under the floor count as the floor, so that the density stays finite."""
        s = np.linalg.svd(self._triangle(at), compute_uv=False)
        return float(np.log(np.maximum(s, max(self.rank_rtol * s.max(), np.finfo(float).tiny))).sum())

    def check_identified(self, at: np.ndarray | None = None) -> None:
        """Singular values of the triangle, not eigenvalues of its square: rounding leaves the smallest of those far above the square of the floor."""
        s = np.linalg.svd(self._triangle(at), compute_uv=False)
        if not s.min() > self.rank_rtol * s.max():
            raise ParameterError(f"{list(self.over)} aren't all identified")


def systematic_floor(fisher: np.ndarray, n_epochs: int, floor: float) -> tuple[float, int]:
    """The tightest direction's standard deviation after n_epochs, and the epoch at which it gets to the floor."""
    if not floor > 0 or n_epochs < 1:
        raise ParameterError("a floor above zero and at least one epoch are needed")
    sigma = 1 / math.sqrt(float(np.linalg.eigvalsh(fisher)[-1]))
    return sigma, math.ceil(n_epochs * (sigma / floor) ** 2)
