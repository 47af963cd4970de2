"""Plans that are affine in some latents: their designs, exact solutions and draws.

A design is a row of coefficients for each cell, an expression of that cell; what leaves the executors is one triangle as wide as the
unknowns (see evidence), so that conditions aren't squared and the driver never sees a cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import dot
from skyloom.operators.base import KEYS
from skyloom.operators.evidence import compress, matrices, null, prior_root, solved
from skyloom.operators.inference import check_same_cells, noise_model
from skyloom.plans.space import Forward, literal


@dataclass(frozen=True)
class LinearBlock:
    """rows: the cells' keys, a (coefficients of the latents, side by side) and offset (what is predicted where they are zero)."""

    rows: DataFrame
    names: tuple[str, ...]
    widths: tuple[int, ...]
    prior_mean: np.ndarray
    prior_std: np.ndarray

    @property
    def width(self) -> int:
        return sum(self.widths)

    def forward(self, x: Sequence[float]) -> DataFrame:
        return self.rows.select(*KEYS, (dot(F.col("a"), literal(x)) + F.col("offset")).alias("data"))

    def adjoint(self, cells: DataFrame) -> np.ndarray:
        """Sums over the cells of coefficient times data."""
        met = self.rows.join(cells.select(*KEYS, F.col("data").alias("_d")).hint("merge"), list(KEYS))
        sums = met.select(F.posexplode("a").alias("i", "c"), "_d").groupBy("i").agg(F.sum(F.col("c") * F.col("_d")).alias("v")).collect()  # a row for each unknown
        out = np.zeros(self.width)
        for r in sums:
            out[r.i] = r.v
        return out

    def as_dict(self, x: Sequence[float]) -> dict[str, np.ndarray]:
        ends = np.cumsum(self.widths)
        return {n: np.asarray(x)[z - w : z] for n, w, z in zip(self.names, self.widths, ends)}


def check_linearity(forward: Forward, names: str | Sequence[str], at: Sequence[float] | None = None, scales: Sequence[float] = (1e-3, 1.0, 1e3), rtol: float = 1e-8, seed: int = 0) -> float:
    """The largest departure from an affine plan, as a share of its change, over random directions of three sizes; refuses one above rtol."""
    theta = forward.space.initial if at is None else np.asarray(at, float)
    places = forward.space.places(names)
    base = theta.copy()
    base[places] = 0.0
    rng = np.random.default_rng(seed)
    a, zero = forward.design(names, theta)
    worst = []
    for s in scales:
        probe = base.copy()
        probe[places] = s * rng.normal(size=len(places))
        change = dot(a, literal(probe[places]))
        gap = F.abs(forward.at(literal(probe)) - zero - change)
        # rounding of the whole prediction is no departure
        worst.append((F.max(gap) / F.max(F.abs(change) + 1e-6 * F.abs(zero))).alias(f"w{len(worst)}"))
    found = max(x if x is not None and np.isfinite(x) else np.inf for x in forward.cells.agg(*worst).first())
    if not found <= rtol:
        raise ParameterError(f"the plan isn't affine in {names}: off by {found:.1e} of its change")
    return found


def linear_operator(forward: Forward, names: str | Sequence[str], at: Sequence[float] | None = None, check: bool = True) -> LinearBlock:
    """The block of these latents, the others held at `at`."""
    if check:
        check_linearity(forward, names, at)
    a, zero = forward.design(names, at)
    space = forward.space
    some = [n for n in space.names if n in ([names] if isinstance(names, str) else names)]
    mean, std = space.gaussian(space.places(some), at)
    return LinearBlock(forward.cells.select(*KEYS, a.alias("a"), zero.alias("offset")), tuple(some), tuple(space.latent(n).width for n in some), mean, std)


def factor_of(rows: DataFrame, design, observed: str, sigma: str, offset: str | None = None, width: int | None = None) -> dict:
    """One factor for all rows."""
    slim = rows.withColumn("_all", F.lit("all"))
    found = compress(slim, "_all", design, observed, sigma, offset=offset, width=width).first()
    return found.asDict() if found else null(width if width is not None else len(design))


def wiener_solve(rows: DataFrame, columns: Sequence[str] | str, y: str, sigma: str, prior_std=None, prior_mean=0.0, offset: str | None = None, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the coefficients of the columns (or of one column of arrays). Rows with no finite sigma count for nothing."""
    r, z, _ = matrices(factor_of(rows, columns, y, sigma, offset, width))
    mean, inverse = solved(r, z, prior_std, prior_mean)
    return mean, inverse @ inverse.T


def _joined(block: LinearBlock, observed: DataFrame, noise, x: np.ndarray | None) -> DataFrame:
    more = [c for c in observed.columns if c not in (*KEYS, "value")]
    # by merge: cells that are exploded from a small table look small to the planner, which would broadcast all of them
    met = block.rows.join(observed.select(*KEYS, F.col("value").alias("_y"), *more).hint("merge"), list(KEYS))
    mu = F.col("offset") if x is None else dot(F.col("a"), literal(x)) + F.col("offset")
    return met.withColumn("_s", noise.std(mu))


def solve_block(block: LinearBlock, observed: DataFrame, noise, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the block's latents given observed (keys, value) under its normal priors; noise that depends on the signal takes the offset's."""
    if check:
        check_same_cells(block.rows, observed, list(KEYS))
    rows = _joined(block, observed, noise_model(noise), None)
    return wiener_solve(rows, "a", "_y", "_s", block.prior_std if np.isfinite(block.prior_std).any() else None, block.prior_mean, "offset", block.width)


def gcr_draws(mean: np.ndarray, cov: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Draws of the posterior that a solution found."""
    return mean + np.random.default_rng(seed).normal(size=(n, len(mean))) @ np.linalg.cholesky(cov).T


def condition(factor: dict, prior_std=None) -> tuple[float, float, float]:
    """Smallest and largest eigenvalue of the information, and their ratio, from the triangle's singular values."""
    r, _, _ = matrices(factor)
    if prior_std is not None:
        r = np.vstack([r, prior_root(prior_std, r.shape[1])])
    s = np.linalg.svd(r, compute_uv=False) ** 2
    return float(s[-1]), float(s[0]), float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def tree_norm(values: dict[str, np.ndarray], scales: dict[str, float] | None = None) -> float:
    """Length of a set of unknowns, each in units of its scale."""
    return float(np.sqrt(sum((np.asarray(v, float) ** 2).sum() / (scales or {}).get(n, 1.0) ** 2 for n, v in values.items())))


@dataclass(frozen=True)
class GLSResult:
    x: np.ndarray
    cov: np.ndarray
    turns: int


def iterative_gls(rows: DataFrame, columns: Sequence[str] | str, y: str, sigma_of, tol: float = 1e-8, least: int = 5, most: int = 100, prior_std=None, prior_mean=0.0, offset: str | None = None, width: int | None = None) -> GLSResult:
    """Reweights until the coefficients stay: sigma_of turns a prediction column into the noise column. One job a turn."""
    a = F.col(columns) if isinstance(columns, str) else F.array(*(F.col(c).cast("double") for c in columns))
    base = F.col(offset) if offset else F.lit(0.0)
    x, cov = wiener_solve(rows.withColumn("_s", F.lit(1.0)), columns, y, "_s", prior_std, prior_mean, offset, width)
    for turn in range(1, most + 1):
        sigma = sigma_of(dot(a, literal(x)) + base)
        new, cov = wiener_solve(rows.withColumn("_s", sigma), columns, y, "_s", prior_std, prior_mean, offset, width)
        if turn >= least and np.linalg.norm(new - x) <= tol * np.linalg.norm(new):
            return GLSResult(new, cov, turn)
        x = new
    raise ParameterError(f"no convergence in {most} turns")
