"""Reduced bases of a bank of spectra: chosen by singular vectors or greedily, seeded with the directions that parameters move."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import dot, finite
from skyloom.operators.base import KEYS
from skyloom.operators.evidence import compress, log_likelihood, matrices
from skyloom.operators.inference import noise_model
from skyloom.operators.linear import factor_of
from skyloom.plans.space import Forward, ParameterSpace, literal
from skyloom.sources.stage import Stage, stage

_EPS = math.sqrt(np.finfo(float).eps)


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """Orthonormal rows of the same span, in order; those that earlier ones explain go. Each is projected twice."""
    kept: list[np.ndarray] = []
    most = np.linalg.norm(rows, axis=1).max(initial=0.0)
    for v in np.asarray(rows, float):
        for _ in range(2):
            for k in kept:
                v = v - (k @ v) * k
        size = np.linalg.norm(v)
        if size > _EPS * most:
            kept.append(v / size)
    return np.array(kept).reshape(len(kept), rows.shape[1])


def numerical_rank(values: np.ndarray) -> int:
    return int((values > _EPS * values.max(initial=0.0)).sum())


@dataclass(frozen=True)
class ReducedBasis:
    """members: a row each, orthonormal in data over sigma (the noise of each channel)."""

    members: np.ndarray
    sigma: np.ndarray
    #: Share of the bank's whitened power outside the basis.
    lost: float
    names: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.members, "<f8").tobytes() + np.ascontiguousarray(self.sigma, "<f8").tobytes()).hexdigest()

    @property
    def gram(self) -> np.ndarray:
        return self.members @ self.members.T

    @property
    def condition(self) -> float:
        return float(np.linalg.cond(self.gram))

    def white(self, spectrum: Column) -> Column:
        return F.zip_with(spectrum, literal(self.sigma), lambda x, s: x / s)

    def project(self, spectrum: Column) -> Column:
        """Coefficients of a column of arrays."""
        white = self.white(spectrum)
        return F.array(*(dot(white, literal(m)) for m in self.members))

    def expand(self, coefficients: Column) -> Column:
        """The spectrum of a column of coefficients."""
        channels = F.array(*(F.struct(literal(c).alias("m"), F.lit(float(s)).alias("s")) for c, s in zip(self.members.T, self.sigma)))
        return F.transform(channels, lambda c: dot(c["m"], coefficients) * c["s"])

    def residual_fraction(self, spectrum: Column) -> Column:
        """Share of a spectrum's whitened power that the basis leaves; null for one of zeros."""
        white, found = self.white(spectrum), self.project(spectrum)
        power = dot(white, white)
        return F.when(power > 0, F.greatest(F.lit(0.0), 1 - dot(found, found) / F.when(power > 0, power)))


def score_directions(forward: Forward, names: Sequence[str] | None = None, at: Sequence[float] | None = None) -> np.ndarray:
    """The derivative of one spectrum by each latent, a row each; the cells are the channels of a single sample."""
    j, _ = forward.jacobian(names, at)
    rows = forward.cells.select("freq_idx", j.alias("j")).orderBy("freq_idx").collect()  # a row for each channel
    if len({r.freq_idx for r in rows}) < len(rows):
        raise ParameterError("the scores of a basis are those of one sample")
    return np.array([r.j for r in rows]).T


def _less(share: Column):
    return lambda x, y: x - share * y


def _left(bank: DataFrame, spectrum: str, basis: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """_v: the whitened spectra of the bank less what the basis explains."""
    white = F.zip_with(spectrum, literal(sigma), lambda x, s: x / s)
    rows = bank.select(white.alias("_w"))
    if not len(basis):
        return rows.select(F.col("_w").alias("_v"))
    parts = [(dot(F.col("_w"), literal(m)).alias(f"_c{i}"), m) for i, m in enumerate(basis)]
    rows = rows.select("_w", *(c for c, _ in parts))
    v = F.col("_w")
    for i, m in enumerate(basis):
        v = F.zip_with(v, literal(m), _less(F.col(f"_c{i}")))
    return rows.select(v.alias("_v"))


def build_reduced_basis(bank: DataFrame, spectrum: str, n_basis: int, sigma: Sequence[float], method: str = "svd", scores: np.ndarray | None = None, names: Sequence[str] = ()) -> ReducedBasis:
    """n_basis members for the bank's spectra (a column of arrays): the scores' directions first, if any, then those that keep most.

    svd: singular vectors of what the scores leave, from one triangle. greedy: the spectrum that is explained worst, again and again; one job a
    member, of which the driver gets one row.
    """
    sigma = np.asarray(sigma, float)
    n = len(sigma)
    start = np.zeros((0, n)) if scores is None else orthonormal(np.atleast_2d(scores) / sigma)
    if method not in ("svd", "greedy"):
        raise ParameterError("a basis is chosen by svd or greedy")
    power = bank.agg(F.sum(dot(*(F.zip_with(spectrum, literal(sigma), lambda x, s: x / s),) * 2))).first()[0]
    if not power:
        raise ParameterError("an empty bank, or one of zeros")
    if method == "svd":
        rows = _left(bank, spectrum, start, sigma).withColumn("_y", F.lit(0.0)).withColumn("_s", F.lit(1.0))
        r, _, _ = matrices(factor_of(rows, "_v", "_y", "_s", width=n))
        _, values, v = np.linalg.svd(r)
        most = numerical_rank(values) if values.max(initial=0.0) > _EPS * math.sqrt(power) else 0
        if not 0 < n_basis <= len(start) + most:
            raise ParameterError(f"{n_basis} members of a bank of rank {len(start) + most}")
        members = orthonormal(np.vstack([start, v[:most]]))[:n_basis]
    else:
        members = start[:n_basis]
        while len(members) < n_basis:
            left = _left(bank, spectrum, members, sigma)
            worst = left.select("_v", dot(F.col("_v"), F.col("_v")).alias("_p")).agg(F.max_by("_v", "_p").alias("v"), F.max("_p").alias("p")).first()
            if not worst.p > _EPS**2 * power:
                raise ParameterError(f"{n_basis} members of a bank of rank {len(members)}")
            members = orthonormal(np.vstack([members, worst.v]))
    kept = bank.select(F.zip_with(spectrum, literal(sigma), lambda x, s: x / s).alias("_w"))
    explained = kept.agg(*(F.sum(F.pow(dot(F.col("_w"), literal(m)), 2)) for m in members)).first()
    return ReducedBasis(members, sigma, max(0.0, 1 - sum(explained) / power), tuple(names))


@dataclass(frozen=True)
class Fidelity:
    """lost: for each latent the share of its score that the basis can't hold; full and kept: information with all channels and through the basis."""

    lost: dict[str, float]
    full: np.ndarray
    kept: np.ndarray

    @property
    def worst(self) -> tuple[str, float]:
        return max(self.lost.items(), key=lambda x: x[1])

    def refuse_above(self, tolerance: float) -> None:
        name, share = self.worst
        if share > tolerance:
            raise ParameterError(f"the basis loses {share:.1e} of {name}")


def basis_fidelity(basis: ReducedBasis, scores: np.ndarray, names: Sequence[str]) -> Fidelity:
    """scores: the derivative of a spectrum by each parameter, a row each."""
    white = np.atleast_2d(scores) / basis.sigma
    inside = white @ basis.members.T
    power = (white**2).sum(axis=1)
    lost = np.where(power > 0, 1 - (inside**2).sum(axis=1) / np.where(power > 0, power, 1.0), 0.0)
    return Fidelity(dict(zip(names, np.maximum(lost, 0.0).tolist())), white @ white.T, inside @ inside.T)


def compress_reduced(rows: DataFrame, epoch: str, basis: ReducedBasis, channel: str, observed: str, sigma: str, **more) -> DataFrame:
    """Factors over the coefficients of a basis: each row of a channel (by index) has the basis there as its design.

    fingerprint tells which basis the factors belong to; factors of unlike bases never merge.
    """
    physical = basis.members * basis.sigma  # a member in units of the data
    table = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(physical.T)], "_channel int, _a array<double>")
    met = rows.join(F.broadcast(table), F.col(channel).cast("int") == F.col("_channel"))  # a row for each channel
    return compress(met, epoch, "_a", observed, sigma, width=len(physical), **more).withColumn("fingerprint", F.lit(basis.fingerprint))


def frozen_gap(basis: ReducedBasis, spectra: np.ndarray, noise_of) -> float:
    """The largest relative change of the noise, frozen at the basis, over spectra at the corners of its support."""
    return max((float(np.abs(noise_of(s) / basis.sigma - 1).max()) for s in np.atleast_2d(spectra)), default=0.0)


def support_corners(space: ParameterSpace, at: Sequence[float], support: Mapping[str, tuple[float, float]]) -> list[np.ndarray]:
    """The centre, and each latent of the support at each of its ends, all of a row's numbers together: two for each latent, not all combinations."""
    centre = np.asarray(at, float)
    out = [centre]
    for name, (low, high) in support.items():
        if not low < high:
            raise ParameterError(f"the support of {name} is empty")
        for end in (low, high):
            probe = centre.copy()
            probe[space.places(name)] = end
            out.append(probe)
    return out


def frozen_gaps(forward: Forward, observed: DataFrame, epoch: str, noise, support: Mapping[str, tuple[float, float]], at: Sequence[float] | None = None) -> DataFrame:
    """epoch, frozen_gap: what freezing the noise at the centre costs an epoch, in nats: the largest difference between the log likelihood with the noise of the
    centre and that with the noise of the place itself, over the corners of the support. NaN where one of them is none; one aggregate for all epochs.

    observed: the cells' keys, value, and the epoch's column.
    """
    space = forward.space
    centre = space.initial if at is None else np.asarray(at, float)
    model = noise_model(noise)
    rows = forward.cells.join(observed.select(*KEYS, F.col(epoch).cast("string").alias("_epoch"), F.col("value").cast("double").alias("_y")), list(KEYS))
    frozen, gaps = model.std(forward.at(literal(centre))), []
    rows = rows.withColumn("_frozen", frozen)
    log = lambda mu, s: -0.5 * F.pow((F.col("_y") - mu) / s, 2) - F.log(s)
    for i, probe in enumerate(support_corners(space, centre, support)):
        mu = forward.at(literal(probe))
        one = log(mu, F.col("_frozen")) - log(mu, model.std(mu))
        gaps.append(F.abs(F.coalesce(F.sum(F.when(finite(F.col("_frozen")) & F.col("_y").isNotNull(), one)), F.lit(0.0))).alias(f"_g{i}"))
    found = rows.groupBy(F.col("_epoch").alias("epoch")).agg(*gaps)
    return found.select("epoch", F.greatest(*(F.col(f"_g{i}") for i in range(len(gaps))), F.lit(0.0)).alias("frozen_gap"))


def outside(basis: ReducedBasis, directions: np.ndarray) -> np.ndarray:
    """Of each direction (a row over the channels), the share of its whitened length that the basis can't hold."""
    white = np.atleast_2d(np.asarray(directions, float)) / basis.sigma
    size = np.linalg.norm(white, axis=1)
    left = np.linalg.norm(white - white @ basis.members.T @ basis.members, axis=1)
    return np.where(size > 0, left / np.where(size > 0, size, 1.0), 0.0)


def compress_certified(
    forward: Forward, observed: DataFrame, epoch: str, basis: ReducedBasis, noise, support: Mapping[str, tuple[float, float]], frozen_tolerance: float, *, at: Sequence[float] | None = None,
    nuisance: Mapping[str, Sequence[float]] = {}, nuisance_std: Mapping[str, float] = {}, nuisance_tolerance: float = 1e-6,
) -> DataFrame:
    """Factors of epochs over the basis's coefficients, and frozen_gap: with the noise frozen at the centre, whose cost over the support is measured where the epochs
    lie. An epoch whose cost is above frozen_tolerance, or no number, is refused.

    nuisance: spectra that each epoch holds in amounts of its own, of spreads nuisance_std, integrated out. One that lies outside of the basis by more
    than nuisance_tolerance of its length is refused: what the basis can't hold can't be integrated out, and would come back as signal.
    """
    if missing := set(nuisance) ^ set(nuisance_std):
        raise ParameterError(f"a nuisance has a spectrum and a spread: {sorted(missing)}")
    names = list(nuisance)
    if names:
        for name, share in zip(names, outside(basis, [nuisance[n] for n in names])):
            if not share <= nuisance_tolerance:
                raise ParameterError(f"{share:.1e} of nuisance {name} lies outside of the basis, more than {nuisance_tolerance}: build the basis with it among its scores")
    centre = forward.space.initial if at is None else np.asarray(at, float)
    rows = forward.cells.withColumn("_s", noise_model(noise).std(forward.at(literal(centre)))).join(observed.select(*KEYS, F.col(epoch).alias("_e"), F.col("value").alias("_y")), list(KEYS))
    more = {}
    if names:
        table = F.array(*(literal([nuisance[n][i] for n in names]) for i in range(len(basis.sigma))))
        rows = rows.withColumns({f"_n{i}": F.get(F.get(table, F.col("freq_idx").cast("int")), F.lit(i)) for i in range(len(names))})
        more = {"nuisance": [f"_n{i}" for i in range(len(names))], "nuisance_std": [float(nuisance_std[n]) for n in names]}
    with stage(observed.sparkSession) as keep:
        gaps = keep(frozen_gaps(forward, observed, epoch, noise, support, at))
        if bad := gaps.where(~(F.col("frozen_gap") <= frozen_tolerance) | F.isnan("frozen_gap")).orderBy(F.desc("frozen_gap")).head():
            raise ParameterError(f"epoch {bad.epoch}: freezing the noise costs {bad.frozen_gap:.2g} nats over the support, more than {frozen_tolerance}")
        return Stage(observed.sparkSession)(compress_reduced(rows, "_e", basis, "freq_idx", "_y", "_s", **more).join(gaps, "epoch"))


def compress_epochs(rows: DataFrame, epoch: str, observed: str, sigma: str, *, design: Sequence[str] | str | None = None, basis: ReducedBasis | None = None, channel: str = "freq_idx", **more) -> DataFrame:
    """Factors over the unknowns of a design, or over the coefficients of a basis."""
    if (design is None) == (basis is None):
        raise ParameterError("an epoch is compressed by a design or by a basis")
    if basis is not None:
        return compress_reduced(rows, epoch, basis, channel, observed, sigma, **more)
    return compress(rows, epoch, design, observed, sigma, **more)


def reduced_log_likelihood(factor, basis: ReducedBasis, spectrum: Sequence[float]) -> float:
    """Of a factor over a basis's coefficients, at a predicted spectrum; a factor of another basis is refused."""
    if factor["fingerprint"] != basis.fingerprint:
        raise ParameterError("a factor of another basis")
    return log_likelihood(factor, basis.members @ (np.asarray(spectrum, float) / basis.sigma))
