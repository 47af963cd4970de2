"""A campaign's memory: one factor for all epochs and a prior that counts once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.errors import IngestError, ParameterError
from skyloom.operators.evidence import combine, log_likelihood, matrices, null, solved
from skyloom.sources.archive import admit
from skyloom.sources.stage import stage


@dataclass(frozen=True)
class Memory:
    """total: the merged factor over names; a row of the streaming memory does as well."""

    total: dict
    names: tuple[str, ...]
    n_epochs: int
    prior_mean: np.ndarray | None = None
    prior_std: np.ndarray | None = None
    #: Shared input products that a latent stands for.
    represents: Mapping[str, str] = ()

    @staticmethod
    def of(factors: DataFrame, names: Sequence[str], prior_mean=0.0, prior_std=None, represents: Mapping[str, str] = ()) -> Memory:
        """Of epochs that the rules of admission let in. Factors are computed once: a small table, which the rules and the sum read."""
        with stage(factors.sparkSession) as keep:
            good = admit(keep(factors), list(names), list(dict(represents)))
            found = combine(good, None).first()
            n = good.count()
        total = found.asDict() if found else null(len(names))
        return Memory.of_total(total, names, n, prior_mean, prior_std, represents)

    @staticmethod
    def of_total(total: dict, names: Sequence[str], n_epochs: int, prior_mean=0.0, prior_std=None, represents: Mapping[str, str] = ()) -> Memory:
        if total["width"] != len(names):
            raise IngestError(f"a factor of width {total['width']} over {list(names)}")
        wide = lambda x: None if x is None else np.broadcast_to(np.asarray(x, float), len(names)).copy()
        return Memory(total, tuple(names), n_epochs, wide(prior_mean), wide(prior_std), represents)

    def log_likelihood(self, x: Sequence[float]) -> float:
        return log_likelihood(self.total, x)

    def log_posterior(self, x: Sequence[float]) -> float:
        """Likelihood and prior, the prior once."""
        log = self.log_likelihood(x)
        if self.prior_std is None:
            return log
        d = (np.asarray(x, float) - self.prior_mean) / self.prior_std
        return log + float((-0.5 * d**2 - np.log(self.prior_std) - 0.5 * np.log(2 * np.pi)).sum())

    @property
    def fisher(self) -> np.ndarray:
        r, _, _ = matrices(self.total)
        return r.T @ r

    def posterior(self) -> tuple[np.ndarray, np.ndarray]:
        r, z, _ = matrices(self.total)
        mean, inverse = solved(r, z, self.prior_std, self.prior_mean)
        return mean, inverse @ inverse.T

    def draws(self, n: int, seed: int) -> np.ndarray:
        mean, cov = self.posterior()
        return mean + np.random.default_rng(seed).normal(size=(n, len(mean))) @ np.linalg.cholesky(cov).T

    def audit(self, bias: Sequence[float] | None = None, bias_tolerance: float | None = None, floors: Mapping[str, float] | None = None, modelled: Sequence[str] = ()) -> dict:
        """What the memory can say of its own soundness.

        bias: the summed gradient of the compression's error by each name; its pull on the estimate is compared with the error bar. floors:
        spreads of shared products, by name, below which no error bar may fall unless the product is modelled as a latent.
        """
        precision = self.fisher + (np.diag(1 / self.prior_std**2) if self.prior_std is not None else 0.0)
        values = np.linalg.eigvalsh(self.fisher)
        report: dict = {"n_epochs": self.n_epochs, "n_observed": self.total["n_observed"], "fisher_lambda_min": float(values[0]), "fisher_condition": float(values[-1] / values[0]) if values[0] > 0 else float("inf"), "unconstrained": [], "bias_over_sigma": {}, "below_floor": {}}
        known = np.diag(self.fisher) > 0
        report["unconstrained"] = [n for n, k in zip(self.names, known) if not k]
        if values[0] <= 0 and self.prior_std is None:
            return report
        cov = np.linalg.inv(precision)
        sigma = np.sqrt(np.diag(cov))
        if bias is not None:
            pull = np.abs(cov @ np.asarray(bias, float)) / sigma
            report["bias_over_sigma"] = {n: float(x) for n, x, k in zip(self.names, pull, known) if k}
            if bias_tolerance is not None and (bad := {n: x for n, x in report["bias_over_sigma"].items() if not x <= bias_tolerance}):
                raise ParameterError(f"compression pulls {bad} standard deviations, more than {bias_tolerance}")
        exempt = {latent for product, latent in dict(self.represents).items() if product in modelled}
        for name, floor in (floors or {}).items():
            s = float(sigma[self.names.index(name)])
            report["below_floor"][name] = {"sigma": s, "floor": floor, "below": not s > floor}
            if not s > floor and name not in exempt:
                raise ParameterError(f"{name}: an error bar of {s:.3e} under the floor {floor:.3e} of what all epochs share")
        return report


def held_out_z(factors: DataFrame, prior_std=None, prior_mean=0.0) -> DataFrame:
    """epoch, chi2, dof, z: each epoch's data under what all others (and a prior) say.

    The total is one row; each row subtracts itself from it. An epoch without which the rest determines nothing has null.
    """
    total = combine(factors, None).first()
    if total is None:
        return factors.select("epoch", F.lit(None).cast("double").alias("chi2"), F.lit(None).cast("long").alias("dof"), F.lit(None).cast("double").alias("z"))
    r, z, _ = matrices(total)
    w = len(z)
    info, shift = r.T @ r, r.T @ z
    if prior_std is not None:
        std = np.broadcast_to(np.asarray(prior_std, float), w)
        info, shift = info + np.diag(1 / std**2), shift + np.broadcast_to(np.asarray(prior_mean, float), w) / std**2

    def of(batches):
        for pdf in batches:
            out = pdf[["epoch"]].copy()
            chi2, dof = [], []
            for row in pdf.itertuples(index=False):
                a, b = np.reshape(np.asarray(row.r, float), (w, w)), np.asarray(row.z, float)
                rest, push = info - a.T @ a, shift - a.T @ b
                if np.linalg.eigvalsh(rest)[0] <= 1e-12 * np.linalg.eigvalsh(info)[-1]:
                    chi2.append(None)
                else:
                    # the epoch's rows have spread one about what the others predict, and the others' own spread
                    gap = b - a @ np.linalg.solve(rest, push)
                    chi2.append(row.corner + float(gap @ np.linalg.solve(np.eye(w) + a @ np.linalg.solve(rest, a.T), gap)))
                dof.append(row.dof + int(np.linalg.matrix_rank(a)))
            out["chi2"], out["dof"] = chi2, dof
            out["z"] = (out["chi2"] - out["dof"]) / np.sqrt(2 * out["dof"].clip(lower=1))
            yield out.astype({"chi2": float, "z": float})

    found = factors.select("epoch", "r", "z", "corner", "dof").mapInPandas(of, "epoch string, chi2 double, dof long, z double")
    return found.select("epoch", F.when(~F.isnan("chi2"), F.col("chi2")).alias("chi2"), "dof", F.when(~F.isnan("z"), F.col("z")).alias("z"))


@dataclass(frozen=True)
class Tiered:
    """A memory beside epochs that stay as they are: problems (see engines) over the same unknowns."""

    memory: Memory
    raw: tuple = ()

    def log_likelihood(self, x: Sequence[float]) -> float:
        return self.memory.log_likelihood(x) + sum(float(p.log_likelihoods([x])[0]) for p in self.raw)

    def log_posterior(self, x: Sequence[float]) -> float:
        """The prior counts once, whatever the number of epochs."""
        return self.memory.log_posterior(x) + sum(float(p.log_likelihoods([x])[0]) for p in self.raw)
