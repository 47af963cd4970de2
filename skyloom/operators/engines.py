"""Fitting a plan to observations: each step is one aggregate job, from which the driver gets a triangle or a few sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import dot, finite
from skyloom.operators.base import KEYS
from skyloom.operators.evidence import log_likelihood, matrices, prior_root, rank, solved, triangle
from skyloom.operators.inference import Flagged, Homoscedastic, check_same_cells, noise_model, sense_of
from skyloom.operators.linear import check_linearity, factor_of
from skyloom.plans.space import Forward, literal


class Problem:
    """A plan, what was observed (the cells' keys and value) and the noise (a number, a column or a model) of it."""

    def __init__(self, forward: Forward, observed: DataFrame, noise, flag: str | None = None, check: bool = True):
        if check:
            check_same_cells(forward.cells, observed, list(KEYS))
        self.forward, self.space = forward, forward.space
        more = [F.col(flag).alias("_flag")] if flag else []
        # by merge: cells that are exploded from a small table look small to the planner, which would broadcast all of them
        self.rows = forward.cells.join(observed.select(*KEYS, F.col("value").cast("double").alias("_y"), *more).hint("merge"), list(KEYS))
        self.noise = noise_model(noise, F.col("_flag") if flag else None)

    def persist(self) -> Problem:
        """Keep the joined rows with the executors, for the many jobs of a fit."""
        self.rows = self.rows.persist()
        return self

    def linearised(self, at: Sequence[float], names: str | Sequence[str] | None = None) -> dict:
        """The factor over changes of these latents at theta. At no change it is the log likelihood itself."""
        some = self.space.names if names is None else [names] if isinstance(names, str) else list(names)
        places = self.space.places(some)
        at = np.asarray(at, float)
        if all(self.space.latent(n).linear for n in some):
            a, zero = self.forward.design(some, at)
            mu = zero + dot(F.col("_j"), literal(at[places]))
        else:
            a, mu = self.forward.jacobian(some, at)
        rows = self.rows.withColumn("_j", a).withColumn("_mu", mu).withColumn("_s", self.noise.std(F.col("_mu")))
        return factor_of(rows, "_j", "_y", "_s", offset="_mu", width=len(places))

    def log_likelihoods(self, points: Sequence[Sequence[float]]) -> np.ndarray:
        """At a few thetas, by one job."""
        sums = []
        for i, p in enumerate(points):
            mu = self.forward.at(literal(p))
            s = self.noise.std(mu)
            one = F.pow((F.col("_y") - mu) / s, 2) + F.log(2 * np.pi * s * s)
            sums.append((-0.5 * F.coalesce(F.sum(F.when(finite(s), one)), F.lit(0.0))).alias(f"p{i}"))
        return np.array(self.rows.agg(*sums).first(), float)

    def log_posteriors(self, points: Sequence[Sequence[float]]) -> np.ndarray:
        prior = np.array([self.space.log_prior(p) for p in points])
        return np.where(np.isfinite(prior), self.log_likelihoods(points) + prior, -np.inf)

    def chi2(self, at: Sequence[float]) -> float:
        mu = self.forward.at(literal(at))
        s = self.noise.std(mu)
        return float(self.rows.agg(F.coalesce(F.sum(F.when(finite(s), F.pow((F.col("_y") - mu) / s, 2))), F.lit(0.0))).first()[0])

    def mean_squared(self, at: Sequence[float], names: Sequence[str] | None) -> tuple[float, np.ndarray]:
        """The mean squared error and its gradient."""
        places = self.space.places(names)
        j, mu = self.forward.jacobian(names, at)
        rows = self.rows.select(j.alias("_j"), (F.col("_y") - mu).alias("_r")).withColumn("_s", F.lit(1.0))
        f = factor_of(rows, "_j", "_r", "_s", width=len(places))
        r, z, _ = matrices(f)
        return (float(z @ z) + f["corner"]) / f["n_observed"], -2 * r.T @ z / f["n_observed"]


@dataclass(frozen=True)
class GradientCalibrator:
    """Steps of one length along the gradient of the mean squared error."""

    learning_rate: float
    n_steps: int

    def fit(self, problem: Problem, names: Sequence[str] | None = None, at: Sequence[float] | None = None, loss=None) -> tuple[np.ndarray, list[float]]:
        """theta, and the loss before each step."""
        if loss is not None and sense_of(loss) != "minimise":
            raise ParameterError("a gradient descends; this loss gets larger as the fit gets better")
        theta = problem.space.initial if at is None else np.array(at, float)
        places, trace, state = problem.space.places(names), [], self._start(len(problem.space.places(names)))
        for step in range(1, self.n_steps + 1):
            value, gradient = problem.mean_squared(theta, names)
            if not np.isfinite(gradient).all():
                raise ParameterError(f"the gradient isn't finite at step {step}")
            trace.append(value)
            theta[places] -= self._move(gradient, step, state)
        return theta, trace

    def _start(self, n: int):
        return None

    def _move(self, gradient: np.ndarray, step: int, state) -> np.ndarray:
        return self.learning_rate * gradient


@dataclass(frozen=True)
class AdamCalibrator(GradientCalibrator):
    """Steps scaled by running means of the gradient and of its square, both corrected for their start at zero."""

    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def _start(self, n: int):
        return [np.zeros(n), np.zeros(n)]

    def _move(self, gradient, step, state):
        state[0] = self.beta1 * state[0] + (1 - self.beta1) * gradient
        state[1] = self.beta2 * state[1] + (1 - self.beta2) * gradient**2
        mean, square = state[0] / (1 - self.beta1**step), state[1] / (1 - self.beta2**step)
        return self.learning_rate * mean / (np.sqrt(square) + self.eps)


@dataclass(frozen=True)
class Block:
    """Latents that are updated together; steps: how often in a sweep, where the plan isn't affine in them."""

    names: str | Sequence[str]
    steps: int = 1
    engine: str | None = None

    @property
    def members(self) -> list[str]:
        return [self.names] if isinstance(self.names, str) else list(self.names)


@dataclass
class Estimate:
    theta: np.ndarray
    chi2: float
    sweeps: int
    converged: bool
    trace: list[float] = field(default_factory=list)


@dataclass
class Draws:
    """theta: a row for each draw."""

    theta: np.ndarray
    names: list[str]
    accepted: dict[str, float]

    @property
    def n_draw(self) -> int:
        return len(self.theta)

    @property
    def mean(self) -> np.ndarray:
        return self.theta.mean(axis=0)

    @property
    def std(self) -> np.ndarray:
        return self.theta.std(axis=0)

    @property
    def rhat(self) -> np.ndarray:
        """Between and within the halves of each trace."""
        n = len(self.theta) // 2
        if n < 2:
            raise ParameterError("four draws at least")
        halves = np.stack([self.theta[:n], self.theta[-n:]])
        within = halves.var(axis=1, ddof=1).mean(axis=0)
        between = halves.mean(axis=1).var(axis=0, ddof=1)
        return np.sqrt(((n - 1) / n * within + between) / np.where(within > 0, within, 1.0))

    def table(self, spark: SparkSession) -> DataFrame:
        """draw_id, theta, as push_forward takes them."""
        return spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(self.theta)], "draw_id long, theta array<double>")


class SamplingPlan:
    """Every latent in one block. Blocks whose latents are all linear are solved or drawn exactly; others move by damped Newton steps or proposals."""

    def __init__(self, problem: Problem, *blocks: Block):
        self.problem, self.space, self.blocks = problem, problem.space, []
        self._whole = None
        named = [n for b in blocks for n in b.members]
        if sorted(named) != sorted(self.space.names):
            raise ParameterError("each latent stands in one block")
        for b in blocks:
            linear = [self.space.latent(n).linear for n in b.members]
            if any(linear) and not all(linear) and b.engine is None:
                raise ParameterError(f"{b.members} are linear in part; say which engine moves them")
            engine = b.engine or ("conjugate" if all(linear) else "gradient")
            if engine not in ("conjugate", "gradient") or (engine == "conjugate" and not all(linear)) or b.steps < 1:
                raise ParameterError(f"no such block: {b}")
            self.blocks.append((b, engine))

    def check(self, at: Sequence[float] | None = None, rtol: float = 1e-8) -> None:
        """Blocks that are solved exactly are affine, and the data with the normal priors determine all latents."""
        theta = self.space.initial if at is None else np.asarray(at, float)
        for b, engine in self.blocks:
            if engine == "conjugate":
                check_linearity(self.problem.forward, b.members, theta)
        r, _, _ = matrices(self.problem.linearised(theta))
        full = np.vstack([r, prior_root(self.space.gaussian()[1], r.shape[1])])
        length = np.linalg.norm(full, axis=0)
        s = np.linalg.svd(full / np.where(length > 0, length, 1.0), compute_uv=False)
        if (s <= rtol * s.max(initial=0.0)).any():
            raise ParameterError(f"{int((s <= rtol * s.max()).sum())} directions aren't determined")

    @property
    def affine(self) -> bool:
        """Whether one factor holds all that the data say: all blocks exact, and noise that doesn't depend on the signal."""
        noise = self.problem.noise
        noise = noise.base if isinstance(noise, Flagged) else noise
        return all(engine == "conjugate" for _, engine in self.blocks) and isinstance(noise, Homoscedastic)

    def _update(self, theta: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Best change of the block's latents by the linearised plan, and the inverse triangle of its precision."""
        places = self.space.places(b.members)
        if self.affine:  # sweeps of an affine plan need no job but this one
            if self._whole is None:
                self._whole = (theta.copy(), *matrices(self.problem.linearised(theta)))
            at, r, z, _ = self._whole
            z = z - r @ (theta - at)
            r = r[:, places]
            t = triangle(np.column_stack([r, z]))
            r, z = t[: len(places), : len(places)], t[: len(places), -1]
        else:
            r, z, _ = matrices(self.problem.linearised(theta, b.members))
        mean, std = self.space.gaussian(places, theta)
        return solved(r, z, std if np.isfinite(std).any() else None, mean - theta[places])

    def _log_posterior(self, theta: np.ndarray) -> float:
        if not self.affine:
            return float(self.problem.log_posteriors([theta])[0])
        at, r, z, offset = self._whole
        return offset - 0.5 * float(((r @ (theta - at) - z) ** 2).sum()) + self.space.log_prior(theta)

    def estimate(self, at: Mapping | Sequence[float] | None = None, tol: float = 1e-8, least: int = 3, most: int = 100, check: bool = True) -> Estimate:
        """Sweeps until the misfit of data and priors stays; those of an affine plan, which need no job, until the latents stay too."""
        theta = self.space.flat(at) if at is None or isinstance(at, Mapping) else np.array(at, float)
        if check:
            self.check(theta)
        before, trace = None, []
        for sweep in range(1, most + 1):
            now, started = None, theta.copy()
            for b, engine in self.blocks:
                places = self.space.places(b.members)
                for _ in range(1 if engine == "conjugate" else b.steps):
                    change, _ = self._update(theta, b)
                    if engine == "conjugate":
                        theta[places] += change
                        now = None
                        continue
                    # the whole step, or a part of it, or none: whichever is best
                    tries = [theta.copy() for _ in range(5)]
                    for t, s in zip(tries, (0.0, 1.0, 0.5, 0.25, 0.05)):
                        t[places] += s * change
                    found = self.problem.log_posteriors(tries)
                    best = int(np.nanargmax(found))
                    theta, now = tries[best], float(found[best])
            if now is None:
                now = self._log_posterior(theta)
            trace.append(-2 * now)
            stays = not self.affine or (np.abs(theta - started) <= 1e-12 * np.maximum(1.0, np.abs(theta))).all()
            if before is not None and sweep >= least and stays and abs(now - before) <= tol * max(1.0, abs(now)):
                return Estimate(theta, self.problem.chi2(theta), sweep, True, trace)
            before = now
        return Estimate(theta, self.problem.chi2(theta), most, False, trace)

    def sample(self, n: int, seed: int, at: Sequence[float] | None = None, warmup: int = 0, check: bool = True) -> Draws:
        """Gibbs sweeps. Blocks that aren't affine are proposed to with a spread fixed at the start, so that chains keep their target."""
        if open_ := [x.name for x in self.space.latents if x.prior is None]:
            raise ParameterError(f"{open_} have no prior")
        theta = self.space.initial if at is None else np.array(at, float)
        if check:
            self.check(theta)
        rng, spread = np.random.default_rng(seed), {}
        for i, (b, engine) in enumerate(self.blocks):
            if engine == "gradient":
                places = self.space.places(b.members)
                spread[i] = self._update(theta, b)[1] * 2.4 / len(places) ** 0.5
        out, tried, taken = [], dict.fromkeys(spread, 0), dict.fromkeys(spread, 0)
        for sweep in range(warmup + n):
            now = None
            for i, (b, engine) in enumerate(self.blocks):
                places = self.space.places(b.members)
                if engine == "conjugate":
                    change, inverse = self._update(theta, b)
                    theta[places] += change + inverse @ rng.normal(size=len(places))
                    now = None
                    continue
                for _ in range(b.steps):
                    new = theta.copy()
                    new[places] += spread[i] @ rng.normal(size=len(places))
                    found = self.problem.log_posteriors([new] if now is not None else [new, theta])
                    now = float(found[1]) if now is None else now
                    tried[i] += 1
                    if np.log(rng.random()) < found[0] - now:
                        theta, now = new, float(found[0])
                        taken[i] += 1
            if sweep >= warmup:
                out.append(theta.copy())
        return Draws(np.array(out), self.space.names, {"/".join(self.blocks[i][0].members): taken[i] / max(1, tried[i]) for i in spread})


@dataclass(frozen=True)
class PriorSensitivity:
    """mode under the priors, mode of the data alone (NaN where they don't determine it), and posterior standard deviations, by place."""

    names: list[str]
    mode: np.ndarray
    data_mode: np.ndarray
    sigma: np.ndarray
    precision: np.ndarray
    prior_mean: np.ndarray
    prior_std: np.ndarray

    @property
    def shift(self) -> np.ndarray:
        """How far the priors moved the mode, in posterior standard deviations."""
        return (self.mode - self.data_mode) / self.sigma

    @property
    def worst(self) -> int:
        return int(np.nanargmax(np.abs(self.shift)))

    def shift_at(self, scale: float) -> np.ndarray:
        """The same, had all priors been `scale` times as wide; to first order."""
        prior = np.diag(1 / (self.prior_std * scale) ** 2)
        moved = np.linalg.solve(self.precision + prior, prior @ (self.prior_mean - self.data_mode))
        return moved / self.sigma


def _newton(problem: Problem, theta: np.ndarray, places: list[int], names: list[str], priors: bool, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    mean, std = problem.space.gaussian(places, theta)  # the other latents stay
    for _ in range(most):
        r, z, _ = matrices(problem.linearised(theta, names))
        change, _ = solved(r, z, std if priors else None, mean - theta[places])
        theta = theta.copy()
        theta[places] += change
        if np.abs(change).max() <= 1e-10 * max(1.0, np.abs(theta[places]).max()):
            break
    return theta, r


def prior_sensitivity(problem: Problem, names: Sequence[str] | None = None, at: Sequence[float] | None = None) -> PriorSensitivity:
    """Two fits, with and without the normal priors of these latents, the others held."""
    space = problem.space
    some = list(space.names if names is None else [names] if isinstance(names, str) else names)
    places = space.places(some)
    mean, std = space.gaussian(places)
    if std.ndim > 1 or not np.isfinite(std).all():
        raise ParameterError("latents whose priors are asked about have normal ones of their own")
    theta = space.initial if at is None else np.asarray(at, float)
    with_, r = _newton(problem, theta, places, some, True)
    precision = r.T @ r + np.diag(1 / std**2)
    sigma = np.sqrt(np.diag(np.linalg.inv(precision)))
    if rank(triangle(np.column_stack([r, np.zeros(len(r))]))[: len(places), : len(places)]) < len(places):
        alone = np.full(len(places), np.nan)
    else:
        alone = _newton(problem, with_, places, some, False)[0][places]
    return PriorSensitivity(some, with_[places], alone, sigma, r.T @ r, mean, std)


def simulate_pairs(forward: Forward, noise, n: int, seed: int, spark: SparkSession) -> DataFrame:
    """draw_id, theta, the cells' keys and data: draws of the priors, each with the noisy data that it would give."""
    from skyloom.functions.random import normal

    draws = forward.space.draws(spark, n, seed)
    mu: Column = F.col("data")
    seen = forward.many(draws).withColumn("data", mu + noise_model(noise).std(mu) * normal(seed, "pairs", "draw_id", *KEYS))
    return seen.join(draws, "draw_id")


def best_log_likelihood(factor: dict) -> float:
    """Of a factor, at its best."""
    r, z, _ = matrices(factor)
    return log_likelihood(factor, solved(r, z)[0])
