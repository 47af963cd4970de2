"""Gradient sampling of plans: Hamiltonian trajectories of many chains side by side, each step one job.

A job meets every cell with every chain's unknowns and sums, for each chain, the log likelihood and its derivatives, which are exact (see functions.dual). The driver
holds one row of numbers for each chain. Unknowns move in units of the information at the start, so that a few steps go across the posterior;
the length of a step adapts while warming up until trajectories are accepted as often as asked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.dual import Point, slope
from skyloom.functions.maths import finite
from skyloom.operators.engines import Problem
from skyloom.operators.evidence import matrices, prior_root
from skyloom.plans.space import Normal, literal


#: A quarter turn of a Gaussian's trajectories: longer ones come back.
QUARTER = np.pi / 2


def value_and_gradient(problem: Problem, points: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood and its derivatives at each point (a whole theta), by one job."""
    forward, noise = problem.forward, problem.noise
    chains = F.array(*(F.struct(F.lit(i).alias("chain"), literal(p).alias("theta")) for i, p in enumerate(points)))
    rows = problem.rows.withColumn("_c", F.explode(chains)).withColumns({"_chain": F.col("_c.chain"), "_theta": F.col("_c.theta")})
    try:
        slopes = F.transform(F.array(*map(F.lit, places)), lambda i: slope(forward.at(Point(F.col("_theta"), i))))
    except (TypeError, AttributeError) as e:
        raise ParameterError("a binding or operator of this plan has no exact derivative: use functions of skyloom.functions.dual in it") from e
    rows = rows.withColumns({"_mu": forward.at(F.col("_theta")), "_j": slopes})
    rows = rows.withColumns({"_s": noise.std(F.col("_mu")), "_l": noise.log_slope(F.col("_mu"))})
    gap = (F.col("_y") - F.col("_mu")) / F.col("_s")
    rows = rows.where(finite(F.col("_s"))).select("_chain", "_j", (-0.5 * (gap * gap + F.log(2 * np.pi * F.col("_s") * F.col("_s")))).alias("_v"), (gap / F.col("_s") + (gap * gap - 1) * F.col("_l")).alias("_g"))
    sums = rows.groupBy("_chain").agg(F.sum("_v").alias("v"), *(F.sum(F.col("_g") * F.get("_j", F.lit(k))).alias(f"g{k}") for k in range(len(places))))
    value, gradient = np.zeros(len(points)), np.zeros((len(points), len(places)))
    for r in sums.collect():  # a row for each chain
        value[r["_chain"]], gradient[r["_chain"]] = r["v"], [r[f"g{k}"] for k in range(len(places))]
    return value, gradient


@dataclass(frozen=True)
class Samples:
    """draws: (chains, draws, unknowns) after warming up; accepted: the mean chance of a trajectory; step: its length in whitened units."""

    names: tuple[str, ...]
    draws: np.ndarray
    accepted: float
    step: float

    @property
    def mean(self) -> np.ndarray:
        return self.draws.mean(axis=(0, 1))

    @property
    def cov(self) -> np.ndarray:
        return np.atleast_2d(np.cov(self.draws.reshape(-1, self.draws.shape[2]).T))

    @property
    def r_hat(self) -> np.ndarray:
        """Of each unknown, between and within the halves of chains; 1 where all tell the same."""
        half = self.draws.shape[1] // 2
        parts = np.concatenate([self.draws[:, :half], self.draws[:, -half:]])
        within, between = parts.var(axis=1, ddof=1).mean(axis=0), parts.mean(axis=1).var(axis=0, ddof=1)
        return np.sqrt((half - 1) / half + between / within)


@dataclass(frozen=True)
class GradientSampler:
    """chains side by side; each trajectory is up to `leaps` steps long, each step a job. target: the chance of acceptance that the step adapts to. A
    trajectory ends after about a quarter turn of the whitened posterior."""

    chains: int = 16
    draws: int = 100
    warm_up: int = 20
    leaps: int = 4
    target: float = 0.9
    seed: int = 0

    def __post_init__(self):
        if self.chains < 2 or self.draws < 4 or self.warm_up < 1 or self.leaps < 1 or not 0 < self.target < 1:
            raise ParameterError("a sampler has two chains, four draws, one step of each kind or more, and a target between 0 and 1")

    def sample(self, problem: Problem, names=None, at=None) -> Samples:
        space = problem.space
        places = space.places(names)
        theta = space.initial if at is None else np.array(at, float)
        some = tuple(n for n in space.names if names is None or n in ([names] if isinstance(names, str) else names))
        r, _, _ = matrices(problem.linearised(theta, list(some)))
        mean, spread = space.gaussian(places, theta)
        root = prior_root(spread, len(places))
        scale = self._scale(r, root, space, places)
        precision = root.T @ root
        rng = np.random.default_rng(self.seed)

        def log_density(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = theta[places] + q @ scale.T
            whole = np.tile(theta, (len(x), 1))
            whole[:, places] = x
            prior = np.array([space.log_prior(p) for p in whole])
            inside = np.isfinite(prior)
            whole[~inside] = theta  # a plan may not be defined there
            value, gradient = value_and_gradient(problem, whole, places)
            value = np.where(inside & np.isfinite(value), value + prior, -np.inf)
            gradient = np.where(np.isfinite(gradient), gradient, 0.0) - (x - mean) @ precision
            return x, value, np.where(inside[:, None], gradient @ scale, 0.0)

        q = self._start(rng, problem, theta, places, scale)
        x, value, gradient = log_density(q)
        if not np.isfinite(value).all():
            raise ParameterError("the start has no finite density")
        kept, chances = [], []
        step, average, log_average = 0.8, 0.0, 0.0
        centre = np.log(step)
        for turn in range(1, self.warm_up + self.draws + 1):
            warm = turn <= self.warm_up
            size = (step if warm else np.exp(log_average)) * rng.uniform(0.8, 1.2)
            momentum = rng.normal(size=q.shape)
            old = value - 0.5 * (momentum**2).sum(axis=1)
            q1, x1, v1, g1 = q, x, value, gradient
            for _ in range(min(self.leaps, max(1, round(QUARTER / size)))):
                momentum = momentum + 0.5 * size * g1
                q1 = q1 + size * momentum
                x1, v1, g1 = log_density(q1)
                momentum = momentum + 0.5 * size * g1
            with np.errstate(over="ignore", invalid="ignore"):
                chance = np.minimum(1.0, np.exp(np.nan_to_num(v1 - 0.5 * (momentum**2).sum(axis=1) - old, nan=-np.inf)))
            taken = rng.random(len(q)) < chance
            q, x, gradient = (np.where(taken[:, None], new, was) for new, was in ((q1, q), (x1, x), (g1, gradient)))
            value = np.where(taken, v1, value)
            if warm:  # dual averaging of how far acceptance is from its target
                average += (self.target - chance.mean() - average) / (turn + 10)
                log_step = min(centre - np.sqrt(turn) / 0.25 * average, np.log(2.0))
                weight = turn**-0.75
                log_average = weight * log_step + (1 - weight) * log_average
                step = np.exp(log_step)
            else:
                kept.append(x.copy())
                chances.append(chance.mean())
        return Samples(some, np.stack(kept, axis=1), float(np.mean(chances)), float(np.exp(log_average)))

    def _scale(self, r: np.ndarray, root: np.ndarray, space, places: list[int]) -> np.ndarray:
        """A root of the inverse of the information at the start, priors included."""
        root = root.copy()
        for x in space.latents:  # a prior between limits is as wide as them
            if x.prior is not None and not isinstance(x.prior, Normal):
                for i in range(*space.spans[x.name].indices(space.width)):
                    if i in places:
                        root[places.index(i), places.index(i)] = 2 / (x.prior.high - x.prior.low)
        _, s, v = np.linalg.svd(np.vstack([r, root]), full_matrices=False)
        if not s.min(initial=np.inf) > 1e-12 * s.max(initial=0.0):
            raise ParameterError("the start tells nothing of some unknowns: give them priors")
        return v.T / s

    def _start(self, rng, problem: Problem, theta: np.ndarray, places: list[int], scale: np.ndarray) -> np.ndarray:
        """Chains apart from each other, but within the priors."""
        q = rng.normal(size=(self.chains, len(places)))
        for i in range(self.chains):
            for _ in range(60):
                whole = theta.copy()
                whole[places] += scale @ q[i]
                if np.isfinite(problem.space.log_prior(whole)):
                    break
                q[i] /= 2
        return q
