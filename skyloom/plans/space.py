"""Parameter spaces: which numbers of a plan are unknown, and the plan as a function of them.

All unknowns of a space lie side by side in one array column theta. Binding puts expressions of theta in the place of parameters, so
that the plan stays one projection of the cells, for one theta, for a table of draws, or, in a higher-order function, for many
neighbouring thetas of the same cell: Jacobians and designs need neither a join nor a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.dual import Dual, Point, slope
from skyloom.functions.random import normal, uniform
from skyloom.operators.base import KEYS, Param
from skyloom.plans.signal_path import PROCESSING, Assembly, stages_requiring_seed

SCOPES = ("global", "per_epoch", "linked")


@dataclass(frozen=True)
class Normal:
    mean: float = 0.0
    std: float = 1.0

    def __post_init__(self):
        if not (np.isfinite(self.mean) and np.isfinite(self.std) and self.std > 0):
            raise ParameterError("a normal prior needs a finite mean and a spread above zero")

    def log_density(self, x):
        return -0.5 * ((x - self.mean) / self.std) ** 2 - np.log(self.std) - 0.5 * np.log(2 * np.pi)

    def draw(self, seed: int, name: str, *keys) -> Column:
        return self.mean + self.std * normal(seed, name, *keys)


@dataclass(frozen=True)
class Uniform:
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        if not (np.isfinite(self.low) and np.isfinite(self.high) and self.low < self.high):
            raise ParameterError("a uniform prior needs finite bounds")

    def log_density(self, x):
        return np.where((x >= self.low) & (x <= self.high), -np.log(self.high - self.low), -np.inf)

    def draw(self, seed: int, name: str, *keys) -> Column:
        return self.low + (self.high - self.low) * uniform(seed, name, *keys)


@dataclass(frozen=True)
class Latent:
    """An unknown number, or a row of them: init says which. linear: the plan is affine in it."""

    name: str
    init: float | Sequence[float]
    prior: Normal | Uniform | None = None
    linear: bool = False
    scope: str = "global"

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ParameterError(f"a scope is one of {SCOPES}")
        if not np.isfinite(np.asarray(self.init, float)).all() or np.ndim(self.init) > 1 or not np.size(self.init):
            raise ParameterError(f"{self.name} starts at a finite number or row of numbers")

    @property
    def width(self) -> int:
        return int(np.size(self.init))


_TARGET = re.compile(r"^(\w+)(?:\[(\d+)\])?\.(\w+)$")


@dataclass(frozen=True)
class Bind:
    """Puts latents into fields of the plan, each named as node.field or node[i].field.

    axis: a latent row goes by time or freq (element by index), whole (array), or, for a single number, as it is (scalar). fn: what is put
    there, as a function of the latents' columns.
    """

    latents: str | Sequence[str]
    into: str | Sequence[str]
    axis: str = "scalar"
    fn: Callable[..., Column] | None = None

    def __post_init__(self):
        if self.axis not in ("scalar", "time", "freq", "array"):
            raise ParameterError("an axis is scalar, time, freq or array")
        if bad := [t for t in self.targets if not _TARGET.match(t)]:
            raise ParameterError(f"no field is named {bad}")
        if not self.names or not self.targets:
            raise ParameterError("a binding has latents and fields")
        if len(self.names) > 1 and self.fn is None:
            raise ParameterError("several latents need a function to become one value")

    @property
    def names(self) -> list[str]:
        return [self.latents] if isinstance(self.latents, str) else list(self.latents)

    @property
    def targets(self) -> list[str]:
        return [self.into] if isinstance(self.into, str) else list(self.into)


@dataclass(frozen=True)
class Joint:
    """A normal prior of several latents together, side by side: a mean and a covariance. They have none of their own."""

    names: Sequence[str]
    mean: Sequence[float]
    cov: Sequence[Sequence[float]]

    def __post_init__(self):
        cov = np.asarray(self.cov, float)
        if cov.shape != (np.size(self.mean),) * 2 or not (np.isfinite(cov).all() and np.isfinite(np.asarray(self.mean, float)).all()):
            raise ParameterError("a joint prior has a mean and a square covariance of finite numbers")
        if not np.allclose(cov, cov.T, rtol=1e-12, atol=0) or np.linalg.eigvalsh(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))[0] <= 1e-14:
            raise ParameterError("the covariance of a joint prior is symmetric and above zero in every direction")

    @property
    def precision(self) -> np.ndarray:
        return np.linalg.inv(np.asarray(self.cov, float))

    def log_density(self, x: np.ndarray) -> float:
        d, cov = x - np.asarray(self.mean, float), np.asarray(self.cov, float)
        return float(-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1])


@dataclass(frozen=True)
class ParameterSpace:
    latents: Sequence[Latent]
    bindings: Sequence[Bind]
    joints: Sequence[Joint] = ()

    def __post_init__(self):
        shared = [n for j in self.joints for n in j.names]
        if bad := [n for n in shared if n not in self.names or self.latent(n).prior is not None or shared.count(n) > 1]:
            raise ParameterError(f"{sorted(set(bad))}: a latent of a joint prior is declared, has no other prior, and is in one")
        if odd := [list(j.names) for j in self.joints if sum(self.latent(n).width for n in j.names) != np.size(j.mean)]:
            raise ParameterError(f"the joint prior of {odd[0]} isn't as wide as they are")
        if twice := {n for n in self.names if self.names.count(n) > 1}:
            raise ParameterError(f"latents {sorted(twice)} are declared twice")
        used = [n for b in self.bindings for n in b.names]
        if unknown := set(used) - set(self.names):
            raise ParameterError(f"bindings of no latent: {sorted(unknown)}")
        if dead := set(self.names) - set(used):
            raise ParameterError(f"latents that nothing depends on: {sorted(dead)}")
        fields = [t.replace("[0]", "") for b in self.bindings for t in b.targets]
        if twice := {t for t in fields if fields.count(t) > 1}:
            raise ParameterError(f"fields {sorted(twice)} are bound twice")
        for b in self.bindings:
            if b.axis == "scalar" and (wide := [n for n in b.names if self.latent(n).width > 1]):
                raise ParameterError(f"{wide} are rows; say along which axis they go")

    @property
    def names(self) -> list[str]:
        return [x.name for x in self.latents]

    def latent(self, name: str) -> Latent:
        found = [x for x in self.latents if x.name == name]
        if not found:
            raise ParameterError(f"no latent {name}")
        return found[0]

    @property
    def spans(self) -> dict[str, slice]:
        ends = np.cumsum([x.width for x in self.latents]).tolist()
        return {x.name: slice(z - x.width, z) for x, z in zip(self.latents, ends)}

    @property
    def width(self) -> int:
        return sum(x.width for x in self.latents)

    @property
    def initial(self) -> np.ndarray:
        return np.concatenate([np.atleast_1d(np.asarray(x.init, float)) for x in self.latents])

    def flat(self, values: Mapping[str, float | Sequence[float]] | None = None) -> np.ndarray:
        """theta: the values given, and the initial ones of the rest."""
        out = self.initial
        for name, v in (values or {}).items():
            s = self.spans.get(name)
            if s is None or np.size(v) != s.stop - s.start:
                raise ParameterError(f"{name} isn't a latent of {np.size(v)}")
            out[s] = v
        return out

    def named(self, theta: Sequence[float]) -> dict[str, float | np.ndarray]:
        theta = np.asarray(theta, float)
        return {n: float(theta[s][0]) if np.ndim(self.latent(n).init) == 0 else theta[s] for n, s in self.spans.items()}

    def places(self, names: str | Sequence[str] | None = None) -> list[int]:
        """Indices in theta of these latents, in the order of the space."""
        some = self.names if names is None else [names] if isinstance(names, str) else list(names)
        for n in some:
            self.latent(n)
        return [i for n, s in self.spans.items() if n in some for i in range(s.start, s.stop)]

    def validate(self, plan: Assembly) -> None:
        if random := stages_requiring_seed(plan):
            raise ParameterError(f"{random} draw random numbers; a plan that is fitted has none")
        for b in self.bindings:
            for t in b.targets:
                node, i, name = _TARGET.match(t).groups()
                found = plan.instances(node)
                if i is None and len(found) > 1:
                    raise ParameterError(f"{len(found)} operators stand at {node}; say which")
                if int(i or 0) >= len(found) or not hasattr(found[int(i or 0)], name):
                    raise ParameterError(f"the plan has no {t}")

    def bind(self, plan: Assembly, theta: Column | Point) -> Assembly:
        """plan with expressions of theta in the place of what is bound."""
        get = theta.get if isinstance(theta, Point) else lambda i: F.get(theta, i)
        part = theta.part if isinstance(theta, Point) else lambda start, size: F.slice(theta, start + 1, size)
        for b in self.bindings:
            values = []
            for n in b.names:
                s = self.spans[n]
                if b.axis == "array":
                    values.append(part(s.start, s.stop - s.start))
                elif b.axis == "scalar":
                    values.append(get(F.lit(s.start)))
                else:
                    values.append(get(F.col(f"{b.axis}_idx").cast("int") + s.start))
            x = b.fn(*values) if b.fn else values[0]
            for t in b.targets:
                node, i, name = _TARGET.match(t).groups()
                plan = plan.replace_field(node, int(i or 0), name, Param.expression(x))
        return plan

    def _together(self, joint: Joint) -> list[int]:
        """Places of a joint prior's latents, in its own order."""
        return [i for n in joint.names for i in range(self.spans[n].start, self.spans[n].stop)]

    def log_prior(self, theta: Sequence[float]) -> float:
        """Of the latents that have a prior."""
        theta = np.asarray(theta, float)
        own = sum(np.sum(x.prior.log_density(theta[self.spans[x.name]])) for x in self.latents if x.prior)
        return float(own + sum(j.log_density(theta[self._together(j)]) for j in self.joints))

    def gaussian(self, places: Sequence[int] | None = None, at: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each place; infinite where there is no normal prior.

        Where joint priors reach these places, a square root of their precision stands for the standard deviations, and the mean is that given the other latents
        at `at`: what a block needs while the others are held.
        """
        mean, std = np.zeros(self.width), np.full(self.width, np.inf)
        for x in self.latents:
            if isinstance(x.prior, Normal):
                mean[self.spans[x.name]], std[self.spans[x.name]] = x.prior.mean, x.prior.std
        keep = list(range(self.width)) if places is None else list(places)
        reached = [j for j in self.joints if set(self._together(j)) & set(keep)]
        if not reached:
            return mean[keep], std[keep]
        theta, root = self.initial if at is None else np.asarray(at, float), np.diag(1 / std)
        for j in reached:
            all_, precision, m = np.array(self._together(j)), j.precision, np.asarray(j.mean, float)
            mine = np.isin(all_, keep)
            own = precision[np.ix_(mine, mine)]
            push = precision[np.ix_(mine, ~mine)] @ (theta[all_[~mine]] - m[~mine])
            mean[all_[mine]] = m[mine] - np.linalg.solve(own, push)
            root[np.ix_(all_[mine], all_[mine])] = np.linalg.cholesky(own).T
        return mean[keep], root[np.ix_(keep, keep)]

    def draws(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """draw_id, theta: draws of the priors, the same for a seed however they are partitioned."""
        together = {name: j for j in self.joints for name in j.names}
        if open_ := [x.name for x in self.latents if x.prior is None and x.name not in together]:
            raise ParameterError(f"{open_} have no prior to draw from")
        parts: dict[int, Column] = {}
        for x in self.latents:
            for i in range(x.width if x.prior else 0):
                parts[self.spans[x.name].start + i] = x.prior.draw(seed, f"{x.name}/{i}", "draw_id")
        for j in self.joints:
            free = [normal(seed, f"{n}/{i}", "draw_id") for n in j.names for i in range(self.latent(n).width)]
            for at, m, row in zip(self._together(j), j.mean, np.linalg.cholesky(np.asarray(j.cov, float))):
                total = F.lit(float(m))
                for c, z in zip(row, free):
                    total = total + float(c) * z if c else total
                parts[at] = total
        return spark.range(n).select(F.col("id").alias("draw_id")).select("draw_id", F.array(*(parts[i] for i in range(self.width))).alias("theta"))


def literal(theta: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in theta))


class Forward:
    """A plan on cells as a function of theta. Plans of grouped steps (flags, averages, filters) have no such function."""

    def __init__(self, space: ParameterSpace, plan: Assembly, cells: DataFrame):
        space.validate(plan)
        if late := [n for n in PROCESSING if n in plan.placed]:
            raise ParameterError(f"a plan that is fitted ends before {late}")
        self.space, self.plan = space, plan
        self._bare = cells
        self.cells = space.bind(plan, literal(space.initial)).expression(cells)[0]

    def at(self, theta: Column | Point) -> Column | Dual:
        """The prediction, a column of self.cells."""
        return self.space.bind(self.plan, theta).expression(self._bare)[1]

    def predict(self, values: Mapping | Sequence[float] | None = None) -> DataFrame:
        theta = self.space.flat(values) if values is None or isinstance(values, Mapping) else np.asarray(values, float)
        return self.cells.select(*KEYS, self.at(literal(theta)).alias("data"))

    def many(self, draws: DataFrame, block: int = 65_536, shards: int = 16) -> DataFrame:
        """draw_id, the cells' keys and data, for each draw (draw_id, theta) and cell.

        Every pair is asked for; blocks of cells meet shards of draws, so that no task holds all of either.
        """
        n = max(1, -(-self.cells.count() // block))
        left = self.cells.withColumn("_block", F.pmod(F.xxhash64(*KEYS), F.lit(n))).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = draws.select("draw_id", "theta", F.pmod(F.xxhash64("draw_id"), F.lit(shards)).cast("int").alias("_shard"))
        right = right.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return left.join(right, ["_block", "_shard"]).select("draw_id", *KEYS, self.at(F.col("theta")).alias("data"))

    def _slopes(self, places: Sequence[int], theta: Sequence[float]) -> Column | None:
        """The array of derivatives at these places, by duals; None where the plan holds a function that knows columns only."""
        try:
            return F.transform(F.array(*map(F.lit, places)), lambda i: slope(self.at(Point(literal(theta), i))))
        except (TypeError, AttributeError):
            return None

    def design(self, names: str | Sequence[str] | None = None, at: Sequence[float] | None = None) -> tuple[Column, Column]:
        """For latents in which the plan is affine: the array of their coefficients, and what is left when they are all zero."""
        theta = self.space.initial if at is None else np.asarray(at, float)
        places = self.space.places(names)
        base = theta.copy()
        base[places] = 0.0
        zero = self.at(literal(base))
        if (exact := self._slopes(places, base)) is not None:
            return exact, zero
        step = lambda i: self.at(F.transform(literal(base), lambda x, j: F.when(j == i, F.lit(1.0)).otherwise(x)))
        return F.transform(F.array(*map(F.lit, places)), lambda i: step(i) - zero), zero

    def jacobian(self, names: str | Sequence[str] | None = None, at: Sequence[float] | None = None, step: float = 1e-5) -> tuple[Column, Column]:
        """The array of derivatives with respect to these latents, and the prediction.

        Exact, by duals (see functions.dual); by central differences where a binding or an operator has a function of columns only.
        """
        theta = self.space.initial if at is None else np.asarray(at, float)
        places = self.space.places(names)
        if (exact := self._slopes(places, theta)) is not None:
            return exact, self.at(literal(theta))
        size = step * np.maximum(np.abs(theta[places]), 1e-3)
        moved = lambda s: self.at(F.transform(literal(theta), lambda x, j: F.when(j == s["i"], x + s["h"]).otherwise(x)))
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(h)).alias("h")) for i, h in zip(places, size)))
        back = lambda s: F.struct(s["i"].alias("i"), (-s["h"]).alias("h"))
        return F.transform(steps, lambda s: (moved(s) - moved(back(s))) / (2 * s["h"])), self.at(literal(theta))


@dataclass(frozen=True)
class Factorization:
    """How a campaign's unknowns go with its epochs: global ones are shared, per_epoch ones integrated out in each, linked ones follow a chain.

    represents: shared input products that a global latent stands for.
    """

    space: ParameterSpace
    transition: object | None = None
    represents: Mapping[str, str] = ()

    def __post_init__(self):
        if not self.of("global"):
            raise ParameterError("a campaign needs a latent that its epochs share")
        if self.of("linked") and self.transition is None:
            raise ParameterError("linked latents need a transition")
        if bad := [n for n in dict(self.represents).values() if n not in self.of("global")]:
            raise ParameterError(f"{bad} are no global latents")

    def of(self, scope: str) -> list[str]:
        return [x.name for x in self.space.latents if x.scope == scope]

    @property
    def global_names(self) -> list[str]:
        return self.of("global")

    @property
    def per_epoch_names(self) -> list[str]:
        return self.of("per_epoch")

    @property
    def linked_names(self) -> list[str]:
        return self.of("linked")
