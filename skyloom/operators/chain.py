"""Ordered epochs whose nuisance follows a linear-Gaussian chain: integrated out exactly, or smoothed.

Each epoch's factor is over (theta, zeta): what all epochs share, then the state of its own. zeta' = phi zeta + noise from one epoch to the
next. Neighbouring epochs join to segments over (theta, first state, last state), whatever lies between integrated out; joining is
associative, so ranges of epochs reduce side by side and only one segment for each range meets its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.operators.evidence import integrated, log_likelihood, matrices, solved
from skyloom.sources.stage import Stage, stage

_LOG2PI = float(np.log(2 * np.pi))


@dataclass(frozen=True)
class Transition:
    phi: np.ndarray
    process_std: np.ndarray
    initial_std: np.ndarray
    initial_mean: np.ndarray

    @staticmethod
    def of(phi, process_std, initial_std, initial_mean=0.0) -> Transition:
        """Numbers stand for a state of one, or for the same in every direction."""
        phi = np.atleast_2d(np.asarray(phi, float))
        if phi.shape[0] != phi.shape[1]:
            raise ParameterError("phi is square")
        k = len(phi)
        q, s, m = (np.broadcast_to(np.asarray(x, float), k).copy() for x in (process_std, initial_std, initial_mean))
        if not (np.isfinite(q) & (q > 0) & np.isfinite(s) & (s > 0)).all() or not (np.isfinite(phi).all() and np.isfinite(m).all()):
            raise ParameterError("standard deviations of a transition must be finite and above zero")
        return Transition(phi, q, s, m)

    @property
    def width(self) -> int:
        return len(self.phi)


def ornstein_uhlenbeck(tau: float, sigma: float, width: int = 1) -> Transition:
    """Stationary, with spread sigma and a memory of tau epochs."""
    if not tau > 0:
        raise ParameterError("tau must be above zero")
    phi = float(np.exp(-1 / tau))
    return Transition.of(np.eye(width) * phi, sigma * (1 - phi * phi) ** 0.5, sigma)


@dataclass(frozen=True)
class HyperTransition:
    """A transition that depends on the shared unknowns: build takes their values by name."""

    build: Callable[[dict[str, float]], Transition]
    hyper: tuple[str, ...]

    def at(self, names: Sequence[str], theta: Sequence[float]) -> Transition:
        values = dict(zip(names, theta))
        return self.build({h: values[h] for h in self.hyper})


@dataclass
class _Segment:
    """A factor over (theta, first state) or, of more than one epoch, (theta, first state, last state)."""

    r: np.ndarray
    z: np.ndarray
    offset: float
    single: bool

    def then(self, other: _Segment, t: Transition) -> _Segment:
        k = t.width
        n = self.r.shape[1] - (k if self.single else 2 * k)
        # unknowns: theta, and the first and last states of both, where those of a single epoch are one
        ends = [(n, n if self.single else n + k)]
        at = ends[0][1] + k
        ends.append((at, at if other.single else at + k))
        width = ends[1][1] + k
        rows, z = [], []
        for s, (a, b) in zip((self, other), ends):
            wide = np.zeros((len(s.r), width))
            wide[:, :n] = s.r[:, :n]
            wide[:, a : a + k] = s.r[:, n : n + k]
            if not s.single:
                wide[:, b : b + k] = s.r[:, n + k :]
            rows.append(wide)
            z.append(s.z)
        step = np.zeros((k, width))
        step[:, ends[0][1] : ends[0][1] + k] = -t.phi / t.process_std[:, None]
        step[:, ends[1][0] : ends[1][0] + k] = np.diag(1 / t.process_std)
        offset = self.offset + other.offset - 0.5 * k * _LOG2PI - float(np.log(t.process_std).sum())
        gone = [i for s, a in ((self, ends[0][1]), (other, ends[1][0])) if not s.single for i in range(a, a + k)]
        return _Segment(*integrated(np.vstack([*rows, step]), np.concatenate([*z, np.zeros(k)]), offset, gone), False)

    def closed(self, t: Transition) -> tuple[np.ndarray, np.ndarray, float]:
        """With the first state's prior, all states integrated out."""
        k = t.width
        n = self.r.shape[1] - (k if self.single else 2 * k)
        prior = np.zeros((k, self.r.shape[1]))
        prior[:, n : n + k] = np.diag(1 / t.initial_std)
        offset = self.offset - 0.5 * k * _LOG2PI - float(np.log(t.initial_std).sum())
        return integrated(np.vstack([self.r, prior]), np.concatenate([self.z, t.initial_mean / t.initial_std]), offset, range(n, self.r.shape[1]))


_OUT = "campaign string, point int, width int, r array<double>, z array<double>, log_offset double, n_observed long"
_SEGMENT = "campaign string, point int, first long, single boolean, width int, r array<double>, z array<double>, log_offset double, n_observed long"


def _reduced(batches, transitions: list[Transition], close: bool):
    """Rows sorted by campaign, point and first: each run of a campaign becomes one segment, or, to close, one factor over theta."""
    at, held = None, []

    def out():
        rows = []
        for point, (first, segment, n) in held:
            r, z, offset = segment.closed(transitions[point]) if close else (segment.r, segment.z, segment.offset)
            rows.append({"campaign": at[0], "point": point, "first": first, "single": segment.single, "width": r.shape[1], "r": r.ravel().tolist(), "z": z.tolist(), "log_offset": offset, "n_observed": n})
        frame = pd.DataFrame(rows)
        return frame.drop(columns=["first", "single"]) if close else frame

    for b in batches:
        for row in b.itertuples(index=False):
            r = np.asarray(row.r, float)
            segment = _Segment(r.reshape(-1, row.width), np.asarray(row.z, float), row.log_offset, row.single)
            points = range(len(transitions)) if row.point < 0 else [row.point]
            if at != (row.campaign, row.point):
                if held:
                    yield out()
                at, held = (row.campaign, row.point), [(p, (row.first, segment, row.n_observed)) for p in points]
            else:
                held = [(p, (first, s.then(segment, transitions[p]), n + row.n_observed)) for p, (first, s, n) in held]
    if held:
        yield out()


def chain_marginal(epochs: DataFrame, transitions: Transition | Sequence[Transition]) -> DataFrame:
    """campaign, point and a factor over theta, the states integrated out; one row for each campaign and transition.

    epochs: campaign, seq and the columns of evidence.DDL; seq orders a campaign's epochs and comes once in each.
    """
    many = [transitions] if isinstance(transitions, Transition) else list(transitions)
    if len({t.width for t in many}) != 1:
        raise ParameterError("transitions of one chain are of one width")
    rows = epochs.select(F.col("campaign").cast("string"), F.lit(-1).alias("point"), F.col("seq").cast("long").alias("first"), F.lit(True).alias("single"), "width", "r", "z", "log_offset", "n_observed")
    order = ["campaign", "point", "first"]
    some = rows.repartitionByRange("campaign", "first").sortWithinPartitions(*order).mapInPandas(lambda b: _reduced(b, many, False), _SEGMENT)
    return some.repartition("campaign", "point").sortWithinPartitions(*order).mapInPandas(lambda b: _reduced(b, many, True), _OUT)


def chain_log_likelihood(epochs: DataFrame, transition: Transition, theta: Sequence[float]) -> float:
    """Of all campaigns together, at one theta."""
    return sum(log_likelihood(f, theta) for f in chain_marginal(epochs, transition).toLocalIterator())


#: Steps of a chain that a task takes in order at a time.
RANGE = 4096


@dataclass
class _Info:
    """What a run of steps tells of its first and its last state, as blocks of an information matrix and vector; of one step, these are one state."""

    ff: np.ndarray
    fl: np.ndarray | None
    ll: np.ndarray | None
    hf: np.ndarray
    hl: np.ndarray | None

    def then(self, j, h, t: Transition) -> _Info:
        """And one more step, with information j, h on its own state."""
        q = np.diag(t.process_std**-2.0)
        pull = t.phi.T @ q
        if self.fl is None:
            return _Info(self.ff + pull @ t.phi, -pull, q + j, self.hf, h)
        inner = np.linalg.inv(self.ll + pull @ t.phi)
        gain = self.fl @ inner
        return _Info(self.ff - gain @ self.fl.T, gain @ pull, q + j - pull.T @ inner @ pull, self.hf - gain @ self.hl, h + pull.T @ inner @ self.hl)

    def ahead(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the last state, of those of the first before any of these data."""
        p = np.linalg.inv(cov)
        j, h = self.ff + p, self.hf + p @ mean
        if self.fl is not None:
            gain = self.fl.T @ np.linalg.inv(j)
            j, h = self.ll - gain @ self.fl, self.hl - gain @ h
        cov = np.linalg.inv(j)
        return cov @ h, cov

    def back(self, j: np.ndarray, h: np.ndarray, t: Transition) -> tuple[np.ndarray, np.ndarray]:
        """Information on the state before the first, of what later steps tell of the last."""
        if self.fl is None:
            jf, hf = self.ff + j, self.hf + h
        else:
            gain = self.fl @ np.linalg.inv(self.ll + j)
            jf, hf = self.ff - gain @ self.fl.T, self.hf - gain @ (self.hl + h)
        q = np.diag(t.process_std**-2.0)
        gain = t.phi.T @ q @ np.linalg.inv(q + jf)
        return t.phi.T @ q @ t.phi - gain @ q @ t.phi, gain @ hf

    def flat(self) -> list[float]:
        parts = [self.ff, self.hf] if self.fl is None else [self.ff, self.fl, self.ll, self.hf, self.hl]
        return np.concatenate([x.ravel() for x in parts]).tolist()

    @staticmethod
    def of(x: np.ndarray, k: int) -> _Info:
        if len(x) == k * k + k:
            return _Info(x[: k * k].reshape(k, k), None, None, x[k * k :], None)
        ff, fl, ll = x[: 3 * k * k].reshape(3, k, k)
        return _Info(ff, fl, ll, x[3 * k * k : -k], x[-k:])


def _scalar_runs(j: np.ndarray, h: np.ndarray, t: Transition) -> list[float]:
    """A run of steps of a state of one number: what folding them one by one into an _Info gives, as plain numbers."""
    phi, q = float(t.phi[0, 0]), float(t.process_std[0]) ** -2
    pull = phi * q
    j, h = j.tolist(), h.tolist()
    if len(j) == 1:
        return [j[0], h[0]]
    ff, fl, ll, hf, hl = j[0] + pull * phi, -pull, q + j[1], h[0], h[1]
    for a, b in zip(j[2:], h[2:]):
        m = ll + pull * phi
        ff, fl, ll, hf, hl = ff - fl * fl / m, fl * pull / m, q + a - pull * pull / m, hf - fl * hl / m, b + pull * hl / m
    return [ff, fl, ll, hf, hl]


def _cut(batches, by: str, order: str, t: Transition):
    """Rows sorted by series and order: numbers of their ranges, and after each range a row of what it tells."""
    from pyspark import TaskContext

    base, number, held = TaskContext.get().partitionId() << 40, 0, None
    k = t.width

    def told(part: pd.DataFrame) -> pd.DataFrame:
        j, h = (np.array(part[c].tolist(), float) for c in ("j", "h"))
        if k == 1:
            flat = _scalar_runs(j[:, 0], h[:, 0], t)
        else:
            info = _Info(j[0].reshape(k, k), None, None, h[0], None)
            for x, y in zip(j[1:], h[1:]):
                info = info.then(x.reshape(k, k), y, t)
            flat = info.flat()
        return pd.DataFrame({by: part[by].iloc[:1], order: part[order].iloc[:1], "range": part["range"].iloc[:1], "j": [flat], "h": [[]], "whole": True})

    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        held = None
        if not len(b):
            continue
        same = (b[by] == b[by].shift()) | (b[by].isna() & b[by].shift().isna())
        same.iloc[0] = False
        starts = np.flatnonzero(~same.to_numpy())
        for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(b)])):
            for s in range(a, z, RANGE):
                part = b.iloc[s : min(z, s + RANGE)]
                if i == len(starts) - 1 and s + RANGE >= z:
                    held = part  # it may go on
                    break
                part = part.assign(range=base + number, whole=False)
                number += 1
                yield part
                yield told(part)
    if held is not None:
        part = held.assign(range=base + number, whole=False)
        yield part
        yield told(part)


def _messages(batches, by: str, t: Transition, smooth: bool):
    """What each range tells, sorted by series and order: for each range the belief in its first state from what came before (j: mean and covariance), and
    what comes after tells of its last (h: information), if asked."""
    k, at, held = t.width, None, []

    def out() -> pd.DataFrame:
        infos = [_Info.of(np.asarray(r["j"], float), k) for r in held]
        mean, cov, before = t.initial_mean, np.diag(t.initial_std**2), []
        for info in infos:
            before.append(np.concatenate([mean, cov.ravel()]).tolist())
            mean, cov = info.ahead(mean, cov)
            mean, cov = t.phi @ mean, t.phi @ cov @ t.phi.T + np.diag(t.process_std**2)
        j, h, after = np.zeros((k, k)), np.zeros(k), []
        for info in reversed(infos) if smooth else ():
            after.append(np.concatenate([j.ravel(), h]).tolist())
            j, h = info.back(j, h, t)
        return pd.DataFrame({"range": [r["range"] for r in held], "j": before, "h": after[::-1] if smooth else [[]] * len(held)})

    for b in batches:
        for row in b.to_dict("records"):
            now = None if pd.isna(row[by]) else row[by]
            if held and now != at:
                yield out()
                held = []
            at = now
            held.append(row)
    if held:
        yield out()


def _scalar_states(j, h, mean, cov, last, t: Transition, smooth: bool):
    phi, q = float(t.phi[0, 0]), float(t.process_std[0]) ** 2
    m, v, ahead, seen = float(mean[0]), float(cov[0, 0]), [], []
    for i, (a, b) in enumerate(zip(j[:, 0].tolist(), h[:, 0].tolist())):
        if i:
            m, v = phi * m, phi * phi * v + q
        ahead.append((m, v))
        m, v = (m + v * b) / (1 + v * a), v / (1 + v * a)
        seen.append((m, v))
    if smooth:
        a, b = float(last[0][0, 0]), float(last[1][0])
        seen[-1] = m, v = (m + v * b) / (1 + v * a), v / (1 + v * a)
        for i in range(len(seen) - 2, -1, -1):
            x, s = seen[i]
            g = phi * s / ahead[i + 1][1]
            m, v = x + g * (m - ahead[i + 1][0]), s + g * g * (v - ahead[i + 1][1])
            seen[i] = m, v
    return [[m] for m, _ in seen], [[v] for _, v in seen]


def _vector_states(j, h, mean, cov, last, t: Transition, smooth: bool):
    k, ahead, seen = t.width, [], []
    for i, (a, b) in enumerate(zip(j.reshape(-1, k, k), h)):
        if i:
            mean, cov = t.phi @ mean, t.phi @ cov @ t.phi.T + np.diag(t.process_std**2)
        ahead.append((mean, cov))
        new = np.linalg.solve(np.eye(k) + cov @ a, cov)
        mean, cov = mean + new @ (b - a @ mean), (new + new.T) / 2
        seen.append((mean, cov))
    if smooth:
        mean, cov = seen[-1]
        new = np.linalg.solve(np.eye(k) + cov @ last[0], cov)
        seen[-1] = mean + new @ (last[1] - last[0] @ mean), (new + new.T) / 2
        for i in range(len(seen) - 2, -1, -1):
            (m, s), (am, ac), (nm, nc) = seen[i], ahead[i + 1], seen[i + 1]
            back = np.linalg.solve(ac, t.phi @ s).T
            seen[i] = m + back @ (nm - am), s + back @ (nc - ac) @ back.T
    return [m.tolist() for m, _ in seen], [np.diag(c).tolist() for _, c in seen]


def _within(batches, by: str, order: str, t: Transition, smooth: bool):
    """Rows sorted by range, a range's messages first: the states of its steps."""
    k, at, held = t.width, None, []

    def out() -> pd.DataFrame:
        part = pd.concat(held)
        first, steps = part.iloc[0], part.iloc[1:]
        x, y = np.asarray(first["j"], float), np.asarray(first["h"], float)
        j, h = (np.array(steps[c].tolist(), float) for c in ("j", "h"))
        last = (y[: k * k].reshape(k, k), y[k * k :]) if smooth else None
        mean, var = (_scalar_states if k == 1 else _vector_states)(j, h, x[:k], x[k:].reshape(k, k), last, t, smooth)
        return pd.DataFrame({by: steps[by].to_numpy(), order: steps[order].to_numpy(), "mean": mean, "var": var})

    for b in batches:
        for r, part in b.groupby("range", sort=False):
            if held and r != at:
                yield out()
                held = []
            at = r
            held.append(part)
    if held:
        yield out()


def states(steps: DataFrame, by: str, order: str, transition: Transition, smooth: bool) -> DataFrame:
    """by, order, mean, var of each step's state, given the data of its series so far or, smoothed, all of them.

    steps: by, order, j and h: information matrix (row by row) and vector of the step's data on its state; zeros where it has none. Series are cut into ranges of at most
    RANGE steps. What each range tells of its first and last state is one row; these meet by series, once forward and once back, and every range is then
    solved by itself. So a series of any length is many tasks' work. Orders of a series come once.
    """
    spark, t = steps.sparkSession, transition
    types = {c: steps.schema[c].dataType.simpleString() for c in (by, order)}
    keys = f"{by} {types[by]}, {order} {types[order]}"
    with stage(spark) as keep:
        rows = steps.select(by, order, "j", "h").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, order).sortWithinPartitions(by, order)
        cut = keep(rows.mapInPandas(lambda b: _cut(b, by, order, t), f"{keys}, j array<double>, h array<double>, range long, whole boolean"))
        told = cut.where("whole").repartition(by).sortWithinPartitions(by, order)
        messages = told.select(by, "range", "j").mapInPandas(lambda b: _messages(b, by, t, smooth), "range long, j array<double>, h array<double>")
        both = cut.where("not whole").select(by, order, "range", F.lit(1).alias("kind"), "j", "h").unionByName(messages.withColumn("kind", F.lit(0)), True)
        found = both.repartition("range").sortWithinPartitions("range", "kind", order).mapInPandas(lambda b: _within(b, by, order, t, smooth), f"{keys}, mean array<double>, var array<double>")
        return Stage(spark)(found)


def smooth(epochs: DataFrame, transition: Transition, theta: Sequence[float]) -> DataFrame:
    """campaign, seq, mean, var: each epoch's state given theta and all data of its campaign; see states()."""
    theta, k = np.asarray(theta, float), transition.width
    n = len(theta)

    def given(batches):
        for b in batches:
            j, h = [], []
            for width, r, z in zip(b["width"], b["r"], b["z"]):
                r, z = np.asarray(r, float).reshape(-1, width), np.asarray(z, float)
                a = r[:, n : n + k]
                j.append((a.T @ a).ravel().tolist())
                h.append((a.T @ (z - r[:, :n] @ theta)).tolist())
            yield pd.DataFrame({"campaign": b["campaign"], "seq": b["seq"], "j": j, "h": h})

    slim = epochs.select(F.col("campaign").cast("string").alias("campaign"), F.col("seq").cast("long").alias("seq"), "width", "r", "z")
    return states(slim.mapInPandas(given, "campaign string, seq long, j array<double>, h array<double>"), "campaign", "seq", transition, True)


class ChainMemory:
    """A campaign's ordered epochs: (seq, columns of evidence.DDL) over names and a state of the transition's width."""

    def __init__(self, epochs: DataFrame, names: Sequence[str], transition: Transition | HyperTransition, prior_std=None, prior_mean=0.0):
        if twice := epochs.groupBy("seq").count().where("count > 1").head():
            raise ParameterError(f"epoch {twice[0]} comes {twice[1]} times")
        self.epochs = epochs if "campaign" in epochs.columns else epochs.withColumn("campaign", F.lit("all"))
        self.names, self.transition, self.prior_std, self.prior_mean = list(names), transition, prior_std, prior_mean

    def remember(self, epochs: DataFrame) -> ChainMemory:
        new = epochs if "campaign" in epochs.columns else epochs.withColumn("campaign", F.lit("all"))
        return ChainMemory(self.epochs.unionByName(new), self.names, self.transition, self.prior_std, self.prior_mean)

    def _at(self, theta) -> Transition:
        return self.transition.at(self.names, theta) if isinstance(self.transition, HyperTransition) else self.transition

    def marginal(self, theta: Sequence[float] | None = None) -> dict:
        """The factor over the names, as one row; theta is needed where the transition depends on it."""
        if theta is None and isinstance(self.transition, HyperTransition):
            raise ParameterError("a transition that depends on the unknowns needs their values")
        return chain_marginal(self.epochs, self._at(theta)).first().asDict()

    def log_likelihoods(self, thetas: Sequence[Sequence[float]]) -> list[float]:
        """At several points, by one job."""
        found = chain_marginal(self.epochs, [self._at(t) for t in thetas]).collect()  # a row for each point
        return [sum(log_likelihood(f, t) for f in found if f["point"] == i) for i, t in enumerate(thetas)]

    def log_posterior(self, theta: Sequence[float]) -> float:
        log = self.log_likelihoods([theta])[0]
        if self.prior_std is not None:
            std, mean = (np.broadcast_to(np.asarray(x, float), len(self.names)) for x in (self.prior_std, self.prior_mean))
            log += float((-0.5 * ((np.asarray(theta) - mean) / std) ** 2 - np.log(std) - 0.5 * _LOG2PI).sum())
        return log

    def fisher(self, theta: Sequence[float] | None = None) -> np.ndarray:
        r, _, _ = matrices(self.marginal(theta))
        return r.T @ r

    def posterior(self, theta: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        r, z, _ = matrices(self.marginal(theta))
        mean, inverse = solved(r, z, self.prior_std, self.prior_mean)
        return mean, inverse @ inverse.T


def kalman(series: DataFrame, by: str, order: str, value: str, phi: float, q: float, s0: float, sigma: float, smooth: bool = False) -> DataFrame:
    """by, order, mean, var: the state of a scalar chain along each series. Filtered on the values so far, or, smoothed, on all; see states().

    A null or NaN value moves the state on without data. Orders of a series come once.
    """
    x = F.col(value).cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    steps = series.select(by, order, F.array(F.when(known, 1 / sigma**2).otherwise(0.0)).alias("j"), F.array(F.when(known, x / sigma**2).otherwise(0.0)).alias("h"))
    found = states(steps, by, order, Transition.of(phi, q, s0), smooth)
    return found.select(by, order, F.col("mean")[0].alias("mean"), F.col("var")[0].alias("var"))
