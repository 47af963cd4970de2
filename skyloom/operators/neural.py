"""A neural posterior: the density of the unknowns given data, learnt from simulated pairs that stay with the executors.

Each step, tasks sum gradients of their share of a minibatch and the driver moves the weights: data in parallel, of which only sums as long as
the weights leave a partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.operators.base import KEYS


def packed(pairs: DataFrame) -> DataFrame:
    """draw_id, theta, x: a row for each draw of simulate_pairs, its cells in order."""
    x = F.transform(F.array_sort(F.collect_list(F.struct(*KEYS, "data"))), lambda c: c["data"])
    return pairs.groupBy("draw_id").agg(F.first("theta").alias("theta"), x.alias("x"))


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


@dataclass
class NeuralPosterior:
    """A mixture of diagonal Gaussians of theta whose weights, means and spreads a tanh network gives for data x, both standardised."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    n_components: int
    theta_mean: np.ndarray
    theta_std: np.ndarray
    x_mean: np.ndarray
    x_std: np.ndarray

    @staticmethod
    def create(theta_mean, theta_std, x_mean, x_std, hidden: tuple[int, ...] = (32, 32), n_components: int = 4, seed: int = 0) -> NeuralPosterior:
        if n_components < 1 or min(hidden, default=1) < 1:
            raise ParameterError("a mixture has components, and a layer units")
        rng, d = np.random.default_rng(seed), len(theta_mean)
        sizes = [len(x_mean), *hidden, n_components * (1 + 2 * d)]
        layers = [(rng.normal(size=(a, b)) / a**0.5, np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        layers[-1][1][:] = rng.normal(size=sizes[-1]) * 0.3  # components start apart
        return NeuralPosterior(layers, n_components, *(np.asarray(v, float) for v in (theta_mean, theta_std, x_mean, x_std)))

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for layer in self.layers for v in layer])

    def with_flat(self, values: np.ndarray) -> NeuralPosterior:
        out, at = [], 0
        for w, b in self.layers:
            out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return NeuralPosterior(out, self.n_components, self.theta_mean, self.theta_std, self.x_mean, self.x_std)

    def _forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        h = [(x - self.x_mean) / self.x_std]
        for w, b in self.layers[:-1]:
            h.append(np.tanh(h[-1] @ w + b))
        out = h[-1] @ self.layers[-1][0] + self.layers[-1][1]
        k, d = self.n_components, len(self.theta_mean)
        return h, out[:, :k], out[:, k : k + k * d].reshape(-1, k, d), np.clip(out[:, k + k * d :].reshape(-1, k, d), -7, 7)

    def log_prob(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each row of theta given the same row of x."""
        _, a, mean, s = self._forward(np.atleast_2d(x))
        each = self._each(np.atleast_2d(theta), mean, s)
        return _log_sum(a - _log_sum(a)[:, None] + each) - np.log(self.theta_std).sum()

    def _each(self, theta, mean, s):
        t = ((theta - self.theta_mean) / self.theta_std)[:, None, :]
        return -0.5 * (((t - mean) / np.exp(s)) ** 2).sum(axis=2) - s.sum(axis=2) - 0.5 * len(self.theta_mean) * np.log(2 * np.pi)

    def gradient(self, theta: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The summed negative log density of standardised theta and its gradient by the weights."""
        h, a, mean, s = self._forward(x)
        t = ((theta - self.theta_mean) / self.theta_std)[:, None, :]
        total = a - _log_sum(a)[:, None] + self._each(theta, mean, s)
        loss = _log_sum(total)
        share, prior = np.exp(total - loss[:, None]), np.exp(a - _log_sum(a)[:, None])
        gap = (t - mean) / np.exp(s)
        free = (np.abs(s) < 7).astype(float)
        back = np.concatenate([prior - share, (-share[:, :, None] * gap / np.exp(s)).reshape(len(x), -1), (share[:, :, None] * (1 - gap**2) * free).reshape(len(x), -1)], axis=1)
        parts = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts.append(np.concatenate([(h[i].T @ back).ravel(), back.sum(axis=0)]))
            if i:
                back = (back @ self.layers[i][0].T) * (1 - h[i] ** 2)
        return -float(loss.sum()), np.concatenate(parts[::-1])

    def sample(self, x: np.ndarray, n: int, seed: int) -> np.ndarray:
        """n draws of theta for one x."""
        rng = np.random.default_rng(seed)
        _, a, mean, s = self._forward(np.atleast_2d(x))
        which = rng.choice(self.n_components, n, p=np.exp(a[0] - _log_sum(a)[0]))
        return self.theta_mean + self.theta_std * (mean[0][which] + np.exp(s[0][which]) * rng.normal(size=(n, len(self.theta_mean))))


@dataclass
class History:
    """Mean losses: of each step's minibatch, and of the held-out rows after some steps."""

    train: list[float] = field(default_factory=list)
    held_out: list[tuple[int, float]] = field(default_factory=list)


_SUMS = "n long, loss double, gradient array<double>"


def _sums(rows: DataFrame, posterior: NeuralPosterior) -> tuple[int, float, np.ndarray]:
    """Rows, summed loss and summed gradient; a partition sends one row."""

    def of(batches):
        n, loss, total = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                theta, x = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("theta", "x"))
                one, g = posterior.gradient(theta, x)
                n, loss, total = n + b.num_rows, loss + one, total + g
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "gradient": [total.tolist()]}, schema=pa.schema([("n", pa.int64()), ("loss", pa.float64()), ("gradient", pa.list_(pa.float64()))]))

    found = rows.select("theta", "x").mapInArrow(of, _SUMS).collect()  # a row for each partition
    if not found:
        return 0, 0.0, np.zeros(len(posterior.flat))
    return sum(r.n for r in found), sum(r.loss for r in found), np.sum([r.gradient for r in found], axis=0)


def train_posterior(pairs: DataFrame, hidden: tuple[int, ...] = (32, 32), n_components: int = 4, n_steps: int = 200, batch: float = 1.0, learning_rate: float = 0.01, held_out: float = 0.1, every: int = 20, seed: int = 0) -> tuple[NeuralPosterior, History]:
    """Of packed pairs (draw_id, theta, x). batch: the share of rows of a step, drawn by a hash of draw and step; held_out: the share of rows
    that only judge; the weights that do best on them are returned."""
    pairs = pairs.persist()
    lot = lambda salt: F.pmod(F.xxhash64("draw_id", F.lit(salt)), F.lit(10_000)) / 10_000
    means = lambda c: pairs.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    theta, x = means("theta"), means("x")  # a row for each number of a pair
    if not theta or not x:
        raise ParameterError("no pair to learn from")
    flat = lambda rows: ([r.m for r in rows], [r.s if r.s and r.s > 0 else 1.0 for r in rows])
    posterior = NeuralPosterior.create(*flat(theta), *flat(x), hidden, n_components, seed)
    judged, learnt = pairs.where(lot(seed) < held_out), pairs.where(lot(seed) >= held_out)
    weights, m, v, history, best = posterior.flat, 0.0, 0.0, History(), (np.inf, posterior)
    for step in range(1, n_steps + 1):
        some = learnt if batch >= 1 else learnt.where(lot(seed + step) < batch)
        n, loss, gradient = _sums(some, posterior)
        if not n:
            continue
        if not np.isfinite(loss):
            raise ParameterError(f"the loss isn't finite at step {step}")
        history.train.append(loss / n)
        g = gradient / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        posterior = posterior.with_flat(weights)
        if step % every == 0 or step == n_steps:
            k, held, _ = _sums(judged, posterior)
            score = held / k if k else history.train[-1]
            history.held_out.append((step, score))
            if score < best[0]:
                best = (score, posterior)
    pairs.unpersist()
    return best[1], history
