"""Linear blocks too wide for a triangle: conjugate gradients whose vectors are tables.

A design is a table of its entries (cell, unknown, a), or of rows that hold a cell's entries each. A few unknowns may stand in a large share of the entries: their part of
a vector is with the driver, and each other unknown's row holds its products with them. Cells with at most one unknown besides those are
summed once and for all; the normal operator of the others is two joins: of a vector with their entries, summed by cell, and of that, summed by
unknown. What the driver sees of a turn is a few sums for each draw; unknowns and cells may be of any number. Draws are solutions of right sides that
hold noise of the data's and the prior's spread, drawn from hashes of seed and keys; all are solved by the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import finite
from skyloom.functions.random import normal
from skyloom.sources.stage import Stage, stage

#: The draw that is the posterior's mean.
MEAN = 0
#: Unknowns that stand in a larger share of the entries are frequent (so there are few of them); right sides that a row sums at once.
_SHARE, _SIDES = 1 / 16, 4


def _said(names: list, c: str | Column = "unknown") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isin(names) if names else F.lit(False)


class _Block:
    """What both forms of a block share. _listed: the unknown of each entry. _terms: (unknown, a, f0.., many, and what `noisy` makes of cell and y) of what counts, a row for
    each cell and unknown; a and y in units of sigma, f0..: the cell's coefficients of the frequent unknowns, many: whether it has more than one besides them."""

    prior: DataFrame

    def _listed(self) -> DataFrame:
        raise NotImplementedError

    def _terms(self, frequent: list, absent: list, noisy: Callable[[DataFrame], DataFrame]) -> DataFrame:
        raise NotImplementedError

    def _unknowns(self) -> DataFrame:
        """(unknown, mean, precision)."""
        std = F.col("std").cast("double")
        told = std.isNotNull() & ~F.isnan(std) & (std < float("inf"))
        precision = F.when(told & (std > 0), 1 / (std * std)).when(told, F.raise_error(F.lit("a prior's std must be above zero")).cast("double")).otherwise(0.0)
        return self.prior.select("unknown", F.coalesce(F.col("mean").cast("double"), F.lit(0.0)).alias("mean"), precision.alias("precision"))


@dataclass(frozen=True)
class WideBlock(_Block):
    """entries: cell, unknown, a; cells: cell, y, sigma; prior: unknown, mean, std.

    A cell's key is its own; entries of the same cell and unknown add up. Cells without a finite y and a finite sigma above zero tell nothing; unknowns without a
    finite std have no prior, and those with no row in prior don't take part. Every unknown is told by data or by its prior, or the solution is refused.
    """

    entries: DataFrame
    cells: DataFrame
    prior: DataFrame

    def _listed(self):
        return self.entries.select("unknown")

    def _terms(self, frequent, absent, noisy):
        cells = self.cells.select("cell", F.col("y").cast("double").alias("y"), F.col("sigma").cast("double").alias("sigma"))
        cells = cells.where(finite(F.col("y")) & finite(F.col("sigma")) & (F.col("sigma") > 0))
        entries = self.entries.where(F.col("unknown").isNotNull() & ~_said(absent)).select("cell", "unknown", F.col("a").cast("double").alias("a"))
        # dealt by cell at once, for the sums, the windows and the join alike
        entries = entries.repartition("cell").groupBy("cell", "unknown").agg(F.sum("a").alias("a")).where("a <> 0")
        cell = Window.partitionBy("cell")
        other = F.when(~_said(frequent), F.col("unknown"))
        many = F.coalesce(F.min(other).over(cell) < F.max(other).over(cell), F.lit(False)).alias("many")
        shared = (F.coalesce(F.sum(F.when(F.col("unknown") == F.lit(u), F.col("a"))).over(cell), F.lit(0.0)).alias(f"f{j}") for j, u in enumerate(frequent))
        met = entries.select("*", many, *shared).join(noisy(cells.withColumn("y", F.col("y") / F.col("sigma"))), "cell")
        for c in ["a", *(f"f{j}" for j in range(len(frequent)))]:
            met = met.withColumn(c, F.col(c) / F.col("sigma"))
        return met


@dataclass(frozen=True)
class WideRows(_Block):
    """The same block from rows that each hold a whole cell: cell, y, sigma, entries (an array of unknown and a); so that no cell has to be put together.

    A cell's key serves its noise, and must be its own where cells have two or more unknowns that aren't frequent.
    """

    rows: DataFrame
    prior: DataFrame

    def _listed(self):
        return self.rows.select(F.explode("entries").alias("e")).select("e.unknown")

    def _terms(self, frequent, absent, noisy):
        entries = F.filter("entries", lambda e: e["unknown"].isNotNull() & e["a"].isNotNull() & ~_said(absent, e["unknown"]))
        entries = F.transform(entries, lambda e: F.struct(e["unknown"].alias("unknown"), e["a"].cast("double").alias("a")))
        y, sigma = F.col("y").cast("double"), F.col("sigma").cast("double")
        rows = self.rows.where(finite(y) & finite(sigma) & (sigma > 0)).select("cell", (y / sigma).alias("y"), sigma.alias("sigma"), entries.alias("entries"))
        total = lambda u: F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.when(e["unknown"] == u, e["a"]).otherwise(0.0))
        names = F.array_distinct(F.transform("entries", lambda e: e["unknown"]))
        added = F.transform(names, lambda u: F.struct(u.alias("unknown"), total(u).alias("a")))
        rows = rows.withColumn("entries", F.when(F.size(names) == F.size("entries"), F.col("entries")).otherwise(added))
        rows = rows.withColumn("entries", F.filter("entries", lambda e: e["a"] != 0))
        shared = ((total(F.lit(u)) / F.col("sigma")).alias(f"f{j}") for j, u in enumerate(frequent))
        rows = noisy(rows.select("*", (F.size(F.filter("entries", lambda e: ~_said(frequent, e["unknown"]))) > 1).alias("many"), *shared))
        rows = rows.select("*", F.explode("entries").alias("e"))
        return rows.select("*", F.col("e.unknown").alias("unknown"), (F.col("e.a") / F.col("sigma")).alias("a")).drop("e", "entries")


@dataclass(frozen=True)
class WideSolution:
    """values: draw (0: the mean), unknown, value. residuals: relative ones of the system with unit diagonal, by draw; condition: that system's, from the
    Ritz values of the turns; error: condition times the largest residual, a bound of the relative error in the same norm."""

    values: DataFrame
    residuals: tuple[float, ...]
    turns: int
    condition: float

    @property
    def error(self) -> float:
        return self.condition * max(self.residuals)


def _apply(entries: DataFrame, vector: DataFrame, column: str) -> DataFrame:
    """(draw, unknown, q): the data's share of the normal operator on the vector."""
    by_cell = entries.join(vector.select("draw", "unknown", F.col(column).alias("_p")), "unknown").groupBy("draw", "cell").agg(F.sum(F.col("a") * F.col("_p")).alias("_t"))
    return by_cell.join(entries, "cell").groupBy("draw", "unknown").agg(F.sum(F.col("a") * F.col("_t")).alias("q"))


def _sums(df: DataFrame, draws: int, **columns: Column) -> dict[str, np.ndarray]:
    """Sums by draw, one row each."""
    out = {name: np.zeros(draws) for name in columns}
    for r in df.groupBy("draw").agg(*(F.sum(c).alias(n) for n, c in columns.items())).collect():
        for name in columns:
            out[name][r["draw"]] = r[name]
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


class _System:
    """The normal operator. rows: draw, unknown, mean, precision, d (the diagonal), own (what cells summed for good give it), f0.. (products with the frequent unknowns),
    b (the right side, relative to the prior's mean), for all but the frequent unknowns; `at` holds the same of those, by draw and place."""

    def __init__(self, block: _Block, keep: Stage, draws: int, seed: int):
        self.draws = draws
        listed = block._listed().where(F.col("unknown").isNotNull()).stat.freqItems(["unknown"], _SHARE).first()[0] or []
        self.frequent = sorted(r[0] for r in block.prior.where(_said(listed)).select("unknown").distinct().collect())  # a few at most
        absent = [u for u in listed if u not in self.frequent]
        self.shared = [f"f{j}" for j in range(len(self.frequent))]
        side = min(draws, _SIDES)
        blocks = -(-draws // side)
        noise = lambda draw, name, *keys: F.when(draw == MEAN, 0.0).otherwise(normal(seed, name, draw, *keys))

        def noisy(cells: DataFrame) -> DataFrame:
            part = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
            cells = cells.withColumn("_part", part)
            at = [(F.col("_part") * side + k if blocks > 1 else F.lit(k)) for k in range(side)]
            return cells.select("*", *((F.col("y") + noise(draw, "data", "cell")).alias(f"y{k}") for k, draw in enumerate(at))).drop("y")

        terms = block._terms(self.frequent, absent, noisy)
        a, keys = F.col("a"), ["unknown", "_part"] if blocks > 1 else ["unknown"]
        sums = {"_d": a * a, "own": F.when(~F.col("many"), a * a).otherwise(0.0)} | {f: a * F.col(f) for f in self.shared} | {f"y{k}": a * F.col(f"y{k}") for k in range(side)}
        right = terms.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        unknowns = block._unknowns()
        if blocks > 1:
            unknowns = unknowns.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        all_ = unknowns.join(right, keys, "left").fillna(0.0, list(sums))
        part = F.col("_part") * side if blocks > 1 else F.lit(0)
        sides = F.array(*(F.struct((part + k).alias("draw"), F.col(f"y{k}").alias("b")) for k in range(side)))
        all_ = all_.withColumn("_s", F.explode(sides)).where(F.col("_s.draw") < draws).select("*", "_s.draw", "_s.b")
        d = F.col("_d") + F.col("precision")
        told = F.when(d > 0, d).otherwise(F.raise_error(F.concat(F.lit("neither data nor a prior tell of "), F.col("unknown").cast("string"))).cast("double"))
        b = F.col("b") + F.sqrt("precision") * noise(F.col("draw"), "prior", "unknown")
        all_ = keep(all_.select("draw", "unknown", "mean", "precision", told.alias("d"), "own", *self.shared, b.alias("b")))
        self.entries = None
        if all_.where(~_said(self.frequent) & (F.col("d") > F.col("precision") + F.col("own"))).head():
            once = F.col("_part") == 0
            self.entries = keep(terms.where(F.col("many") & ~_said(self.frequent) & once).select("cell", "unknown", "a"))
        self.at = {c: np.zeros((draws, len(self.frequent))) for c in ("mean", "precision", "d", "b")}
        self.gram = np.zeros((len(self.frequent),) * 2)
        for r in all_.where(_said(self.frequent)).collect():  # a row for each frequent unknown and draw
            j = self.frequent.index(r["unknown"])
            for c, v in self.at.items():
                v[r["draw"], j] = r[c]
            self.gram[j] = [r[f] for f in self.shared]
        # the right side, less what the prior's means predict
        rows = self.times(all_.where(~_said(self.frequent)), "mean", self.at["mean"])
        self.at["b"] -= self.of_frequent(rows, "mean", self.at["mean"])
        rows = rows.withColumn("b", F.col("b") - F.col("q")).drop("q")
        self.rows = keep(rows) if self.entries is not None else rows

    def by_draw(self, values: np.ndarray) -> Column:
        return F.element_at(F.lit(np.ascontiguousarray(values, float)), F.col("draw") + 1)

    def times(self, rows: DataFrame, column: str, at: np.ndarray) -> DataFrame:
        """rows with q: the data's share of the operator on the vector that a column of rows and `at` make up."""
        q = F.col("own") * F.col(column)
        for j, f in enumerate(self.shared):
            q = q + F.col(f) * self.by_draw(at[:, j])
        if self.entries is None:
            return rows.withColumn("q", q)
        met = rows.join(_apply(self.entries, rows, column).withColumnRenamed("q", "_q"), ["draw", "unknown"], "left")
        return met.withColumn("q", q + F.coalesce("_q", F.lit(0.0))).drop("_q")

    def of_frequent(self, rows: DataFrame, column: str, at: np.ndarray, **more: Column):
        """The operator's share for the frequent unknowns; with more, also sums of other columns by draw."""
        found = _sums(rows, self.draws, **{f: F.col(f) * F.col(column) for f in self.shared}, **more) if self.shared or more else {}
        q = at @ self.gram.T
        for j, f in enumerate(self.shared):
            q[:, j] += found[f]
        return (q, *(found[m] for m in more)) if more else q

    def table(self, values: np.ndarray, like: DataFrame) -> DataFrame:
        """(draw, unknown, value) of the frequent unknowns."""
        draw, place = (x.ravel() for x in np.indices(values.shape))
        rows = pa.table({"draw": pa.array(draw, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(values.ravel(), pa.float64())})
        names = F.array(*(F.lit(u) for u in self.frequent))
        return like.sparkSession.createDataFrame(rows).select("draw", F.element_at(names, F.col("place") + 1).cast(like.schema["unknown"].dataType).alias("unknown"), "value")


def wide_solve(block: WideBlock | WideRows, draws: int = 0, seed: int = 0, tol: float = 1e-8, most: int = 500, require: float | None = 1e-3) -> WideSolution:
    """The posterior's mean, and `draws` draws of it, by conjugate gradients on the system scaled to a unit diagonal.

    Stops once every right side's relative residual is at most tol; refuses after `most` turns, and where the bound of the error is above `require`. A turn is one
    job whose result is written, and two small ones; it shuffles only where cells have two or more unknowns that aren't frequent.
    """
    spark, n = block.prior.sparkSession, draws + 1
    out = Stage(spark)
    with stage(spark) as keep:
        system = _System(block, keep, n, seed)
        at, d, precision = system.at, system.at["d"], system.at["precision"]
        bb = _sums(system.rows, n, bb=F.col("b") * F.col("b") / F.col("d"))["bb"] + (at["b"] ** 2 / d).sum(axis=1)
        state = system.rows.select("*", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p"))
        x, r, p = np.zeros_like(d), at["b"].copy(), at["b"] / d
        rz, steps, ratios, held = bb, [], [], len(keep.written)
        for turn in range(most + 1):
            residual = np.sqrt(_ratio(rz, bb))
            if residual.max(initial=0.0) <= tol:
                break
            if turn == most:
                raise ParameterError(f"no convergence in {most} turns: a residual of {residual.max():.1e}")
            now = keep(system.times(state, "p", p).withColumn("q", F.col("q") + F.col("precision") * F.col("p")))
            keep.keep_last(held)
            q, pq = system.of_frequent(now, "p", p, pq=F.col("p") * F.col("q"))
            q += precision * p
            alpha = _ratio(rz, pq + (p * q).sum(axis=1))
            r -= alpha[:, None] * q
            x += alpha[:, None] * p
            left = F.col("r") - system.by_draw(alpha) * F.col("q")
            new = _sums(now, n, rz=left * left / F.col("d"))["rz"] + (r**2 / d).sum(axis=1)
            beta = _ratio(new, rz)
            p = r / d + beta[:, None] * p
            state = now.withColumns({"x": F.col("x") + system.by_draw(alpha) * F.col("p"), "r": left, "p": left / F.col("d") + system.by_draw(beta) * F.col("p")}).drop("q")
            steps.append(alpha)
            ratios.append(beta)
            rz = new
        # the residual itself, not the turns' account of it
        end = system.times(state, "x", x)
        gap = F.col("b") - F.col("q") - F.col("precision") * F.col("x")
        q, gaps = system.of_frequent(end, "x", x, gap=gap * gap / F.col("d"))
        gaps = gaps + ((at["b"] - q - precision * x) ** 2 / d).sum(axis=1)
        values = state.select("draw", "unknown", (F.col("mean") + F.col("x")).alias("value"))
        values = out(values.unionByName(system.table(at["mean"] + x, values)) if system.frequent else values)
        residual = np.sqrt(_ratio(gaps, bb))
    found = WideSolution(values, tuple(map(float, residual)), len(steps), _ritz(steps, ratios))
    if require is not None and not found.error <= require:
        raise ParameterError(f"the error's bound is {found.error:.1e}: a condition of {found.condition:.1e} times a residual of {max(residual):.1e}")
    return found


def _ritz(steps: list[np.ndarray], ratios: list[np.ndarray]) -> float:
    """The condition that the turns of the right sides have seen: of the tridiagonal matrices that conjugate gradients build."""
    worst = 1.0
    for i in range(len(steps[0]) if steps else 0):
        a, b = ([x[i] for x in some] for some in (steps, ratios))
        k = next((j for j, x in enumerate(a) if not x > 0), len(a))
        if not k:
            continue
        diagonal = [1 / a[j] + (b[j - 1] / a[j - 1] if j else 0.0) for j in range(k)]
        beside = [np.sqrt(b[j]) / a[j] for j in range(k - 1)]
        e = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        worst = max(worst, float(e[-1] / max(e[0], 1e-300)))
    return worst


def extreme_eigenvalues(block: WideBlock | WideRows, turns: int = 30, seed: int = 0) -> tuple[float, float]:
    """Largest and smallest eigenvalue of the system with unit diagonal, by power iteration on it and on the largest less it: both from inside.

    The smallest is at least the least share that a prior has in a diagonal.
    """
    spark = block.prior.sparkSession
    with stage(spark) as keep:
        system = _System(block, keep, 1, seed)
        start, d, precision = system.rows, system.at["d"], system.at["precision"]
        held = len(keep.written)
        root = F.sqrt("d")
        shares = [start.agg(F.min(F.col("precision") / F.col("d"))).first()[0], *(precision / d).ravel()]
        least = float(min((x for x in shares if x is not None), default=0.0))

        def iterate(shift: float, name: str) -> float:
            v = start.withColumn("v", normal(seed, name, "unknown"))
            few = system.table(np.zeros_like(d), start).withColumn("v", normal(seed, name, "unknown")).collect() if system.frequent else []
            w = np.zeros_like(d)
            for r in few:
                w[0, system.frequent.index(r["unknown"])] = r["v"]
            size, found = np.sqrt(_sums(v, 1, s=F.col("v") * F.col("v"))["s"][0] + (w**2).sum()), 0.0
            for _ in range(turns):
                v, w = v.withColumn("v", F.col("v") / float(size)).withColumn("p", F.col("v") / root), w / size
                own = (system.of_frequent(v, "p", w / np.sqrt(d)) + precision * w / np.sqrt(d)) / np.sqrt(d)
                image = (F.col("q") + F.col("precision") * F.col("p")) / root
                image = (shift * F.col("v") - image) if shift else image
                v = keep(system.times(v, "p", w / np.sqrt(d)).withColumn("v", image).drop("p", "q"))
                w = shift * w - own if shift else own
                keep.keep_last(held)
                size = np.sqrt(_sums(v, 1, s=F.col("v") * F.col("v"))["s"][0] + (w**2).sum())
                found = float(size)
                if not size > 0:
                    break
            return found

        largest = iterate(0.0, "power")
        return largest, max(largest - iterate(largest, "shifted"), least)
