"""Evidence: the data of an epoch compressed to a square-root-information factor, and factors merged, in any order.

A factor (R, z, offset) stands for log L = offset - |R x - z|^2 / 2. Rows are first compressed within each partition, so that an epoch
of any size crosses the network as one small triangle a partition; the triangles of an epoch merge by running stacks, first in
parts and then whole, so that no task holds a list of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError

DDL = "epoch string, width int, r array<double>, z array<double>, log_offset double, n_observed long, corner double, dof long, templates map<string,double>"
_SCHEMA = pa.schema([
    ("epoch", pa.string()), ("width", pa.int32()), ("r", pa.list_(pa.float64())), ("z", pa.list_(pa.float64())), ("log_offset", pa.float64()),
    ("n_observed", pa.int64()), ("corner", pa.float64()), ("dof", pa.int64()), ("templates", pa.map_(pa.string(), pa.float64())),
])
_PART = "epoch string, side int, u array<double>, log_norm double, n long, corner double, dof long"
_PART_SCHEMA = pa.schema([("epoch", pa.string()), ("side", pa.int32()), ("u", pa.list_(pa.float64())), ("log_norm", pa.float64()), ("n", pa.int64()), ("corner", pa.float64()), ("dof", pa.int64())])
#: Rows that a task stacks before it compresses them, epochs that it holds open, and parts of an epoch that merge side by side.
_STACK, _OPEN, _PARTS = 8192, 1024, 64
_EPS = float(np.sqrt(np.finfo(float).eps))


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of a QR of the rows, filled with zeros."""
    side = rows.shape[1]
    out = np.zeros((side, side))
    if len(rows):
        u = np.triu(np.linalg.qr(rows, mode="r"))
        out[: len(u)] = u
    return out


def rank(r: np.ndarray) -> int:
    """Of a triangle with its columns scaled to length one."""
    length = np.linalg.norm(r, axis=0)
    s = np.linalg.svd(r / np.where(length > 0, length, 1.0), compute_uv=False)
    return int((s > 1e-10 * s.max(initial=0.0)).sum())


class _Stack:
    """Rows of one epoch on their way to one triangle."""

    def __init__(self, side: int):
        self.side, self.rows, self.held, self.log_norm, self.n, self.corner, self.dof = side, [], 0, 0.0, 0, 0.0, 0

    def add(self, rows: np.ndarray, log_norm: float, n: int, corner: float = 0.0, dof: int = 0) -> None:
        if rows.shape[1] != self.side:
            raise ParameterError(f"factors of widths {sorted({rows.shape[1] - 1, self.side - 1})} don't merge")
        self.rows.append(rows)
        self.held += len(rows)
        self.log_norm, self.n, self.corner, self.dof = self.log_norm + log_norm, self.n + n, self.corner + corner, self.dof + dof
        if self.held > _STACK:
            self.rows, self.held = [triangle(np.vstack(self.rows))], self.side

    def part(self, epoch: str) -> dict:
        u = triangle(np.vstack(self.rows)) if self.rows else np.zeros((self.side, self.side))
        return {"epoch": epoch, "side": self.side, "u": u.ravel(), "log_norm": self.log_norm, "n": self.n, "corner": self.corner, "dof": self.dof}


def _batch(parts: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(parts, _PART_SCHEMA)


def _running(batches) -> Iterator[pa.RecordBatch]:
    """Parts sorted by epoch: one part of each."""
    at, stack = None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if stack is None or row["epoch"] != at:
                if stack is not None:
                    out.append(stack.part(at))
                at, stack = row["epoch"], _Stack(row["side"])
            stack.add(np.reshape(row["u"], (-1, row["side"])), row["log_norm"], row["n"], row["corner"], row["dof"])
        if out:
            yield _batch(out)
    if stack is not None:
        yield _batch([stack.part(at)])


def _merged(parts: DataFrame) -> DataFrame:
    """One part for each epoch."""
    names = parts.columns
    dealt = parts.withColumn("_salt", F.spark_partition_id() % _PARTS).repartition("epoch", "_salt").sortWithinPartitions("epoch", "_salt")
    some = dealt.select(*names).mapInArrow(_running, _PART)
    return some.repartition("epoch").sortWithinPartitions("epoch").mapInArrow(_running, _PART)


def _arrays(columns: Sequence[str] | str) -> list[Column]:
    """A name is that of an array column; a list is of columns of numbers."""
    if isinstance(columns, str):
        return [F.col(columns).cast("array<double>")]
    return [F.array(*(F.col(c).cast("double") for c in columns))] if columns else []


def compress(
    rows: DataFrame, epoch: str, design: Sequence[str] | str, observed: str, sigma: str, *, nuisance: Sequence[str] | str = (),
    nuisance_std: float | Sequence[float] | None = None, nuisance_mean: float | Sequence[float] = 0.0, templates: Sequence[str] = (), offset: str | None = None, width: int | None = None,
) -> DataFrame:
    """A row of DDL for each epoch. Rows with null or infinite sigma count for nothing.

    design and nuisance: columns of numbers, or one column of arrays. Nuisances are integrated out under a normal prior. offset: what the
    model predicts at zero. corner is what design and nuisance leave of the data (chi2), dof the rows less their rank. templates: for
    each column the residual along it, in standard deviations; one that the design explains is refused. width: of a design in one
    column of arrays; where it isn't said, the first row is asked.
    """
    templates = list(templates)
    y = F.col(observed).cast("double") - (F.col(offset).cast("double") if offset else 0.0)
    row = F.concat(*_arrays(nuisance), *_arrays(design), *_arrays(templates), F.array(y))
    s = F.col(sigma).cast("double")
    counts = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    n_nuisance = _width(rows, nuisance)
    side = n_nuisance + (_width(rows, design) if width is None else width) + len(templates) + 1
    # an epoch whose rows all count for nothing is there too
    slim = rows.select(
        F.col(epoch).cast("string").alias("epoch"), F.when(counts, F.transform(row, lambda x: x / s)).alias("m"),
        F.when(counts, -0.5 * F.log(2 * np.pi * s * s)).alias("log_norm"),
    )

    def partial(batches):
        held: dict = {}
        for b in batches:
            codes = b.column("epoch").dictionary_encode()
            index, seen = codes.indices.to_numpy(zero_copy_only=False), b.column("m").is_valid().to_numpy(zero_copy_only=False)
            some = b.column("m").drop_null()
            m = some.flatten().to_numpy(zero_copy_only=False)
            if len(m) != len(some) * side:
                raise ParameterError("rows of unlike widths")
            m = m.reshape(-1, side)
            place, norm = np.cumsum(seen) - 1, b.column("log_norm").to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(index[order])) + 1) if len(order) else ():
                name = codes.dictionary[int(index[mine[0]])].as_py()
                mine = mine[seen[mine]]
                if name not in held:
                    held[name] = _Stack(side)
                held[name].add(m[place[mine]], float(norm[mine].sum()), len(mine))
            if len(held) > _OPEN:
                yield _batch([x.part(e) for e, x in held.items()])
                held = {}
        if held:
            yield _batch([x.part(e) for e, x in held.items()])

    std = None if nuisance_std is None else np.broadcast_to(np.asarray(nuisance_std, float), n_nuisance)
    if n_nuisance and (std is None or not (np.isfinite(std) & (std > 0)).all()):
        raise ParameterError("nuisances need a prior with standard deviations above zero")
    mean = np.broadcast_to(np.asarray(nuisance_mean, float), n_nuisance)

    def finish(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([_finished(x, n_nuisance, std, mean, templates) for x in b.to_pylist()], _SCHEMA)

    return _merged(slim.mapInArrow(partial, _PART)).mapInArrow(finish, DDL)


def _width(rows: DataFrame, columns: Sequence[str] | str) -> int:
    if not isinstance(columns, str):
        return len(columns)
    first = rows.where(F.col(columns).isNotNull()).select(F.size(columns)).head()
    return first[0] if first else 0


def _finished(part: dict, v: int, std: np.ndarray | None, mean: np.ndarray, templates: list[str]) -> dict:
    side = part["side"]
    u = np.reshape(part["u"], (side, side))
    q = side - 1 - len(templates)  # nuisances and design
    chi2 = float((u[q:, -1] ** 2).sum())
    found = None
    if templates:
        along = u[q : side - 1, q : side - 1]
        size = np.linalg.norm(along, axis=0)
        whole = np.linalg.norm(u[: side - 1, q : side - 1], axis=0)
        if (bad := [t for t, a, b in zip(templates, size, whole) if not a > 1e-8 * b]) and part["n"]:
            raise ParameterError(f"the design explains the templates {bad}")
        found = [(t, float(along[:, i] @ u[q : side - 1, -1] / size[i]) if size[i] else float("nan")) for i, t in enumerate(templates)]
    body = np.delete(u, np.arange(q, side - 1), axis=1)
    if v:
        prior = np.hstack([np.diag(1 / std), np.zeros((v, q - v)), (mean / std)[:, None]])
        body = np.vstack([prior, body])
    t = triangle(body)
    corner, pivots = float(t[q, q] ** 2), np.abs(np.diag(t)[:v])
    offset = part["log_norm"] - corner / 2 - (float(np.log(std).sum() + np.log(pivots).sum()) if v else 0.0)
    r = t[v:q, v:q]
    return {"epoch": part["epoch"], "width": q - v, "r": r.ravel(), "z": t[v:q, q], "log_offset": offset, "n_observed": part["n"], "corner": chi2, "dof": part["n"] - rank(u[:q, :q]), "templates": found}


def _parts(factors: DataFrame) -> DataFrame:
    def opened(batches):
        for b in batches:
            out = []
            for f in b.to_pylist():
                w = f["width"]
                r = np.reshape(f["r"], (w, w))
                u = np.vstack([np.column_stack([r, f["z"]]), np.zeros(w + 1)])
                out.append({"epoch": f["epoch"], "side": w + 1, "u": u.ravel(), "log_norm": f["log_offset"], "n": f["n_observed"], "corner": f["corner"], "dof": f["dof"] + rank(r)})
            yield _batch(out)

    return factors.select("epoch", "width", "r", "z", "log_offset", "n_observed", "corner", "dof").mapInArrow(opened, _PART)


def combine(factors: DataFrame, by: str | None = "epoch") -> DataFrame:
    """Factors merged by epoch, or (by None) all of them: within each partition first, and then in parts."""
    parts = _parts(factors)
    if by is None:
        parts = parts.withColumn("epoch", F.lit("all")).mapInArrow(_running, _PART)

    def closed(batches):
        for b in batches:
            out = []
            for p in b.to_pylist():
                w = p["side"] - 1
                u = np.reshape(p["u"], (w + 1, w + 1))
                corner = float(u[w, w] ** 2)
                r = u[:w, :w]
                out.append({"epoch": p["epoch"], "width": w, "r": r.ravel(), "z": u[:w, w], "log_offset": p["log_norm"] - corner / 2, "n_observed": p["n"], "corner": p["corner"] + corner, "dof": p["dof"] - rank(r), "templates": None})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return _merged(parts).mapInArrow(closed, DDL)


def null(width: int) -> dict:
    """The factor that changes nothing it merges with."""
    return {"epoch": None, "width": width, "r": [0.0] * width * width, "z": [0.0] * width, "log_offset": 0.0, "n_observed": 0, "corner": 0.0, "dof": 0, "templates": None}


def fisher(factors: DataFrame) -> DataFrame:
    """(epoch, i, j, value): R'R, and with j = width R'z, as expressions on the arrays."""
    w = F.col("width")
    cell = lambda a, k, j: F.element_at(a, (k * w + j + 1).cast("int"))
    i, j = F.col("i"), F.col("j")
    rows = factors.withColumn("i", F.explode(F.sequence(F.lit(0), w - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), w)))
    other = lambda k: F.when(j < w, cell(F.col("r"), k, F.least(j, w - 1))).otherwise(F.element_at("z", (k + 1).cast("int")))
    prod = F.aggregate(F.sequence(F.lit(0), w - 1), F.lit(0.0), lambda a, k: a + cell(F.col("r"), k, i) * other(k))
    return rows.select("epoch", "i", "j", prod.alias("value"))


def matrices(factor) -> tuple[np.ndarray, np.ndarray, float]:
    """R, z and offset of one row of factors."""
    w = factor["width"]
    return np.reshape(np.array(factor["r"], float), (w, w)), np.array(factor["z"], float), float(factor["log_offset"])


def log_likelihood(factor, x: np.ndarray) -> float:
    """Of one row of factors."""
    r, z, offset = matrices(factor)
    return offset - 0.5 * float(((r @ np.asarray(x, float) - z) ** 2).sum())


def log_likelihoods(factors: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
    """epoch, point, value: the log likelihood of each factor at each of a few points, as expressions on the arrays."""
    w = F.col("width")
    at = F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in points))
    rows = factors.select("*", F.posexplode(at).alias("point", "_x"))
    residual = F.transform(
        F.sequence(F.lit(0), w - 1),
        lambda i: F.aggregate(F.zip_with(F.slice("r", i * w + 1, w), F.col("_x"), lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v) - F.element_at("z", i + 1),
    )
    square = F.aggregate(residual, F.lit(0.0), lambda s, v: s + v * v)
    return rows.select("epoch", "point", (F.col("log_offset") - 0.5 * square).alias("value"))


def prior_root(prior_std, width: int) -> np.ndarray:
    """A square root of a normal prior's precision: of standard deviations (infinite ones tell nothing), or, a matrix, as it is given."""
    std = np.asarray(prior_std, float)
    return std if std.ndim == 2 else np.diag(1 / np.broadcast_to(std, width))


def solved(r: np.ndarray, z: np.ndarray, prior_std=None, prior_mean=0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the unknowns and the inverse of their triangle (whose product with its transpose is the covariance). prior_std: see prior_root."""
    w = len(z)
    if prior_std is not None:
        root, mean = prior_root(prior_std, w), np.broadcast_to(np.asarray(prior_mean, float), w)
        u = triangle(np.vstack([np.column_stack([r, z]), np.column_stack([root, root @ mean])]))
        r, z = u[:w, :w], u[:w, w]
    if rank(r) < w:
        raise ParameterError("the data and the prior don't determine all unknowns")
    inverse = np.linalg.inv(r)
    return inverse @ z, inverse


def solutions(factors: DataFrame, prior_std=None, prior_mean=0.0) -> DataFrame:
    """epoch, x, std: the mean of each factor's unknowns and their standard deviations."""

    def of(batches):
        for b in batches:
            out = []
            for f in b.to_pylist():
                r, z, _ = matrices(f | {"log_offset": 0.0})
                x, inverse = solved(r, z, prior_std, prior_mean)
                out.append({"epoch": f["epoch"], "x": x, "std": np.sqrt((inverse**2).sum(axis=1))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("epoch", pa.string()), ("x", pa.list_(pa.float64())), ("std", pa.list_(pa.float64()))]))

    return factors.select("epoch", "width", "r", "z").mapInArrow(of, "epoch string, x array<double>, std array<double>")


def integrated(r: np.ndarray, z: np.ndarray, offset: float, gone: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """The factor over what is left when the unknowns at the places `gone` are integrated out of exp(offset - |R x - z|^2 / 2)."""
    w, k = r.shape[1], len(gone)
    stay = [i for i in range(w) if i not in set(gone)]
    t = triangle(np.column_stack([r[:, [*gone, *stay]], z]))
    size = np.abs(np.diag(t)[:k])
    if k and size.min() <= _EPS * np.abs(np.diag(t)[:w]).max():
        raise ParameterError("what is to be integrated out isn't determined")
    # a Gaussian integral over k unknowns, and what no unknown can explain
    offset += 0.5 * k * float(np.log(2 * np.pi)) - float(np.log(size).sum()) - float(t[w, w] ** 2) / 2
    return t[k:w, k:w], t[k:w, w], offset


def marginalise(factors: DataFrame, gone: Sequence[int]) -> DataFrame:
    """Factors over the unknowns that are left when those at the places `gone` are integrated out."""
    gone = list(gone)

    def of(batches):
        for b in batches:
            out = []
            for f in b.to_pylist():
                r, z, offset = integrated(*matrices(f), gone)
                out.append(f | {"width": len(z), "r": r.ravel(), "z": z, "log_offset": offset, "templates": f["templates"]})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    names = _SCHEMA.names
    return factors.select(*names).mapInArrow(of, DDL)
