"""Wide linear blocks against dense algebra; Jeffreys' prior on singular designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import campaign_queries, errors
from skyloom.operators import diagnostics, linear, wide
from skyloom.sources.stage import Stage
from tests.conftest import SF


def problem(spark, rng, cells=60, unknowns=9):
    x = rng.normal(size=(cells, unknowns)) * (rng.random((cells, unknowns)) < 0.4)
    y, sigma = rng.normal(size=cells), rng.uniform(0.2, 2, cells)
    mean, std = rng.normal(size=unknowns), rng.uniform(0.3, 3, unknowns)
    entries = spark.createDataFrame([(c, f"u{u}", float(x[c, u])) for c in range(cells) for u in range(unknowns) if x[c, u]], "cell long, unknown string, a double").repartition(3)
    data = spark.createDataFrame([(c, float(y[c]), float(sigma[c])) for c in range(cells)], "cell long, y double, sigma double")
    prior = spark.createDataFrame([(f"u{u}", float(mean[u]), float(std[u])) for u in range(unknowns)], "unknown string, mean double, std double")
    m = (x / sigma[:, None]).T @ (x / sigma[:, None]) + np.diag(1 / std**2)
    b = x.T @ (y / sigma**2) + mean / std**2
    return wide.WideBlock(entries, data, prior), x, y, sigma, mean, std, m, b


def values(found, draw=0):
    return np.array([r.value for r in found.values.where(F.col("draw") == draw).orderBy("unknown").collect()])


def test_solution_and_spectrum(spark):
    block, x, y, sigma, mean, std, m, b = problem(spark, np.random.default_rng(3))
    found = wide.wide_solve(block, tol=1e-11)
    want = np.linalg.solve(m, b)
    assert np.allclose(values(found), want, atol=1e-8) and found.residuals[0] < 1e-10
    rows = spark.createDataFrame([(r.tolist(), float(v), float(s)) for r, v, s in zip(x, y, sigma)], "a array<double>, y double, s double")
    assert np.allclose(linear.wiener_solve(rows, "a", "y", "s", std, mean)[0], values(found), atol=1e-8)
    d = np.sqrt(np.diag(m))
    e = np.linalg.eigvalsh(m / d[:, None] / d)
    assert np.isclose(found.condition, e[-1] / e[0], rtol=0.05) and found.error >= np.linalg.norm((values(found) - want) * d) / np.linalg.norm(want * d) / 10
    top, low = wide.extreme_eigenvalues(block, 12)
    assert 0.9 * e[-1] < top <= e[-1] * (1 + 1e-9) and e[0] * (1 - 1e-9) <= low < e[0] + 0.15 * e[-1]


def test_draws(spark):
    """Draws solve the right sides of their own noise: over many, mean and covariance are the posterior's."""
    block, *_, m, b = problem(spark, np.random.default_rng(5), 25, 4)
    n = 400
    found = wide.wide_solve(block, draws=n, seed=2, tol=1e-9)
    rows = found.values.where("draw > 0").toPandas().pivot(index="draw", columns="unknown", values="value").to_numpy()
    cov = np.linalg.inv(m)
    assert rows.shape == (n, 4)
    assert (np.abs(rows.mean(axis=0) - np.linalg.solve(m, b)) < 5 * np.sqrt(np.diag(cov) / n)).all()
    assert np.allclose(np.cov(rows.T), cov, atol=6 * np.diag(cov).max() / np.sqrt(n))
    again = wide.wide_solve(wide.WideBlock(block.entries.repartition(5), block.cells, block.prior), draws=2, seed=2, tol=1e-9)
    assert np.allclose(values(again, 2), rows[1], atol=1e-6)


def test_odd_rows(spark):
    """Flagged and null cells tell nothing, entries add up, unknowns without data stay at their prior, without either they are refused."""
    entries = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "a", 3.0), (3, "a", 9.0), (4, "a", 9.0), (5, "other", 1.0), (9, "a", 1.0)], "cell long, unknown string, a double")
    cells = spark.createDataFrame([(1, 4.0, 1.0), (2, 3.0, 2.0), (3, None, 1.0), (4, 5.0, float("inf")), (5, 1.0, 1.0)], "cell long, y double, sigma double")
    prior = spark.createDataFrame([("a", 1.0, None), ("alone", 7.0, 2.0)], "unknown string, mean double, std double")
    found = wide.wide_solve(wide.WideBlock(entries, cells, prior))
    assert {r.unknown: round(r.value, 9) for r in found.values.collect()} == {"a": round((2 * 4 + 3 * 3 / 4) / (4 + 9 / 4), 9), "alone": 7.0}
    with pytest.raises(Exception, match="neither data nor a prior"):
        wide.wide_solve(wide.WideBlock(entries, cells, prior.union(spark.createDataFrame([("free", 0.0, None)], prior.schema))))
    empty = wide.wide_solve(wide.WideBlock(entries, cells, prior.limit(0)))
    assert empty.values.count() == 0 and empty.turns == 0
    block, *_ = problem(spark, np.random.default_rng(3))
    with pytest.raises(errors.ParameterError, match="no convergence"):
        wide.wide_solve(block, most=1)
    with pytest.raises(errors.ParameterError, match="the error's bound"):
        wide.wide_solve(block, tol=0.3, require=1e-3)


def test_fifty_thousand_unknowns(spark):
    """A level for each group and a slope for all: the block elimination by hand, from groups' sums."""
    n = 150_000
    t = spark.range(n).select(F.col("id").alias("cell"), (F.col("id") % 50_000).cast("string").alias("g"), (F.hash("id") % 1000 / 1000.0).alias("x"))
    t = t.withColumn("y", 3 * F.col("x") + (F.hash("g") % 100) / 50.0)
    entries = t.select("cell", F.col("g").alias("unknown"), F.lit(1.0).alias("a")).union(t.select("cell", F.lit("slope"), "x"))
    prior = t.select(F.col("g").alias("unknown")).distinct().union(spark.createDataFrame([("slope",)], "unknown string")).select("unknown", F.lit(0.0).alias("mean"), F.lit(2.0).alias("std"))
    found = wide.wide_solve(wide.WideBlock(entries, t.select("cell", "y", F.lit(0.5).alias("sigma")), prior), tol=1e-10)
    g = t.groupBy("g").agg(F.sum("x").alias("b"), F.sum("y").alias("c"), (F.count("*") + 1 / 16).alias("d")).toPandas()
    s = t.agg(F.sum(F.col("x") * F.col("x")) + 1 / 16, F.sum(F.col("x") * F.col("y"))).first()
    slope = (s[1] - (g.b * g.c / g.d).sum()) / (s[0] - (g.b**2 / g.d).sum())
    got = {r.unknown: r.value for r in found.values.where("unknown in ('slope', '0', '77', '49999')").collect()}
    assert abs(got.pop("slope") - slope) < 1e-7 and found.turns < 30
    level = ((g.c - g.b * slope) / g.d).set_axis(g.g)
    assert len(got) == 3 and all(abs(v - level[u]) < 1e-7 for u, v in got.items())


def test_cells_of_many_unknowns(spark):
    """Cells of rare and frequent unknowns, twice the same, and ones without a prior's row: both forms of a block give the dense solution and the same draws."""
    rng = np.random.default_rng(8)
    cells, rare = 300, 24
    x = np.zeros((cells, rare + 1))
    listed = []
    for c in range(cells):
        mine = [(f"u{u:02}", float(a)) for u, a in zip(rng.choice(rare, 3, replace=False), rng.normal(size=3))]
        mine += [(mine[0][0], 0.5), ("zz", float(rng.normal())), ("absent", 3.0)] + ([("alien", 2.0)] if c % 9 == 0 else []) + ([("u07", None)] if c % 7 == 0 else [])
        for u, a in mine:
            if u[0] in "uz" and a is not None:
                x[c, rare if u == "zz" else int(u[1:])] += a
        listed.append(mine)
    y, sigma = 5 + rng.normal(size=cells), rng.uniform(0.2, 2, cells)
    gone = np.arange(cells) % 11 == 0
    mean, std = rng.normal(size=rare + 1), rng.uniform(0.3, 3, rare + 1)
    data = [(c, float(y[c]), float("inf") if gone[c] else float(sigma[c])) for c in range(cells)]
    prior = spark.createDataFrame([("zz" if u == rare else f"u{u:02}", float(mean[u]), float(std[u])) for u in range(rare + 1)], "unknown string, mean double, std double")
    apart = wide.WideBlock(
        spark.createDataFrame([(c, u, a) for c in range(cells) for u, a in listed[c]], "cell long, unknown string, a double").repartition(3),
        spark.createDataFrame(data, "cell long, y double, sigma double"), prior,
    )
    rows = wide.WideRows(spark.createDataFrame([(*d, m) for d, m in zip(data, listed)], "cell long, y double, sigma double, entries array<struct<unknown string, a double>>").repartition(5), prior)
    w = np.where(gone, 0.0, 1 / sigma)[:, None]
    m = (x * w).T @ (x * w) + np.diag(1 / std**2)
    want = np.linalg.solve(m, (x * w).T @ (y * w[:, 0]) + mean / std**2)
    a, b = (wide.wide_solve(block, draws=5, seed=3) for block in (apart, rows))
    assert np.allclose(values(a), want, atol=1e-6) and np.allclose(values(b), want, atol=1e-6)
    for draw in range(1, 6):
        assert np.allclose(values(a, draw), values(b, draw), atol=1e-6) and np.abs(values(a, draw) - want).max() > 0.1
    d = np.sqrt(np.diag(m))
    e = np.linalg.eigvalsh(m / d[:, None] / d)
    top, _ = wide.extreme_eigenvalues(rows, 3)
    assert 0.5 * e[-1] < top <= e[-1] * (1 + 1e-9)


@pytest.mark.parametrize("draws", [0, 2])
def test_turns_shuffle_nothing(spark, monkeypatch, draws):
    """Where cells share frequent unknowns only, data are shuffled once, before the turns: their disk doesn't grow with turns, cells or draws."""
    plans, write = [], Stage.__call__
    monkeypatch.setattr(Stage, "__call__", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df))
    found = wide.wide_solve(campaign_queries._levels(spark, SF), draws, seed=4, tol=1e-11)
    assert len(plans) == found.turns + 2 and ["Exchange" in p for p in plans] == [True] + [False] * (found.turns + 1)


def test_singular_designs_are_refused():
    """Exactly singular designs of all scales, whatever rounding makes of them."""
    rng = np.random.default_rng(9)
    for i in range(300):
        x = rng.normal(size=(40, 4)) * 10.0 ** rng.uniform(-3, 3, 4)
        x[:, 3] = x[:, :3] @ rng.normal(size=3)
        prior = diagnostics.JeffreysPrior(None, None, ("a", "b", "c", "d"))
        r = np.linalg.qr(x)[1]
        object.__setattr__(prior, "_triangle", lambda at, r=r: r)
        with pytest.raises(errors.ParameterError):
            prior.check_identified()
        assert np.isfinite(prior.log_density())
        r[3, 3] = r[0, 0]
        prior.check_identified()
        assert np.isclose(prior.log_density(), np.log(np.linalg.svd(r, compute_uv=False)).sum())
