"""Diagnostics against dense linear algebra, the archive's rules, and the streaming memory against a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
import skyloom.campaign_queries  # noqa: F401
from skyloom.operators import bases, chain, diagnostics, evidence, inference, linear, memory, reduced
from skyloom.queries import ORACLE_SQL, QUERIES, waterfall
from skyloom.sources.archive import load_memory, save_memory
from skyloom.streaming.memory import remember
from tests.conftest import SF


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    return spark.createDataFrame([(f"e{i % 6}", *map(float, r), float(r @ [1.0, -2.0, 0.5] + e), 0.3) for i, (r, e) in enumerate(zip(x, rng.normal(size=300) * 0.3))], "epoch string, a double, b double, c double, y double, sigma double")


def test_identifiability(rows):
    wide = rows.withColumns({"d": F.col("a") - 2 * F.col("b"), "zero": F.lit(0.0)})
    found = diagnostics.identifiability(wide, ["a", "b", "c", "d", "zero"], F.col("sigma"))
    assert (found.rank, found.nullity) == (3, 2)
    part = found.participation()
    assert part["c"] < 1e-9 and abs(part["zero"] - 1) < 1e-9 and part["a"] > 0.05
    r = diagnostics.jacobian_triangle(wide, ["a", "b"], 0.5)
    x = np.array(wide.select("a", "b").collect()) / 0.5
    assert np.allclose(r.T @ r, x.T @ x)
    with pytest.raises(errors.ParameterError):
        diagnostics.jeffreys_half_log_det(wide, ["a", "b", "d"])
    assert np.isclose(diagnostics.jeffreys_half_log_det(wide, ["a", "b"], 0.5), 0.5 * np.linalg.slogdet(x.T @ x)[1])
    assert diagnostics.identifiability(wide.limit(0), ["a", "b"]).rank == 0


def _spectra(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")


@pytest.mark.parametrize("method", ["svd", "greedy"])
def test_reduced_basis(spark, method):
    rng = np.random.default_rng(6)
    sigma = np.array([1.0, 2.0, 0.5, 1.0])
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 4))
    bank = _spectra(spark, x)
    basis = reduced.build_reduced_basis(bank, "v", 2, sigma, method)
    assert basis.lost < 1e-12 and np.allclose(basis.gram, np.eye(2)) and abs(basis.condition - 1) < 1e-9 and len(basis.fingerprint) == 64
    assert bank.select(F.max(basis.residual_fraction(F.col("v")))).first()[0] < 1e-9
    back = bank.select("v", basis.expand(basis.project(F.col("v"))).alias("w")).collect()
    assert all(np.allclose(r.v, r.w) for r in back)
    with pytest.raises(errors.ParameterError):
        reduced.build_reduced_basis(bank, "v", 3, sigma, method)
    scores = np.array([[1.0, 0, 0, 0]])
    seeded = reduced.build_reduced_basis(bank, "v", 1, sigma, method, scores)
    fit = reduced.basis_fidelity(seeded, np.vstack([scores, [0, 1.0, 0, 0]]), ["p", "q"])
    assert fit.lost["p"] < 1e-12 and fit.worst == ("q", 1.0) and np.allclose(fit.full, np.diag([1, 0.25]))
    with pytest.raises(errors.ParameterError):
        fit.refuse_above(0.1)


def test_reduced_basis_query(spark):
    """The query's five channels against NumPy."""
    d = np.zeros((720, 5))
    for r in waterfall(spark, SF).collect():
        d[r.time_idx, r.freq_idx] += r.data
    s = np.linalg.svd(d / [1, 2, 1, 2, 1], compute_uv=False) ** 2
    assert np.isclose(QUERIES["reduced_basis"](spark, SF).first().lost, s[2:].sum() / s.sum(), atol=2e-6)


def test_bases():
    assert np.allclose(bases.basis_matrix("legendre", 3, 3)[:, 2], [1, -0.5, 1]) and np.allclose(bases.basis_matrix("fourier", 4, 3)[1], [1, 0, 1])
    for bad in (("legendre", 2, 3), ("wavelet", 3, 1)):
        with pytest.raises(errors.ParameterError):
            bases.basis_matrix(*bad)


def test_nuisance_and_templates(spark, rows):
    """Against the dense Gaussian with the nuisance's prior in its covariance."""
    f = evidence.compress(rows, "epoch", ["a"], "y", "sigma", nuisance=["b", "c"], nuisance_std=[0.5, 2.0], nuisance_mean=0.1, offset="a").collect()
    data = {}
    for r in rows.collect():
        data.setdefault(r.epoch, []).append((r.a, r.b, r.c, r.y, r.sigma))
    for row in f:
        m = np.array(data[row.epoch])
        b, t = m[:, 1:3], 0.7
        cov = np.diag(m[:, 4] ** 2) + b @ np.diag([0.25, 4.0]) @ b.T
        d = m[:, 3] - m[:, 0] * (1 + t) - b @ [0.1, 0.1]
        want = -0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1]
        assert np.isclose(evidence.log_likelihood(row, [t]), want, atol=1e-8)
        assert row.dof == len(m) - 3
    found = evidence.compress(rows, "epoch", ["a", "b"], "y", "sigma", templates=["c"]).first()
    m = np.array(data[found.epoch]) / 0.3
    off = np.eye(len(m)) - m[:, :2] @ np.linalg.pinv(m[:, :2])
    t = off @ m[:, 2]
    assert np.isclose(found.templates["c"], t @ m[:, 3] / np.linalg.norm(t)) and np.isclose(found.corner, m[:, 3] @ off @ m[:, 3])
    with pytest.raises(Exception, match="templates"):
        evidence.compress(rows.withColumn("d", F.col("a") * 2), "epoch", ["a", "b"], "y", "sigma", templates=["d"]).collect()
    with pytest.raises(errors.ParameterError):
        evidence.compress(rows, "epoch", ["a"], "y", "sigma", nuisance=["b"])


def test_factors_merge_in_any_order(spark, rows):
    one = evidence.combine(evidence.compress(rows, "epoch", ["a", "b", "c"], "y", "sigma"), None).first()
    two = evidence.combine(evidence.compress(rows.repartition(7), "epoch", ["a", "b", "c"], "y", "sigma").repartition(3), None).first()
    direct = linear.factor_of(rows, ["a", "b", "c"], "y", "sigma")
    x = [0.3, -1.0, 2.0]
    for other in (two, direct):
        assert np.isclose(evidence.log_likelihood(one, x), evidence.log_likelihood(other, x)) and np.isclose(one.corner, other["corner"]) and one.dof == other["dof"] == 297
    none = evidence.null(3)
    both = evidence.combine(spark.createDataFrame([tuple(one), tuple({**none, "epoch": "x"}.values())], evidence.DDL), None).first()
    assert np.isclose(evidence.log_likelihood(both, x), evidence.log_likelihood(one, x))
    dark = evidence.compress(rows.withColumn("sigma", F.lit(None).cast("double")), "epoch", ["a"], "y", "sigma").collect()
    assert len(dark) == 6 and all(r.n_observed == 0 and r.r == [0.0] for r in dark)
    assert evidence.combine(evidence.compress(rows.limit(0), "epoch", ["a"], "y", "sigma"), None).count() == 0


def test_marginal_is_an_integral(spark, rows):
    f = evidence.compress(rows, "epoch", ["a", "b"], "y", "sigma")
    kept = {r.epoch: r for r in evidence.marginalise(f, [0]).collect()}
    for row in f.collect():
        grid = np.linspace(-1, 3, 20001)
        logs = np.array([evidence.log_likelihood(row, [g, -2.1]) for g in grid])
        top = logs.max()
        want = top + np.log(np.exp(logs - top).sum() * (grid[1] - grid[0]))
        assert np.isclose(evidence.log_likelihood(kept[row.epoch], [-2.1]), want, atol=1e-6)
    with pytest.raises(Exception, match="determined"):
        evidence.marginalise(evidence.compress(rows.withColumn("z", F.lit(0.0)), "epoch", ["z", "b"], "y", "sigma"), [0]).collect()


def _chain(spark, n, k, seed):
    """Factors of n epochs over two shared unknowns and k states, and what they are made of."""
    rng = np.random.default_rng(seed)
    made = [(rng.normal(size=(6, 2 + k)), rng.normal(size=6)) for _ in range(n)]
    rows = [(f"{e:03d}", *map(float, r), float(v), 0.3) for e, (a, y) in enumerate(made) for r, v in zip(a, y)]
    names = [f"x{i}" for i in range(2 + k)]
    df = spark.createDataFrame(rows, "epoch string, " + ", ".join(f"{c} double" for c in names) + ", y double, s double").repartition(5)
    f = evidence.compress(df, "epoch", names, "y", "s").withColumns({"campaign": F.lit("c"), "seq": F.col("epoch").cast("long")})
    return f, made


def _dense(made, t, theta):
    """Mean and covariance of all states, and of the data given theta."""
    k, n = t.width, len(made)
    mean, cov = [t.initial_mean], np.zeros((n * k, n * k))
    var = np.diag(t.initial_std**2)
    for i in range(n):
        step = var
        for j in range(i, n):
            cov[i * k : i * k + k, j * k : j * k + k] = step.T
            cov[j * k : j * k + k, i * k : i * k + k] = step
            step = t.phi @ step
        if i < n - 1:
            mean.append(t.phi @ mean[-1])
        var = t.phi @ var @ t.phi.T + np.diag(t.process_std**2)
    b = np.zeros((6 * n, n * k))
    for e, (a, _) in enumerate(made):
        b[6 * e : 6 * e + 6, e * k : e * k + k] = a[:, 2:]
    mean = np.concatenate(mean)
    d = np.concatenate([y - a[:, :2] @ theta for a, y in made]) - b @ mean
    return mean, cov, b, d, b @ cov @ b.T + 0.09 * np.eye(6 * n)


@pytest.mark.parametrize("n, k", [(1, 1), (2, 1), (9, 1), (7, 2)])
def test_chain_against_dense(spark, n, k):
    f, made = _chain(spark, n, k, n)
    t = chain.Transition.of(0.8 if k == 1 else [[0.8, 0.1], [-0.2, 0.7]], 0.5, 1.0, 0.3)
    theta = np.array([0.4, -1.1])
    mean, cov, b, d, c = _dense(made, t, theta)
    want = -0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1]
    kept = chain.ChainMemory(f, ["p", "q"], t, prior_std=2.0)
    assert np.isclose(kept.log_likelihoods([theta])[0], want, atol=1e-8)
    assert np.isclose(kept.log_posterior(theta), want - 0.5 * (theta**2).sum() / 4 - 2 * np.log(2) - np.log(2 * np.pi), atol=1e-8)
    states = chain.smooth(f, t, theta).orderBy("seq").collect()
    gain = cov @ b.T @ np.linalg.inv(c)
    assert np.allclose(np.concatenate([r["mean"] for r in states]), mean + gain @ d)
    assert np.allclose(np.concatenate([r["var"] for r in states]), np.diag(cov - gain @ b @ cov))


def test_chain_rules(spark):
    f, _ = _chain(spark, 3, 1, 3)
    build = chain.HyperTransition(lambda v: chain.Transition.of(v["p"], 0.5, 1.0), ("p",))
    kept = chain.ChainMemory(f, ["p", "q"], build)
    fixed = chain.ChainMemory(f, ["p", "q"], chain.Transition.of(0.5, 0.5, 1.0))
    assert np.isclose(kept.log_likelihoods([(0.2, 1.0), (0.5, 1.0)])[1], fixed.log_likelihoods([(0.5, 1.0)])[0])
    assert np.allclose(kept.fisher([0.5, 1.0]), fixed.fisher())
    with pytest.raises(errors.ParameterError):
        kept.fisher()
    with pytest.raises(errors.ParameterError):
        fixed.remember(f)
    ou = chain.ornstein_uhlenbeck(3.0, 2.0, 2)
    assert np.allclose(ou.phi**2 * ou.initial_std**2 + np.diag(ou.process_std**2), np.eye(2) * 4)
    for bad in ((0.5, 0.0, 1.0), (0.5, 1.0, float("inf"))):
        with pytest.raises(errors.ParameterError):
            chain.Transition.of(*bad)


def test_memory(spark, rows):
    f = evidence.compress(rows, "epoch", ["a", "b", "c"], "y", "sigma")
    kept = memory.Memory.of(f, ["a", "b", "c"], 0.0, 5.0, {"beam": "c"})
    m = np.array(rows.select("a", "b", "c", "y").collect()) / 0.3
    want = np.linalg.solve(m[:, :3].T @ m[:, :3] + np.eye(3) / 25, m[:, :3].T @ m[:, 3])
    mean, cov = kept.posterior()
    assert np.allclose(mean, want) and np.allclose(kept.fisher, m[:, :3].T @ m[:, :3])
    x = [1.0, -2.0, 0.0]
    assert np.isclose(kept.log_posterior(x) - kept.log_likelihood(x), sum(-0.5 * (v / 5) ** 2 - np.log(5) - 0.5 * np.log(2 * np.pi) for v in x))
    report = kept.audit(bias=[1.0, 0.0, 0.0], floors={"c": 1.0}, modelled=["beam"])
    assert report["n_epochs"] == 6 and report["below_floor"]["c"]["below"] and 0 < report["bias_over_sigma"]["a"] < 1
    for bad in ({"floors": {"c": 1.0}}, {"bias": [1e3, 0, 0], "bias_tolerance": 0.1}):
        with pytest.raises(errors.ParameterError):
            kept.audit(**bad)
    assert np.abs(kept.draws(4000, 1).mean(axis=0) - mean).max() < 0.01
    with pytest.raises(errors.IngestError):
        memory.Memory.of(f.union(f), ["a", "b", "c"])


def test_held_out(spark, rows):
    f = evidence.compress(rows, "epoch", ["a", "b"], "y", "sigma")
    got = {r.epoch: r for r in memory.held_out_z(f, prior_std=3.0).collect()}
    data = {}
    for r in rows.collect():
        data.setdefault(r.epoch, []).append((r.a / 0.3, r.b / 0.3, r.y / 0.3))
    for e, mine in data.items():
        mine, rest = np.array(mine), np.array([x for k, v in data.items() if k != e for x in v])
        info = rest[:, :2].T @ rest[:, :2] + np.eye(2) / 9
        gap = mine[:, 2] - mine[:, :2] @ np.linalg.solve(info, rest[:, :2].T @ rest[:, 2])
        chi2 = gap @ np.linalg.solve(np.eye(len(mine)) + mine[:, :2] @ np.linalg.solve(info, mine[:, :2].T), gap)
        assert np.isclose(got[e].chi2, chi2) and got[e].dof == len(mine)


def test_losses():
    assert inference.sense_of(inference.mean_squared_error) == "minimise" and inference.sense_of(inference.log_likelihood) == "maximise"
    with pytest.raises(errors.ParameterError):
        inference.sense_of(lambda a, b: a)


def test_floor():
    sigma, epoch = diagnostics.systematic_floor(np.diag([4.0, 100.0]), 10, 0.05)
    assert (sigma, epoch) == (0.1, 40)


def test_archive(spark, rows, tmp_path):
    factors = evidence.compress(rows, "epoch", ["a", "b", "c"], "y", "sigma")
    at = f"file://{tmp_path}/m"
    save_memory(factors, at, ["a", "b", "c"])
    assert load_memory(spark, at, ["a", "b", "c"]).count() == 6
    with pytest.raises(errors.IngestError):
        load_memory(spark, at, ["a", "c", "b"])
    with pytest.raises(errors.IngestError):
        save_memory(factors.union(factors), f"{at}2", ["a", "b", "c"])
    with pytest.raises(errors.IngestError):
        save_memory(factors.withColumn("log_offset", F.lit(float("nan"))), f"{at}3", ["a", "b", "c"])
    used = factors.withColumn("inputs", F.create_map(F.lit("beam"), F.when(F.col("epoch") < "e2", "x").otherwise(F.col("epoch"))))
    with pytest.raises(errors.IngestError):
        save_memory(used, f"{at}4", ["a", "b", "c"])
    save_memory(used, f"{at}5", ["a", "b", "c"], represents=["beam"])


def test_smoother_against_dense(spark):
    y = np.random.default_rng(2).normal(size=12)
    n, phi, q, s0, s = len(y), 0.8, 0.5, 1.5, 0.3
    cov = np.zeros((n, n))
    var = s0 * s0
    for i in range(n):
        cov[i, i:] = cov[i:, i] = var * phi ** np.arange(n - i)
        var = phi * phi * var + q * q
    gain = cov @ np.linalg.inv(cov + s * s * np.eye(n))
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double")
    got = np.array([(r["mean"], r["var"]) for r in chain.kalman(df, "k", "t", "y", phi, q, s0, s, smooth=True).orderBy("t").collect()])
    assert np.allclose(got[:, 0], gain @ y) and np.allclose(got[:, 1], np.diag(cov - gain @ cov))


def test_streaming_memory(spark, rows, tmp_path):
    factors = evidence.compress(rows, "epoch", ["a", "b", "c"], "y", "sigma").withColumn("campaign", F.lit("night"))
    source, out = f"file://{tmp_path}/in", []
    factors.where("epoch < 'e3'").write.parquet(source)
    stream = remember(spark.readStream.schema(factors.schema).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(lambda df, i: out.extend(df.collect()))
    stream.trigger(availableNow=True).start().awaitTermination()
    factors.write.mode("append").parquet(source)  # three epochs come again
    stream.trigger(availableNow=True).start().awaitTermination()
    last, want = max(out, key=lambda r: r["n_epochs"]), evidence.combine(factors, None).first()
    x = np.array([1.0, -2.0, 0.5])
    assert (last["n_epochs"], last["n_observed"]) == (6, 300)
    assert np.isclose(evidence.log_likelihood(last, x), evidence.log_likelihood(want, x))


@pytest.mark.parametrize("name", ["chain_smooth", "identifiability", "jeffreys_prior", "reduced_basis_greedy"])
def test_registered(name):
    assert name in QUERIES and name in ORACLE_SQL


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_states_by_ranges(spark, monkeypatch, size):
    """Series of all lengths, cut anywhere: the dense posterior of all states, filtered and smoothed, of numbers and of vectors."""
    monkeypatch.setattr(chain, "RANGE", size)
    rng = np.random.default_rng(size)
    for k, t in ((1, chain.Transition.of(0.9, 0.4, 1.5, 0.3)), (2, chain.Transition.of([[0.9, 0.2], [-0.1, 0.7]], [0.5, 0.3], [1.0, 2.0], [0.4, -1.0]))):
        rows, want = [], {}
        for series, n in (("a", 1), ("b", 2), ("c", 17), (None, 5), ("d", 40)):
            js, hs = [], []
            for i in range(n):
                a = rng.normal(size=(2, k)) * (rng.random() < 0.7)
                js.append(a.T @ a)
                hs.append(a.T @ rng.normal(size=2))
                rows.append((series, i * 3, js[-1].ravel().tolist(), hs[-1].tolist(), "x"))
            big, right = np.zeros((n * k, n * k)), np.zeros(n * k)
            at = [slice(i * k, i * k + k) for i in range(n)]
            big[at[0], at[0]] += np.diag(t.initial_std**-2.0)
            right[at[0]] += t.initial_mean / t.initial_std**2
            qi = np.diag(t.process_std**-2.0)
            for i in range(1, n):
                big[at[i], at[i]] += qi
                big[at[i - 1], at[i - 1]] += t.phi.T @ qi @ t.phi
                big[at[i - 1], at[i]] -= t.phi.T @ qi
                big[at[i], at[i - 1]] -= qi @ t.phi
            for smooth in (False, True):
                for i in range(n):
                    b, y = big.copy(), right.copy()
                    for j in range(n if smooth else i + 1):
                        b[at[j], at[j]] += js[j]
                        y[at[j]] += hs[j]
                    cov = np.linalg.inv(b)
                    want[smooth, series, i * 3] = ((cov @ y)[at[i]], np.diag(cov)[at[i]])
        df = spark.createDataFrame(rows, "s string, o long, j array<double>, h array<double>, whole string").repartition(5)
        for smooth in (False, True):
            got = chain.states(df, "s", "o", t, smooth).collect()
            assert len(got) == 65
            for r in got:
                mean, var = want[smooth, r.s, r.o]
                assert np.allclose(r["mean"], mean, atol=1e-9) and np.allclose(r["var"], var, atol=1e-9)
        assert chain.states(df.limit(0), "s", "o", t, True).count() == 0


def test_streaming_chain(spark, tmp_path):
    """Batches in any order, late epochs between earlier ones and repeated ones: the marginal of the batch operator."""
    from skyloom.streaming.chain import remember_chain

    t = chain.Transition.of([[0.8, 0.1], [-0.2, 0.7]], 0.5, 1.0, 0.3)
    f, _ = _chain(spark, 12, 2, 5)
    far = F.expr("case when seq < 4 then seq - 5 when seq < 9 then seq * 50 else seq * 100000000000 end")  # many leaves and levels
    f = f.withColumn("seq", far).withColumn("campaign", F.lit("night")).cache()
    seqs = sorted(r.seq for r in f.select("seq").collect())
    source, out = f"file://{tmp_path}/in", []
    stream = None
    for i, some in enumerate(([7, 2, 11], [0, 1, 2, 7], [3, 4, 5, 6, 8, 9, 10, 0])):
        part = f.where(F.col("seq").isin([seqs[j] for j in some]))
        (part.union(part.limit(1)) if i == 0 else part).coalesce(1).write.mode("append").parquet(source)
        stream = stream or remember_chain(spark.readStream.schema(f.schema).parquet(source), t).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c")
        stream.foreachBatch(lambda df, i: out.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    last = max(out, key=lambda r: r["n_epochs"])
    want = chain.chain_marginal(f, t).first()
    assert (last["n_epochs"], last["n_refused"], last["n_observed"]) == (12, 1 + 2 + 1, want["n_observed"])
    for x in ([0.4, -1.1], [2.0, 3.0]):
        assert np.isclose(evidence.log_likelihood(last, x), evidence.log_likelihood(want, x), atol=1e-8)
    assert sorted(r["n_epochs"] for r in out) == [3, 5, 12]


@pytest.mark.parametrize("name", ["linear_block_solve", "sampling_plan", "gradient_fit", "adam_fit", "prior_sensitivity", "plan_log_likelihood", "joint_prior"])
def test_fits_broadcast_no_cells(spark, name):
    """Cells are exploded from a small table, whose size is all that the planner knows of them; they meet what was observed by merge all the same."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    assert QUERIES[name](spark, SF).count() > 0
    bus.waitUntilEmpty()
    found = store.executionsList(int(before), 1000)
    plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
    assert any("SortMergeJoin Inner" in p or "SortMergeJoin(" in p for p in plans) and not any("BroadcastHashJoin Inner" in p for p in plans)
