"""Parameter spaces, fits of plans and uncertainty, against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
from skyloom.operators import diagnostics, engines, inference, linear, neural, processing, sources, transforms, uncertainty
from skyloom.operators.base import Param
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Factorization, Forward, Latent, Normal, ParameterSpace, Uniform, literal

T, N = 6, 5
FREQ = np.array([60e6 + 5e6 * i for i in range(N)])


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([("a", t, f, float(t), float(FREQ[f])) for t in range(T) for f in range(N)], "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double")


def _observed(cells, y):
    at = F.array(*(F.lit(float(v)) for v in np.asarray(y).ravel()))
    return cells.select("recording_id", "time_idx", "freq_idx", F.element_at(at, F.col("time_idx") * N + F.col("freq_idx") + 1).alias("value"))


@pytest.fixture(scope="module")
def forward(cells):
    space = ParameterSpace(
        [Latent("amp", 100.0, Normal(100.0, 20.0), linear=True), Latent("beta", 2.4, Normal(2.5, 0.2)), Latent("gain", (1.0,) * T, Normal(1.0, 0.1))],
        [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds[0].spectral_index"), Bind("gain", "gain.gain", "time")],
    )
    return Forward(space, assemble(sources.Foreground(1.0, 2.5), sources.UniformSky(10.0), transforms.Gain(1.0)), cells)


def _model(theta):
    return theta[2:, None] * (theta[0] * (FREQ / 75e6) ** -theta[1] + 10)


def test_forward(spark, forward):
    theta = np.array([150.0, 2.2, *np.linspace(0.9, 1.1, T)])
    for r in forward.predict({"amp": 150.0, "beta": 2.2, "gain": theta[2:]}).collect():
        assert np.isclose(r.data, _model(theta)[r.time_idx, r.freq_idx])
    draws = spark.createDataFrame([(i, (theta * (1 + i / 10)).tolist()) for i in range(3)], "draw_id long, theta array<double>")
    many = forward.many(draws, block=7, shards=2).collect()
    assert len(many) == 3 * T * N and all(np.isclose(r.data, _model(theta * (1 + r.draw_id / 10))[r.time_idx, r.freq_idx]) for r in many)
    j, mu = forward.jacobian(["beta", "gain"], theta)
    for r in forward.cells.select("time_idx", "freq_idx", j.alias("j"), mu.alias("mu")).collect():
        sky = theta[0] * (FREQ[r.freq_idx] / 75e6) ** -theta[1]
        want = [-theta[2 + r.time_idx] * sky * np.log(FREQ[r.freq_idx] / 75e6), *np.where(np.arange(T) == r.time_idx, sky + 10, 0)]
        assert np.allclose(r.j, want, rtol=1e-7, atol=1e-6) and np.isclose(r.mu, _model(theta)[r.time_idx, r.freq_idx])


def test_space_refusals(cells):
    a, b = Latent("a", 1.0), Latent("b", (1.0, 2.0))
    into = Bind("a", "gain.gain")
    for bad in (
        lambda: ParameterSpace([a, a], [into]), lambda: ParameterSpace([a], []), lambda: ParameterSpace([a], [into, Bind("c", "adc.scale")]),
        lambda: ParameterSpace([a], [into, Bind("a", "gain[0].gain")]), lambda: ParameterSpace([b], [Bind("b", "gain.gain")]), lambda: Latent("x", float("nan")),
        lambda: Latent("x", 1.0, scope="far"), lambda: Bind("a", "gain"), lambda: Bind(("a", "b"), "gain.gain"), lambda: Normal(0.0, 0.0), lambda: Uniform(1.0, 1.0),
        lambda: Factorization(ParameterSpace([Latent("z", 1.0, scope="linked")], [Bind("z", "gain.gain")])),
    ):
        with pytest.raises(errors.ParameterError):
            bad()
    space = ParameterSpace([a], [into])
    for plan in (assemble(sources.UniformSky(1.0)), assemble(transforms.Gain(1.0), transforms.Noise(1.0, 3)), assemble(transforms.Gain(1.0), processing.Flag(1.0))):
        with pytest.raises(errors.ParameterError):
            Forward(space, plan, cells.withColumn("data", F.lit(1.0)))
    with pytest.raises(errors.ParameterError):
        space.flat({"q": 1.0})
    whole = Factorization(ParameterSpace([a, Latent("n", 0.0, scope="per_epoch")], [into, Bind("n", "uniform_sky.amplitude")]), represents={"beam": "a"})
    assert (whole.global_names, whole.per_epoch_names, whole.linked_names) == (["a"], ["n"], [])


def test_linearity(forward):
    assert linear.check_linearity(forward, "amp") < 1e-9 and linear.check_linearity(forward, "gain") < 1e-9
    for names in ("beta", ["amp", "gain"]):
        with pytest.raises(errors.ParameterError):
            linear.check_linearity(forward, names)


def test_block(forward, cells):
    rng = np.random.default_rng(3)
    theta = np.array([100.0, 2.4, *np.linspace(0.9, 1.1, T)])
    y = _model(theta) + rng.normal(size=(T, N))
    block = linear.linear_operator(forward, "gain")
    a = np.zeros((T, N, T))
    for t in range(T):
        a[t, :, t] = 100 * (FREQ / 75e6) ** -2.4 + 10
    a = a.reshape(-1, T)
    x, cov = linear.solve_block(block, _observed(cells, y), 1.0, check=True)
    info = a.T @ a + np.eye(T) / 0.01
    assert np.allclose(x, np.linalg.solve(info, a.T @ y.ravel() + 100)) and np.allclose(cov, np.linalg.inv(info))
    assert np.allclose(block.adjoint(_observed(cells, y).withColumnRenamed("value", "data")), a.T @ y.ravel())
    assert np.allclose([r.data for r in block.forward(theta[2:]).orderBy("time_idx", "freq_idx").collect()], _model(theta).ravel())
    draws = linear.gcr_draws(x, cov, 5000, 2)
    assert np.allclose(draws.mean(axis=0), x, atol=5e-4) and np.allclose(np.cov(draws.T), cov, atol=3e-5)
    low, high, ratio = linear.condition(linear.factor_of(block.rows.withColumns({"y": F.lit(0.0), "s": F.lit(1.0)}), "a", "y", "s", width=T))
    assert np.allclose([low, high], np.linalg.eigvalsh(a.T @ a)[[0, -1]]) and np.isclose(ratio, high / low)
    with pytest.raises(errors.ParameterError):
        linear.solve_block(block, _observed(cells, y).where("time_idx > 0"), 1.0, check=True)
    assert linear.tree_norm({"a": np.array([3.0]), "b": np.array([8.0])}, {"b": 2.0}) == 5.0


def test_gls(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(1, 2, 200)
    y = 3 * x + 1 + rng.normal(size=200) * 0.01
    rows = spark.createDataFrame([(float(a), 1.0, float(b)) for a, b in zip(x, y)], "x double, one double, y double")
    found = linear.iterative_gls(rows, ["x", "one"], "y", lambda mu: 0.01 * mu, least=3)
    w = 1 / (0.01 * (found.x[0] * x + found.x[1])) ** 2
    a = np.column_stack([x, np.ones(200)])
    assert np.allclose(found.x, np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y)), rtol=1e-6) and found.turns >= 3


def _problem(forward, cells, seed=4):
    theta = np.array([120.0, 2.55, *np.linspace(0.95, 1.05, T)])
    y = _model(theta) + np.random.default_rng(seed).normal(size=(T, N)) * 0.5
    return engines.Problem(forward, _observed(cells, y), 0.5), theta, y


def test_problem(forward, cells):
    problem, theta, y = _problem(forward, cells)
    want = lambda p: float((-0.5 * ((y - _model(p)) / 0.5) ** 2 - 0.5 * np.log(2 * np.pi * 0.25)).sum())
    points = [theta, theta * 1.01]
    assert np.allclose(problem.log_likelihoods(points), [want(p) for p in points])
    assert np.isclose(engines.log_likelihood(problem.linearised(theta), np.zeros(len(theta))), want(theta))
    assert np.isclose(problem.chi2(theta), (((y - _model(theta)) / 0.5) ** 2).sum())
    value, gradient = problem.mean_squared(theta, ["beta"])
    step = np.eye(len(theta))[1] * 1e-6
    assert np.isclose(value, ((y - _model(theta)) ** 2).mean())
    assert np.isclose(gradient[0], (((y - _model(theta + step)) ** 2).mean() - ((y - _model(theta - step)) ** 2).mean()) / 2e-6, rtol=1e-4)
    with pytest.raises(errors.ParameterError):
        engines.GradientCalibrator(0.1, 1).fit(problem, loss=inference.log_likelihood)


def test_plan(spark, forward, cells):
    problem, theta, y = _problem(forward, cells)
    found = engines.SamplingPlan(problem, engines.Block(["amp", "beta", "gain"], engine="gradient")).estimate(most=8, tol=1e-7, check=False)
    assert found.converged and found.chi2 < 2 * T * N and abs(found.theta[1] - 2.55) < 0.05
    space = ParameterSpace([Latent("amp", 100.0, Normal(100.0, 20.0), linear=True), Latent("beta", 2.4, Normal(2.5, 0.2))], [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index")])
    small = Forward(space, assemble(sources.Foreground(1.0, 2.5, 70e6)), cells)
    sky = 120 * np.tile((FREQ / 70e6) ** -2.55, (T, 1)) + np.random.default_rng(1).normal(size=(T, N))
    plan = engines.SamplingPlan(engines.Problem(small, _observed(cells, sky), 1.0), engines.Block("amp"), engines.Block("beta"))
    best = plan.estimate(most=8, tol=1e-6)
    assert best.converged and np.abs(best.theta - [120, 2.55]).max() < 1.0
    draws = plan.sample(4, seed=1, at=best.theta, check=False)
    assert draws.n_draw == 4 and len(draws.rhat) == 2 and np.abs(draws.mean - best.theta).max() < 2 and draws.table(spark).count() == 4
    for bad in ((engines.Block("amp"),), (engines.Block(["amp", "beta", "gain"]),), (engines.Block("amp"), engines.Block("beta", engine="conjugate"), engines.Block("gain"))):
        with pytest.raises(errors.ParameterError):
            engines.SamplingPlan(problem, *bad)


def test_gibbs_is_the_posterior(cells):
    """Two correlated linear blocks: draws have the moments of the joint solution, at no job a sweep."""
    space = ParameterSpace([Latent(n, 0.0, Normal(0.0, 5.0), linear=True) for n in ("off", "line")], [Bind("off", "uniform_sky.amplitude"), Bind("line", "emi.amplitude")])
    problem = engines.Problem(Forward(space, assemble(sources.UniformSky(0.0), transforms.PeriodicLines(0.0, 2)), cells), _observed(cells, np.arange(T * N) % 7), 2.0)
    draws = engines.SamplingPlan(problem, engines.Block("off"), engines.Block("line")).sample(6000, 3, warmup=20)
    a = np.column_stack([np.ones(T * N), np.tile([1.0, 0, 1, 0, 1], T)]) / 2
    cov = np.linalg.inv(a.T @ a + np.eye(2) / 25)
    assert np.allclose(draws.mean, cov @ a.T @ (np.arange(T * N) % 7) / 2, atol=0.06) and np.allclose(draws.std, np.sqrt(np.diag(cov)), rtol=0.06)
    assert (draws.rhat < 1.02).all()


def test_uncertainty(spark, forward, cells):
    theta = np.array([120.0, 2.55, *np.linspace(0.95, 1.05, T)])
    j = np.stack([(_model(theta + e) - _model(theta - e)).ravel() / 2e-5 for e in np.eye(len(theta)) * 1e-5], axis=1)
    noise = inference.Radiometer(100.0, 1.0)
    mu = _model(theta).ravel()
    info = j.T @ ((100 / mu**2 + 2 / mu**2)[:, None] * j)
    found = uncertainty.fisher_information(forward, noise, at=theta, prior=True)
    assert np.allclose(found.value, info + np.diag(1 / np.array([20, 0.2, *[0.1] * T]) ** 2), rtol=1e-5)
    cov = uncertainty.parameter_covariance(found)
    assert np.isclose(cov.sigma("beta")[0], np.sqrt(cov.value[1, 1])) and cov.block("amp", "gain").shape == (1, T)
    spread = uncertainty.propagate_covariance(forward, cov, theta).orderBy("time_idx", "freq_idx").collect()
    assert np.allclose([r.std for r in spread], np.sqrt(np.diag(j @ cov.value @ j.T)), rtol=1e-5)
    with pytest.raises(errors.ParameterError):
        uncertainty.parameter_covariance(uncertainty.FlatMatrix(forward.space, ("amp", "beta"), np.ones((2, 2))))
    pushed = uncertainty.push_forward(forward, forward.space.draws(spark, 50, 1))
    assert {r.n for r in pushed.collect()} == {50}
    found = diagnostics.plan_identifiability(forward, at=theta)
    assert (found.rank, found.nullity) == (2 + T, 0) and found.columns[2] == "gain[0]"
    dark = np.array([0.0, 2.55, *[1.0] * T])  # without an amplitude nothing tells the index
    assert diagnostics.plan_identifiability(forward, ["amp", "beta"], dark).participation()["beta"] > 0.99
    prior = diagnostics.JeffreysPrior(forward, 0.5, ("amp", "beta"))
    assert np.isclose(prior.log_density(theta), 0.5 * np.linalg.slogdet(j[:, :2].T @ j[:, :2] * 4)[1], rtol=1e-6)
    prior.check_identified(theta)
    with pytest.raises(errors.ParameterError):
        prior.check_identified(dark)


def test_sensitivity(forward, cells):
    problem, theta, _ = _problem(forward, cells)
    r = engines.prior_sensitivity(problem, ["amp", "beta"], theta)
    assert np.allclose(r.shift_at(1.0), r.shift, atol=0.05) and np.abs(r.shift_at(100.0)).max() < 1e-3 and r.worst in (0, 1)


def test_noise_wave_latents(cells, spark):
    """All four noise-wave temperatures of a receiver are one linear block."""
    reflections = spark.createDataFrame([(0, f, 0.1 + 0.1 * (f % 2), 0.05 * f * f, 0.08, -0.03) for f in range(N)], "src int, freq_idx int, gs_re double, gs_im double, gr_re double, gr_im double")
    names = ["t_unc", "t_cos", "t_sin", "t_rx"]
    space = ParameterSpace([Latent(n, 10.0, linear=True) for n in names], [Bind(n, f"noise_wave.{n}") for n in names])
    c = cells.withColumn("receiver_input", F.lit(0))
    forward = Forward(space, assemble(sources.UniformSky(300.0), transforms.NoiseWave(0.0, 0.0, 0.0, 0.0, reflections)), c)
    truth = forward.predict([50.0, 10.0, 5.0, 200.0]).withColumnRenamed("data", "value")
    block = linear.linear_operator(forward, names)
    x, _ = linear.solve_block(block, truth, 0.1)
    assert np.allclose(x, [50, 10, 5, 200], atol=1e-5)


def test_tied_latents(cells):
    """One latent in two fields, and one value of two latents."""
    space = ParameterSpace([Latent("a", 2.0), Latent("b", 3.0)], [Bind("a", ["uniform_sky.amplitude", "atmosphere.t_atm"]), Bind(("a", "b"), "emi.amplitude", fn=lambda a, b: a * b)])
    forward = Forward(space, assemble(sources.UniformSky(0.0), sources.Atmosphere(0.0), transforms.PeriodicLines(0.0, 5)), cells)
    assert {(r.freq_idx, r.data) for r in forward.predict().where("freq_idx < 2").collect()} == {(0, 10.0), (1, 4.0)}
    assert Param.expression(F.lit(1.0)).axis == "expression" and literal([1.0]) is not None


def test_neural_posterior(spark):
    """Gradients against differences, and the posterior of a linear Gaussian model against its formula."""
    rng = np.random.default_rng(2)
    p = neural.NeuralPosterior.create([0.0, 1.0], [1.0, 2.0], [0.0] * 3, [1.0] * 3, (5,), 2, 1)
    theta, x = rng.normal(size=(7, 2)), rng.normal(size=(7, 3))
    loss, g = p.gradient(theta, x)
    assert np.isclose(loss, -(p.log_prob(theta, x) + np.log(2.0)).sum())
    for i in rng.choice(len(g), 12, replace=False):
        step = np.eye(len(g))[i] * 1e-6
        assert np.isclose(g[i], (p.with_flat(p.flat + step).gradient(theta, x)[0] - p.with_flat(p.flat - step).gradient(theta, x)[0]) / 2e-6, atol=1e-5)
    t = rng.normal(size=600)
    rows = [(i, [float(a)], (a + 0.5 * rng.normal(size=2)).tolist()) for i, a in enumerate(t)]
    pairs = spark.createDataFrame(rows, "draw_id long, theta array<double>, x array<double>").repartition(2)
    found, history = neural.train_posterior(pairs, (8,), 1, n_steps=60, learning_rate=0.05, every=15)
    assert history.train[-1] < history.train[0] - 0.3 and len(history.held_out) == 4
    draws = found.sample([0.8, 1.2], 4000, 3)
    assert abs(draws.mean() - 2.0 / (0.25 + 2)) < 0.15 and abs(draws.std() - (0.25 / 2.25) ** 0.5) < 0.1


def test_pairs_are_packed(spark, forward):
    found = neural.packed(engines.simulate_pairs(forward, 0.5, 3, 1, spark)).collect()
    assert len(found) == 3 and {(len(r.theta), len(r.x)) for r in found} == {(2 + T, T * N)}
