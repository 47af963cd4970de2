"""Gradient sampling: derivatives by differences, moments of a known Gaussian, a curved plan against its density on a grid, limits of priors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
from skyloom.operators import engines, inference, sampler, sources, transforms
from skyloom.operators.base import KEYS
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Forward, Latent, Normal, ParameterSpace, Uniform

FREQ = np.array([60e6, 70e6, 80e6])


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("r", t, f, 60.0 * t, float(FREQ[f])) for t in range(2) for f in range(3)]
    return spark.createDataFrame(rows, "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double").coalesce(1).cache()


def problem(cells, space, plan, model, theta, sigma, seed):
    y = np.tile(model(*theta), (2, 1)) + np.random.default_rng(seed).normal(size=(2, 3)) * sigma
    observed = cells.select(*KEYS, F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in y)), F.col("time_idx") + 1)[F.col("freq_idx")].alias("value"))
    return engines.Problem(Forward(space, plan, cells), observed, sigma, check=False).persist(), y


def test_gradient(cells):
    space = ParameterSpace([Latent("amp", 100.0, Normal(100.0, 50.0)), Latent("beta", 2.5, Normal(2.5, 1.0))], [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index")])
    model = lambda a, b: a * (FREQ / 75e6) ** -b
    made, _ = problem(cells, space, assemble(sources.Foreground(1.0, 2.5)), model, (100.0, 2.5), 3.0, 1)
    for noise in (3.0, inference.Radiometer(1e4, 0.1, 1.0)):
        made.noise = inference.noise_model(noise)
        points = np.array([[100.0, 2.5], [90.0, 2.2], [140.0, 3.0]])
        value, gradient = sampler.value_and_gradient(made, points, [0, 1])
        assert np.allclose(value, made.log_likelihoods(points))
        for i, h in enumerate((1e-3, 1e-5)):
            step = h * np.eye(2)[i]
            rise = (made.log_likelihoods(points + step) - made.log_likelihoods(points - step)) / (2 * h)
            assert np.allclose(gradient[:, i], rise, rtol=1e-5, atol=1e-5)


def test_known_gaussian(cells):
    """An affine plan: mean and covariance of the exact posterior, halves of chains alike."""
    space = ParameterSpace([Latent("sky", 10.0, Normal(10.0, 5.0)), Latent("amp", 100.0, Normal(100.0, 30.0))], [Bind("sky", "uniform_sky.amplitude"), Bind("amp", "foregrounds.amplitude")])
    model = lambda s, a: s + a * (FREQ / 75e6) ** -2.5
    made, y = problem(cells, space, assemble(sources.UniformSky(1.0), sources.Foreground(1.0, 2.5)), model, (12.0, 110.0), 4.0, 2)
    found = sampler.GradientSampler(chains=32, draws=40, warm_up=10, leaps=3, seed=3).sample(made)
    a = np.tile(np.column_stack([np.ones(3), (FREQ / 75e6) ** -2.5]), (2, 1))
    info = a.T @ a / 16 + np.diag([1 / 25, 1 / 900])
    mean = np.linalg.solve(info, a.T @ y.ravel() / 16 + [10 / 25, 100 / 900])
    sd = np.sqrt(np.diag(np.linalg.inv(info)))
    assert (np.abs(found.mean - mean) < 0.15 * sd).all() and np.allclose(found.cov, np.linalg.inv(info), atol=0.2 * np.outer(sd, sd).max())
    assert (found.r_hat < 1.01).all() and 0.6 < found.accepted < 1 and found.draws.shape == (32, 40, 2)


def test_curved_plan(cells):
    """A spectral index that few data bend away from a Gaussian, between limits: its density on a grid."""
    space = ParameterSpace([Latent("amp", 100.0, Normal(100.0, 20.0)), Latent("beta", 2.5, Uniform(1.0, 3.2))], [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index")])
    model = lambda a, b: a * (FREQ / 75e6) ** -b
    made, y = problem(cells, space, assemble(sources.Foreground(1.0, 2.5)), model, (100.0, 2.6), 15.0, 5)
    found = sampler.GradientSampler(chains=32, draws=40, warm_up=10, leaps=4, seed=4).sample(made)
    amp, beta = np.meshgrid(np.linspace(40, 160, 400), np.linspace(1.0, 3.2, 400), indexing="ij")
    log = -0.5 * ((amp - 100) / 20) ** 2
    for t in range(2):
        for f in range(3):
            log -= 0.5 * ((y[t, f] - amp * (FREQ[f] / 75e6) ** -beta) / 15) ** 2
    p = np.exp(log - log.max())
    p /= p.sum()
    mean = np.array([(p * amp).sum(), (p * beta).sum()])
    sd = np.sqrt([(p * amp**2).sum() - mean[0] ** 2, (p * beta**2).sum() - mean[1] ** 2])
    assert (np.abs(found.mean - mean) < 0.2 * sd).all() and np.allclose(np.sqrt(np.diag(found.cov)), sd, rtol=0.15)
    assert found.draws[..., 1].min() >= 1.0 and found.draws[..., 1].max() <= 3.2 and (found.r_hat < 1.03).all()
    again = sampler.GradientSampler(chains=4, draws=4, warm_up=2, leaps=2, seed=9)
    assert np.allclose(again.sample(made).draws, again.sample(made).draws)


def test_refusals(cells):
    space = ParameterSpace([Latent("x", 1.0)], [Bind("x", "uniform_sky.amplitude", fn=lambda c: F.exp(c))])
    made, _ = problem(cells, space, assemble(sources.UniformSky(1.0)), lambda x: np.full(3, np.e), (1.0,), 1.0, 1)
    with pytest.raises(errors.ParameterError, match="exact derivative"):
        sampler.GradientSampler(chains=2, draws=4).sample(made)
    space = ParameterSpace([Latent("x", 1.0), Latent("y", 1.0)], [Bind("x", "uniform_sky.amplitude"), Bind("y", "gain.gain")])
    flat, _ = problem(cells, space, assemble(sources.UniformSky(1.0), transforms.Gain(1.0)), lambda x, y: np.full(3, x * y), (1.0, 1.0), 1.0, 1)
    with pytest.raises(errors.ParameterError, match="give them priors"):
        sampler.GradientSampler(chains=2, draws=4).sample(flat)
    with pytest.raises(errors.ParameterError):
        sampler.GradientSampler(chains=1)
