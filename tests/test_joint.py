"""Joint priors: in solutions, blocks with others held, fits, information, draws and densities, against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
from skyloom.operators import engines, linear, sampler, sources, uncertainty
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Forward, Joint, Latent, Normal, ParameterSpace

FREQ = np.array([60e6, 70e6, 80e6])
MEAN, COV = np.array([100.0, 8.0]), np.array([[400.0, -30.0], [-30.0, 9.0]])
BINDS = [Bind("sky", "uniform_sky.amplitude"), Bind("amp", "foregrounds.amplitude"), Bind("point", "point_sources.level")]
SPACE = ParameterSpace([Latent("sky", 9.0), Latent("amp", 110.0), Latent("point", 2.0, Normal(1.0, 2.0))], BINDS, [Joint(["amp", "sky"], MEAN, COV)])
#: In the order of the space: sky, amp, point.
PRIOR = np.zeros((3, 3))
PRIOR[np.ix_([1, 0], [1, 0])] = np.linalg.inv(COV)
PRIOR[2, 2] = 0.25
CENTRE = np.array([8.0, 100.0, 1.0])
A = np.tile(np.column_stack([np.ones(3), (FREQ / 75e6) ** -2.5, np.ones(3)]), (2, 1))


@pytest.fixture(scope="module")
def made(spark):
    rows = [("r", t, f, 60.0 * t, float(FREQ[f])) for t in range(2) for f in range(3)]
    cells = spark.createDataFrame(rows, "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double").coalesce(1)
    y = A @ [12.0, 90.0, 3.0] + np.random.default_rng(2).normal(size=6) * 4
    seen = spark.createDataFrame([("r", t, f, float(y[3 * t + f])) for t in range(2) for f in range(3)], "recording_id string, time_idx int, freq_idx int, value double")
    return Forward(SPACE, assemble(sources.UniformSky(1.0), sources.Foreground(1.0, 2.5), sources.PointSource(1.0)), cells), seen, y


def test_solutions(made):
    forward, seen, y = made
    info, push = A.T @ A / 16 + PRIOR, A.T @ y / 16 + PRIOR @ CENTRE
    x, cov = linear.solve_block(linear.linear_operator(forward, ["sky", "amp", "point"]), seen, 4.0)
    assert np.allclose(x, np.linalg.solve(info, push)) and np.allclose(cov, np.linalg.inv(info))
    # one of them, the others held: the prior given these
    at = np.array([5.0, 130.0, 0.0])
    for name, i in (("sky", 0), ("amp", 1)):
        x, cov = linear.solve_block(linear.linear_operator(forward, name, at), seen, 4.0)
        rest = [k for k in range(3) if k != i]
        assert np.allclose(cov, 1 / info[i, i]) and np.allclose(x, (push[i] - info[i, rest] @ at[rest]) / info[i, i])
    found = uncertainty.fisher_information(forward, 4.0, prior=True)
    assert np.allclose(found.value, info)
    assert np.isclose(SPACE.log_prior(at), -0.5 * (at - CENTRE) @ PRIOR @ (at - CENTRE) + 0.5 * np.linalg.slogdet(PRIOR / (2 * np.pi))[1])


def test_fits(made):
    """Sweeps of single latents and a sampler get to the whole posterior."""
    forward, seen, y = made
    problem = engines.Problem(forward, seen, 4.0).persist()
    info = A.T @ A / 16 + PRIOR
    mean, sd = np.linalg.solve(info, A.T @ y / 16 + PRIOR @ CENTRE), np.sqrt(np.diag(np.linalg.inv(info)))
    drawn = sampler.GradientSampler(chains=24, draws=30, warm_up=8, leaps=3, seed=1).sample(problem)
    assert (np.abs(drawn.mean - mean) < 0.2 * sd).all() and np.allclose(drawn.cov, np.linalg.inv(info), atol=0.25 * np.outer(sd, sd).max())
    with pytest.raises(errors.ParameterError):
        engines.prior_sensitivity(problem, ["amp"])


def test_draws(spark):
    from skyloom.functions.random import normal

    found = np.array([r.theta for r in SPACE.draws(spark, 4000, 3).collect()])
    root = np.linalg.cholesky(COV)
    assert np.allclose(found.mean(axis=0), CENTRE, atol=5 * np.sqrt(np.array([9, 400, 4]) / 4000).max())
    assert np.allclose(np.cov(found[:, [1, 0]].T), COV, rtol=0.12, atol=2)
    z = spark.range(4000).select(normal(3, "amp/0", F.col("id")).alias("a"), normal(3, "sky/0", F.col("id")).alias("b")).toPandas().to_numpy()
    assert np.allclose(found[:, [1, 0]], MEAN + z @ root.T)


def test_refusals():
    latents = [Latent("sky", 9.0), Latent("amp", 110.0), Latent("point", 2.0, Normal(1.0, 2.0))]
    for bad in (
        lambda: Joint(["amp", "sky"], MEAN, -COV), lambda: Joint(["amp", "sky"], MEAN, [[1.0, 2.0], [0.0, 1.0]]), lambda: Joint(["amp"], MEAN, [[1.0]]), lambda: Joint(["amp", "sky"], MEAN, [[1.0, 1.0], [1.0, 1.0]]),
        lambda: ParameterSpace(latents, BINDS, [Joint(["amp", "point"], MEAN, COV)]), lambda: ParameterSpace(latents, BINDS, [Joint(["amp", "none"], MEAN, COV)]),
        lambda: ParameterSpace(latents, BINDS, [Joint(["amp", "sky"], MEAN, COV), Joint(["amp"], [1.0], [[1.0]])]), lambda: ParameterSpace(latents, BINDS, [Joint(["amp"], MEAN, COV)]),
    ):
        with pytest.raises(errors.ParameterError):
            bad()
