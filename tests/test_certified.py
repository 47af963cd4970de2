"""Compression by a reduced basis whose frozen noise and nuisances are measured over the support."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
from skyloom.operators import evidence, inference, reduced, sources
from skyloom.operators.base import KEYS
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Forward, Latent, ParameterSpace

FREQ = np.array([60e6, 65e6, 70e6, 75e6, 80e6])
SPACE = ParameterSpace([Latent("amp", 100.0), Latent("beta", 2.5)], [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index")])
SUPPORT = {"amp": (98.0, 103.0), "beta": (2.45, 2.52)}


@pytest.fixture(scope="module")
def bank(spark):
    rng = np.random.default_rng(4)
    rows = [("r", t, f, 60.0 * t, float(FREQ[f])) for t in range(6) for f in range(5)]
    cells = spark.createDataFrame(rows, "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double")
    y = 100 * (FREQ / 75e6) ** -2.5 + rng.normal(size=(6, 5)) * 3
    seen = spark.createDataFrame([("r", t, f, float(y[t, f]), f"n{t // 2}") for t in range(6) for f in range(5)], "recording_id string, time_idx int, freq_idx int, value double, night string")
    return Forward(SPACE, assemble(sources.Foreground(100.0, 2.5)), cells), seen, y


def mu(amp, beta):
    return amp * (FREQ / 75e6) ** -beta


def test_frozen_gaps(bank):
    forward, seen, y = bank
    noise = inference.Radiometer(1.0, 1000.0, 1.0)
    got = {r.epoch: r.frozen_gap for r in reduced.frozen_gaps(forward, seen, "night", noise, SUPPORT).collect()}
    root = 1000**0.5
    for n in range(3):
        gaps = []
        for amp, beta in ((100, 2.5), (98, 2.5), (103, 2.5), (100, 2.45), (100, 2.52)):
            m, s0, s = mu(amp, beta), mu(100, 2.5) / root, mu(amp, beta) / root
            d = y[2 * n : 2 * n + 2] - m
            gaps.append(abs((-0.5 * (d / s0) ** 2 - np.log(s0) + 0.5 * (d / s) ** 2 + np.log(s)).sum()))
        assert np.isclose(got[f"n{n}"], max(gaps), rtol=1e-9)
    assert all(r.frozen_gap == 0 for r in reduced.frozen_gaps(forward, seen, "night", 3.0, SUPPORT).collect())
    holes = seen.withColumn("value", F.when(F.col("freq_idx") > 0, F.col("value")))
    assert all(r.frozen_gap > 0 for r in reduced.frozen_gaps(forward, holes, "night", noise, SUPPORT).collect())
    with pytest.raises(errors.ParameterError):
        reduced.frozen_gaps(forward, seen, "night", noise, {"amp": (3.0, 3.0)})


def test_certified(bank):
    """A good bank gives the likelihood of its model; one whose noise moves, or whose nuisance the basis can't hold, is refused."""
    forward, seen, y = bank
    noise = inference.Radiometer(1.0, 1000.0, 1.0)
    sigma = mu(100, 2.5) / 1000**0.5
    scores = np.array([mu(100, 2.5) / 100, -mu(100, 2.5) * np.log(FREQ / 75e6), np.ones(5)])
    basis = reduced.ReducedBasis(reduced.orthonormal(scores / sigma), sigma, 0.0)
    good = reduced.compress_certified(forward, seen, "night", basis, noise, SUPPORT, 100.0, nuisance={"flat": np.ones(5)}, nuisance_std={"flat": 4.0}).orderBy("epoch").collect()
    assert [r.epoch for r in good] == ["n0", "n1", "n2"] and all(r.frozen_gap > 0 and r.fingerprint == basis.fingerprint for r in good)
    for n, r in enumerate(good):
        cov = np.kron(np.eye(2), np.diag(sigma**2)) + 16.0  # one amount of the nuisance for all cells of an epoch
        m = mu(100.4, 2.5)
        d = (y[2 * n : 2 * n + 2] - m).ravel()
        want = -0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1]
        assert np.isclose(reduced.reduced_log_likelihood(r, basis, m), want, atol=1e-6)
    with pytest.raises(errors.ParameterError, match="freezing the noise costs"):
        reduced.compress_certified(forward, seen, "night", basis, noise, SUPPORT, 1e-3)
    with pytest.raises(errors.ParameterError, match="nats"):  # a place without a number is no good bank
        reduced.compress_certified(forward, seen.withColumn("value", F.when(F.col("time_idx") > 0, F.col("value")).otherwise(float("nan"))), "night", basis, noise, SUPPORT, 100.0)
    with pytest.raises(errors.ParameterError, match="nuisance wave lies outside"):
        reduced.compress_certified(forward, seen, "night", basis, noise, SUPPORT, 100.0, nuisance={"wave": np.array([1.0, -1, 1, -1, 1])}, nuisance_std={"wave": 1.0})
    with pytest.raises(errors.ParameterError, match="a spectrum and a spread"):
        reduced.compress_certified(forward, seen, "night", basis, noise, SUPPORT, 100.0, nuisance={"flat": np.ones(5)})
    assert evidence.combine(reduced.compress_certified(forward, seen, "night", basis, noise, SUPPORT, 100.0), None).first().n_observed == 30
