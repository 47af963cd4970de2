"""Harmonics of pixel tables and scans, against dense sums over pixels with harmonics written out."""

import math

import numpy as np
import pytest

from skyloom.operators import harmonics as h

LMAX, NSIDE = 5, 4


def centres(nside):
    """Colatitude and longitude of every pixel, ring by ring."""
    theta, phi = [], []
    for r in range(1, 4 * nside):
        at = min(r, 4 * nside - r)
        z = 1 - at**2 / (3 * nside**2) if at < nside else 4 / 3 - 2 * at / (3 * nside)
        n = 4 * at if at < nside else 4 * nside
        for j in range(n):
            half = 0.5 if at < nside else 0.5 * ((r - nside + 1) % 2)
            theta.append(math.acos(z if r <= 2 * nside else -z))
            phi.append(2 * math.pi * (j + half) / n)
    return np.array(theta), np.array(phi)


def ylm(l, m, theta, phi):  # noqa: E741
    """The sum over powers, by Rodrigues."""
    x = np.cos(theta)
    p = np.polynomial.Polynomial([-1, 0, 1]) ** l
    d = p.deriv(l + m) if l + m else p
    norm = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - m) / math.factorial(l + m))
    return (-1) ** m * norm / (2**l * math.factorial(l)) * np.sin(theta) ** m * d(x) * np.exp(1j * m * phi)


def turned(b, axis_to_sky, theta, phi):
    """A beam of coefficients b, turned by a rotation matrix, at directions."""
    n = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)])
    x = axis_to_sky.T @ n
    t, f = np.arccos(np.clip(x[2], -1, 1)), np.arctan2(x[1], x[0])
    return sum((1 if m == 0 else 2) * (c * ylm(l, m, t, f)).real for (l, m), c in b.items())


def pointed(lst, lat, az, el, rot):
    """Columns: the beam's axes in the sky's frame, built from directions rather than from Euler angles."""
    lst, lat, az, el, rot = np.radians([lst, lat, az, el, rot])
    up = np.array([math.cos(lat) * math.cos(lst), math.cos(lat) * math.sin(lst), math.sin(lat)])
    east = np.array([-math.sin(lst), math.cos(lst), 0])
    north = np.cross(up, east)
    level = math.cos(az) * north + math.sin(az) * east
    axis = math.cos(el) * level + math.sin(el) * up
    down = math.sin(el) * level - math.cos(el) * up  # towards the horizon
    side = np.cross(axis, down)
    return np.stack([math.cos(rot) * down + math.sin(rot) * side, -math.sin(rot) * down + math.cos(rot) * side, axis], 1)


def maps(spark, values):
    return spark.createDataFrame([(f, p, float(v)) for f, row in enumerate(values) for p, v in enumerate(row)], "freq_idx int, pix long, value double").repartition(5)


def coefficients(rng, channels=2):
    return [{(l, m): complex(rng.normal(), rng.normal() if m else 0) for l in range(LMAX + 1) for m in range(l + 1)} for _ in range(channels)]


def as_table(spark, some):
    return spark.createDataFrame([(f, l, m, c.real, c.imag) for f, b in enumerate(some) for (l, m), c in b.items()], "freq_idx int, l int, m int, re double, im double")


def test_rings(spark):
    for nside in (1, 2, 3, 16):
        n = 12 * nside**2
        theta, phi = centres(nside)
        df = spark.range(n).withColumn("ring", h.ring_of(h.F.col("id"), nside)).withColumn("start", h.ring_start(h.F.col("ring"), nside)).orderBy("id").toPandas()
        z, size, start = h.ring_geometry(df.ring.to_numpy(), nside)
        assert np.allclose(z, np.cos(theta)) and np.allclose(start + 2 * np.pi * (df.id - df.start) / size, phi)
    big = 2**20
    caps = spark.createDataFrame([(k, 2 * k * (k - 1) + d) for k in (3, 2**19, 2**20 - 1) for d in (0, 4 * k - 1)], "k long, pix long")
    assert all(r.k == r.ring for r in caps.withColumn("ring", h.ring_of(h.F.col("pix"), big)).collect())


def test_legendre():
    z = np.linspace(-0.999, 0.999, 41)
    for m in range(7):
        got = h.legendre(z, m, 9)
        for l in range(m, 10):  # noqa: E741
            assert np.allclose(got[l - m], ylm(l, m, np.arccos(z), 0).real, atol=1e-12)
    # values far too small at low l still come to their size: the functions of one order are orthonormal
    x, w = np.polynomial.legendre.leggauss(3001)
    top = h.legendre(x, 900, 2990)
    assert np.allclose(2 * np.pi * (top[[0, 1000, 2000, 2090]] * w) @ top[[0, 1000, 2000, 2090]].T, np.eye(4), atol=1e-9)
    assert np.allclose(h.legendre(np.array([1.0, -1.0]), 3, 5), 0) and np.isfinite(h.legendre(np.array([1.0]), 0, 3)).all()


def test_right_angle():
    for l, d in enumerate(h.right_angle(60)):
        assert np.allclose(d @ d.T, np.eye(2 * l + 1), atol=1e-10)
        m = np.arange(-l, l + 1)
        assert np.allclose(d, (-1.0) ** (m[:, None] - m) * d.T, atol=1e-11)
    half = h.right_angle(1)[1]  # from the textbook, m = -1, 0, 1
    assert np.allclose(half, [[0.5, 0.5**0.5, 0.5], [-(0.5**0.5), 0, 0.5**0.5], [0.5, -(0.5**0.5), 0.5]])


def test_analysis_and_synthesis(spark):
    rng = np.random.default_rng(1)
    theta, phi = centres(NSIDE)
    sky = rng.normal(size=(2, len(theta)))
    got = {(r.freq_idx, r.l, r.m): r.re + 1j * r.im for r in h.analyse(maps(spark, sky), NSIDE, LMAX).collect()}
    assert len(got) == 2 * 21
    for (f, l, m), x in got.items():
        assert abs(x - (sky[f] * ylm(l, m, theta, phi).conj()).sum()) < 1e-10
    some = coefficients(rng)
    back = {(r.freq_idx, r.pix): r.value for r in h.synthesise(as_table(spark, some), NSIDE, LMAX).collect()}
    for f, b in enumerate(some):
        want = turned(b, np.eye(3), theta, phi)
        assert np.allclose([back[f, p] for p in range(len(theta))], want, atol=1e-10)
    again = h.beam_coefficients(h.synthesise(as_table(spark, some), NSIDE, LMAX), NSIDE, LMAX, 6).collect()
    assert all(abs(r.re + 1j * r.im - some[r.freq_idx][r.l, r.m]) < 1e-3 for r in again)
    # nulls, missing and repeated pixels; no rows; a pixel that isn't there
    odd = spark.createDataFrame([(0, 3, 1.0), (0, 3, 2.0), (0, 5, None), (0, None, 1.0)], "freq_idx int, pix long, value double")
    got = {(r.l, r.m): r.re + 1j * r.im for r in h.analyse(odd, NSIDE, 2).collect()}
    assert all(abs(x - 3 * ylm(l, m, theta[3], phi[3]).conj()) < 1e-12 for (l, m), x in got.items()) and len(got) == 6
    assert h.analyse(odd.limit(0), NSIDE, 2).count() == 0
    with pytest.raises(Exception, match="no such pixel"):
        h.analyse(odd.selectExpr("freq_idx", "pix + 1000 pix", "value"), NSIDE, 2).collect()


def test_scans_against_dense_matrices(spark):
    """Forward and adjoint of both scans are a matrix and its transpose; a drift scan is the general one at rest."""
    rng = np.random.default_rng(7)
    theta, phi = centres(NSIDE)
    sky, some = rng.normal(size=(2, len(theta))), coefficients(rng)
    beam = as_table(spark, some)
    lst, az, el, rot = rng.uniform(0, 360, 12), rng.uniform(0, 360, 12), rng.uniform(-20, 90, 12), rng.uniform(0, 360, 12)
    el[0], el[1], az[2] = 90, 0, 0
    pointing = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(lst, az, el, rot))], "time_idx int, lst_deg double, az_deg double, el_deg double, selfrot_deg double").repartition(3)
    drift_at = pointing.selectExpr("time_idx", "lst_deg", "33D az_deg", "71D el_deg", "12D selfrot_deg")
    data = rng.normal(size=(12, 2))
    cells = spark.createDataFrame([(t, f, float(data[t, f])) for t in range(12) for f in range(2)], "time_idx int, freq_idx int, value double")
    for normalised in (False, True):
        general = h.GeneralPointing(beam, 51.0, NSIDE, LMAX, normalised)
        drift = h.DriftScan(beam, 51.0, 33.0, 71.0, NSIDE, LMAX, 12.0, 40.0, normalised)
        for scan, at, where in ((general, pointing, zip(lst, az, el, rot)), (general, drift_at, ((x, 33, 71, 12) for x in lst)), (drift, drift_at, ((x, 33, 71, 12) for x in lst))):
            dense = np.array([[turned(b, pointed(a, 51.0, *p), theta, phi) for b in some] for a, *p in where])
            if normalised:
                dense /= dense.sum(axis=2, keepdims=True)
            got = {(r.time_idx, r.freq_idx): r.value for r in scan.forward(maps(spark, sky), at).collect()}
            want = np.einsum("tfp,fp->tf", dense, sky)
            assert len(got) == 24 and np.allclose([[got[t, f] for f in range(2)] for t in range(12)], want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
            back = {(r.freq_idx, r.pix): r.value for r in scan.adjoint(cells, at).collect()}
            want = np.einsum("tfp,tf->fp", dense, data)
            assert np.allclose([[back[f, p] for p in range(len(theta))] for f in range(2)], want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_passes_and_refusals(spark, monkeypatch):
    beam = h.zonal_beam(spark, [1.0, 0.5, 0.25], 3)
    sky = maps(spark, np.ones((3, 48)))
    pointing = spark.createDataFrame([(0, 10.0, 0.0, 80.0), (1, 20.0, 90.0, 45.0)], "time_idx int, lst_deg double, az_deg double, el_deg double")
    scan = h.GeneralPointing(beam, -30.0, 2, 2)
    whole = sorted(map(tuple, scan.forward(sky, pointing).collect()))
    monkeypatch.setattr(h, "HELD_BYTES", 100)  # one channel a pass
    assert np.allclose(sorted(map(tuple, scan.forward(sky, pointing).collect())), whole) and len(whole) == 6
    with pytest.raises(Exception, match="az_deg isn't finite"):
        scan.forward(sky, pointing.selectExpr("time_idx", "lst_deg", "double('nan') az_deg", "el_deg")).collect()
    with pytest.raises(h.ParameterError):
        h.analyse(sky, 2, 9)
