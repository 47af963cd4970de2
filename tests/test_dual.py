"""Exact derivatives of plans: against formulas, and against differences where those are the only way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import dual
from skyloom.operators import sources, transforms
from skyloom.operators.base import Param
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Forward, Latent, ParameterSpace


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("r", t, f, 60.0 * t, 60e6 + 5e6 * f, 280.0 + t if t % 2 else None, t % 2) for t in range(4) for f in range(5)]
    return spark.createDataFrame(rows, "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double, t_ambient double, receiver_input int")


def test_functions(spark):
    """Each rule against a small difference of the function itself."""
    p = dual.Point(F.array(F.lit(0.7), F.lit(1.3)), F.col("i"))
    a, b = p.get(F.lit(0)), p.get(F.lit(1))
    c = F.lit(2.5)
    made = {
        "sum": (a + b * 3 - 1 + c, lambda x, y: x + 3 * y + 1.5), "less": (2 - a - b, lambda x, y: 2 - x - y), "ratio": (a / b / c, lambda x, y: x / y / 2.5), "inverse": (1 / a, lambda x, y: 1 / x),
        "power": (a**3, lambda x, y: x**3), "to": (dual.power(c, b), lambda x, y: 2.5**y), "both": (dual.power(a, b), lambda x, y: x**y), "exp": (dual.exp(a * b), lambda x, y: np.exp(x * y)), "log": (dual.log(a), lambda x, y: np.log(x)),
        "sqrt": (dual.sqrt(a * b), lambda x, y: np.sqrt(x * y)), "waves": (dual.sin(a) * dual.cos(b), lambda x, y: np.sin(x) * np.cos(y)), "tanh": (dual.tanh(a), lambda x, y: np.tanh(x)), "clip": (dual.clip(a + b, 0.0, 1.5), lambda x, y: min(x + y, 1.5)),
        "inside": (dual.clip(a * b, -1.0, 1.5), lambda x, y: x * y), "either": (dual.either(F.lit(True), a, b), lambda x, y: x), "none": (dual.coalesce(F.lit(None).cast("double"), b), lambda x, y: y), "flat": (dual.power(a, 0), lambda x, y: 1.0),
    }
    df = spark.createDataFrame([(0,), (1,)], "i int").select("i", *(dual.slope(d).alias(n) for n, (d, _) in made.items()), *(dual.value(d).alias(f"{n}_") for n, (d, _) in made.items()))
    for r in df.collect():
        for n, (_, f) in made.items():
            x = np.array([0.7, 1.3])
            h = 1e-6 * np.eye(2)[r.i]
            assert np.isclose(r[f"{n}_"], f(*x)) and np.isclose(r[n], (f(*(x + h)) - f(*(x - h))) / 2e-6, atol=1e-8), n


def test_jacobian_against_formulas(cells):
    names = ["depth", "centre", "width", "amp", "beta", "delta", "spill", "gain"]
    space = ParameterSpace(
        [Latent("depth", 0.2), Latent("centre", 78e6), Latent("width", 3e6), Latent("amp", 180.0), Latent("beta", 2.5), Latent("delta", 0.01), Latent("spill", 0.9), Latent("gain", (1.0, 1.1, 0.9, 1.2))],
        [Bind("depth", "global_signal.depth"), Bind("centre", "global_signal.centre"), Bind("width", "global_signal.width"), Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index"), Bind("delta", "ionosphere.delta"), Bind("spill", "beam_spill.sky_fraction"), Bind("gain", "gain.gain", "time")],
    )
    plan = assemble(sources.GlobalSignal(0.2, 78e6, 3e6), sources.Foreground(180.0, 2.5), transforms.Ionosphere(0.01), transforms.BeamSpill(0.9, 290.0), transforms.Gain(Param.per_time([1.0] * 4)), transforms.Digitiser(1.0, 20))
    forward = Forward(space, plan, cells)
    j, mu = forward.jacobian(names)
    for r in forward.cells.select("time_idx", "freq_hz", j.alias("j"), mu.alias("mu")).collect():
        nu, g = r.freq_hz, [1.0, 1.1, 0.9, 1.2][r.time_idx]
        line = np.exp(-0.5 * ((nu - 78e6) / 3e6) ** 2)
        power = (nu / 75e6) ** -2.5
        thick = (nu / 75e6) ** -2
        sky = -0.2 * line + 180 * power
        seen = sky * (1 + 0.01 * thick)
        mean = 0.9 * seen + 0.1 * 290
        up = g * 0.9 * (1 + 0.01 * thick)
        u = (nu - 78e6) / 3e6
        want = [-line * up, -0.2 * line * u / 3e6 * up, -0.2 * line * u * u / 3e6 * up, power * up, -180 * power * np.log(nu / 75e6) * up, g * 0.9 * sky * thick, g * (seen - 290), *(mean if t == r.time_idx else 0.0 for t in range(4))]
        assert np.allclose(r.j, want, rtol=1e-12, atol=1e-13) and np.isclose(r.mu, g * mean, rtol=1e-13)


def test_arrays_switches_and_fallback(cells):
    """Coefficients of a basis, a switched load, a ground temperature that some cells measure, and a binding that knows columns only."""
    basis = sources.BasisTemperature(Param.expression(F.array(F.lit(0.0))), tuple((1.0, t / 4) for t in range(4)), tuple((1.0, float(f)) for f in range(5)))
    plan = assemble(basis, sources.GroundPickup(0.1, 300.0), sources.CalLoad(350.0))
    space = ParameterSpace([Latent("c", (1.0, 2.0, 3.0, 4.0)), Latent("ground", 300.0), Latent("load", 350.0)], [Bind("c", "t_sys_extra.coeff", "array"), Bind("ground", "ground_pickup.t_ground"), Bind("load", "cal_loads.t_load")])
    forward = Forward(space, plan, cells)
    for r in forward.cells.select("time_idx", "freq_idx", "receiver_input", "t_ambient", forward.jacobian()[0].alias("j")).collect():
        t, f, on = r.time_idx / 4, r.freq_idx, r.receiver_input == 0
        assert r.j == ([1.0, f, t, t * f, 0.1 if r.t_ambient is None else 0.0, 0.0] if on else [0.0] * 5 + [1.0])
    for fn, exact in ((lambda x: dual.exp(x), True), (lambda x: F.exp(x), False), (lambda x: F.col("freq_idx") * x, False), (lambda x: x * F.col("freq_idx"), True)):
        space = ParameterSpace([Latent("x", 0.5)], [Bind("x", "uniform_sky.amplitude", fn=fn)])
        forward = Forward(space, assemble(sources.UniformSky(1.0)), cells)
        assert (forward._slopes([0], [0.5]) is not None) == exact
        rows = forward.cells.select("freq_idx", forward.jacobian()[0].alias("j")).collect()
        want = [np.exp(0.5)] * 20 if fn(F.lit(1.0))._jc.toString().lower().startswith("exp") else [r.freq_idx for r in rows]
        assert np.allclose([r.j[0] for r in rows], want, rtol=1e-12 if exact else 1e-6, atol=1e-9)
