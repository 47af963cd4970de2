"""The library's own operators: refusals, exact small cases, and every query with oracle SQL against DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import errors
from skyloom.functions.random import uniform
import skyloom.campaign_queries  # noqa: F401
from skyloom.operators import evidence, processing, projection, sources, transforms
from skyloom.operators.base import Param
from skyloom.plans.graph import SignalGraph, get_graph, register_graph
from skyloom.plans.signal_path import NODES, RECEIVER, At, Pipeline, assemble, stages_requiring_seed
from skyloom.queries import FREQ_HZ, ORACLE_SQL, QUERIES, waterfall
from skyloom.sources.joins import as_of, interpolate
from skyloom.sources.recording import recording
from skyloom.sources.touchstone import parse
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 3) + 0.0 if isinstance(v, float) else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    assert len(got) > 0
    for a, b in zip(got, sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key), strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, float(y), abs_tol=2e-3)) for x, y in zip(a, b))


def test_graph():
    assert len(NODES) == 32
    plan = assemble(transforms.Gain(2.0), sources.UniformSky(1.0))
    assert plan.lit == ["uniform_sky", "gain"] and "adc" in plan.skipped
    with pytest.raises(errors.PlanError):
        assemble(transforms.Custom(lambda x: x))
    with pytest.raises(errors.PlanError):
        assemble(transforms.Gain(1.0), transforms.Gain(2.0))
    with pytest.raises(errors.PlanError):
        assemble(At("noise", transforms.Tone(1.0, 70e6, 5e6)))
    with pytest.raises(errors.AmbiguousNodeError):
        assemble(sources.Foreground(1.0, 2.0), sources.Foreground(2.0, 2.0))["foregrounds"]


@pytest.fixture(scope="module")
def small(spark):
    """Four samples of five channels."""
    rows = [("a", t, f, t * 1.0, FREQ_HZ[f], None, t % 2) for t in range(4) for f in range(5)]
    return spark.createDataFrame(rows, "recording_id string, time_idx int, freq_idx int, time_s double, freq_hz double, t_ambient double, receiver_input int")


def test_plan(spark, small):
    g = small
    plan = assemble(sources.UniformSky(10.0), transforms.Gain(2.0), At("noise", transforms.Custom(lambda x: x + 1)), At("emi", transforms.Snapshot("raw")))
    assert {r.data for r in plan(g).collect()} == {21.0}
    assert {r.data for r in plan.without("gain")(g).collect()} == {11.0}
    assert {r.data for r in plan.replace_node("gain", transforms.Gain(3.0))(g).collect()} == {31.0}
    assert "snap_raw" in plan(g).columns
    with pytest.raises(errors.PlanError):
        plan(g.withColumn("data", F.lit(0.0)))
    with pytest.raises(errors.MissingSeedError):
        assemble(sources.UniformSky(1.0), transforms.Noise(1.0))(g)


@pytest.mark.parametrize("make", [lambda: sources.Interference(1.0, 2.0), lambda: processing.Sidereal("extract", 1, 24), lambda: processing.FourierBand("keep"), lambda: transforms.Gain(Param.per_freq([1.0])), lambda: transforms.Tone(1.0, 7e7, 0.0), lambda: processing.ChunkAverage(0)])
def test_refusals(make):
    with pytest.raises(errors.LoomError):
        make()


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(200).withColumn("u", uniform(3, "x", "id"))
    assert sorted(d.collect()) == sorted(d.repartition(7).collect())


def test_touchstone():
    text = "! c\n# MHZ S RI R 50\n60 .1 .2 .3 .4 .5 .6 .7 .8\n70 .1 .2 .3 .4 .5 .6 .7 .8"
    rows = list(parse(text, 2))
    assert rows[1] == (60e6, 2, 1, 0.3, 0.4) and rows[2][1:3] == (1, 2)
    assert next(parse("# GHZ S DB\n1 20 90", 1))[3:] == pytest.approx((0, 10))
    for bad in ("60 1 2", "# MHZ S RI\n# MHZ S RI\n", "# S RI\n1 2 3", "# MHZ S RI\n2 1 1\n1 1 1", "# MHZ S RI\n1 2", ""):
        with pytest.raises(errors.IngestError):
            list(parse(bad, 1))


def test_evidence_against_dense(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 3))
    y = x @ [1.3, -0.7, 0.4] + rnd.normal(size=300) * 0.2
    rows = spark.createDataFrame([(str(i % 12), *map(float, x[i]), float(y[i]), 0.2 if i % 7 else None) for i in range(300)], "epoch string, a double, b double, c double, y double, s double").repartition(5)
    factor = evidence.combine(evidence.compress(rows, "epoch", ["a", "b", "c"], "y", "s"), None).first()
    seen = [i for i in range(300) if i % 7]
    at = np.array([1.0, 0.5, -0.2])
    want = sum(-0.5 * ((y[i] - x[i] @ at) / 0.2) ** 2 - 0.5 * math.log(2 * math.pi * 0.04) for i in seen)
    assert factor.n_observed == len(seen)
    assert evidence.log_likelihood(factor.asDict(), at) == pytest.approx(want, rel=1e-11)


def test_regions_and_views(small):
    plan = assemble(sources.UniformSky(3.0), sources.Foreground(1.0, 2.0), sources.Foreground(2.0, 2.0), sources.CalLoad(5.0), At(("noise", "emi"), transforms.Custom(lambda x: x * 2)))
    assert len(plan.instances("foregrounds")) == 2 and plan.materialized == ["astro_sum", "receiver_input"]
    assert plan.aliased["t_ant_sum"] == "beam_spill" and "observed_astro_sky" not in plan.aliased
    with pytest.raises(errors.PlanError):
        assemble(At(("noise", "adc"), transforms.Custom(lambda x: x)))
    with pytest.raises(errors.PlanError):
        assemble(sources.UniformSky(1.0), transforms.PeriodicLines(1.0, 2), At(("noise", "emi"), transforms.Custom(lambda x: x)))
    assert "uniform_sky([uniform_sky]):::lit" in plan.to_mermaid() and plan.to_html().count("<rect") == 32
    assert get_graph("receiver") is RECEIVER and register_graph(RECEIVER) is RECEIVER
    assert stages_requiring_seed(assemble(sources.UniformSky(1.0), transforms.Noise(1.0, 3))) == ["noise"]


@pytest.mark.parametrize(
    "nodes, edges",
    [
        ({"a": "source", "b": "transform"}, (("a", "b"), ("a", "b"))),
        ({"a": "source", "b": "sum"}, (("a", "b"),)),
        ({"a": "source", "b": "transform", "c": "transform"}, (("a", "b"),)),
        ({"a": "transform", "b": "transform", "c": "transform"}, (("a", "b"), ("b", "a"))),
        ({"a": "source", "b": "odd"}, (("a", "b"),)),
    ],
)
def test_graphs_refused(nodes, edges):
    with pytest.raises(errors.PlanError):
        SignalGraph("g", nodes, edges)


def test_pipeline(small):
    p = Pipeline(transforms.Gain(2.0), transforms.Gain(3.0), processing.Flag(5.0))
    assert p.names == ["gain", "gain_2", "flagging"] and len(p) == 3
    cells = small.withColumn("data", F.lit(1.0))
    assert {(r.data, r.flag) for r in p(cells).collect()} == {(6.0, True)}
    assert {r.data for r in p.replace_stage("gain_2", transforms.Gain(1.0))(cells).collect()} == {2.0}
    assert len(p.run_with_intermediates(cells)) == 3 and p["gain"] is p[0]
    with pytest.raises(errors.PlanError):
        Pipeline(transforms.Gain(1.0), transforms.Tone(1.0, 7e7, 5e6))
    with pytest.raises(errors.PlanError):
        p["adc"]


def test_flags_and_chunks(small):
    cells = small.withColumn("data", F.when(F.col("time_idx") == 1, F.lit(float("nan"))).otherwise(F.col("time_idx") + 0.0)).withColumn("snap_raw", F.lit(4.0))
    assert {(r.time_idx, r.flag) for r in processing.Flag(1.5)(cells).collect()} == {(0, False), (1, False), (2, True), (3, True)}
    got = processing.ChunkAverage(2)(cells).where("freq_idx = 0 and time_idx = 1").first()
    assert (got.data, got.snap_raw, got.receiver_input, got.freq_hz) == (2.5, 4.0, None, 60e6)
    with pytest.raises(Exception, match="fill a chunk"):
        processing.ChunkAverage(3)(cells).collect()


def test_filters_against_dense(spark):
    w = waterfall(spark, SF).where("time_idx < 60").withColumn("flag", F.col("data") > 60)
    d = np.zeros((60, 5))
    seen = np.zeros((60, 5))
    for r in w.collect():
        d[r.time_idx, r.freq_idx], seen[r.time_idx, r.freq_idx] = r.data, not r.flag
    p = np.random.default_rng(4).normal(size=(60, 4))
    m = spark.createDataFrame([(t, i, float(p[t, i])) for t in range(60) for i in range(4)], "time_idx int, pix int, weight double")
    got = processing.SkySpace("extract", m, 4, 0.3)(w)
    want = np.stack([p @ np.linalg.solve(p.T @ (seen[:, [f]] * p) + 0.3 * np.eye(4), p.T @ (seen[:, f] * d[:, f])) for f in range(5)], axis=1)
    assert got.columns == w.columns
    for r in got.collect():
        assert math.isclose(r.data, want[r.time_idx, r.freq_idx], rel_tol=1e-9, abs_tol=1e-9)
    f = np.array([0, 1, 2, 2, 1]) / 5
    band = np.fft.ifft(np.where((f >= 0.1) & (f < 0.3), np.fft.fft(d, axis=1), 0), axis=1).real
    for r in processing.FourierBand("remove", "freq", 0.1, 0.3)(w).collect():
        assert math.isclose(r.data, (d - band)[r.time_idx, r.freq_idx], abs_tol=1e-9)


def test_tone_checks(small):
    transforms.Tone(1.0, 70e6, 5e6).check(small)
    for bad in (transforms.Tone(1.0, 70e6, 1e6), transforms.Tone(1.0, 70e6, 5e7), transforms.Tone(1.0, 90e6, 5e6), transforms.Tone(1.0, 70e6, 5e6, amplitude_drift_rate=-1.0)):
        with pytest.raises(errors.ParameterError):
            bad.check(small)


def test_projection_is_adjoint(spark):
    rng = np.random.default_rng(7)
    m = spark.createDataFrame([(t, p, f, float(x)) for t in range(3) for p in range(4) for f, x in enumerate(rng.normal(size=2))], "time_idx int, pix int, freq_idx int, weight double")
    sky = spark.createDataFrame([(f, p, float(x)) for p in range(4) for f, x in enumerate(rng.normal(size=2))], "freq_idx int, pix int, value double")
    tod = spark.createDataFrame([(t, f, float(x)) for t in range(3) for f, x in enumerate(rng.normal(size=2))], "time_idx int, freq_idx int, value double")
    dots = [a.join(b.withColumnRenamed("value", "other"), on).agg(F.sum(F.col("value") * F.col("other"))).first()[0] for a, b, on in ((projection.forward(m, sky), tod, ["time_idx", "freq_idx"]), (projection.adjoint(m, tod), sky, ["freq_idx", "pix"]))]
    assert math.isclose(*dots, rel_tol=1e-12)


def test_as_of_in_spans(spark):
    rng = np.random.default_rng(5)
    samples = spark.createDataFrame([(f"k{i % 3}", i, float(t)) for i, t in enumerate(rng.integers(0, 300, 400))], "k string, id int, t double")
    log = spark.createDataFrame([(f"k{i % 2}", float(t), i) for i, t in enumerate(sorted(set(rng.integers(20, 200, 30).tolist())))], "k string, t double, v int")
    whole, cut = (sorted(map(tuple, as_of(samples, log, ["k"], "t", "v", 3.0, span).collect())) for span in (None, 10.0))
    assert whole == cut and len(whole) > 100


def test_strict_interpolation(spark):
    table = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 5.0)], "k string, x double, y double")
    at = lambda *x: spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    got = interpolate(at(0, 0.5, 2 + 1e-10), table, ["k"], "x", "y", strict=True)
    assert [r.y for r in got.orderBy("x").collect()] == [1.0, 2.0, 5.0]
    with pytest.raises(Exception, match="outside"):
        interpolate(at(2.1), table, ["k"], "x", "y", strict=True).collect()
    with pytest.raises(Exception, match="finite"):
        interpolate(at(1.0), table.union(at(1.0).withColumn("y", F.lit(float("nan")))), ["k"], "x", "y", strict=True).collect()


def test_recording_refusals(spark):
    sdr = spark.createDataFrame([("a", 0.0, [1.0, 2.0]), ("a", 1.0, [3.0, 4.0])], "recording_id string, sdr_times double, sdr_waterfall array<double>")
    freqs = spark.createDataFrame([("a", [60.0, 70.0])], "recording_id string, sdr_freqs array<double>")
    log = spark.createDataFrame([("a", 0.0, "sky")], "recording_id string, switch_times double, switch_states string")
    rows = recording(sdr, freqs, log, freq_unit="mhz").to_cells(["sky"]).orderBy("time_idx", "freq_idx").collect()
    assert [(r.data, r.freq_hz, r.receiver_input, r.flag) for r in rows] == [(1.0, 6e7, 0, True), (2.0, 7e7, 0, True), (3.0, 6e7, 0, True), (4.0, 7e7, 0, True)]
    with pytest.raises(errors.IngestError):
        recording(sdr, freqs, log, freq_unit="ghz")
    with pytest.raises(Exception, match="channel outside"):
        recording(sdr, freqs, log, freq_unit="hz").cells.collect()
    with pytest.raises(Exception, match="no place"):
        recording(sdr, freqs, log, freq_unit="mhz").to_cells(["load"]).collect()
    with pytest.raises(Exception, match="finite"):
        recording(sdr.withColumn("sdr_times", F.lit(float("nan"))), freqs, log, freq_unit="mhz").cells.collect()
    with pytest.raises(errors.IngestError):
        recording(sdr, freqs, log, freq_unit="mhz").thermistor("sky")
