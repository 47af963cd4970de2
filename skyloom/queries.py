"""Queries of the library's own operators on the driver's tables, each with the DuckDB SQL that must give the same rows.

The waterfall is that of `events`: a recording for every 50 users, 720 hours from 2024-01-01 (all that the tables hold) by five event
types as channels of 60 to 80 MHz; a cell is the sum of the values in it. Numbers are rounded, as sums depend on their order.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import bases, processing, projection, sources, transforms
from skyloom.operators.base import KEYS, Param
from skyloom.plans.signal_path import At, assemble
from skyloom.sources.joins import as_of, interpolate
from skyloom.sources.recording import recording

# The channels.
TYPES = ["click", "error", "purchase", "signup", "view"]
FREQ_HZ = [60e6 + 5e6 * i for i in range(5)]
GAIN = [1.0 + 0.001 * (i % 100) for i in range(720)]
BAND = [0.9, 1.0, 1.1, 1.05, 0.95]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)  # for workers that share this file system
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(rec().alias("recording_id")).distinct()


def rec() -> Column:
    return F.concat(F.lit("r"), F.floor(F.col("user_id") / 50).cast("string"))


def grid(spark: SparkSession, sf_dir: str, n_time: int = 720) -> DataFrame:
    """Cells without data: every recording, sample and channel."""
    freqs = F.explode(F.array(*(F.struct(F.lit(i).alias("freq_idx"), F.lit(f).alias("freq_hz")) for i, f in enumerate(FREQ_HZ))))
    t = recordings(spark, sf_dir).withColumn("time_idx", F.explode(F.sequence(F.lit(0), F.lit(n_time - 1))))
    t = t.withColumn("f", freqs).select("recording_id", "time_idx", "f.freq_idx", (F.col("time_idx") * 3600.0).alias("time_s"), "f.freq_hz")
    return t.withColumn("t_ambient", F.when(F.col("time_idx") % 3 > 0, 280.0 + F.col("time_idx") % 24)).withColumn("receiver_input", (F.col("time_idx") % 4).cast("int"))


def hour() -> Column:
    return ((F.unix_date(F.to_date("ts")) - 19723) * 24 + F.hour("ts")).cast("int")


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("event_type")).cast("int") - 1
    sums = table(spark, sf_dir, "events").groupBy(rec().alias("recording_id"), hour().alias("time_idx"), place.alias("freq_idx")).agg(F.sum("value").alias("data"))
    return grid(spark, sf_dir).join(sums, list(KEYS), "left").withColumn("data", F.coalesce("data", F.lit(0.0)))


_REC = "'r' || (user_id // 50)"
GRID = f"""n as (select distinct {_REC} as recording_id from events),
g as (select n.recording_id, cast(t.t as int) as time_idx, cast(f.f as int) as freq_idx, t.t * 3600.0::double as time_s, (60e6 + 5e6 * f.f)::double as freq_hz,
  case when t.t % 3 > 0 then (280 + t.t % 24)::double end as t_ambient, cast(t.t % 4 as int) as receiver_input from n, range(720) t(t), range(5) f(f))"""
W = GRID + f""", e as (select {_REC} as recording_id, cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as int) as time_idx,
  cast(list_position(['click','error','purchase','signup','view'], event_type) - 1 as int) as freq_idx, sum(value) as data from events group by 1, 2, 3),
w as (select g.*, coalesce(e.data, 0)::double as data from g left join e using (recording_id, time_idx, freq_idx))"""
K = "recording_id, time_idx, freq_idx"


def cells(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*KEYS, (F.round("data", 5) + 0.0).alias("data"), *more)  # no negative zeros


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def on_grid(name: str, *ops, sql: str) -> None:
    add(name, lambda s, d: cells(assemble(*ops)(grid(s, d))), f"with {GRID} select {K}, round({sql}, 5) + 0.0 as data from g")


def on_waterfall(name: str, *ops, sql: str) -> None:
    add(name, lambda s, d: cells(assemble(*ops)(waterfall(s, d))), f"with {W} select {K}, round({sql}, 5) + 0.0 as data from w")


# --- sources -----------------------------------------------------------------
on_grid("src_uniform_sky", sources.UniformSky(1000.0), sql="1000.0::double")
on_grid("src_point_source", sources.PointSource(12.5), sql="12.5::double")
on_grid("src_global_signal", sources.GlobalSignal(0.2, 78e6, 3e6), sql="-0.2::double * exp(-0.5 * pow((freq_hz - 78e6) / 3e6, 2))")
on_grid("src_foreground", sources.Foreground(180.0, 2.5, 75e6), sql="180.0 * pow(freq_hz / 75e6, -2.5)")
on_grid("src_ground_pickup", sources.GroundPickup(0.05, 300.0), sql="0.05::double * coalesce(t_ambient, 300.0)")
on_grid("src_atmosphere", sources.Atmosphere(Param.per_freq([3.0, 2.5, 2.0, 1.5, 1.0])), sql="3.0::double - 0.5 * freq_idx")
on_grid("src_cal_load", sources.CalLoad(Param.per_time([300.0 + i / 8 for i in range(720)])), sql="300.0::double + time_idx / 8.0")
on_grid(
    "src_basis_temperature",
    sources.BasisTemperature(((1.0, 0.5), (0.25, -2.0)), tuple((1.0, i / 1024) for i in range(720)), tuple((1.0, float(j * j)) for j in range(5))),
    sql="1.0::double + 0.5 * freq_idx * freq_idx + 0.25 * time_idx / 1024.0 - 2.0 * time_idx / 1024.0 * freq_idx * freq_idx",
)
MD5 = "(('0x' || substr(md5({text}), 1, 12))::bigint / pow(16, 12))"
_CELL = "'{seed}:{name}:' || recording_id || ':' || time_idx || ':' || freq_idx"
on_grid("src_rfi_bernoulli", sources.Interference(2000.0, 0.01, seed=7), sql=f"case when {MD5.format(text=_CELL.format(seed=7, name='rfi'))} < 0.01 then 2000.0::double else 0 end")

# --- transforms --------------------------------------------------------------
_EFF = "(0.95::double + 0.01::double * freq_idx)"
# a factor of many digits, so that no product ends in a five that is rounded either way
on_waterfall("trn_ionosphere", transforms.Ionosphere(0.0133333333333), sql="data * (1 + 0.0133333333333::double * pow(freq_hz / 75e6, -2))")
on_waterfall("trn_beam_spill", transforms.BeamSpill(0.9, 290.0), sql="0.9::double * data + (1 - 0.9::double) * 290")
on_waterfall(
    "trn_antenna_loss", transforms.AntennaLoss(Param.per_freq([0.95, 0.96, 0.97, 0.98, 0.99]), 290.0),
    sql=f"{_EFF} * data + (1 - {_EFF}) * 290",
)
on_waterfall("trn_bandpass", transforms.Bandpass(Param.per_freq(BAND)), sql="data * ([0.9, 1.0, 1.1, 1.05, 0.95])[freq_idx + 1]::double")
on_waterfall("trn_gain", transforms.Gain(Param.per_time(GAIN)), sql="data * (1.0::double + 0.001::double * (time_idx % 100))")
on_waterfall("trn_emi", transforms.PeriodicLines(5.0, 2), sql="data + case when freq_idx % 2 = 0 then 5.0 else 0 end")
on_waterfall("trn_adc", transforms.Digitiser(0.5, 6), sql="greatest(-32.0::double, least(32.0::double, data * 0.5))")
_U, _V = (MD5.format(text=_CELL.format(seed=11, name=f"noise/{x}")) for x in "uv")
on_waterfall("trn_noise", transforms.Noise(0.1, seed=11), sql=f"data + 0.1::double * sqrt(-2 * ln(1 - {_U})) * cos(2 * pi() * {_V})")
add(
    "trn_cw_tone",
    lambda s, d: cells(assemble(transforms.Tone(40.0, 70e6, 5.5e6, "gaussian", drift_rate=0.5))(waterfall(s, d))),
    f"""with {W}, x as (select *, pow((freq_hz - (70e6 + 0.5 * time_s)) / 5.5e6, 2) as q from w),
y as (select *, exp(-0.5 * (q - min(q) over (partition by recording_id, time_idx))) as s from x)
select {K}, round(data + 40 * s / sum(s) over (partition by recording_id, time_idx), 5) as data from y""",
)
add(
    "trn_cw_tone_sinc",
    lambda s, d: cells(assemble(transforms.Tone(40.0, 70.3e6, 5.5e6, amplitude_drift_rate=1e-7))(waterfall(s, d))),
    f"""with {W}, x as (select *, pi() * (freq_hz - 70.3e6) / 5.5e6 as q from w),
y as (select *, case when q = 0 then 1 else pow(sin(q) / q, 2) end as s from x)
select {K}, round(data + 40 * (1 + 1e-7::double * time_s) * s / sum(s) over (partition by recording_id, time_idx), 5) as data from y""",
)
_LAYERS = (([[0.8], [-1.1]], [0.1, 0.2]), ([[0.3, -0.2]], [0.05]))
add(
    "trn_neural",
    lambda s, d: cells(assemble(At("noise", transforms.NeuralResponse(_LAYERS, 60e6, 80e6)))(waterfall(s, d))),
    f"""with {W}, x as (select *, 2 * (freq_hz - 60e6) / 20e6 - 1 as x from w)
select {K}, round(data * exp(0.05 + 0.3 * tanh(0.8 * x + 0.1) - 0.2 * tanh(-1.1 * x + 0.2)), 5) + 0.0 as data from x""",
)
add(
    "trn_custom_snapshot",
    lambda s, d: assemble(At("emi", transforms.Custom(lambda x: x * 2 + 1)), At("noise", transforms.Snapshot("raw")))(waterfall(s, d)).select(*KEYS, F.round("data", 5).alias("data"), F.round("snap_raw", 5).alias("raw")),
    f"with {W} select {K}, round(data * 2 + 1, 5) as data, round(data, 5) as raw from w",
)


def _reflections(spark: SparkSession) -> DataFrame:
    x = spark.range(15).select((F.col("id") / 5).cast("int").alias("src"), (F.col("id") % 5).cast("int").alias("freq_idx"))
    return x.select(
        "src", "freq_idx", (0.1 * F.col("src") + 0.02 * F.col("freq_idx")).alias("gs_re"), (0.05 - 0.01 * F.col("freq_idx")).alias("gs_im"),
        F.lit(0.08).alias("gr_re"), F.lit(-0.03).alias("gr_im"),
    )


add(
    "trn_noise_wave",
    lambda s, d: assemble(transforms.NoiseWave(50.0, 10.0, 5.0, 200.0, _reflections(s)))(waterfall(s, d)).select(*KEYS, F.when(~F.isnan("data"), F.round("data", 5)).alias("data")),
    f"""with {W},
a as (select *, 0.1::double * receiver_input + 0.02::double * freq_idx as sr, 0.05::double - 0.01::double * freq_idx as si, 0.08::double as rr, -0.03::double as ri from w),
b as (select *, 1 - (sr * rr - si * ri) as dr, -(sr * ri + si * rr) as di, sqrt(1 - (rr * rr + ri * ri)) as root, sr * sr + si * si as s2 from a),
c as (select *, root * dr / (dr * dr + di * di) as fr, -root * di / (dr * dr + di * di) as fi from b)
select {K}, case when receiver_input < 3 then round(data * (1 - s2) * (fr * fr + fi * fi) + 50 * s2 * (fr * fr + fi * fi)
  + 10 * (sr * fr - si * fi) + 5 * (sr * fi + si * fr) + 200, 5) end as data from c""",
)


def _by_channel(df: DataFrame) -> DataFrame:
    return df.select("freq_idx", F.round("value", 6).alias("value"))


add(
    "trn_unit_mean_bandpass", lambda s, d: _by_channel(transforms.unit_mean_bandpass(transforms.unit_mean_free(waterfall(s, d).groupBy("freq_idx").agg(F.avg("data").alias("value"))))),
    f"""with {W}, b as (select freq_idx, avg(data) as value from w group by 1) select freq_idx, round(value / (select avg(value) from b), 6) as value from b""",
)
add(
    "trn_unit_mean_free", lambda s, d: _by_channel(transforms.unit_mean_free(waterfall(s, d).groupBy("freq_idx").agg(F.avg("data").alias("value")))),
    f"""with {W}, b as (select freq_idx, avg(data) as value from w group by 1)
select freq_idx, round(value / (select avg(value) from b), 6) as value from b where freq_idx < 4""",
)

# --- composition --------------------------------------------------------------
on_grid(
    "sum_operator", sources.Foreground(180.0, 2.5), sources.GlobalSignal(0.2, 78e6, 3e6), sources.UniformSky(10.0), sources.Atmosphere(3.0),
    sql="180 * pow(freq_hz / 75e6, -2.5) - 0.2 * exp(-0.5 * pow((freq_hz - 78e6) / 3e6, 2)) + 13",
)
on_grid(
    "select_operator", sources.UniformSky(10.0), sources.CalLoad(300.0), sources.CalLoad(Param.per_freq([400.0, 401, 402, 403, 404])),
    sql="case receiver_input when 0 then 10.0::double when 1 then 300.0::double when 2 then 400.0::double + freq_idx else 0 end",
)


def _twin():
    return assemble(
        transforms.Gain(Param.per_time(GAIN)), sources.Foreground(180.0, 2.5), At("filters", processing.Sidereal("remove", 30, 720)), processing.Flag(150.0),
        sources.GroundPickup(0.05), transforms.Ionosphere(0.01), transforms.Bandpass(Param.per_freq(BAND)), sources.CalLoad(300.0), sources.CalLoad(400.0),
        processing.ApplyCalibration(Param.per_time(GAIN)),
    )


add(
    "assembled_twin",
    lambda s, d: cells(_twin()(grid(s, d)), "flag"),
    f"""with {GRID}, a as (select *, case receiver_input
  when 0 then 180 * pow(freq_hz / 75e6, -2.5) * (1 + 0.01 * pow(freq_hz / 75e6, -2)) + 0.05::double * coalesce(t_ambient, 300)
  when 1 then 300 when 2 then 400 else 0 end * ([0.9, 1.0, 1.1, 1.05, 0.95])[freq_idx + 1]::double as x,
  1.0::double + 0.001::double * (time_idx % 100) as k from g)
select {K}, round(x - avg(x) over (partition by recording_id, time_idx % 24, freq_idx), 5) + 0.0 as data, x * k > 150 as flag from a""",
)

# --- processing ---------------------------------------------------------------
add(
    "flag_threshold", lambda s, d: processing.Flag(60.0)(waterfall(s, d)).select(*KEYS, "flag"),
    f"with {W} select {K}, data > 60 as flag from w",
)


def _mask(s):
    return s.range(5).select(F.col("id").cast("int").alias("freq_idx"), (F.col("id") % 2 == 1).alias("protected"))


add(
    "protect_channels", lambda s, d: processing.Flag(60.0)(processing.protect(waterfall(s, d), _mask(s))).select(*KEYS, "flag", "protected"),
    f"with {W} select {K}, data > 60 and freq_idx % 2 = 0 as flag, freq_idx % 2 = 1 as protected from w",
)
add(
    "unflag_protected", lambda s, d: processing.unflag_protected(processing.protect(processing.Flag(60.0)(waterfall(s, d)), _mask(s))).select(*KEYS, "flag"),
    f"with {W} select {K}, data > 60 and freq_idx % 2 = 0 as flag from w",
)
add(
    "reduce_protection", lambda s, d: processing.reduce_protection(waterfall(s, d).select(*KEYS, (F.col("data") > 60).alias("protected")), 6).select(*KEYS, "protected"),
    f"with {W} select recording_id, cast(time_idx // 6 as int) as time_idx, freq_idx, bool_or(data > 60) as protected from w group by 1, 2, 3",
)
add(
    "protect_tone",
    lambda s, d: transforms.Tone(40.0, 70e6, 5.5e6, "gaussian").protect(waterfall(s, d), 0.5).select(*KEYS, "protected"),
    f"""with {W}, x as (select *, exp(-0.5 * pow((freq_hz - 70e6) / 5.5e6, 2)) as s from w)
select {K}, s >= 0.5 * max(s) over (partition by recording_id, time_idx) as protected from x""",
)
add(
    "chunk_average",
    lambda s, d: cells(processing.ChunkAverage(4)(processing.Flag(60.0)(waterfall(s, d))), "flag", F.round("time_s", 3).alias("time_s")),
    f"""with {W} select recording_id, cast(time_idx // 4 as int) as time_idx, freq_idx, round(avg(data), 5) as data, bool_or(data > 60) as flag,
round(avg(time_s), 3) as time_s from w group by 1, 2, 3""",
)
for _mode, _what in (("extract", "p"), ("remove", "data - p")):
    add(
        f"sidereal_{_mode}",
        lambda s, d, m=_mode: cells(processing.Sidereal(m, 30, 720)(waterfall(s, d))),
        f"""with {W}, x as (select *, avg(data) over (partition by recording_id, time_idx % 24, freq_idx) as p from w)
select {K}, round({_what}, 5) + 0.0 as data from x""",
    )
add(
    "fourier_band",
    lambda s, d: cells(processing.FourierBand("extract", "time", 0.03, 0.1, 720)(waterfall(s, d))),
    f"""with {W}, f as (select i, least(i, 720 - i) / 720.0::double as fr from range(720) t(i)),
k as (select n.i as lag, sum(cos(2 * pi() * fr * n.i)) / 720 as c from range(720) n(i), f where fr >= 0.03 and fr < 0.1 group by 1)
select a.recording_id, a.time_idx, a.freq_idx, round(sum(b.data * k.c), 5) + 0.0 as data
from w a join w b using (recording_id, freq_idx) join k on k.lag = (a.time_idx - b.time_idx + 720) % 720 group by 1, 2, 3""",
)
on_waterfall("apply_cal", processing.ApplyCalibration(Param.per_time(GAIN)), sql="data / (1.0::double + 0.001::double * (time_idx % 100))")


def _one_pixel(spark: SparkSession) -> DataFrame:
    return spark.range(720).select(F.col("id").cast("int").alias("time_idx"), F.lit(0).alias("pix"), (1.0 + 0.01 * F.col("id")).alias("weight"))


add(
    "sky_space_filter",
    lambda s, d: cells(processing.SkySpace("remove", _one_pixel(s), 1, 0.5)(processing.Flag(60.0)(waterfall(s, d)))),
    f"""with {W}, x as (select *, 1.0::double + 0.01::double * time_idx as p from w),
s as (select recording_id, freq_idx, coalesce(sum(p * data) filter (where data <= 60), 0) / (coalesce(sum(p * p) filter (where data <= 60), 0) + 0.5) as s from x group by 1, 2)
select x.recording_id, time_idx, x.freq_idx, round(data - p * s, 5) + 0.0 as data from x join s using (recording_id, freq_idx)""",
)

# --- ingestion ----------------------------------------------------------------
def _switch(spark, sf_dir):
    clock = F.unix_date(F.to_date("ts")) * 86400.0 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.date_format("ts", "s.SSSSSS").cast("double")
    e = table(spark, sf_dir, "events").withColumn("s", clock)
    log = e.where("event_type = 'error'").groupBy("user_id", "s").agg(F.max("event_id").alias("error_id"))
    found = as_of(e.where("event_type <> 'error'").select("user_id", "s", "event_id"), log, ["user_id"], "s", "error_id", 3600.0, 6 * 86400.0)
    return found.select("event_id", "user_id", "error_id", "settled")


add(
    "switch_asof",
    _switch,
    """with e as (select *, epoch_us(ts) / 1e6::double as s from events),
log as (select user_id, s, max(event_id) as error_id from e where event_type = 'error' group by 1, 2)
select e.event_id, e.user_id, log.error_id, e.s - log.s >= 3600 as settled
from e asof join log on e.user_id = log.user_id and e.s >= log.s where e.event_type <> 'error'""",
)


def _interpolated(spark, sf_dir):
    points = grid(spark, sf_dir).select("recording_id", (F.col("freq_hz") + 1e4 * F.col("time_idx")).alias("x")).distinct()
    by = recordings(spark, sf_dir).withColumn("xy", F.explode(F.array(*(F.struct(F.lit(58e6 + 4e6 * i).alias("x"), F.lit(i * i - 3.5).alias("y")) for i in range(9)))))
    return interpolate(points, by.select("recording_id", "xy.x", "xy.y"), ["recording_id"], "x", "y", strict=True).select("recording_id", "x", F.round("y", 6).alias("y"))


add(
    "interp_onto",
    _interpolated,
    f"""with {GRID}, p as (select distinct recording_id, freq_hz + 1e4 * time_idx as x from g), b as (select 58e6::double + 4e6 * i as x, i * i - 3.5::double as y from range(9) t(i))
select p.recording_id, p.x, round(case when a.x = c.x then a.y else a.y + (p.x - a.x) * (c.y - a.y) / (c.x - a.x) end, 6) as y
from p asof left join b a on p.x >= a.x asof left join b c on p.x <= c.x""",
)


def _switches(spark, sf_dir):
    label = F.element_at(F.array(F.lit("antenna"), F.lit("load"), F.lit("heated")), (F.col("i") % 3 + 1).cast("int"))
    log = recordings(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99))))
    return log.select("recording_id", (F.col("i") * 25000.0 + 20000).alias("switch_times"), label.alias("switch_states"))


def _recording(spark, sf_dir):
    w = waterfall(spark, sf_dir)
    row = F.transform(F.array_sort(F.collect_list(F.struct("freq_idx", "data"))), lambda x: x["data"])
    sdr = w.groupBy("recording_id", F.col("time_s").alias("sdr_times")).agg(row.alias("sdr_waterfall"))
    freqs = recordings(spark, sf_dir).withColumn("sdr_freqs", F.array(*(F.lit(f / 1e6) for f in FREQ_HZ)))
    warm = recordings(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(400))))
    warm = warm.select("recording_id", (F.col("i") * 7200.0).alias("temperature_times"), F.array(F.lit(20.0), 90.0 + 0.05 * F.col("i")).alias("temperatures"))
    return recording(sdr, freqs, _switches(spark, sf_dir), warm, freq_unit="mhz", thermistor_columns={"antenna": 0, "load": 0, "heated": 1}, settle_seconds=4000.0)


add(
    "observation",
    lambda s, d: cells(_recording(s, d).to_cells(["antenna", "load", "heated"]), "receiver_input", "flag", "time_s", "epoch_unix_s"),
    f"""with {W}, log as (select 25000.0::double * i + 20000 as at, cast(i % 3 as int) as receiver_input from range(100) t(i)),
o as (select w.recording_id, w.time_idx, w.freq_idx, data, log.receiver_input, w.time_s - log.at < 4000 as flag, w.time_s from w asof join log on w.time_s >= log.at)
select {K}, round(data, 5) as data, receiver_input, flag, time_s - min(time_s) over (partition by recording_id) as time_s,
  min(time_s) over (partition by recording_id) as epoch_unix_s from o""",
)
add(
    "thermistors", lambda s, d: _recording(s, d).thermistor("heated").select("recording_id", "time_idx", F.round("value", 5).alias("value")),
    f"with {GRID} select distinct recording_id, time_idx, round(273.15::double + 90 + 0.05 * time_s / 7200, 5) as value from g",
)
add(
    "cal_loads_of_recording", lambda s, d: cells(assemble(*_recording(s, d).cal_loads(["antenna", "heated"]).values())(grid(s, d))),
    f"""with {GRID} select {K}, round(case receiver_input when 0 then 293.15::double when 1 then 273.15::double + 90 + 0.05 * time_s / 7200 else 0 end, 5) as data from g""",
)

# --- projection and bases -------------------------------------------------------
def _matrix(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time_idx"), F.posexplode("embedding").alias("pix", "weight"))
    return m.withColumn("weight", F.col("weight").cast("double"))


def _sky(spark):
    pixels = spark.range(64).select(F.col("id").cast("int").alias("pix"), (1.0 + F.col("id") % 7).alias("amplitude"))
    return projection.power_law_sky(pixels, FREQ_HZ, 2.5, 75e6)


_MATRIX = """m as (select vec_id as time_idx, unnest(range(64)) as pix, unnest(embedding)::double as weight from embeddings),
sky as (select cast(f as int) as freq_idx, p as pix, (1.0::double + p % 7) * pow((60e6 + 5e6 * f) / 75e6, -2.5) as value from range(64) a(p), range(5) b(f))"""
add(
    "matrix_projector_forward", lambda s, d: projection.forward(_matrix(s, d), _sky(s)).select("time_idx", "freq_idx", F.round("value", 5).alias("value")),
    f"with {_MATRIX} select time_idx, freq_idx, round(sum(weight * value), 5) as value from m join sky using (pix) group by 1, 2",
)
add(
    "matrix_projector_adjoint",
    lambda s, d: projection.adjoint(_matrix(s, d), projection.forward(_matrix(s, d), _sky(s))).select("freq_idx", F.col("pix").cast("long").alias("pix"), F.round(F.col("value") / 1000, 5).alias("value")),
    f"""with {_MATRIX}, c as (select time_idx, freq_idx, sum(weight * value) as value from m join sky using (pix) group by 1, 2)
select freq_idx, pix, round(sum(weight * value) / 1000, 5) as value from m join c using (time_idx) group by 1, 2""",
)


def _chromatic(spark, sf_dir):
    scale = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.lit(1.0 + 0.1 * i).alias("s")) for i in range(5))))
    m = _matrix(spark, sf_dir).withColumn("c", scale)
    return m.select("time_idx", "pix", F.col("c.f").alias("freq_idx"), (F.col("weight") * F.col("c.s")).alias("weight"))


add(
    "sky_source", lambda s, d: projection.forward(_chromatic(s, d), projection.uniform_sky(s, 64, 5, 3.0)).select("time_idx", "freq_idx", F.round("value", 5).alias("value")),
    f"with {_MATRIX} select time_idx, freq_idx, round(sum(weight * 3 * (1 + 0.1::double * freq_idx)), 5) as value from m join sky using (pix) group by 1, 2",
)


def _beam(spark, sf_dir):
    m = _matrix(spark, sf_dir).groupBy("pix").agg(F.sum(F.col("weight") * F.col("weight")).alias("value"))
    m = m.withColumn("freq_idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return m.select("freq_idx", "pix", (F.col("pix") * 3.0 - 90).alias("elevation"), (F.col("value") * (1 + F.col("freq_idx") * F.col("pix"))).alias("value"))


_BEAM = f"{_MATRIX}, b0 as (select pix, sum(weight * weight) as v from m group by 1), b as (select cast(f as int) as freq_idx, pix, pix * 3.0::double - 90 as e, v * (1 + f * pix) as value from b0, range(5) t(f))"
_SOFT = "case when e <= 0 then 0 when e < 30 then pow(sin(pi() / 2 * e / 30), 2) else 1 end"
add(
    "truncated_beam", lambda s, d: projection.truncate_beam(_beam(s, d), 30.0)[0].select("freq_idx", F.col("pix").cast("long").alias("pix"), F.round("value", 5).alias("value")),
    f"with {_BEAM} select freq_idx, pix, round({_SOFT} * value, 5) as value from b",
)
add(
    "beam_above_horizon", lambda s, d: _by_channel(projection.truncate_beam(_beam(s, d), 30.0)[1]),
    f"with {_BEAM} select freq_idx, round(sum({_SOFT} * value) / sum(value), 6) as value from b group by 1",
)
add(
    "beam_spill_from_beam",
    lambda s, d: cells(assemble(transforms.BeamSpill.from_beam(_beam(s, d), 290.0))(waterfall(s, d))),
    f"""with {W}, {_BEAM}, s as (select freq_idx, sum(case when e > 0 then value else 0 end) / sum(value) as s from b group by 1)
select {K}, round(s * data + (1 - s) * 290, 5) as data from w join s using (freq_idx)""",
)


def _modes(s: SparkSession, d: str) -> DataFrame:
    """What the channels hold by hours of a turn, as m-modes."""
    place = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("event_type")).cast("int") - 1
    sums = table(s, d, "events").groupBy(place.alias("freq_idx"), (hour() % 6).cast("int").alias("m"))
    return sums.agg((F.sum("value") / 1000).alias("re"), (F.sum("user_id") / 10000).alias("im"))


def _turns(s: SparkSession, d: str, step: float, times: Column) -> DataFrame:
    return table(s, d, "events").select(times.cast("int").alias("time_idx")).distinct().withColumn("lst_deg", F.col("time_idx") * step)


def _by_hour(s: SparkSession, d: str) -> DataFrame:
    """A day's turn: sums by hour of the day and channel."""
    place = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("event_type")).cast("int") - 1
    return table(s, d, "events").groupBy((hour() % 24).cast("int").alias("time_idx"), place.alias("freq_idx")).agg(F.sum("value").alias("value"))


_AT = """h as (select cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as int) as t,
  cast(list_position(['click','error','purchase','signup','view'], event_type) - 1 as int) as freq_idx, value, user_id from events)"""
add(
    "mmode_synthesis", lambda s, d: projection.mmode_synthesis(_modes(s, d), _turns(s, d, 7.5, hour()), 10.0).select("time_idx", "freq_idx", F.round("value", 5).alias("value")),
    f"""with {_AT}, x as (select freq_idx, t % 6 as m, sum(value) / 1000 as re, sum(user_id) / 10000 as im from h group by 1, 2),
t as (select distinct t as time_idx, radians(t * 7.5 - 10) as phi from h)
select time_idx, freq_idx, round(sum(case when m > 0 then 2 else 1 end * (re * cos(m * phi) + im * sin(m * phi))), 5) as value from x, t group by 1, 2""",
)
add(
    "mmode_analysis", lambda s, d: projection.mmode_analysis(_by_hour(s, d), _turns(s, d, 15.0, hour() % 24), 5).select("freq_idx", "m", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im")),
    f"""with {_AT}, x as (select t % 24 as t, freq_idx, sum(value) as v from h group by 1, 2)
select freq_idx, cast(m as int) as m, round(avg(v * cos(m * radians(t * 15))), 5) + 0.0 as re, round(avg(v * sin(m * radians(t * 15))), 5) + 0.0 as im from x, range(6) b(m) group by 1, 2""",
)


def _separable():
    return bases.SeparableBasis(bases.basis_matrix("polynomial", 720, 2), bases.basis_matrix("legendre", 5, 2))


def _coefficients(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "events").groupBy((hour() % 2).cast("int").alias("k"), (F.col("user_id") % 2).cast("int").alias("j"))
    return parts.agg((F.sum("value") / 1000).alias("value"))


_AXES = "(2 * time_idx / 719.0::double - 1) as x, (freq_idx / 2.0::double - 1) as y"
add(
    "basis_expand", lambda s, d: _separable().expand(_coefficients(s, d)).select("time_idx", "freq_idx", F.round("value", 6).alias("value")),
    f"""with {_AT}, g as (select cast(t as int) as time_idx, cast(f as int) as freq_idx from range(720) a(t), range(5) b(f)), x as (select *, {_AXES} from g),
c as (select t % 2 as k, user_id % 2 as j, sum(value) / 1000 as c from h group by 1, 2)
select time_idx, freq_idx, round(sum(c * case when k = 1 then x else 1 end * case when j = 1 then y else 1 end), 6) as value from x, c group by 1, 2""",
)
add(
    "basis_fit", lambda s, d: _separable().fit(waterfall(s, d).groupBy("time_idx", "freq_idx").agg(F.sum("data").alias("value"))).select("k", "j", F.round("value", 5).alias("value")),
    f"""with {W}, x as (select {_AXES}, sum(data) as v from w group by time_idx, freq_idx)
select 0 as k, 0 as j, round(avg(v), 5) as value from x union all select 0, 1, round(sum(v * y) / sum(y * y), 5) from x
union all select 1, 0, round(sum(v * x) / sum(x * x), 5) from x union all select 1, 1, round(sum(v * x * y) / sum(x * x * y * y), 5) from x""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly waterfall and a foreground through gain, flags, averages of four hours and calibration."""
    w = waterfall(spark, sf_dir).withColumn("data", F.col("data") + 180 * F.pow(F.col("freq_hz") / 75e6, F.lit(-2.5)))
    steps = assemble(processing.ApplyCalibration(1.25), processing.ChunkAverage(4), processing.Flag(300.0), transforms.Gain(1.25))
    return cells(steps(w), "flag")


add(
    "calibrated_averages", flagship,
    f"""with {W}, x as (select *, (data + 180 * pow(freq_hz / 75e6, -2.5)) * 1.25 as x from w)
select recording_id, cast(time_idx // 4 as int) as time_idx, freq_idx, round(avg(x) / 1.25, 5) as data, bool_or(x > 300) as flag from x group by 1, 2, 3""",
)
