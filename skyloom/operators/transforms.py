"""Transforms of the trunk: each an expression of the cell, so that a whole signal path is one projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.errors import MissingSeedError, ParameterError
from skyloom.functions import dual
from skyloom.functions.maths import dot, sinc
from skyloom.functions.random import normal
from skyloom.operators.base import KEYS, Param, Transform


@dataclass(frozen=True)
class Ionosphere(Transform):
    delta: float | Param
    ref_freq: float = 75e6
    node = "ionosphere"
    params = ("delta",)

    def __post_init__(self):
        if not self.ref_freq > 0:
            raise ParameterError("ref_freq must be above zero")

    def column(self, x, p):
        return x * (1 + p["delta"] * F.pow(F.col("freq_hz") / self.ref_freq, -2))


@dataclass(frozen=True)
class BeamSpill(Transform):
    sky_fraction: float | Param
    t_ground: float | Param
    node = "beam_spill"
    params = ("sky_fraction", "t_ground")

    @staticmethod
    def from_beam(beam: DataFrame, t_ground: float | Param) -> BeamSpill:
        """The share of each channel's beam (freq_idx, elevation, value) that lies above the horizon."""
        above = F.sum(F.when(F.col("elevation") > 0, F.col("value")).otherwise(0.0)) / F.sum("value")
        return BeamSpill(Param.per_freq(beam.groupBy("freq_idx").agg(above.alias("value"))), t_ground)

    def column(self, x, p):
        return p["sky_fraction"] * x + (1 - p["sky_fraction"]) * p["t_ground"]


@dataclass(frozen=True)
class AntennaLoss(Transform):
    efficiency: float | Param
    t_physical: float | Param
    node = "antenna_loss"
    params = ("efficiency", "t_physical")

    def column(self, x, p):
        return p["efficiency"] * x + (1 - p["efficiency"]) * p["t_physical"]


@dataclass(frozen=True)
class NoiseWave(Transform):
    """Receiver noise waves. reflections: a table (src, freq_idx, gs_re, gs_im, gr_re, gr_im) of what source and receiver reflect.

    The source is the switch position; positions without a row give NaN.
    """

    t_unc: float | Param
    t_cos: float | Param
    t_sin: float | Param
    t_rx: float | Param
    reflections: DataFrame
    node = "noise_wave"
    params = ("t_unc", "t_cos", "t_sin", "t_rx")

    def attach(self, cells, prefix):
        cells, p = super().attach(cells, prefix)
        r = self.reflections
        gs2, gr2 = r.gs_re**2 + r.gs_im**2, r.gr_re**2 + r.gr_im**2
        # f = sqrt(1 - |gr|^2) / (1 - gs gr)
        re, im = 1 - (r.gs_re * r.gr_re - r.gs_im * r.gr_im), -(r.gs_re * r.gr_im + r.gs_im * r.gr_re)
        size = re**2 + im**2
        root = F.sqrt(1 - gr2)
        f_re, f_im = root * re / size, -root * im / size
        f2 = f_re**2 + f_im**2
        couple = F.struct(((1 - gs2) * f2).alias("s"), (gs2 * f2).alias("u"), (r.gs_re * f_re - r.gs_im * f_im).alias("c"), (r.gs_re * f_im + r.gs_im * f_re).alias("i"))
        side = r.select(F.col("src").alias("receiver_input"), "freq_idx", couple.alias(f"_{prefix}_k"))
        return cells.join(side, ["receiver_input", "freq_idx"], "left"), p | {"k": F.col(f"_{prefix}_k")}

    def column(self, x, p):
        k = p["k"]
        waves = p["t_unc"] * k["u"] + p["t_cos"] * k["c"] + p["t_sin"] * k["i"] + p["t_rx"]
        return dual.coalesce(x * k["s"] + waves, F.lit(float("nan")))


@dataclass(frozen=True)
class Tone(Transform):
    """A calibration line: its shape sums to one over the channels of each sample.

    Times count from each recording's first sample, an aggregate of the time axis that is joined back.
    """

    amplitude: float | Param
    tone_freq: float
    line_width: float
    lineshape: str = "sinc2"
    drift_rate: float = 0.0
    amplitude_drift_rate: float = 0.0
    node = "cw_tone"
    params = ("amplitude",)
    precedes = ("bandpass", "gain")

    def __post_init__(self):
        if self.lineshape not in ("sinc2", "gaussian"):
            raise ParameterError("lineshape is sinc2 or gaussian")
        if not self.line_width > 0:
            raise ParameterError("line_width must be above zero")

    def check(self, cells: DataFrame) -> None:
        """One aggregate: the line is as wide as its channels allow, stays in the band and keeps its level above zero."""
        r = cells.groupBy("recording_id").agg(F.min("freq_hz").alias("lo"), F.max("freq_hz").alias("hi"), F.count_distinct("freq_idx").alias("n"), (F.max("time_s") - F.min("time_s")).alias("span"))
        step = (F.col("hi") - F.col("lo")) / F.greatest(F.col("n") - 1, F.lit(1))
        least = step * (1.0 if self.lineshape == "sinc2" else 0.25)
        most = F.greatest(0.25 * (F.col("hi") - F.col("lo")), 2 * step)
        ends = [self.tone_freq + self.drift_rate * t for t in (F.lit(0.0), F.col("span"))]
        bad = (F.lit(self.line_width) < least) | (F.lit(self.line_width) > most)
        for f in ends:
            bad = bad | (f < F.col("lo") - step / 2) | (f > F.col("hi") + step / 2)
        bad = bad | (1 + self.amplitude_drift_rate * F.col("span") <= 0)
        if r.where(bad).head():
            raise ParameterError("the line is too narrow or wide for the channels, leaves the band, or falls to zero")

    def _since(self, cells: DataFrame, name: str) -> DataFrame:
        """cells with the seconds since the recording's first sample."""
        if not self.drift_rate and not self.amplitude_drift_rate:
            return cells.withColumn(name, F.lit(0.0))
        first = cells.groupBy("recording_id").agg(F.min("time_s").alias("_first"))
        return cells.join(first, "recording_id").withColumn(name, F.col("time_s") - F.col("_first")).drop("_first")

    def _shape(self, cells: DataFrame, name: str, since: str) -> DataFrame:
        x = (F.col("freq_hz") - (self.tone_freq + self.drift_rate * F.col(since))) / self.line_width
        sample = Window.partitionBy("recording_id", "time_idx")
        raw = F.pow(sinc(x), 2) if self.lineshape == "sinc2" else F.exp(-0.5 * (x * x - F.min(x * x).over(sample)))
        return cells.withColumn(name, raw)

    def attach(self, cells, prefix):
        cells, p = super().attach(cells, prefix)
        raw, since = f"_{prefix}_raw", f"_{prefix}_since"
        cells = self._shape(self._since(cells, since), raw, since)
        cells = cells.withColumn(f"_{prefix}_w", F.col(raw) / F.sum(raw).over(Window.partitionBy("recording_id", "time_idx")))
        return cells, {"w": F.col(f"_{prefix}_w"), "a": p["amplitude"] * (1 + self.amplitude_drift_rate * F.col(since))}

    def column(self, x, p):
        return x + p["a"] * p["w"]

    def protect(self, cells: DataFrame, floor: float) -> DataFrame:
        """Marks the cells that hold `floor` of the line's top or more as protected."""
        before = F.coalesce(F.col("protected"), F.lit(False)) if "protected" in cells.columns else F.lit(False)
        top = F.max("_w").over(Window.partitionBy("recording_id", "time_idx"))
        marked = self._shape(self._since(cells, "_since"), "_w", "_since").withColumn("protected", before | (F.col("_w") >= floor * top))
        return marked.drop("_w", "_since")


@dataclass(frozen=True)
class Bandpass(Transform):
    bandpass: float | Param
    node = "bandpass"
    params = ("bandpass",)

    def column(self, x, p):
        return x * p["bandpass"]


def unit_mean_bandpass(free: DataFrame) -> DataFrame:
    """(freq_idx, value) of all but the last channel, and the last such that the mean is 1."""
    last = free.agg((F.max("freq_idx") + 1).cast("int").alias("freq_idx"), (F.count("*") + 1 - F.sum("value")).alias("value"))
    return free.select(F.col("freq_idx").cast("int"), "value").unionByName(last)


def unit_mean_free(bandpass: DataFrame) -> DataFrame:
    """The inverse: (freq_idx, value) over its mean, without the last channel."""
    whole = bandpass.agg(F.avg("value").alias("_mean"), F.max("freq_idx").alias("_last"))
    scaled = bandpass.crossJoin(F.broadcast(whole))  # one row
    return scaled.where(F.col("freq_idx") < F.col("_last")).select("freq_idx", (F.col("value") / F.col("_mean")).alias("value"))


@dataclass(frozen=True)
class Gain(Transform):
    gain: float | Param
    node = "gain"
    params = ("gain",)

    def __post_init__(self):
        if isinstance(self.gain, Param) and self.gain.axis not in ("scalar", "time", "expression"):
            raise ParameterError("gain is a number or varies by time")

    def column(self, x, p):
        return x * p["gain"]


@dataclass(frozen=True)
class Noise(Transform):
    sigma: float | Param
    seed: int | None = None
    node = "noise"
    params = ("sigma",)
    random = True

    def column(self, x, p):
        if self.seed is None:
            raise MissingSeedError("noise needs a seed")
        return x + p["sigma"] * normal(self.seed, "noise", *KEYS)


@dataclass(frozen=True)
class PeriodicLines(Transform):
    """Adds to every period-th channel."""

    amplitude: float | Param
    period: int
    node = "emi"
    params = ("amplitude",)

    def __post_init__(self):
        if self.period < 1:
            raise ParameterError("period is one channel or more")

    def column(self, x, p):
        return x + dual.either(F.col("freq_idx") % self.period == 0, p["amplitude"], 0.0)


@dataclass(frozen=True)
class Digitiser(Transform):
    """Scales and clips; it doesn't round."""

    scale: float = 1.0
    n_bits: int = 14
    node = "adc"

    def column(self, x, p):
        top = float(2 ** (self.n_bits - 1))
        return dual.clip(x * self.scale, -top, top)


@dataclass(frozen=True)
class Custom(Transform):
    """Any expression: function takes and gives a column. It has no place of its own; say where with at."""

    function: object

    def column(self, x, p):
        return self.function(x)


@dataclass(frozen=True)
class Snapshot(Transform):
    """Keeps the signal as it is here in column snap_<name>; assemble() adds it."""

    name: str

    def column(self, x, p):
        return x


@dataclass(frozen=True)
class NeuralResponse(Transform):
    """A smooth response by channel: the exponential of a small network (tanh layers) of the frequency scaled to -1..1.

    layers: (weights, offsets) of each layer, the last with one output. The network is an expression of the channel's row alone.
    """

    layers: tuple
    f_min: float
    f_max: float

    def __post_init__(self):
        if not self.f_min < self.f_max or not self.layers:
            raise ParameterError("a response needs a band and a layer")

    @staticmethod
    def create(width: int, depth: int, f_min: float, f_max: float, seed: int) -> NeuralResponse:
        rng = np.random.default_rng(seed)
        sizes = [1, *[width] * depth, 1]
        return NeuralResponse(tuple((rng.normal(size=(n, m)) / max(1, m) ** 0.5, np.zeros(n)) for m, n in zip(sizes, sizes[1:])), f_min, f_max)

    @staticmethod
    def _unit(x: Column, last: bool):
        """Of a row of weights and its offset: the unit's value for inputs x."""
        total = lambda r: r["b"] + dot(r["w"], x)
        return total if last else lambda r: F.tanh(total(r))

    def response(self, freq_hz: Column) -> Column:
        x = F.array(2 * (freq_hz - self.f_min) / (self.f_max - self.f_min) - 1)
        for i, (w, b) in enumerate(self.layers):
            rows = F.array(*(F.struct(F.array(*(F.lit(float(v)) for v in row)).alias("w"), F.lit(float(o)).alias("b")) for row, o in zip(np.asarray(w), np.asarray(b))))
            x = F.transform(rows, self._unit(x, i == len(self.layers) - 1))
        return F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x[0])))

    def attach(self, cells, prefix):
        # once for each channel, not for each cell
        channels = cells.select("freq_idx", "freq_hz").distinct()
        side = channels.select("freq_idx", "freq_hz", self.response(F.col("freq_hz")).alias(f"_{prefix}_h"))
        return cells.join(side, ["freq_idx", "freq_hz"], "left"), {"h": F.col(f"_{prefix}_h")}

    def column(self, x, p):
        return x * p["h"]
