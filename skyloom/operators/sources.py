"""Sources: what adds to the signal, as one expression of a cell's time and frequency."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import MissingSeedError, ParameterError
from skyloom.functions import dual
from skyloom.functions.maths import dot
from skyloom.functions.random import uniform
from skyloom.operators.base import KEYS, Param, Source
from skyloom.operators.projection import forward


@dataclass(frozen=True)
class UniformSky(Source):
    amplitude: float | Param
    node = "uniform_sky"
    params = ("amplitude",)

    def column(self, p: dict[str, Column]) -> Column:
        return p["amplitude"]


@dataclass(frozen=True)
class GlobalSignal(Source):
    """A Gaussian absorption line."""

    depth: float | Param
    centre: float | Param
    width: float | Param
    node = "global_signal"
    params = ("depth", "centre", "width")

    def column(self, p):
        return -p["depth"] * dual.exp(-0.5 * dual.power((p["centre"] - F.col("freq_hz")) / p["width"], 2))


@dataclass(frozen=True)
class Foreground(Source):
    """A power law of frequency."""

    amplitude: float | Param
    spectral_index: float | Param
    ref_freq: float = 75e6
    node = "foregrounds"
    params = ("amplitude", "spectral_index")

    def __post_init__(self):
        if not self.ref_freq > 0:
            raise ParameterError("ref_freq must be above zero")

    def column(self, p):
        return p["amplitude"] * dual.power(F.col("freq_hz") / self.ref_freq, -p["spectral_index"])


@dataclass(frozen=True)
class PointSource(Source):
    level: float | Param
    node = "point_sources"
    params = ("level",)

    def column(self, p):
        return p["level"]


@dataclass(frozen=True)
class Interference(Source):
    """Bernoulli bursts, drawn by cell."""

    amplitude: float | Param
    occupancy: float
    seed: int | None = None
    node = "rfi_field"
    params = ("amplitude",)
    random = True

    def __post_init__(self):
        if not 0 <= self.occupancy <= 1:
            raise ParameterError("occupancy is a share")

    def column(self, p):
        if self.seed is None:
            raise MissingSeedError("interference needs a seed")
        return dual.either(uniform(self.seed, "rfi", *KEYS) < self.occupancy, p["amplitude"], 0.0)


@dataclass(frozen=True)
class GroundPickup(Source):
    """By the measured ambient temperature where there is one."""

    coupling: float | Param
    t_ground: float | Param = 300.0
    node = "ground_pickup"
    params = ("coupling", "t_ground")

    def column(self, p):
        return p["coupling"] * dual.coalesce(F.col("t_ambient"), p["t_ground"])


@dataclass(frozen=True)
class Atmosphere(Source):
    t_atm: float | Param
    node = "atmosphere"
    params = ("t_atm",)

    def column(self, p):
        return p["t_atm"]


@dataclass(frozen=True)
class CalLoad(Source):
    """A load that the receiver switch can select; each is a position of its own."""

    t_load: float | Param
    node = "cal_loads"
    params = ("t_load",)

    def column(self, p):
        return p["t_load"]


@dataclass(frozen=True)
class BasisTemperature(Source):
    """Sum over k and j of time basis k, coefficient (k, j) and frequency basis j.

    The bases are matrices ([time_idx][k], [freq_idx][j]) or tables (index, b array<double>), joined on the cell's indices. coeff is a
    matrix, or a column of its numbers row by row.
    """

    coeff: Sequence[Sequence[float]] | Param
    time_basis: Sequence[Sequence[float]] | DataFrame
    freq_basis: Sequence[Sequence[float]] | DataFrame
    node = "t_sys_extra"

    def attach(self, cells, prefix):
        for name, index, rows in (("bt", "time_idx", self.time_basis), ("bf", "freq_idx", self.freq_basis)):
            if not isinstance(rows, DataFrame):
                rows = cells.sparkSession.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{index} int, b array<double>")
            cells = cells.join(rows.select(index, F.col("b").alias(f"_{prefix}_{name}")), index, "left")
        flat = self.coeff.value if isinstance(self.coeff, Param) else F.array(*(F.lit(float(c)) for row in self.coeff for c in row))
        return cells, {"c": flat, "bt": F.col(f"_{prefix}_bt"), "bf": F.col(f"_{prefix}_bf")}

    def column(self, p):
        outer = F.flatten(F.transform(p["bt"], lambda t: F.transform(p["bf"], lambda f: t * f)))
        return dual.linear(lambda c: dot(c, outer), p["c"])


@dataclass(frozen=True)
class ObservedSky(Source):
    """A sky that was projected beforehand: cells with `value` (see projection.forward)."""

    sky: Param
    node = "observed_astro_sky"
    params = ("sky",)

    @staticmethod
    def of(model: DataFrame, matrix: DataFrame) -> ObservedSky:
        """A sky model (freq_idx, pix, value) through a projection matrix (see projection)."""
        return ObservedSky(Param.per_cell(forward(matrix, model)))

    def column(self, p):
        return p["sky"]
