"""Recordings of a spectrometer as Parquet tables: waterfall, switch log and thermistors.

A folder holds sdr (recording_id, sdr_times, sdr_waterfall array), freqs (recording_id, sdr_freqs array), switches (recording_id,
switch_times, switch_states) and, where there are any, temperatures (recording_id, temperature_times, temperatures array).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.errors import IngestError, SchemaError
from skyloom.operators.base import Param
from skyloom.operators.sources import CalLoad
from skyloom.sources.joins import interpolate, observe

# Hertz of a unit, and the range in which channels of a receiver lie.
UNITS = {"hz": 1.0, "mhz": 1e6}
LOWEST_HZ, HIGHEST_HZ = 1e6, 1e10
KELVIN = 273.15
COLUMNS = {"sdr": ("recording_id", "sdr_times", "sdr_waterfall"), "freqs": ("recording_id", "sdr_freqs"), "switches": ("recording_id", "switch_times", "switch_states"), "temperatures": ("recording_id", "temperature_times", "temperatures")}


def _need(df: DataFrame, name: str) -> DataFrame:
    if missing := set(COLUMNS[name]) - set(df.columns):
        raise SchemaError(f"{name} lacks {sorted(missing)}")
    return df


def _checked(ok: Column, value: Column, why: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(why)).cast("double"))


@dataclass(frozen=True)
class Recording:
    """cells (recording_id, time_idx, freq_idx, time_s, freq_hz, data), log (recording_id, time_s, label) and thermistors (recording_id, time_s, kelvin array)."""

    cells: DataFrame
    log: DataFrame
    thermistors: DataFrame | None = None
    columns: Mapping[str, int] | None = None
    settle: float = 5.0

    def to_cells(self, source_order: Sequence[str]) -> DataFrame:
        """The cells with the switch's position, flags of unsettled samples, and times from each recording's first sample."""
        return observe(self.cells, self.log, list(source_order), self.settle)

    def thermistor(self, label: str) -> DataFrame:
        """(recording_id, time_idx, value): the kelvin of a label's thermistor on the time axis, without a gap."""
        if self.thermistors is None or not self.columns or label not in self.columns:
            raise IngestError(f"no thermistor for {label}")
        axis = self.cells.select("recording_id", "time_idx", "time_s").distinct()
        table = self.thermistors.select("recording_id", "time_s", F.get("kelvin", F.lit(self.columns[label])).alias("value"))
        found = interpolate(axis.select("recording_id", "time_s"), table, ["recording_id"], "time_s", "value", strict=True)
        return axis.join(found, ["recording_id", "time_s"]).select("recording_id", "time_idx", "value")

    def cal_loads(self, labels: Sequence[str] | None = None) -> dict[str, CalLoad]:
        """A calibration load for each label, as warm as its thermistor."""
        return {label: CalLoad(Param.per_time(self.thermistor(label))) for label in (labels or (self.columns or {}))}


def recording(sdr: DataFrame, freqs: DataFrame, switches: DataFrame, temperatures: DataFrame | None = None, *, freq_unit: str, thermistor_columns: Mapping[str, int] | None = None, settle_seconds: float = 5.0, thermistor_unit: str = "celsius") -> Recording:
    """Of the tables of a folder. Refuses channels outside a receiver's range, times that aren't finite or repeat, and labels without a thermistor."""
    if freq_unit not in UNITS:
        raise IngestError(f"frequencies are in {sorted(UNITS)}, not {freq_unit}")
    if thermistor_unit not in ("celsius", "kelvin"):
        raise IngestError("thermistors are in celsius or kelvin")
    hz = F.col("freq") * UNITS[freq_unit]
    f = _need(freqs, "freqs").select("recording_id", F.posexplode("sdr_freqs").alias("freq_idx", "freq"))
    f = f.select("recording_id", "freq_idx", _checked(hz.between(LOWEST_HZ, HIGHEST_HZ), hz, f"a channel outside 1 MHz to 10 GHz in {freq_unit}").alias("freq_hz"))
    t = F.col("sdr_times").cast("double")
    order = Window.partitionBy("recording_id").orderBy("sdr_times")
    ascends = F.lag("sdr_times").over(order).isNull() | (F.lag("sdr_times").over(order) < t)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    # the index comes from the time axis; a waterfall's row goes with its time
    axis = _need(sdr, "sdr").select("recording_id", "sdr_times").withColumn("time_idx", F.row_number().over(order) - 1).withColumn("time_s", _checked(finite & ascends, t, "sample times must be finite and differ"))
    rows = sdr.join(axis, ["recording_id", "sdr_times"]).select("recording_id", "time_idx", "time_s", F.posexplode("sdr_waterfall").alias("freq_idx", "data"))
    cells = rows.join(f, ["recording_id", "freq_idx"]).select("recording_id", "time_idx", "freq_idx", "time_s", "freq_hz", F.col("data").cast("double").alias("data"))
    at = F.col("switch_times").cast("double")
    log = _need(switches, "switches").select("recording_id", _checked(at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf")), at, "switch times must be finite").alias("time_s"), F.col("switch_states").cast("string").alias("label"))
    warm = None
    if temperatures is not None:
        add = KELVIN if thermistor_unit == "celsius" else 0.0
        warm = _need(temperatures, "temperatures").select("recording_id", F.col("temperature_times").cast("double").alias("time_s"), F.transform("temperatures", lambda x: x.cast("double") + add).alias("kelvin"))
        if thermistor_columns is not None and (missing := log.where(~F.col("label").isin(*thermistor_columns)).head()):
            raise IngestError(f"no thermistor for {missing.label}")
    return Recording(cells, log, warm, thermistor_columns, settle_seconds)


def read_recording(spark: SparkSession, path: str, **options) -> Recording:
    """Of a folder of Parquet tables (see the module); options as in recording()."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    warm = read("temperatures") if options.get("thermistor_columns") is not None else None
    return recording(read("sdr"), read("freqs"), read("switches"), warm, **options)
