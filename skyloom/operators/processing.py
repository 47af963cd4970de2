"""Processing of cells: flags, protection, averages, calibration and filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.errors import ParameterError, SchemaError
from skyloom.functions.maths import dot, safe_divide
from skyloom.operators.base import Param, Stage, need
from skyloom.operators.evidence import compress, solutions


def _protected(cells: DataFrame):
    return F.coalesce(F.col("protected"), F.lit(False)) if "protected" in cells.columns else F.lit(False)


@dataclass(frozen=True)
class Flag(Stage):
    """Cells above the threshold that aren't protected; earlier flags don't count. NaN is above nothing."""

    threshold: float
    node = "flagging"

    def __call__(self, cells):
        return cells.withColumn("flag", (F.col("data") > self.threshold) & ~F.isnan("data") & ~_protected(cells))


def protect(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Adds a mask, by channel or by cell, to what is protected."""
    on = [k for k in ("recording_id", "time_idx", "freq_idx") if k in mask.columns]
    if "freq_idx" not in on:
        raise SchemaError("a mask is by channel or by cell")
    joined = cells.join(mask.select(*on, F.col("protected").alias("_mask")), on, "left")
    return joined.withColumn("protected", _protected(cells) | F.coalesce("_mask", F.lit(False))).drop("_mask")


def unflag_protected(cells: DataFrame) -> DataFrame:
    return cells.withColumn("flag", F.coalesce(F.col("flag"), F.lit(False)) & ~_protected(cells))


def reduce_protection(mask: DataFrame, n_chunk: int) -> DataFrame:
    """A mask by cell for chunks of n_chunk samples, protected if any sample was; a mask by channel stays."""
    if "time_idx" not in mask.columns:
        return mask
    on = [k for k in ("recording_id", "freq_idx") if k in mask.columns]
    chunk = F.floor(F.col("time_idx") / n_chunk).cast("int").alias("time_idx")
    return mask.groupBy(*on, chunk).agg(F.bool_or("protected").alias("protected"))


@dataclass(frozen=True)
class ChunkAverage(Stage):
    """Means of n_chunk samples; flags and protection hold if they did anywhere in the chunk. Flagged cells count in the mean.

    Snapshots and the ambient temperature are averaged too; a switch position that isn't one in the chunk becomes null. A chunk that
    isn't whole is refused.
    """

    n_chunk: int
    node = "averaging"

    def __post_init__(self):
        if self.n_chunk < 1:
            raise ParameterError("a chunk is one sample or more")

    def __call__(self, cells):
        need(cells, "recording_id", "time_idx", "freq_idx", "data", "time_s")
        short = F.raise_error(F.lit(f"samples that don't fill a chunk of {self.n_chunk}")).cast("double")
        means = [F.avg(c).alias(c) for c in cells.columns if c in ("time_s", "t_ambient") or c.startswith("snap_")]
        anywhere = [F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("flag", "protected") if c in cells.columns]
        keep = [F.first(c).alias(c) for c in ("freq_hz",) if c in cells.columns]
        if "receiver_input" in cells.columns:
            keep.append(F.when(F.min("receiver_input") == F.max("receiver_input"), F.min("receiver_input")).alias("receiver_input"))
        data = F.when(F.count("*") == self.n_chunk, F.avg("data")).otherwise(short).alias("data")
        chunk = F.floor(F.col("time_idx") / self.n_chunk).cast("int").alias("time_idx")
        return cells.groupBy("recording_id", chunk, "freq_idx").agg(data, *means, *anywhere, *keep)


@dataclass(frozen=True)
class ApplyCalibration(Stage):
    gain: float | Param
    node = "apply_cal"
    params = ("gain",)

    def __call__(self, cells):
        before = cells.columns
        cells, p = self.attach(cells, "cal")
        return cells.withColumn("data", safe_divide(F.col("data"), p["gain"])).select(*before)


@dataclass(frozen=True)
class _Filter(Stage):
    mode: str = "extract"
    node = "filters"

    def __post_init__(self):
        if self.mode not in ("extract", "remove"):
            raise ParameterError("a filter extracts or removes")

    def _out(self, cells, found: str):
        return cells.withColumn("data", F.col(found) if self.mode == "extract" else F.col("data") - F.col(found)).drop(found)


@dataclass(frozen=True)
class Sidereal(_Filter):
    """The mean over days of each slot of the day; samples are those of n_days whole days."""

    n_days: int = 2
    n_time: int = 0

    def __post_init__(self):
        super().__post_init__()
        if self.n_days < 2 or self.n_time % self.n_days:
            raise ParameterError("a sidereal filter needs two whole days or more")

    def __call__(self, cells):
        slot = Window.partitionBy("recording_id", F.col("time_idx") % (self.n_time // self.n_days), "freq_idx")
        return self._out(cells.withColumn("_p", F.avg("data").over(slot)), "_p")


@dataclass(frozen=True)
class FourierBand(_Filter):
    """What lies in a band of cycles a sample, low <= |f| < high, along time or frequency.

    Each series is one group, transformed there and back once; n, where given, is the length that every series must have.
    """

    axis: str = "time"
    low: float = 0.0
    high: float = 0.5
    n: int = 0

    def __post_init__(self):
        super().__post_init__()
        if not 0 <= self.low < self.high <= 0.5 or self.axis not in ("time", "freq") or self.n < 0:
            raise ParameterError("a band is 0 <= low < high <= 0.5 along time or freq")

    def __call__(self, cells):
        index, other = ("time_idx", "freq_idx") if self.axis == "time" else ("freq_idx", "time_idx")
        low, high, n, keep = self.low, self.high, self.n, self.mode == "extract"

        def series(t: pa.Table) -> pa.Table:
            if n and t.num_rows != n:
                raise ParameterError(f"a series of {t.num_rows} samples, not {n}")
            order = np.argsort(t[index].to_numpy(), kind="stable")
            d = t["data"].to_numpy()[order]
            k = np.arange(len(d))
            f = np.minimum(k, len(d) - k) / len(d)
            band = np.fft.ifft(np.where((f >= low) & (f < high), np.fft.fft(d), 0)).real
            out = np.empty(len(d))
            out[order] = band if keep else d - band
            return t.set_column(t.column_names.index("data"), t.schema.field("data"), pa.array(out))

        return cells.withColumn("data", F.col("data").cast("double")).groupBy("recording_id", other).applyInArrow(series, cells.schema)


@dataclass(frozen=True)
class SkySpace(_Filter):
    """What a sky of n_pix pixels can explain through a projection matrix (see projection), by ridge least squares over unflagged cells.

    Each channel's samples become one triangle, merged side by side; the solved skies are joined back, one small row a channel.
    """

    matrix: DataFrame | None = None
    n_pix: int = 0
    regularization: float = 1e-6

    def __post_init__(self):
        super().__post_init__()
        if self.matrix is None or self.n_pix < 1 or not self.regularization > 0:
            raise ParameterError("a sky filter needs a matrix, pixels and a regularization above zero")

    def __call__(self, cells):
        by = ["time_idx", *(["freq_idx"] if "freq_idx" in self.matrix.columns else [])]
        entries = F.map_from_entries(F.collect_list(F.struct(F.col("pix").cast("int"), F.col("weight").cast("double"))))
        row = F.transform(F.sequence(F.lit(0), F.lit(self.n_pix - 1)), lambda i: F.coalesce(F.try_element_at("_e", i), F.lit(0.0)))
        packed = self.matrix.groupBy(*by).agg(entries.alias("_e")).select(*by, row.alias("_a"))
        seen = ~F.coalesce(F.col("flag"), F.lit(False)) if "flag" in cells.columns else F.lit(True)
        wide = cells.join(packed, by, "left").withColumn("_key", F.concat_ws("/", "freq_idx", "recording_id"))
        noise = wide.withColumn("_s", F.when(seen & F.col("_a").isNotNull(), F.lit(1.0)))
        sky = solutions(compress(noise, "_key", "_a", "data", "_s"), prior_std=self.regularization**-0.5)
        met = wide.join(sky.select(F.col("epoch").alias("_key"), F.col("x").alias("_x")), "_key", "left")
        return self._out(met.withColumn("_p", F.coalesce(dot(F.col("_a"), F.col("_x")), F.lit(0.0))), "_p").select(*cells.columns)
