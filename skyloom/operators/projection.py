"""Linear maps between sky pixels and cells, as joins: forward sums over pixels, adjoint over samples.

A matrix is a table (time_idx, pix, weight), with freq_idx too if beams differ by channel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(matrix: DataFrame, *keys: str) -> list[str]:
    return [*keys, *(["freq_idx"] if "freq_idx" in matrix.columns else [])]


def forward(matrix: DataFrame, sky: DataFrame) -> DataFrame:
    """(time_idx, freq_idx, value): sum over pix of the matrix times sky (freq_idx, pix, value)."""
    met = matrix.join(sky, _on(matrix, "pix"))
    return met.groupBy("time_idx", "freq_idx").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def adjoint(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """(freq_idx, pix, value): sum over time_idx of the matrix times cells (time_idx, freq_idx, value)."""
    met = matrix.join(cells, _on(matrix, "time_idx"))
    return met.groupBy("freq_idx", "pix").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def uniform_sky(spark, n_pix: int, n_freq: int, amplitude: float) -> DataFrame:
    """(freq_idx, pix, value): the same everywhere."""
    pix = spark.range(n_pix).select(F.explode(F.sequence(F.lit(0), F.lit(n_freq - 1))).alias("freq_idx"), F.col("id").cast("int").alias("pix"))
    return pix.withColumn("value", F.lit(float(amplitude)))


def power_law_sky(pixels: DataFrame, freq_hz: list[float], spectral_index: float, ref_freq: float) -> DataFrame:
    """(freq_idx, pix, value): amplitude (freq / ref) ** -index of pixels (pix, amplitude), for each channel."""
    factors = ((i, (f / ref_freq) ** -spectral_index) for i, f in enumerate(freq_hz))
    channels = F.array(*(F.struct(F.lit(i).alias("freq_idx"), F.lit(x).alias("factor")) for i, x in factors))
    return pixels.withColumn("c", F.explode(channels)).select("c.freq_idx", "pix", (F.col("amplitude") * F.col("c.factor")).alias("value"))


def truncate_beam(beam: DataFrame, apod_deg: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """beam (freq_idx, pix, elevation in degrees, value) cut at the horizon, softly over apod_deg above it; and the share of each channel kept."""
    e = F.col("elevation")
    soft = F.pow(F.sin(math.pi / 2 * e / apod_deg), 2) if apod_deg else F.lit(1.0)
    weight = F.when(e <= 0, 0.0).when(e < apod_deg, soft).otherwise(1.0)
    cut = beam.withColumn("_w", weight)
    share = cut.groupBy("freq_idx").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("value")).alias("value"))
    return cut.withColumn("value", F.col("_w") * F.col("value")).drop("_w"), share


def mmode_synthesis(mmodes: DataFrame, times: DataFrame, ref_deg: float = 0.0) -> DataFrame:
    """(time_idx, freq_idx, value) of a drift scan: mmodes (freq_idx, m, re, im) turned by times (time_idx, lst_deg).

    The real signal of modes m >= 0, those above zero standing for their conjugates too. A channel's modes are gathered to one row, which meets the
    times of that channel by its key, in parts; every cell is one expression.
    """
    modes = mmodes.groupBy("freq_idx").agg(F.collect_list(F.struct("m", "re", "im")).alias("modes"))
    channels = [r[0] for r in mmodes.select("freq_idx").distinct().collect()]  # as many as channels
    parts = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.radians(F.col("lst_deg") - ref_deg)

    def wave(x: Column) -> Column:
        twice = F.when(x["m"] > 0, 2.0).otherwise(1.0)
        return twice * (x["re"] * F.cos(x["m"] * turn) + x["im"] * F.sin(x["m"] * turn))

    each = F.explode(F.array(*(F.lit(c) for c in channels)) if channels else F.array().cast("array<int>"))
    dealt = times.withColumn("freq_idx", each).withColumn("_part", F.pmod(F.xxhash64("time_idx"), F.lit(parts)))
    met = dealt.join(modes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["freq_idx", "_part"])
    total = F.aggregate(F.transform("modes", wave), F.lit(0.0), lambda a, x: a + x)
    return met.select("time_idx", "freq_idx", total.alias("value"))


def mmode_analysis(cells: DataFrame, times: DataFrame, m_max: int, ref_deg: float = 0.0) -> DataFrame:
    """(freq_idx, m, re, im) of cells (time_idx, freq_idx, value) over a uniform full turn of times: what mmode_synthesis takes."""
    turn = F.radians(F.col("lst_deg") - ref_deg)
    met = cells.join(times, "time_idx").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(m_max))))
    phase = F.col("m") * turn
    return met.groupBy("freq_idx", "m").agg(F.avg(F.col("value") * F.cos(phase)).alias("re"), F.avg(F.col("value") * F.sin(phase)).alias("im"))
