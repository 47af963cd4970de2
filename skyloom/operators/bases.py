"""Smooth functions of an axis as tables, and coefficients of products of two of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import dot


def basis_matrix(kind: str, n: int, n_basis: int) -> np.ndarray:
    """n places by n_basis functions: legendre or polynomial on -1..1, or fourier (1, cos, sin, ...) over one period."""
    if not 0 < n_basis <= n:
        raise ParameterError(f"{n_basis} functions of {n} places")
    x = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    if kind == "legendre":
        return np.polynomial.legendre.legvander(x, n_basis - 1)
    if kind == "polynomial":
        return np.polynomial.polynomial.polyvander(x, n_basis - 1)
    if kind == "fourier":
        turn = 2 * np.pi * np.arange(n) / n
        waves = [f((k + 1) * turn) for k in range(n_basis // 2) for f in (np.cos, np.sin)]
        return np.column_stack([np.ones(n), *waves])[:, :n_basis]
    raise ParameterError(f"no basis {kind}")


@dataclass(frozen=True)
class SeparableBasis:
    """Products of functions of time and of frequency. Matrices are as long as their axis, which the driver holds."""

    time: np.ndarray
    freq: np.ndarray

    def table(self, spark: SparkSession, axis: str) -> DataFrame:
        """(index, b): the functions at each place of an axis, an array a row."""
        m = self.time if axis == "time" else self.freq
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{axis}_idx int, b array<double>")

    def expand(self, coeff: DataFrame) -> DataFrame:
        """(time_idx, freq_idx, value) of coefficients (k, j, value)."""
        spark = coeff.sparkSession
        width = self.freq.shape[1]
        rows = F.map_from_entries(F.collect_list(F.struct((F.col("k") * width + F.col("j")).cast("int"), F.col("value").cast("double"))))
        n = self.time.shape[1] * width
        flat = coeff.agg(rows.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("c"))
        t, f = self.table(spark, "time").withColumnRenamed("b", "bt"), self.table(spark, "freq").withColumnRenamed("b", "bf")
        grid = t.crossJoin(F.broadcast(f.crossJoin(F.broadcast(flat))))  # every place of the grid; channels and coefficients are short
        outer = F.flatten(F.transform("bt", lambda a: F.transform("bf", lambda b: a * b)))
        return grid.select("time_idx", "freq_idx", dot(F.col("c"), outer).alias("value"))

    def fit(self, values: DataFrame) -> DataFrame:
        """(k, j, value): least squares of values (time_idx, freq_idx, value) on the whole grid."""
        spark = values.sparkSession
        inverse = SeparableBasis(np.linalg.pinv(self.time).T, np.linalg.pinv(self.freq).T)
        met = values.join(F.broadcast(inverse.table(spark, "freq").withColumnRenamed("b", "bf")), "freq_idx")
        by_time = met.select("time_idx", F.posexplode("bf").alias("j", "f"), "value").groupBy("time_idx", "j").agg(F.sum(F.col("f") * F.col("value")).alias("v"))
        over = by_time.join(inverse.table(spark, "time").withColumnRenamed("b", "bt"), "time_idx")
        return over.select("j", F.posexplode("bt").alias("k", "t"), "v").groupBy("k", "j").agg(F.sum(F.col("t") * F.col("v")).alias("value"))
