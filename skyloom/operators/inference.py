"""Noise models, likelihoods and diagnostics as expressions and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.functions.maths import finite


def radiometer_noise(prediction: Column, channel_width: float, integration_time: float, floor: float = 0.0) -> Column:
    return F.greatest(F.abs(prediction), F.lit(floor)) / (channel_width * integration_time) ** 0.5


def flagged_noise(sigma: Column, flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit(float("inf"))).otherwise(sigma)


def inverse_variance(sigma: Column) -> Column:
    """1 / sigma^2; exactly 0 where sigma is null or not finite."""
    return F.when(finite(sigma), 1 / (sigma * sigma)).otherwise(0.0)


@dataclass(frozen=True)
class Homoscedastic:
    """One spread for all cells, or a column of them."""

    sigma: float | Column

    def std(self, prediction: Column) -> Column:
        return self.sigma if isinstance(self.sigma, Column) else F.lit(float(self.sigma))

    def log_slope(self, prediction: Column) -> Column:
        """The derivative of the logarithm of the spread with respect to the prediction."""
        return F.lit(0.0)


@dataclass(frozen=True)
class Radiometer:
    """A spread in proportion to the prediction."""

    channel_width: float
    integration_time: float
    floor: float = 0.0

    def __post_init__(self):
        if not (self.channel_width > 0 and self.integration_time > 0 and self.floor >= 0):
            raise ParameterError("a radiometer has a width and a time above zero")

    def std(self, prediction: Column) -> Column:
        return radiometer_noise(prediction, self.channel_width, self.integration_time, self.floor)

    def log_slope(self, prediction: Column) -> Column:
        return F.when(F.abs(prediction) > self.floor, 1 / F.when(prediction != 0, prediction)).otherwise(0.0)


@dataclass(frozen=True)
class Flagged:
    """Another model, with no information where a column says so."""

    base: Homoscedastic | Radiometer
    flag: Column

    def std(self, prediction: Column) -> Column:
        return flagged_noise(self.base.std(prediction), self.flag)

    def log_slope(self, prediction: Column) -> Column:
        return self.base.log_slope(prediction)


def noise_model(noise, flag: Column | None = None):
    """A number, a column or a model, as a model; with flags where there are any."""
    plain = isinstance(noise, (Column, int, float))
    model = Homoscedastic(noise if isinstance(noise, Column) else float(noise)) if plain else noise
    return model if flag is None else Flagged(model, flag)


def minimised(loss):
    """Marks a loss as one that gets smaller as the fit gets better."""
    loss.sense = "minimise"
    return loss


def maximised(loss):
    loss.sense = "maximise"
    return loss


def sense_of(loss) -> str:
    sense = getattr(loss, "sense", None)
    if sense is None:
        raise ParameterError("a loss says whether it is minimised or maximised")
    return sense


def check_same_cells(prediction: DataFrame, observed: DataFrame, keys: list[str]) -> None:
    """Refuses observations that aren't those of the prediction's cells, each once."""
    both = prediction.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("o")).unionByName(observed.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("o")))
    if odd := both.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("o").alias("o")).where("p <> 1 or o <> 1").head():
        raise ParameterError(f"cell {[odd[k] for k in keys]} is predicted {odd['p']} times and observed {odd['o']} times")


@maximised
def log_likelihood(prediction: Column, observed: Column, sigma: Column, include_logdet: bool = True) -> Column:
    """An aggregate: the Gaussian log density over the cells with finite sigma."""
    r = (observed - prediction) / sigma
    one = r * r + (F.log(2 * np.pi * sigma * sigma) if include_logdet else F.lit(0.0))
    return -0.5 * F.coalesce(F.sum(F.when(finite(sigma), one)), F.lit(0.0))


@minimised
def mean_squared_error(prediction: Column, observed: Column) -> Column:
    return F.avg(F.pow(prediction - observed, 2))


def normal_matrix(rows: DataFrame, columns: list[str], y: str, weight: Column, by: list[str] = ()) -> DataFrame:
    """(by, i, j, value): sums of weighted products of the columns and y (index len(columns)), upper triangle; aggregated map-side first."""
    names = [*columns, y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j]) * weight).alias(f"_{i}_{j}") for i, j in pairs]
    out = rows.groupBy(*by).agg(*sums)
    long = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("value")) for i, j in pairs))
    return out.select(*by, F.explode(long).alias("e")).select(*by, "e.*")


def split_rhat(draws: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, rhat: between and within the two halves of each trace; the middle draw of an odd number goes. Under four draws there is none."""
    whole = Window.partitionBy(*by)
    d = draws.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order))).withColumn("_n", F.count("*").over(whole))
    half = F.floor(F.col("_n") / 2)
    d = d.withColumn("_h", F.when(F.col("_i") <= half, 0).when(F.col("_i") > F.col("_n") - half, 1)).where("_h is not null")
    h = d.groupBy(*by, "_h").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    enough = F.first("n") >= 2
    return h.groupBy(*by).agg(F.when(enough, F.sqrt(((F.first("n") - 1) / F.first("n") * F.avg("v") + F.var_samp("m")) / F.avg("v"))).alias("rhat"))


def epoch_residuals(epochs: DataFrame) -> DataFrame:
    return epochs.select("epoch_id", "chi2", "dof", F.when(F.col("dof") > 0, F.col("chi2") / F.when(F.col("dof") > 0, F.col("dof"))).otherwise(F.lit(float("nan"))).alias("reduced"))


def coherent_mode(epochs: DataFrame) -> DataFrame:
    """One row: mean chi2, and z of all epochs' chi2 together."""
    return epochs.agg(F.avg("chi2").alias("mean_chi2"), ((F.sum("chi2") - F.sum("dof")) / F.sqrt(2 * F.sum("dof"))).alias("chi2_z"), F.count("*").alias("n"))


def coherent_templates(epochs: DataFrame) -> DataFrame:
    """template, mean, std (of the population), n, z: whether the epochs' residuals along each template (map templates) pull one way."""
    along = epochs.select(F.explode("templates").alias("template", "value"))
    out = along.groupBy("template").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
    return out.withColumn("z", F.col("mean") * F.sqrt("n"))


def shrinkage_power(points: DataFrame, n: str = "n", sigma: str = "sigma") -> DataFrame:
    """One row, slope: the power of n with which sigma shrinks; -0.5 if errors average down."""
    return points.where(f"{n} > 0 and {sigma} > 0").agg(F.regr_slope(F.log(sigma), F.log(n)).alias("slope"))


def shrinkage_report(points: DataFrame, by: list[str], tolerance: float = 0.1) -> DataFrame:
    """by, slope, points, averages: for each group whether sigma falls as the root of n does, within the tolerance."""
    good = points.where("n > 0 and sigma > 0")
    out = good.groupBy(*by).agg(F.regr_slope(F.log("sigma"), F.log("n")).alias("slope"), F.count("*").alias("points"))
    return out.withColumn("averages", F.abs(F.col("slope") + 0.5) <= tolerance)
