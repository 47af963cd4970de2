"""Parameters on a named axis, and the operators' common shape.

A parameter says by what it varies, so an operator can't take a row for a column: scalar, by frequency, by time or by cell, or it is an
expression of the cell's own columns. Tables of parameters are joined on their keys; Spark broadcasts those it knows to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from skyloom.errors import SchemaError

KEYS = ("recording_id", "time_idx", "freq_idx")
#: Lists up to this long are literals in the plan; longer ones are tables.
LITERALS = 32


def indexed(values: Sequence, index: str, session) -> DataFrame:
    """(index, value) of a list that the driver holds, as a table."""
    kind = StructType().add(index, IntegerType()).add("value", DoubleType())
    return session.createDataFrame([(i, float(v)) for i, v in enumerate(values)], kind)


@dataclass(frozen=True)
class Param:
    """value: a number, a list by index of the axis, a table with the axis keys and `value`, or (axis expression) a column."""

    value: float | Sequence[float] | DataFrame | Column
    axis: str = "scalar"

    @staticmethod
    def of(x: Param | float) -> Param:
        return x if isinstance(x, Param) else Param(float(x))

    @staticmethod
    def per_freq(x) -> Param:
        return Param(x, "freq")

    @staticmethod
    def per_time(x) -> Param:
        return Param(x, "time")

    @staticmethod
    def per_cell(x) -> Param:
        return Param(x, "cell")

    @staticmethod
    def expression(x: Column) -> Param:
        return Param(x, "expression")

    def attach(self, cells: DataFrame, name: str) -> tuple[DataFrame, Column]:
        """cells with what the parameter needs, and its column."""
        if self.axis == "expression":
            return cells, self.value
        if self.axis == "scalar":
            return cells, F.lit(float(self.value))
        table = self.value
        if not isinstance(table, DataFrame):
            index = {"freq": "freq_idx", "time": "time_idx"}[self.axis]
            if len(table) <= LITERALS:
                return cells, F.element_at(F.array(*(F.lit(float(v)) for v in table)), F.col(index).cast("int") + 1)
            table = indexed(table, index, cells.sparkSession)
        want = {"freq": ("freq_idx",), "time": ("time_idx",), "cell": ("time_idx", "freq_idx")}[self.axis]
        on = [k for k in ("recording_id", *want) if k in table.columns]
        if missing := set(want) - set(on):
            raise SchemaError(f"a parameter by {self.axis} needs {sorted(missing)}")
        side = table.select(*on, F.col("value").cast("double").alias(name))
        return cells.join(side, on, "left"), F.col(name)


class Operator:
    """node: the place in the signal path; params: the names of fields that are parameters; random: whether a seed is needed."""

    node: str | None = None
    kind = "transform"
    params: tuple[str, ...] = ()
    random = False
    precedes: tuple[str, ...] = ()

    def attach(self, cells: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, Column]]:
        out = {}
        for name in self.params:
            cells, out[name] = Param.of(getattr(self, name)).attach(cells, f"_{prefix}_{name}")
        return cells, out


class Source(Operator):
    kind = "source"

    def column(self, p: dict[str, Column]) -> Column:
        raise NotImplementedError


class Transform(Operator):
    """A transform that is an expression of the cell alone."""

    def column(self, x: Column, p: dict[str, Column]) -> Column:
        raise NotImplementedError

    def __call__(self, cells: DataFrame) -> DataFrame:
        before = cells.columns
        cells, p = self.attach(cells, "own")
        return cells.withColumn("data", self.column(F.col("data"), p)).select(*dict.fromkeys([*before, "data"]))


class Stage(Operator):
    """A step of processing: cells to cells."""

    def __call__(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError


def need(cells: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in cells.columns]:
        raise SchemaError(f"cells lack {missing}")
