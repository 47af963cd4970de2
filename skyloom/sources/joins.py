"""As-of and interpolation joins: a union and windows, so that neither side is held whole in a task.

A long key can be cut into spans of its time: each span has a window of its own, and what the one before ends with is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.errors import IngestError, SchemaError

#: Seconds of a recording that one task takes at a time.
SPAN = 86_400.0


def _carried(rows: DataFrame, by: list[str], order: list, at: Column, span: Column | None) -> DataFrame:
    """rows with _last: the last value of `at` that isn't null up to each row, by key."""
    if span is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_last", F.last(at, ignorenulls=True).over(w))
    rows = rows.withColumn("_span", span)
    w = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_span").agg(F.max_by(at, F.when(at.isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row for each span
    ends = ends.select(*by, "_span", F.last("_end", ignorenulls=True).over(before).alias("_end"))
    return rows.withColumn("_last", F.last(at, ignorenulls=True).over(w)).join(ends, [*by, "_span"]).withColumn("_last", F.coalesce("_last", "_end")).drop("_end", "_span")


def as_of(samples: DataFrame, log: DataFrame, by: list[str], time: str, value: str, settle: float | None = None, span: float | None = None) -> DataFrame:
    """samples with the last `value` logged at or before their time; earlier samples go. With settle: whether it is that long ago.

    At equal times the log comes first. span: seconds of a key that one task takes; without it a key is one task.
    """
    kept = [c for c in samples.columns if c not in by and c != time]
    left = samples.select(*by, time, F.lit(1).alias("_side"), F.lit(None).cast(log.schema[value].dataType).alias("_value"), F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"))
    right = log.select(*by, time, F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    at = F.when(F.col("_side") == 0, F.struct("_value", F.col(time).alias("_at")))
    both = _carried(left.unionByName(right), by, [time, "_side"], at, None if span is None else F.floor(F.col(time) / span))
    out = both.where("_side = 1 and _last is not null")
    more = [(F.col(time) - F.col("_last._at") >= settle).alias("settled")] if settle is not None else []
    return out.select(*by, time, *(F.col(f"_row.{c}").alias(c) for c in kept), F.col("_last._value").alias(value), *more)


def interpolate(points: DataFrame, table: DataFrame, by: list[str], x: str, y: str, clamp: bool = False, strict: bool = False) -> DataFrame:
    """points with y by linear interpolation of table at x; outside its span null, the end's value with clamp, or refused if strict.

    strict also refuses a table with numbers that are null or not finite; points a rounding error beyond the span take its end.
    """
    left = points.select(*by, x, F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_y"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    value = F.col(y).cast("double")
    if strict:
        bad = odd(value) | odd(F.col(x).cast("double"))
        value = F.when(bad, F.raise_error(F.lit("a table to interpolate holds numbers that aren't finite")).cast("double")).otherwise(value)
    right = table.select(*by, x, F.lit(0).alias("_side"), value.alias("_y"))
    at = F.when(F.col("_side") == 0, F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    back = Window.partitionBy(*by).orderBy(x, "_side")
    ahead = Window.partitionBy(*by).orderBy(F.col(x).desc(), "_side")
    whole = Window.partitionBy(*by)
    out = left.unionByName(right).withColumn("_a", F.last(at, ignorenulls=True).over(back)).withColumn("_b", F.last(at, ignorenulls=True).over(ahead))
    if strict:
        ends = [f(F.when(F.col("_side") == 0, F.col(x))).over(whole) for f in (F.min, F.max)]
        out = out.withColumn("_slack", 1e-9 * (ends[1] - ends[0]) + 4 * 2.0**-52 * F.abs(ends[1]))
    out = out.where("_side = 1")
    a, b = F.col("_a"), F.col("_b")
    between = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (F.col(x) - a["x"]) * (b["y"] - a["y"]) / F.when(a["x"] != b["x"], b["x"] - a["x"]))
    if strict and not clamp:
        end = F.coalesce(a["x"], b["x"])
        outside = F.raise_error(F.concat(F.lit("outside the table: "), F.col(x).cast("string"))).cast("double")
        between = F.when(a["x"].isNotNull() & b["x"].isNotNull(), between).when(F.abs(F.col(x) - end) <= F.col("_slack"), F.coalesce(a["y"], b["y"])).otherwise(outside)
    return out.select(*by, x, (F.coalesce(between, a["y"], b["y"]) if clamp else between).alias(y))


def observe(cells: DataFrame, log: DataFrame, order: list[str], settle: float = 5.0, span: float | None = SPAN) -> DataFrame:
    """cells (recording_id, time_idx, freq_idx, time_s, data) with receiver_input from a switch log (recording_id, time_s, label).

    Labels become places in order; samples before the first switch go; those switched less than settle seconds ago are flagged;
    times count from each recording's first sample. The log meets the time axis, of which cells are a multiple, in spans.
    """
    if len(set(order)) < len(order):
        raise IngestError("a label stands twice in the order")
    if missing := {"recording_id", "time_s", "label"} - set(log.columns):
        raise SchemaError(f"a switch log needs {sorted(missing)}")
    place = F.element_at(F.create_map(*(F.lit(x) for pair in ((label, i) for i, label in enumerate(order)) for x in pair)), F.col("label"))
    axis = cells.select("recording_id", "time_idx", "time_s").distinct()
    seen = as_of(axis, log, ["recording_id"], "time_s", "label", settle, span)
    unknown = F.raise_error(F.concat(F.lit("no place for label "), F.col("label"))).cast("int")
    seen = seen.withColumn("receiver_input", F.coalesce(place, unknown)).withColumn("flag", ~F.col("settled"))
    first = seen.groupBy("recording_id").agg(F.min("time_s").alias("epoch_unix_s"))
    axis = seen.join(first, "recording_id").select("recording_id", "time_idx", (F.col("time_s") - F.col("epoch_unix_s")).alias("time_s"), "epoch_unix_s", "receiver_input", "label", "settled", "flag")
    kept = [c for c in cells.columns if c not in ("time_s", "receiver_input", "flag", "label", "settled", "epoch_unix_s")]
    return cells.select(*kept).join(axis, ["recording_id", "time_idx"])
