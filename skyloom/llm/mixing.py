"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target r times its size is taken floor(r) times, and once more with inclusion probability r - floor(r).
The flight phase moves these probabilities three at a time along the null space of two balancing constraints, the number of
documents and the number of words, until one of the three is 0 or 1. Each source flies on its own, a large one in parts, which leave
a few open documents each; those fly again in fewer parts, until one is left and the landing chooses among the last few.
"""

from __future__ import annotations

from bisect import insort
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import id_in, id_out, scratch, staged

#: Rows of a source that fly together, about, and documents that stay open of them; both fix the result, whatever the cluster.
FLIGHT_ROWS = 5_000
OPEN = 10
WEIGHTS = (5, 2, 1)
_EPS = 1e-9
_FIELDS = "row_id long, doc_id long, source string, size long, base int, pi double, order long, key long, salt int"


def words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for sizes (source, source_size).

    Sources by code point, null last, have the weights in turn. Together they get `share` of all sizes, in proportion to weight, but
    none over `most` times its own; what is over is shared again by weight. In order of cap by weight, a source is at its cap
    exactly if the level, left share by left weight, would be above it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.col("level") * F.col("w") <= F.col("cap")
    s = s.withColumn("free", F.max(F.when(free, F.lit(1)).otherwise(0)).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    s = s.withColumn("first", F.first(F.when(free, F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.when(F.col("free"), F.least(F.col("first") * F.col("w"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def _fly(three: list[list]) -> None:
    """Move the probabilities of three documents along the null space of (1, size) until one is 0 or 1. Each: [size, order, row, pi]."""
    (a, b, c) = (x[0] for x in three)
    step = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
    top = max(map(abs, step))
    step = [s / top for s in step]
    room = lambda sign: min((1 - x[3] if s * sign > 0 else x[3]) / abs(s) for x, s in zip(three, step) if s)
    up, down = room(1), room(-1)
    # the side is drawn so that probabilities keep their means; the draw comes from the documents' own order keys
    draw = ((three[0][1] ^ three[1][1] * 31 ^ three[2][1] * 17) * 0x9E3779B97F4A7C15 % 2**64) / 2**64
    move = up if draw < down / (up + down) else -down
    for x, s in zip(three, step):
        x[3] += move * s


def _flight(batches):
    """Rows sorted by source and salt: settled documents at once, open ones at their end. The largest fly first, so that small ones stay open."""
    at, group = None, []
    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            part = (row.source if isinstance(row.source, str) else None, row.salt)
            if part != at:
                out += [x[2]._replace(pi=x[3]) for x in group]
                at, group = part, []
            if not _EPS < row.pi < 1 - _EPS:
                out.append(row._replace(pi=float(round(row.pi))))
                continue
            insort(group, [row.size, row.order, row, row.pi], key=lambda x: x[:2])
            while len(group) > OPEN:
                three = group[-3:]
                _fly(three)
                open_ = []
                for x in three:
                    if _EPS < x[3] < 1 - _EPS:
                        open_.append(x)
                    else:
                        out.append(x[2]._replace(pi=float(round(x[3]))))
                group[-3:] = open_
        if out:
            yield pd.DataFrame(out)
    if group:
        yield pd.DataFrame([x[2]._replace(pi=x[3]) for x in group])


def _landing(batches):
    """The last open documents of a source: the choice with the words, then the documents, nearest to what was aimed at."""
    groups: dict = {}
    for b in batches:
        for row in b.itertuples(index=False):
            groups.setdefault(row.source if isinstance(row.source, str) else None, []).append(row)
    out = []
    for rows in groups.values():
        rows.sort(key=lambda r: (r.order, r.doc_id, r.size, r.row_id))
        size, pi = np.array([r.size for r in rows], float), np.array([r.pi for r in rows])
        picks = np.array(list(product((0, 1), repeat=len(rows))))
        words, docs = np.abs(picks @ size - pi @ size), np.abs(picks.sum(axis=1) - pi.sum())
        best = picks[np.lexsort((docs, words))[0]]
        out += [r._replace(pi=float(p)) for r, p in zip(rows, best)]
    if out:
        yield pd.DataFrame(out)


def _row_key() -> Column:
    """What tells rows apart but for equal ones: doc_id, text and source."""
    return F.xxhash64(id_in("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string"))


def _parts(level: DataFrame) -> DataFrame:
    """of, parts: sources of more rows than fly together, and in how many parts they fly. One row for FLIGHT_ROWS rows at most."""
    most = max(FLIGHT_ROWS, 2 * OPEN)
    return staged(level.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1"), "parts")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size (words), source_size, target (its source's), copies (times the mix takes it), taken (words).

    Null texts have size 0; null sources are one source, last in order. Repeated rows are documents of their own. Reruns agree: the
    draws come from doc_id, size, text and source; key is their hash but for size. An empty table gives an empty result;
    a text of any length counts whole.
    """
    sized = docs.select(id_in("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), _row_key().alias("key"))
    sized = staged(sized.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    by_source = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = by_source.withColumn("ratio", ratio).withColumnRenamed("source", "of")
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("row_id", "doc_id", "source", "size", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("pi"), F.xxhash64("doc_id", "size", "key").alias("order"), "key")
    done, level = [], rows
    while True:
        parts = _parts(level)
        last = parts.isEmpty()
        dealt = level.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("salt", F.pmod(F.xxhash64("order"), F.coalesce("parts", F.lit(1))).cast("int")).drop("of", "parts")
        dealt = dealt.repartition("source", "salt").sortWithinPartitions("source", "salt", "order", "doc_id", "size", "row_id")
        level = staged(dealt.mapInPandas(_flight, _FIELDS), "flight")
        done.append(level.where("pi in (0, 1)"))
        level = level.where("pi not in (0, 1)").drop("salt")
        if last:
            break
    done.append(level.withColumn("salt", F.lit(0)).repartition("source").mapInPandas(_landing, _FIELDS))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = out.join(by_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("base") + F.col("pi").cast("int")
    return out.select(id_out("doc_id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row_id", "key")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; see mix_sources. Null and empty texts weigh nothing but are drawn like any other; equal
    rows share their copies in any order; an empty table is empty."""
    turn = Window.partitionBy("_key").orderBy("_key")  # equal rows only: which of them has which number doesn't matter
    with scratch(docs.sparkSession):
        took = mix_sources(docs, weights, share, most).select(F.col("key").alias("_key"), "copies")
        took = staged(took.withColumn("_turn", F.row_number().over(turn)), "mix", keep=True)
    rows = docs.withColumn("_key", _row_key()).withColumn("_turn", F.row_number().over(turn))
    both = rows.join(took.hint("merge"), ["_key", "_turn"]).where("copies > 0")
    return both.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*docs.columns)
