"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm, descending, and cut into buckets. A pack of anchors goes down a stripe of the buckets. By Cauchy-Schwarz no row of a
bucket scores more than the anchor's norm times the bucket's largest, so an anchor passes over a bucket where this is under the lower limit of
each of its windows, or under the score of a window's running kth row. The best rows of all stripes are merged.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import partitions, scratch, ship, staged, trimmed

#: Vectors of a bucket, and anchors that a task holds.
BUCKET = 1024
PACK = 2048
_TOLD = "norm double, n int, rows binary, ids binary, labels binary, m binary"
_FOUND = "anchor long, window int, row long, vec_id long, score decimal(38,0)"
_MOST = 10**38 - 1


def vectors_of(vectors: DataFrame, scale: int, relabel_every: int, classes: int) -> DataFrame:
    """row (a number of its own), vec_id, label, v (integers) and norm (never under the true one) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("embedding").isNotNull() & finite & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % classes).otherwise(label).alias("label"),
        F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))) * (1 + 1e-9)
    return rows.select(F.monotonically_increasing_id().alias("row"), "*", norm.alias("norm"))


def _matrix(vectors: list) -> np.ndarray:
    m = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, x in enumerate(vectors):
        m[i, : len(x)] = x
    return m


def _buckets(batches):
    """Rows sorted by norm, as buckets of at most BUCKET."""
    for b in batches:
        for i in range(0, len(b), BUCKET):
            part = b.iloc[i : i + BUCKET]
            blobs = {c: [part[s].to_numpy(np.int64).tobytes()] for c, s in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}
            yield pd.DataFrame({"norm": [part["norm"].max()], "n": [len(part)], **blobs, "m": [_matrix(list(part["v"])).tobytes()]})


class _Pack:
    """Anchors, and the best rows so far of each of their windows."""

    def __init__(self, b: pd.DataFrame, k: int, same: bool, low: int, high: int):
        self.k, self.same = k, same
        self.row, self.label, self.norm, self.m = b["row"].to_numpy(), b["label"].to_numpy(), b["norm"].to_numpy(), _matrix(list(b["v"]))
        # a window's limits as integers: low * ps <= 100 * score <= high * ps
        self.windows = [[(None, None)] if p is None else [(-(-low * int(s) // 100), high * int(s) // 100) for s in p] for p in b["scores"]]
        self.best = [[[] for _ in w] for w in self.windows]
        self.least = np.array([self._least(i) for i in range(len(b))])

    def _least(self, i: int) -> float:
        """A score under which no row is of use to anchor i."""
        out = float("inf")
        for (lo, hi), best in zip(self.windows[i], self.best[i]):
            if lo is None or lo <= hi:
                kth = best[-1][0] if len(best) == self.k else -float("inf")
                out = min(out, kth if lo is None else max(lo, kth))
        return out

    def meet(self, norm: float, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        asks = np.flatnonzero(self.norm * norm * (1 + 1e-9) >= self.least)
        if not len(asks):
            return
        width = max(m.shape[1], self.m.shape[1])
        a, m = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.m[asks], m))
        most = width * max(1, int(np.abs(a.astype(float)).max(initial=0))) * max(1, int(np.abs(m.astype(float)).max(initial=0)))
        kind = float if most < 1 << 53 else object  # sums of products are exact either way
        scores = a.astype(kind) @ m.astype(kind).T
        fits = ((self.label[asks, None] == labels) == self.same) & (rows != self.row[asks, None]) & (scores >= self.least[asks, None]).astype(bool)
        for j in np.flatnonzero(fits.any(axis=1)):
            i, at = asks[j], np.flatnonzero(fits[j])
            s, of, r = scores[j, at], ids[at], rows[at]
            for w, (lo, hi) in enumerate(self.windows[i]):
                inside = np.ones(len(at), bool) if lo is None else ((s >= lo) & (s <= hi)).astype(bool)
                if len(self.best[i][w]) == self.k:
                    inside &= (s >= self.best[i][w][-1][0]).astype(bool)
                new = np.flatnonzero(inside)
                if kind is float and len(new) > self.k:
                    new = new[np.lexsort((r[new], of[new], -s[new]))[: self.k]]
                if len(new):
                    all_ = self.best[i][w] + [(int(s[x]), int(of[x]), int(r[x])) for x in new]
                    self.best[i][w] = sorted(all_, key=lambda x: (-x[0], *x[1:]))[: self.k]
            self.least[i] = self._least(i)

    def found(self) -> pd.DataFrame:
        out = [(int(self.row[i]), w, r, d, Decimal(max(-_MOST, min(_MOST, s)))) for i, ws in enumerate(self.best) for w, best in enumerate(ws) for s, d, r in best]
        return pd.DataFrame(out, columns=["anchor", "window", "row", "vec_id", "score"]).astype({"anchor": np.int64, "window": np.int32, "row": np.int64, "vec_id": np.int64})


def _search(anchors: DataFrame, buckets: DataFrame, n_anchors: int, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The k best rows of each window of each anchor, by stripe of the buckets. anchors: row, label, norm, v, scores (of positives, or null)."""
    packs = max(1, -(-n_anchors // PACK))
    stripes = max(1, partitions(anchors.sparkSession) // packs)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumns({"pack": F.pmod(F.xxhash64("row"), F.lit(packs)), "stripe": spread(stripes)})
    told = buckets.withColumns({"stripe": F.pmod(F.xxhash64("bucket"), F.lit(stripes)), "pack": spread(packs)})
    key = (F.col("pack") * stripes + F.col("stripe")).alias("key")
    both = asked.select(key, F.lit(True).alias("asks"), "row", "label", "norm", "v", "scores").unionByName(told.select(key, F.lit(False).alias("asks"), "norm", "n", "rows", "ids", "labels", "m"), True)

    def search(batches):
        at, held, pack = None, [], None
        for b in batches:
            for key, part in b.groupby("key", sort=False):
                if key != at:
                    if pack is not None:
                        yield pack.found()
                    at, held, pack = key, [], None
                if part["asks"].any():
                    held.append(part[part["asks"]])
                for x in part[~part["asks"].astype(bool)].itertuples():
                    if pack is None and held:
                        pack = _Pack(pd.concat(held), k, same, low, high)
                    if pack is not None:
                        ids, rows, labels = (np.frombuffer(y, np.int64) for y in (x.ids, x.rows, x.labels))
                        pack.meet(x.norm, rows, ids, labels, np.frombuffer(x.m, np.int64).reshape(int(x.n), -1))
        if pack is not None:
            yield pack.found()

    return both.repartition("key").sortWithinPartitions("key", F.desc("asks"), F.desc("norm")).mapInPandas(lambda b: trimmed(search(b)), _FOUND)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, relabel_every: int = 7, classes: int = 10, scale: int = 256, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id `every` divides; their positives are the best other rows of the same label, and for each of them the negatives
    are the best rows of another label with low * positive_score <= 100 * score <= high * positive_score. Where `relabel_every` divides
    vec_id, the label first becomes (label + 1) % classes. Scores are inner products of floor(scale * x); ties go to the smaller vec_id.

    Rows without vec_id, label or vector, or with null or non-finite components, take no part; shorter vectors count as filled with zeros, and empty
    ones score 0. Repeated rows, and unlike rows of one vec_id, are rows of their own: each is asked and found. Scores are exact below 10**38;
    beyond 64 bits the result shows the nearest 64-bit number. A table without anchors gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    with scratch(spark):
        rows = staged(vectors_of(vectors, scale, relabel_every, classes), "vectors")
        buckets = rows.repartitionByRange(partitions(spark), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row").mapInPandas(_buckets, _TOLD)
        buckets = staged(buckets.select(F.monotonically_increasing_id().alias("bucket"), "*"), "buckets")
        anchors = rows.where(F.col("vec_id") % every == 0)
        n = anchors.count()
        found = _search(anchors.withColumn("scores", F.lit(None).cast("array<decimal(38,0)>")), buckets, n, positives, True)
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
        found = staged(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives), "positives")
        lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("of"))
        asked = anchors.join(lists.hint("merge"), F.col("row") == F.col("anchor")).withColumn("scores", F.col("of.score"))
        found = _search(asked, buckets, n, negatives, False, low, high)
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
        known = asked.select("anchor", F.col("vec_id").alias("anchor_id"), "of")
        out = found.join(known.hint("merge"), "anchor").withColumn("p", F.get("of", F.col("window")))
        clip = lambda c: F.greatest(F.lit(-(2**63)), F.least(F.lit(2**63 - 1), c)).cast("long")
        out = out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), clip(F.col("p.score")).alias("positive_score"), clip(F.col("score")).alias("negative_score"))
        return staged(out, "negatives", keep=True)
