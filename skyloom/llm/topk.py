"""Exact top-k search by Fagin's threshold algorithm.

Vectors are dealt into blocks, and each block keeps a list of its vectors for every dimension, sorted by component. A query goes down all lists
at once (up, where its own component is negative); what it meets is scored in full. No vector still unseen can score more than
the sum of the products at the current depth, so the search stops once the kth best score is above that bound. Blocks meet packs of
queries; the best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import ship

#: Vectors of a block, and queries of a pack.
BLOCK = 4096
PACK = 1024


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k])
    return np.lexsort((ids, -scores))[:k]


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of each query. All integers, and exact: as doubles where no sum of products can pass
    2**53, as 64-bit integers below 2**63, and as Python's integers beyond."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    down, up = order[::-1], order
    high, low = np.take_along_axis(vectors, down, 0).astype(float), np.take_along_axis(vectors, up, 0).astype(float)
    most = dims * max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))) * max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
    kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    q, v = queries.astype(kind), vectors.astype(kind)
    depths = [d for d in (2**i for i in range(n.bit_length())) if d < n] + [n]
    at = np.array(depths) - 1
    f = queries.astype(float)
    bound = np.maximum(f, 0) @ high[at].T + np.minimum(f, 0) @ low[at].T  # queries x depths
    if kind is not float:  # a bound that was rounded is taken a little higher
        bound += 4 * dims * 2.0**-53 * (np.abs(f) @ np.maximum(np.abs(high[at]), np.abs(low[at])).T)
    out = []
    for i, qid in enumerate(query_ids.tolist()):
        lists = np.where(q[i] >= 0, down, up)
        lists = lists[:, q[i] != 0] if (q[i] != 0).any() else lists
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        seen = np.zeros(n, bool)
        begin = 0
        for j, depth in enumerate(depths):
            met = np.zeros(n, bool)
            met[lists[begin:depth].ravel()] = True
            new = np.flatnonzero(met & ~seen & (ids != qid))
            seen |= met
            begin = depth
            best_s, best_i = np.append(best_s, v[new] @ q[i]), np.append(best_i, ids[new])
            if len(best_s) > k:
                top = _best(best_s, best_i, k)
                best_s, best_i = best_s[top], best_i[top]
            if len(best_s) == k and min(best_s) > bound[i, j]:
                break
        out += [(qid, int(b), max(-(2**63), min(2**63 - 1, int(s)))) for b, s in zip(best_i, best_s)]
    return out


def _pack(batches):
    for b in batches:
        dims = b["v"].map(len)
        width = int(dims.max()) if len(b) else 0
        m = np.zeros((len(b), width), np.int64)
        for i, x in enumerate(b["v"]):
            m[i, : len(x)] = x
        for g, rows in b.groupby("g").indices.items():
            yield pd.DataFrame({"g": [g], "n": [len(rows)], "ids": [b["vec_id"].to_numpy()[rows].astype(np.int64).tobytes()], "m": [m[rows].tobytes()]})


def _unpack(parts_ids, parts_m, parts_n):
    ids = [np.frombuffer(x, np.int64) for x in parts_ids]
    ms = [np.frombuffer(m, np.int64).reshape(n, -1) for m, n in zip(parts_m, parts_n)]
    width = max((m.shape[1] for m in ms), default=0)
    return np.concatenate(ids), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in ms])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product with each query, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the vectors whose vec_id `every` divides; a query never finds rows of its own vec_id. Vectors
    that are null or empty, or hold null or non-finite components, and rows without vec_id take no part; shorter vectors
    count as filled with zeros. Repeated rows are found once each, and asked once. Components and scores beyond 64 bits take the nearest
    64-bit number. A table without queries gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size(e) > 0) & finite & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, nq = rows.agg(F.count("*"), F.count_if(asked)).first()
    blocks, packs = max(1, -(-n // block)), max(1, -(-nq // pack))
    part = lambda df: df.mapInPandas(_pack, "g int, n int, ids binary, m binary")
    gathered = lambda df: df.groupBy("g").agg(F.collect_list(F.struct("ids", "m", "n")).alias("parts"))
    cand = gathered(part(rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))))
    packed = gathered(part(rows.where(asked).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int"))))
    packed = packed.select(F.col("parts").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g"))
    met = cand.join(packed.hint("merge"), "g").select("parts", "asked")

    def search(batches):
        for b in batches:
            for parts, asked in zip(b["parts"], b["asked"]):
                ids, m = _unpack(*zip(*((p["ids"], p["m"], p["n"]) for p in parts)))
                qids, q = _unpack(*zip(*((p["ids"], p["m"], p["n"]) for p in asked)))
                width = max(m.shape[1], q.shape[1])
                m, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, q))
                yield pd.DataFrame(threshold_search(q, qids, m, ids, k), columns=["query_id", "vec_id", "score"]).astype(np.int64)

    found = met.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
