"""MinHash near-dedup by SetSketch registers.

A register is the least of an exponential variable over a set's shingles, on a scale of powers of BASE, truncated to 16 bits; the registers of a union are the
larger ones of both sketches, so that sketches merge in any order. Equal registers are as likely as the sets are similar: sets that share a band of
registers are candidates. Of two candidates, the numbers of larger, smaller and equal registers, together with the exact sizes, give the likelihood
of every similarity. Where the threshold is far less likely than the best estimate the pair goes; the others form families, whose whole
shingle sets are then compared.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import grams, id_out, mix, scratch, ship, spread_join, staged, texts, trimmed, word_hashes
from skyloom.llm.similar import SHARD, WINDOW, _Sets, joined

#: 24 bands of 6 registers: a pair at a similarity of 0.85 shares no band once in 85,000.
BANDS, BAND_ROWS = 24, 6
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: A pair goes if the best similarity is e^DOUBT times as likely as the threshold: a pair at the threshold does once in four million.
DOUBT = 12.5
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RNG = np.random.default_rng(20240503)
_A, _B, _C = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(odd) for odd in (1, 1, 0))


def shingle_set(text: str, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the words, and the sorted 64-bit hashes of the set; no words, none."""
    joined_ = b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    words = word_hashes(joined_)[0]
    h = grams(words, min(shingle, len(words))) if len(words) else words
    return int(np.uint64(xxhash.xxh3_64_intdigest(joined_)).view(np.int64)), np.unique(h)


def registers(u: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    low, high = u.astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(u), 512):
        v = low[i : i + 512, None] * _A + (high[i : i + 512, None] * _B + _C)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, v.min(axis=0))
    if not len(u):
        return np.zeros(REGISTERS, np.uint16)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def cardinality(k: np.ndarray) -> float:
    """The estimated size of the set of a sketch."""
    return 0.0 if not k.any() else len(k) * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(BASE ** -k.astype(float)))


def _log_likelihood(j, u, v, more, less, same):
    tiny = 1e-300
    return more * np.log(np.maximum(u - v * j, tiny)) + less * np.log(np.maximum(v - u * j, tiny)) + same * np.log(np.maximum(j, tiny))


def similarity(n: float, size: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most likely Jaccard similarity of a set of size n to sets of the sizes given, of which `more` registers are smaller, `less` larger and
    `same` equal to its own, and both shares of the sizes. BASE is so near 1 that the probabilities are linear in the similarity, and the estimate solves a quadratic."""
    u, v = n / (n + size), size / (n + size)
    a, b, c = u * v * (more + less + same), same * (u * u + v * v) + more * v * v + less * u * u, same * u * v
    best = 2 * c / (b + np.sqrt(np.maximum(b * b - 4 * a * c, 0)))
    return np.minimum(best, np.minimum(u / v, v / u)), u, v


def _bands(k: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in k.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


class _Whole(_Sets):
    """Sets as sorted hashes of 48 bits."""

    width = 6

    def _unpacked(self, raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view("<u8").ravel()


class _Sketches:
    """Sketches side by side, each compared with many at once; with the sets behind them, where they are given, to verify."""

    head = 8 + 2 * REGISTERS

    def __init__(self, raw: list[bytes], verify: bool = True):
        self.size = np.array([int.from_bytes(r[:8], "little") for r in raw])
        self.k = np.stack([np.frombuffer(r[8 : self.head], "<u2") for r in raw]) if raw else np.zeros((0, REGISTERS), np.uint16)
        self.sets = _Whole([r[self.head :] for r in raw]) if verify else None

    def near(self, i: int, to: np.ndarray, least: float) -> np.ndarray:
        """Whether set i is, or without sets may be, similar to each of those at the places `to`."""
        n, size, out = self.size[i], self.size[to], np.zeros(len(to), bool)
        fits = np.flatnonzero(np.minimum(size, n) >= least * np.maximum(size, n))
        if not len(fits):
            return out
        k = self.k[to[fits]]
        more, same = (self.k[i] > k).sum(axis=1), (self.k[i] == k).sum(axis=1)
        less = REGISTERS - more - same
        best, u, v = similarity(n, size[fits], more, less, same)
        far = best < least
        far[far] = (_log_likelihood(best, u, v, more, less, same) - _log_likelihood(least, u, v, more, less, same))[far] > DOUBT
        fits = fits[~far]
        out[fits] = self.sets.near(i, to[fits], least) if self.sets is not None and len(fits) else True
        return out


def sketches(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row_key (hash of the text), node (hash of the words), size (of the set), bands and raw (size and registers) of every row."""

    def of(batches):
        for b in batches:
            out = []
            for d, key, t in zip(b["doc_id"], b["row_key"], b["text"]):
                node, u = shingle_set(t, shingle)
                k = registers(u)
                out.append((d, key, node, len(u), _bands(k).view(np.int64), len(u).to_bytes(8, "little") + k.astype("<u2").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "row_key", "node", "size", "bands", "raw"])

    return texts(docs).withColumn("row_key", F.xxhash64("text")).mapInPandas(lambda b: trimmed(of(b)), "doc_id long, row_key long, node long, size long, bands array<long>, raw binary")


def distinct_shingles(docs: DataFrame, by: str, shingle: int = 3) -> DataFrame:
    """by, estimate: the number of distinct shingles of all texts of a group, from merged sketches. Groups may be of any size."""

    def unpacked(batches):
        for b in batches:
            yield pd.DataFrame({"by": b["by"], "k": [registers(shingle_set(t, shingle)[1]).astype(np.int32) for t in b["text"]]})

    def counted(batches):
        for b in batches:
            yield pd.DataFrame({"by": b["by"], "estimate": [cardinality(np.array([x["k"] for x in sorted(k, key=lambda x: x["i"])])) for k in b["k"]]})

    rows = docs.select(F.col(by).cast("string").alias("by"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.mapInPandas(unpacked, "by string, k array<int>").select("by", F.posexplode("k").alias("i", "k"))
    merged = each.groupBy("by", "i").agg(F.max("k").alias("k")).groupBy("by").agg(F.collect_list(F.struct("i", "k")).alias("k"))
    return merged.mapInPandas(counted, "by string, estimate double").withColumnRenamed("by", by)


def _with_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """node and raw, whole sets included, of the nodes of members: node, raw and value (doc_id and row_key of a row of it)."""

    def of(batches):
        for b in batches:
            sets = (shingle_set(t, shingle)[1] for t in b["text"])
            raw = [r + u.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for r, u in zip(b["raw"], sets)]
            yield pd.DataFrame({"node": b["node"], "raw": raw})

    key = ["doc_id", "row_key"]
    rows = texts(docs).withColumn("row_key", F.xxhash64("text")).groupBy(*key).agg(F.first("text").alias("text"))  # repeated rows once
    met = rows.join(members.select("node", "raw", "value.doc_id", "value.row_key").hint("merge"), key)
    return met.select("node", "raw", "text").mapInPandas(lambda b: trimmed(of(b)), "node long, raw binary")


def setsketch_dedup(docs: DataFrame, shingle: int = 3, least: float = 0.85, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included), kept (whether that is its own), one row per row.

    Texts are lower-cased (A to Z) and split at white space; a set holds the distinct shingles, of fewer words the whole sequence. Sets link at a Jaccard similarity
    of `least` or more, on whole sets (hashes of 48 bits); texts without words, nulls included, have an empty set and no links. Equal
    texts are one node, told by a hash of 64 bits. Candidates share a band of registers: see BANDS; all pairs of a bucket count, however many it holds.

    A null doc_id counts as smaller than any other and comes back as null; a row without one is kept if its component's id is null. Repeated rows each come
    back. Very long texts are taken whole. Empty tables give empty results, other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark):
        rows = staged(sketches(docs, shingle), "sketches")
        nodes = rows.where("size > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("value"), *(F.first(c).alias(c) for c in ("size", "bands", "raw")))
        nodes = staged(nodes, "nodes")
        buckets = staged(nodes.select(F.explode("bands").alias("bucket"), "node", F.lit(1).alias("size")), "buckets")
        families = joined(buckets, nodes.select("node", "raw"), nodes.select("node", F.col("node").alias("value")), least, window, shard, partial(_Sketches, verify=False))
        members = families.join(nodes.select("node", "size", "raw", "value").hint("merge"), "node")
        members = staged(members.select("node", F.col("label").alias("bucket"), "size", "raw", "value"), "members")
        sets = staged(_with_sets(docs, members, shingle), "content")
        values = nodes.select("node", F.col("value.doc_id").alias("value"))
        reached = joined(members.select("bucket", "node", "size"), sets, values, least, window, shard, _Sketches)
        known = staged(values.join(reached.hint("merge"), "node", "left").select("node", F.coalesce("label", "value").alias("component_id")), "known")
        out = rows.select("doc_id", "size", "node")
        out = spread_join(out, known, "node", "left")  # of empty sets none is known
        component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        out = out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
        out = out.select(id_out("doc_id").alias("doc_id"), "n_shingles", id_out("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
        return staged(out, "deduplicated", keep=True)
