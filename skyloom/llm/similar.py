"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Fingerprints of 64 bits tell such texts apart too coarsely (a similarity of 0.8 is about ten bits), so candidates come from
SimHash chains and, beside them, from bands of MinHash values; each link is then verified on all shingles of both texts, held as
sorted 32-bit hashes.

A bucket of candidates is searched window by window, which finds the components of nearly all of its texts. Where windows were needed
and texts of more than one component remain, a second pass compares those outside the bucket's largest component with all the others,
in blocks: every pair of a bucket is then compared, or already joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import mix, spread_join, staged, texts, trimmed

#: 20 bands of 5 values: a pair at a similarity of 0.8 shares no band once in 2,800.
BANDS, BAND_ROWS = 20, 5
#: Texts and shingles that are compared among themselves at a time, and members of a large bucket that one task takes.
WINDOW, WINDOW_SHINGLES, SHARD = 1024, 8_000_000, 16_384
_RNG = np.random.default_rng(20240502)
_XOR, _ODD = (_RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def _bands(u: np.ndarray) -> np.ndarray:
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for i in range(0, len(u), 4096):
        least = np.minimum(least, ((u[i : i + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row_key (hash of the text as it is), whole (hash of the words), fp (fingerprint), bands, size and shingles (the set, as sorted hashes) of every row."""
    from skyloom.llm.simhash import majority, shingle_hashes

    def of(batches):
        for b in batches:
            out = []
            for d, key, t in zip(b["doc_id"], b["row_key"], b["text"]):
                joined, h = shingle_hashes(t, shingle)
                u = np.unique(mix(h)) if len(h) else np.zeros(1, np.uint64)
                low = np.unique((u >> np.uint64(32)).astype("<u4"))
                whole = np.uint64(xxhash.xxh3_64_intdigest(joined)).view(np.int64)
                out.append((d, key, int(whole), int(np.uint64(majority(h)).view(np.int64)), _bands(u).view(np.int64), len(low), low.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "row_key", "whole", "fp", "bands", "size", "shingles"])

    return texts(docs).withColumn("row_key", F.xxhash64("text")).mapInPandas(lambda b: trimmed(of(b)), "doc_id long, row_key long, whole long, fp long, bands array<long>, size long, shingles binary")


class _Sets:
    """Sets of shingles side by side, each to be compared with many at once."""

    width = 4  # bytes of a hash

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) // self.width for r in raw])
        self.values = self._unpacked(b"".join(raw))
        self.start = np.cumsum(self.size) - self.size

    def _unpacked(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u4")

    def near(self, i: int, to: np.ndarray, least: float) -> np.ndarray:
        """Whether set i is similar to each of those at the places `to`."""
        n, out = self.size[i], np.zeros(len(to), bool)
        fits = np.flatnonzero(np.minimum(self.size[to], n) >= least * np.maximum(self.size[to], n))
        a = self.values[self.start[i] : self.start[i] + n]
        ends = np.cumsum(self.size[to[fits]])
        for part in np.split(fits, np.flatnonzero(np.diff(ends // 4_000_000)) + 1) if len(fits) else ():
            start, size = self.start[to[part]], self.size[to[part]]
            first = np.cumsum(size) - size
            v = self.values[np.repeat(start - first, size) + np.arange(size.sum())]
            both = np.add.reduceat(a[np.minimum(np.searchsorted(a, v), n - 1)] == v, first, dtype=np.int64)
            out[part] = both >= least * (n + size - both)
        return out


def _forest(s: _Sets, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that span the components of similar sets, and a root of each."""
    left, links, roots = np.arange(len(s.size)), [], []
    while len(left):
        roots.append(int(left[0]))
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = s.near(at, left, least)
            links += [(at, x) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return links, roots


def _frame(pairs) -> pd.DataFrame:
    return pd.DataFrame([(min(p), max(p)) for p in pairs], columns=["a", "b"], dtype="int64")


def _links(batches, least: float, window: int, kind=_Sets):
    """Rows sorted by bucket. A window of a bucket is searched with roots of the windows before it, as many as a window holds."""
    at, held, fresh, load = None, [], 0, 0

    def search():
        pairs, roots = _forest(kind([r[1] for r in held]), least)
        return _frame((held[x][0], held[y][0]) for x, y in pairs), [held[r] for r in roots]

    for b in batches:
        for bucket, node, raw in zip(b["bucket"], b["node"], b["raw"]):
            if held and (bucket != at or fresh >= window or load + len(raw) > 8 * WINDOW_SHINGLES):
                out, roots = search()
                yield out
                roots = np.array(roots, object)[np.cumsum([len(r[1]) for r in roots]) <= 4 * WINDOW_SHINGLES][:window] if bucket == at else []
                held, fresh, load = [tuple(r) for r in roots], 0, sum(len(r[1]) for r in roots)
            at = bucket
            held.append((node, raw))
            fresh, load = fresh + 1, load + len(raw)
    if held:
        yield search()[0]


def _bridges(batches, least: float, kind=_Sets):
    """Rows sorted by key, those to be asked about first: a link from each of these to each component among the others that it is similar to."""
    at, asked = None, []
    for b in batches:
        for key, part in b.groupby("key", sort=False):
            if key != at:
                at, asked = key, []
            asked += [(n, c, raw) for n, c, raw, ask in zip(part["node"], part["component"], part["raw"], part["asked"]) if ask]
            rest = part[~part["asked"]]
            if not len(rest):
                continue
            s = kind([r[2] for r in asked] + list(rest["raw"]))
            component, node, links = rest["component"].to_numpy(), rest["node"].to_numpy(), []
            for i, (n, c, _) in enumerate(asked):
                others = np.flatnonzero(component != c)
                hit = others[s.near(i, others + len(asked), least)]
                links += [(n, node[x]) for x in hit[np.unique(component[hit], return_index=True)[1]]]
            if links:
                yield _frame(links)


def joined(buckets: DataFrame, content: DataFrame, values: DataFrame, least: float, window: int = WINDOW, shard: int = SHARD, kind=_Sets) -> DataFrame:
    """node, label: the smallest value that links between similar nodes of a bucket reach, of the nodes with a link.

    buckets: bucket, node, size; content: node and raw, of which `kind` makes what tells near nodes; values: node, value. All pairs of nodes that
    share a bucket count, however many it holds: see the module. The second pass costs the members of a bucket times those outside its largest
    component, over the size of a block. All three tables are read several times and should be written ones.
    """
    from skyloom.llm.components import smallest_reachable

    # buckets of the same nodes are searched once
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("x")).where("lo < hi")
    full = staged(full.groupBy("n", "load", "lo", "hi", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "load"), "full")
    dealt = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / shard))
    members = buckets.join(full.hint("merge"), "bucket").select(F.xxhash64("bucket", dealt).alias("bucket"), "node")
    found = members.join(content.hint("merge"), "node")
    found = found.repartition("bucket").sortWithinPartitions("bucket", "node").mapInPandas(lambda b: trimmed(_links(b, least, window, kind)), "a long, b long").distinct()
    found = staged(found, "links")
    reached = staged(smallest_reachable(found, values), "reached")

    wide = full.where((F.col("n") > window) | (F.col("load") > WINDOW_SHINGLES))
    inside = buckets.join(wide.hint("merge"), "bucket").join(values.hint("merge"), "node").join(reached.hint("merge"), "node", "left")
    inside = staged(inside.select("bucket", "n", "load", "node", F.xxhash64(F.coalesce("label", "value")).alias("component")), "inside")
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("of"))
    parts = parts.groupBy("bucket").agg(F.max_by("component", F.struct("of", "component")).alias("main"), F.sum("of").alias("all"), F.max("of").alias("most")).where("all > most")
    blocks = F.greatest(F.ceil(F.col("n") / (4 * window)), F.ceil(F.col("load") / WINDOW_SHINGLES)).cast("int")
    asks = F.greatest(F.lit(1), F.ceil(blocks * (F.col("all") - F.col("most")) / F.col("n"))).cast("int")
    inside = inside.join(parts.hint("merge"), "bucket").withColumns({"blocks": blocks, "asks": asks, "mine": F.xxhash64("node", "bucket")})
    told = inside.select("bucket", "node", "component", F.lit(False).alias("asked"), F.pmod("mine", "blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("j"))
    asked = inside.where("component <> main").select("bucket", "node", "component", F.lit(True).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod("mine", "asks").alias("j"))
    open_ = asked.union(told).select(F.xxhash64("bucket", "i", "j").alias("key"), "node", "component", "asked").join(content.hint("merge"), "node")
    bridges = open_.repartition("key").sortWithinPartitions("key", F.desc("asked"), "node").mapInPandas(lambda b: trimmed(_bridges(b, least, kind)), "a long, b long").distinct()
    bridges = staged(bridges, "bridges")
    if not bridges.isEmpty():
        reached = staged(smallest_reachable(found.union(bridges), values), "rejoined")
    return reached


def similar_components(docs: DataFrame, shingle: int, least: float, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc_id (null as NULL_ID), row_key, component_id, component_key: the smallest doc_id and then row_key that links of similar texts
    reach; one row per row of docs. A row_key is the hash of a text, so that unlike rows of one doc_id, or of none, are told apart.

    Texts are lower-cased words; texts of fewer words than a shingle are one shingle, and texts without words are copies of each
    other. Equal texts are one node; see joined().
    """
    from skyloom.llm.simhash import links as chains

    rows = staged(shingle_sets(docs, shingle), "sets")
    nodes = rows.groupBy("whole").agg(F.min(F.struct("doc_id", "row_key")).alias("value"), *(F.first(c).alias(c) for c in ("fp", "bands", "size", "shingles")))
    nodes = staged(nodes.withColumnRenamed("whole", "node"), "nodes")
    by_fp = staged(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.min_by("size", "node").alias("size")), "fingerprints")
    near = chains(by_fp)
    ends = near.select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("fp"))
    buckets = nodes.select(F.explode(F.array_append("bands", F.xxhash64("fp"))).alias("bucket"), "node", "size").union(ends.join(by_fp.hint("merge"), "fp").select("bucket", "node", "size"))
    buckets = staged(buckets, "buckets")
    values = nodes.select("node", "value")
    reached = joined(buckets, nodes.select("node", F.col("shingles").alias("raw")), values, least, window, shard)
    known = values.join(reached.hint("merge"), "node", "left").select("node", F.coalesce("label", "value").alias("first"))
    out = spread_join(rows.select("doc_id", "row_key", F.col("whole").alias("node")), staged(known, "known"), "node")  # copies are one node
    return out.select("doc_id", "row_key", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("component_key"))
