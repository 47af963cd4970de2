"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of five segments. If two differ in at most four bits, then from some segment on every
chain of l consecutive segments differs in at most floor(4 l / 5) bits: the first is equal and the second differs in one bit at
most. A fingerprint therefore meets its candidates under the key (segment, next segment, with each bit flipped once), and the rest
of the chain is checked before the full Hamming distance. Only distinct fingerprints take part; inside a key a
breadth-first search yields a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import id_in, id_out, scratch, spread_join, staged, texts
from skyloom.llm.components import smallest_reachable
from skyloom.llm.similar import similar_components

WIDTHS = (13, 13, 13, 13, 12)
MAX_BITS = 4
_STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str, shingle: int) -> tuple[bytes, np.ndarray]:
    """The lower-cased words joined by spaces, and the hash of each shingle of them."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return joined, np.array([digest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin = np.concatenate(([0], gaps + 1))[:n].tolist()
    end = np.append(gaps, len(joined))[shingle - 1 :].tolist()
    return joined, np.fromiter((digest(joined[a:z], 42) for a, z in zip(begin, end)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 256):  # lanes of a byte hold 255 hashes
        lanes = _SPREAD[h[i : i + 255 * 256].view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle)[1])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def of(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return texts(docs).mapInPandas(of, "doc_id long, fp long")


def _segments(x: np.ndarray, first: int) -> np.ndarray:
    """Differing bits by segment, along the ring from the first."""
    return np.stack([np.bitwise_count((x >> np.uint64(_STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)) for i in ((first + j) % len(WIDTHS) for j in range(len(WIDTHS)))])


def _linked(x: np.ndarray, first: int) -> np.ndarray:
    """Whether the differences x pass the chains of two and more segments, and then the full distance."""
    chain = np.cumsum(_segments(x, first), axis=0, dtype=np.int64)
    budget = np.arange(1, len(WIDTHS) + 1) * MAX_BITS // len(WIDTHS)
    ok = (chain[:-1] <= budget[:-1, None]).all(axis=0)
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def _forest(fps: np.ndarray, first: int) -> list[tuple[int, int]]:
    left, links = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _linked(left ^ at, first)
            links += [(at, x) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return links


def _links(batches):
    """Rows sorted by key: links between the fingerprints under one key."""
    rest = None
    for b in _then_end(batches):
        if b is None:
            if rest is None:
                return
            key, fp, plain = rest
            last = len(key)
        else:
            now = (b["bucket"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["plain"].to_numpy())
            key, fp, plain = now if rest is None else map(np.concatenate, zip(rest, now))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            rest = (key[last:], fp[last:], plain[last:])
        cut = np.flatnonzero(np.concatenate(([True], key[1:last] != key[: last - 1], [True]))) if last else np.zeros(1, int)
        links = []
        for i in np.flatnonzero(np.diff(cut) > 1):
            a, z = cut[i], cut[i + 1]
            if plain[a:z].any():
                links += _forest(np.unique(fp[a:z]), int(key[a] >> 26))
        if links:
            x = np.array(links, np.uint64).view(np.int64)
            yield pd.DataFrame({"a": x.min(axis=1), "b": x.max(axis=1)})


def _then_end(batches):
    yield from batches
    yield None


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp: their components are those of all pairs within four bits."""
    n = len(WIDTHS)
    keys = None
    seg = [F.shiftrightunsigned("fp", _STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1)) for i in range(n)]
    for i in range(n):
        nxt = (i + 1) % n
        base = (F.lit(i << 26) + F.shiftleft(seg[i], 13) + seg[nxt]).cast("long")
        keys = [*(keys or []), F.struct(base.alias("bucket"), F.lit(True).alias("plain")), *(F.struct(base.bitwiseXOR(F.lit(1 << j).cast("long")).alias("bucket"), F.lit(False).alias("plain")) for j in range(WIDTHS[nxt]))]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.bucket", "k.plain")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_links, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), class_id (smallest doc_id with that fingerprint), component_id (smallest reachable).

    Texts are taken whole, however long; those with fewer words than a shingle are one shingle; texts without words, nulls included, have
    fingerprint zero and link like any other. A null doc_id counts as smaller than any other and comes back as null. Repeated rows each
    come back. An empty table gives an empty result.
    """
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    reached = smallest_reachable(staged(links(classes), "links"), classes.select(F.col("fp").alias("node"), F.col("class_id").alias("value")))
    known = classes.join(reached.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    out = spread_join(fps, staged(known, "known"), "fp")
    return out.select(id_out("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("class_id").alias("class_id"), id_out("component_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs less all but one of each group of near copies, that of the smallest doc_id (null before all), with all their columns.

    Rows are told apart by doc_id and text: rows of one doc_id, or of none, with unlike texts all stay, and of equal rows one. Near
    copies are texts that links of a similarity (Jaccard, of sets of five-word shingles) of at least `least` join. Chains of
    fingerprints alone would miss most of those under 0.95, so bands add candidates; see similar_components.
    """
    keyed = docs.withColumns({"_id": id_in("doc_id"), "_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    key = ["_id", "_key"]
    with scratch(docs.sparkSession):
        found = similar_components(docs, shingle, least)
        first = (F.col("doc_id") == F.col("component_id")) & (F.col("row_key") == F.col("component_key"))
        found = found.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.first(first).alias("first"), F.count("*").alias("n"))
        found = staged(found.where("not first or n > 1"), "found", keep=True)
    gone = found.where("not first").select(*key)
    twice = found.where("first").select(*key)
    rest = keyed.join(gone, key, "left_anti")
    return rest.join(twice, key, "left_anti").unionByName(rest.join(twice, key, "left_semi").dropDuplicates(key)).select(*docs.columns)
