"""Substring dedup: Rabin-Karp hashes of every 13-word window, counted in Spark; repeated windows merge into removal intervals.

A window goes to the task of its anchor, the smallest hash among the 5-word grams it holds: equal windows have equal anchors, and
neighbouring windows mostly share one, so a run of windows costs one anchor and four bytes a window. Before the shuffle each batch
of documents settles what repeats inside it and sends a window from its smallest document only, with all its places there; a passage that every
document holds therefore reaches a task from one document of a batch, not from each. Anchors that more windows share than a task should
get are counted beforehand, and their windows go by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import NULL_ID, grams, id_out, mix, partitions, sliding_min, staged, texts, trimmed, word_hashes

_ANCHOR = 5
#: Words of text that one batch settles at once; it bounds the memory of a task.
_BATCH_WORDS = 1_500_000
#: Windows that one packed span tells of; longer runs are several spans.
_LONGEST = (1 << 24) - 1


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at consecutive words of a row as one long: the first word above 24 bits, and the number of windows. With the first's index."""
    new = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) != 1)))[: len(row)]
    first = np.flatnonzero(new)
    new |= (np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))) % _LONGEST == 0
    first = np.flatnonzero(new)
    return first, start[first].astype(np.int64) << 24 | np.diff(np.append(first, len(row)))


def _joined_keys(anchor: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A window's identity: its anchor, and 40 bits of its own hash."""
    return mix(anchor + low * np.uint64(0xD6E8FEB86659FD93))


def _anchors(words: np.ndarray, window: int) -> np.ndarray:
    return sliding_min(grams(words, _ANCHOR), window - _ANCHOR + 1)


def _frequent(batches, window: int, share: float):
    """(anchor, n): anchors with at least this share of a batch's windows, and how many they have."""
    held, words = [], 0

    def out():
        all_ = np.concatenate(held)
        anchor, n = np.unique(all_, return_counts=True)
        some = n >= max(4, share * len(all_))
        return pa.RecordBatch.from_arrays([pa.array(anchor[some].view(np.int64)), pa.array(n[some].astype(np.int64)), pa.array(np.zeros(some.sum(), np.int64))], names=["anchor", "n", "of"])

    for batch in batches:
        total = 0
        for text in batch["text"]:
            h, _ = word_hashes(b" ".join(_split(text.as_py())))
            if len(h) >= window:
                held.append(_anchors(h, window))
                words += len(h)
                total += len(h) - window + 1
            if words >= _BATCH_WORDS:
                yield out()
                held, words = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["anchor", "n", "of"])
    if held:
        yield out()


def _crowded(rows: DataFrame, window: int, buckets: int, most: int | None) -> np.ndarray:
    """Sorted anchors that so many windows share that a task would hold them all: over a quarter of a bucket's share, so four for each
    bucket at most."""
    found = rows.mapInArrow(lambda b: _frequent(b, window, 1 / (16 * buckets)), "anchor long, n long, of long")
    found = staged(found.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("of").alias("of")), "anchors")
    total = found.agg(F.sum("of")).first()[0] or 0
    limit = max(100_000, total // (4 * buckets)) if most is None else most
    hot = found.where((F.col("n") > limit) & (F.col("anchor") != 0)).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in hot], np.int64).view(np.uint64))


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal key in a smaller document; and which a smaller document elsewhere may still hold: all places of
    each key in its smallest document, or one of them if that has a null id, as nothing is smaller."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    d = doc[order]
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(k))))
    later = np.zeros(len(key), bool)
    later[order] = d > least
    own = d == least
    seen = np.cumsum(own)
    begin = np.repeat(seen[first] - own[first], np.diff(np.append(first, len(k))))
    open_ = np.zeros(len(key), bool)
    open_[order] = own & ((d != NULL_ID) | (seen - begin == 1))
    return later, open_


def _settle(docs: list[tuple], parts: list[tuple], buckets: int, window: int) -> Iterator[dict]:
    """docs: (doc_id, row key); parts: for each the window hashes and anchors."""
    if not docs:
        return
    n = np.array([len(h) for h, _ in parts])
    key = np.concatenate([h for h, _ in parts])
    if not len(key):
        return
    anchor = np.concatenate([a for _, a in parts])
    which = np.repeat(np.arange(len(docs)), n)
    pos = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
    ids = np.array([d for d, _ in docs], np.int64)
    low = key >> np.uint64(24)
    later, send = _repeats(_joined_keys(anchor, low), ids[which])
    at = np.flatnonzero(later)
    first, spans = _spans(which[at], pos[at])
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(which[at[first]])) + 1) if len(at) else ():
        d, row = docs[which[at[first[part[0]]]]]
        yield {"bucket": -1 - d % buckets, "doc_id": d, "row_key": row, "spans": spans[part].tobytes(), "blob": None}
    at = np.flatnonzero(send)
    new = np.concatenate(([True], (which[at][1:] != which[at][:-1]) | (pos[at][1:] != pos[at][:-1] + 1) | (anchor[at][1:] != anchor[at][:-1])))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    # runs longer than a byte can tell are cut
    while length.max(initial=0) > 255:
        more = begin[length > 255] + 255
        begin = np.sort(np.concatenate((begin, more)))
        length = np.diff(np.append(begin, len(at)))
    head = at[begin]
    to = (anchor[head] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0)))
    low = low[at]
    for runs in np.split(order, cut[1:]):
        size = length[runs]
        rows = np.repeat(begin[runs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own, index = np.unique(which[head[runs]], return_inverse=True)
        blob = b"".join((
            np.array([len(runs), len(own), size.sum()], np.int64).tobytes(), anchor[head[runs]].tobytes(), ids[own].tobytes(),
            np.array([docs[i][1] for i in own], np.int64).tobytes(), pos[head[runs]].astype(np.uint32).tobytes(),
            (low[rows] >> np.uint64(8)).astype(np.uint32).tobytes(), low[rows].astype(np.uint8).tobytes(), index.astype(np.uint32).tobytes(), size.astype(np.uint8).tobytes(),
        ))
        yield {"bucket": int(to[runs[0]]), "doc_id": None, "row_key": None, "spans": None, "blob": blob}


_SENT = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("spans", pa.binary()), ("blob", pa.binary())])


def _windows(batches, buckets: int, window: int, crowded: np.ndarray = np.zeros(0, np.uint64)):  # noqa: B008
    docs, parts, words, known = [], [], 0, set()

    def out():
        for rows in _chunks(_settle(docs, parts, buckets, window), 512):
            yield pa.RecordBatch.from_pylist(rows, _SENT)

    for batch in batches:
        for d, row, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"]):
            if (d, row) in known:  # a repeated row: what is found for the first holds for it too
                continue
            h, _ = word_hashes(b" ".join(_split(text.as_py())))
            if len(h) >= window:
                known.add((d, row))
                docs.append((d, row))
                key, anchor = grams(h, window), _anchors(h, window)
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                    anchor = np.where(crowded[at] == anchor, key, anchor)
                parts.append((key, anchor))
                words += len(h)
            if words >= _BATCH_WORDS:
                yield from out()
                docs, parts, words = [], [], 0
                known.clear()
    yield from out()


def _chunks(rows, n):
    some = []
    for r in rows:
        some.append(r)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


_FOUND = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("span", pa.int64())])


def _count(batches):
    """All windows of some anchors: spans of those that a smaller document holds too."""
    keys, docs, rows, starts = [], [], [], []
    for batch in batches:
        settled = batch.filter(pc.is_valid(batch["spans"]))
        if settled.num_rows:
            spans = [np.frombuffer(x.as_buffer(), np.int64) for x in settled["spans"]]
            n = [len(x) for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(settled[c].to_numpy(), n)) for c in ("doc_id", "row_key")] + [pa.array(np.concatenate(spans))], schema=_FOUND)
        for blob in batch["blob"].drop_null():
            b = blob.as_buffer()
            r, d, w = np.frombuffer(b, np.int64, 3)
            at = 24

            def take(kind, n):
                nonlocal at
                x = np.frombuffer(b, kind, n, at)
                at += x.nbytes
                return x

            anchor, ids, own, pos = take(np.uint64, r), take(np.int64, d), take(np.int64, d), take(np.uint32, r)
            low = take(np.uint32, w).astype(np.uint64) << np.uint64(8) | take(np.uint8, w)
            index, size = take(np.uint32, r), take(np.uint8, r).astype(np.int64)
            within = np.arange(w) - np.repeat(np.cumsum(size) - size, size)
            keys.append(_joined_keys(np.repeat(anchor, size), low))
            docs.append(np.repeat(ids[index], size))
            rows.append(np.repeat(own[index], size))
            starts.append((np.repeat(pos, size) + within).astype(np.uint32))
    if not keys:
        return
    key, doc, row, start = map(np.concatenate, (keys, docs, rows, starts))
    del keys, docs, rows, starts
    later, _ = _repeats(key, doc)
    doc, row, start = doc[later], row[later], start[later]
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    if not len(doc):
        return
    first, spans = _spans(np.cumsum((np.diff(doc, prepend=doc[:1]) != 0) | (np.diff(row, prepend=row[:1]) != 0)), start)
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(row[first]), pa.array(spans)], schema=_FOUND)


def merged(spans: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) of words that these spans of windows cover."""
    s = np.sort(np.asarray(spans, np.int64))
    if not len(s):
        return []
    begin = s >> 24
    end = np.maximum.accumulate(begin + (s & ((1 << 24) - 1)) - 1 + window)
    cut = np.concatenate(([True], begin[1:] > end[:-1]))
    return list(zip(begin[cut].tolist(), end[np.append(cut[1:], True)].tolist()))


def _apply(batches, window: int):
    for batch in batches:
        out = []
        for d, packed, found in zip(batch["doc_id"].to_pylist(), batch["packed"], batch["found"]):
            words = zstandard.decompress(packed.as_py()).split()
            spans = merged(found.values.to_numpy(), window) if found.is_valid else []
            kept, at = [], 0
            for a, z in spans:
                kept += words[at:a]
                at = z
            kept += words[at:]
            text = b" ".join(kept)
            out.append((d, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass"), [x for s in spans for x in s]))
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r)) for r in out], _RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.int64()))])


def _packed(batches):
    for batch in batches:
        zip_ = zstandard.ZstdCompressor(level=1)
        packed = [zip_.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(packed, pa.binary())], names=["doc_id", "row_key", "packed"])


def substring_dedup(docs: DataFrame, window: int = 13, most: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, removed (begin and end of each interval of words, flattened).

    A word goes if a window of `window` consecutive words that covers it also starts in a document with a smaller doc_id. Null and
    empty texts have no words: n_words 0 and the hash of the empty text. Rows with one doc_id never remove words of each
    other; a null doc_id counts as smaller than any other. Repeated rows each come back. Texts are taken whole, however long. An empty
    table gives an empty result. most: windows of one anchor from which on they go apart; it changes where work is done, not what is found.
    """
    if window < 6:
        raise ValueError("a window has six words or more")
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    crowded = spark.sparkContext.broadcast(_crowded(rows, window, buckets, most))
    sent = rows.mapInArrow(lambda b: trimmed(_windows(b, buckets, window, crowded.value)), "bucket int, doc_id long, row_key long, spans binary, blob binary")
    found = sent.repartition(partitions(spark), "bucket").mapInArrow(lambda b: trimmed(_count(b)), "doc_id long, row_key long, span long")
    found = found.groupBy("doc_id", "row_key").agg(F.collect_list("span").alias("found"))
    small = rows.mapInArrow(_packed, "doc_id long, row_key long, packed binary")
    both = small.join(found.hint("merge"), ["doc_id", "row_key"], "left").select("doc_id", "packed", "found")
    out = both.mapInArrow(lambda b: _apply(b, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<long>")
    return out.withColumn("doc_id", id_out("doc_id"))
