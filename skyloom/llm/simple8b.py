"""Simple-8b: a selector of four bits says how many ids of which width fill the other 60 bits of a word.

Selectors 0 to 13 pack the counts below; 14 is unused, and 15 is the escape: the 64-bit word that follows is one id of any size.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: ids in a word, and the bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15


def encode_many(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (unsigned 64-bit) of sequences that lie one after another in ids, and how many words each has.

    Every sequence starts a new word and gets the words it would get alone.
    """
    ids, sizes = np.asarray(ids, np.uint64), np.asarray(sizes, np.int64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    # the largest count that fits at each position: sliding maxima of doubled spans, within the sequence
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8) if ids.max() < 1 << 52 else np.array([int(x).bit_length() for x in ids], np.uint8)
    room = np.repeat(ends, sizes) - np.arange(n)
    choice = np.full(n, ESCAPE, np.uint8)
    choice[bits <= 60] = 13
    spans = {1: bits}
    for s in range(len(COUNTS) - 2, -1, -1):
        count, width = COUNTS[s], BITS[s]
        if n < count or not (choice[: n - count + 1] == s + 1).any():
            break
        half = 1 << (count.bit_length() - 1)
        if half not in spans:
            x = spans[half // 2]
            spans[half] = np.maximum(x[: -half // 2], x[half // 2 :])
        top = spans[half][: n - count + 1]
        if half < count:
            top = np.maximum(top, spans[half][count - half :])
        fits = (top <= width) & (room[: n - count + 1] >= count)
        if not fits.any():
            break
        choice[: n - count + 1][fits] = s
    step = np.array((*COUNTS, 0, 1), np.int64)[choice].tolist()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    starts = np.array(starts)
    kind = choice[starts]
    size = 1 + (kind == ESCAPE)
    to = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.flatnonzero(np.bincount(kind)).tolist():
        rows = np.flatnonzero(kind == s)
        first = starts[rows]
        if s == ESCAPE:
            out[to[rows]] = np.uint64(ESCAPE)
            out[to[rows] + 1] = ids[first]
            continue
        word = np.full(len(rows), s, np.uint64)
        for j in range(COUNTS[s]):
            word |= ids[first + j] << np.uint64(4 + j * BITS[s])
        out[to[rows]] = word
    before = np.append(to, len(out))[np.searchsorted(starts, np.concatenate(([0], ends)))]
    return out, np.diff(before)


def encode(ids: np.ndarray) -> np.ndarray:
    """The words of these ids (unsigned 64-bit)."""
    return encode_many(ids, np.array([len(ids)]))[0]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of these words."""
    words = np.asarray(words, np.uint64)
    kind = (words & np.uint64(15)).astype(np.uint8)
    size = np.array((*COUNTS, 0, 1), np.int64)
    escaped = np.flatnonzero(kind == ESCAPE)
    plain = np.ones(len(words), bool)
    if len(escaped):
        # a literal may itself look like an escape: every second one of a run of neighbours is a literal
        run = np.concatenate(([0], np.cumsum(np.diff(escaped) != 1)))
        first = escaped[np.flatnonzero(np.diff(run, prepend=-1))]
        escaped = escaped[(escaped - first[run]) % 2 == 0]
        plain[escaped + 1] = False
    counts = np.where(plain, size[kind], 0)
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[to[escaped]] = words[escaped + 1]
    for s in np.unique(kind[plain]).tolist():
        if s == ESCAPE:
            continue
        rows = np.flatnonzero(plain & (kind == s))
        mask = np.uint64((1 << BITS[s]) - 1)
        for j in range(COUNTS[s]):
            out[to[rows] + j] = (words[rows] >> np.uint64(4 + j * BITS[s])) & mask
    return out
