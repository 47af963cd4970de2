"""Mixing against its definition, Simple-8b and token files against round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm.common import ship, table
from skyloom.llm.mixing import mix_sources, targets
from skyloom.llm.simple8b import decode, encode
from tests.conftest import SF


def water(sizes: dict, share=1.5, most=2.0):
    """By the words of the definition: share, cap, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return goal | capped
        capped |= {s: most * sizes[s] for s in over}


@given(st.dictionaries(st.one_of(st.none(), st.text("abzÉ😀", min_size=0, max_size=3)), st.integers(0, 5000), min_size=1, max_size=9))
@settings(max_examples=12, deadline=None)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)


def test_mix(spark):
    docs = table(spark, SF, "documents")
    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(got) == key(again) and len(got) == docs.count()
    taken, size, goal = Counter(), Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        size[r.source] += r.size
        goal[r.source] = r.target
    assert goal == pytest.approx(water(size))
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 30


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 50, None), (3, "x " * 50, None), (None, "one two", "a"), (5, "w", "b")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(docs).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 50, 50]
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix_sources(docs.limit(0)).count() == 0


def test_mix_of_many_sources(spark, monkeypatch):
    """More sources than a flight could ever settle together, and one large source that flies in parts."""
    from skyloom.llm import mixing

    monkeypatch.setattr(mixing, "FLIGHT_ROWS", 1000)
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(1, 30), f"s{i % 5200}.org") for i in range(62_400)] + [(None, "w " * rnd.randrange(1, 30), None) for _ in range(6000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert len(got) == len(rows) and len(goal) == 5201
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 30 for s in goal)


def test_mixed_rows_of_one_id(spark):
    """Rows of equal size without an id keep to their sources: each is taken as often as the mix says."""
    from skyloom.llm.mixing import mixed

    rows = [(None, f"{a} {i} w", s) for s, a in (("a", "x"), ("b", "y"), ("c", "z")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = Counter(r.source for r in mix_sources(docs).collect() for _ in range(r.copies))
    assert Counter(r.source for r in mixed(docs).collect()) == taken


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49_407), st.integers(0, 2**64 - 1)), max_size=300))
@settings(deadline=None)
def test_simple8b(ids):
    assert decode(encode(np.array(ids, np.uint64))).tolist() == ids


def test_simple8b_is_dense():
    assert len(encode(np.ones(600, np.uint64))) == 10
    assert len(encode(np.full(400, 40_000, np.uint64))) == 134  # three of 20 bits
    assert decode(encode(np.array([2**63 + 15, 2**64 - 1, 15, 2**62], np.uint64))).tolist() == [2**63 + 15, 2**64 - 1, 15, 2**62]


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skyloom.llm.token_output import token_output

    ship(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(1)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    odd = ["", None, " \n", "It's 12.5km, y'all'll <|endoftext|>x naïve É́ é ́x", "a\x1cb\x85c d e", "ΣΑΣ ΟΔΟΣ. İI ǅ", "don't,stop!! ** || x|| &%$ 世界 人。", "\x00 ﻿ ​", "ﬁ ﬂ Å K", "a\u2028b\u3000c\xa0d\u1680e\u200af"]
    odd += ["".join(rnd.choice("aB. ,'’0é́ ſß中|*\n\t\x0b\x1f😀") for _ in range(60)) for _ in range(60)]
    rows += [(100_000 + i, x) for i, x in enumerate(odd)] + [rows[3], rows[3]]
    got = token_output(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int"), path).orderBy("doc_id").collect()
    want, at = [], 0
    for d, x in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_output(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_simple8b_of_many():
    """Sequences side by side get the words that each gets alone."""
    import numpy as np

    from skyloom.llm.simple8b import decode, encode, encode_many

    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 1 << int(rng.integers(1, 62)), int(rng.integers(0, 300)), dtype=np.uint64) for _ in range(60)] + [np.ones(200, np.uint64)] * 3
    words, sizes = encode_many(np.concatenate(parts), np.array([len(p) for p in parts]))
    assert [w.tolist() for w in np.split(words, np.cumsum(sizes)[:-1])] == [encode(p).tolist() for p in parts]
    assert decode(words).tolist() == np.concatenate(parts).tolist()
    assert [len(x) for x in encode_many(np.zeros(0), np.zeros(3, int))] == [0, 3]
