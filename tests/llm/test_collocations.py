"""Phrase collocations against counting every phrase of every text."""

import random
import re
from collections import Counter, defaultdict

from skyloom.llm import collocations as co
from skyloom.llm.common import ship

SCHEMA = "id long, text string, lang string, word string"


def brute(rows, longest=3, least=10, top=2000, inside=50):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        best = []
        for p, a in found.items():
            if covered[p] and 100 * covered[p] >= inside * a:
                continue
            s, _, l, r = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def run(spark, rows, parts=3, **more):
    ship(spark)
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in co.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Straße", "naïve", "日本", "😀", "\x1f", "a\x00b", " ", "İ", "zz�"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(0, 60)):
            words += rnd.choice([["New", "York", "City"], ["of", "the"], ["the"], [rnd.choice(vocabulary)], [rnd.choice(vocabulary)], [f"rare{rnd.randrange(10**6)}"]])
        seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! ", "\x0b", "\r\n"]
        rows.append(("".join(w + rnd.choice(seps) for w in words), rnd.choice(["en", "de", None, ""])))
    return rows


def test_brute_force(spark, monkeypatch):
    rows = corpus(1, 250) + [(None, "en"), ("", "de"), (" \t. ", "xx"), ("lone", None)] + [("the very same words come again", "en")] * 40
    rows.append(("long tail of words " * 30000, "en"))
    want = brute(rows)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "de", "und", ""}
    assert run(spark, rows) == want
    monkeypatch.setattr(co, "BLOCK_BYTES", 2000)  # many blocks, many ranges, merges within a range
    monkeypatch.setattr(co, "RANGE_KEYS", 150)
    assert run(spark, rows, 5) == want
    assert run(spark, rows, top=7) == brute(rows, top=7)
    assert run(spark, rows[:200], longest=4, least=5, inside=80) == brute(rows[:200], 4, 5, inside=80)


def test_ties_and_empty(spark):
    rows = [(f"a{i} b{i}. c d{i % 3}", "en") for i in range(6)] * 12  # all of one score
    assert run(spark, rows, top=3) == brute(rows, top=3)
    assert run(spark, rows[:0]) == [] and run(spark, [(None, None), ("a b", "en")]) == []


def test_radix_and_ids_beyond_16_bits():
    import numpy as np

    m = np.random.default_rng(2).integers(0, 2**32, (5000, 3), dtype=np.uint32)
    m[::3, 0] = 70000
    assert (m[co._radix(m)] == m[np.lexsort(m.T[::-1])]).all()
    assert (co._from_planes(co._planes(m), len(m), 3) == m).all()


def test_exact_scores(spark):
    """Scores whose products pass 64 bits."""
    grams = spark.createDataFrame([([1, 2], 3_000_000_007)], "ids array<int>, f long")
    dictionary = spark.createDataFrame([(1, "en", "a", 3_000_000_019), (2, "en", "b", 4_000_000_007)], "id long, lang string, word string, f long")
    assert co._scored(grams, dictionary, 50).first().score == 10**6 * 3_000_000_007**2 // (3_000_000_019 * 4_000_000_007)


def test_sorts_of_few_keys(monkeypatch):
    """Ranges of many keys are sorted in pieces, to the same phrases, in memory in proportion to what is held."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(7)
    parts, f = [], Counter()
    for _ in range(40):
        m, counts = co._counted((rnd.pareto(0.5, (30_000, 3)) + 1).clip(1, 9000).astype(np.uint32), np.ones(30_000, np.int64))
        parts.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([len(m)], pa.int32()), pa.array([co._planes(m)]), pa.array([co._planes(counts)])], ["range", "n", "keys", "counts"]))
        for k in (2, 3):
            at = co._starts(m, k)
            f.update(dict(zip(map(tuple, m[at, :k].tolist()), np.add.reduceat(counts, at).tolist())))
    want = {k: v for k, v in f.items() if v >= 10}
    for size in (400_000, 5000):
        monkeypatch.setattr(co, "SORT_KEYS", size)
        tracemalloc.start()
        out = list(co._runs(iter(parts), 3, 10))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        got = [(tuple(i), n) for b in out for i, n in zip(b.column("ids").to_pylist(), b.column("f").to_pylist())]
        assert len(got) == len(want) and dict(got) == want
        assert most < 60 * sum(b.column("n")[0].as_py() for b in parts)  # 68 where all keys are sorted at once
