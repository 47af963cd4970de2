"""SetSketch near-dedup against all pairs of whole shingle sets."""

import random
import re

import numpy as np

from skyloom.llm import setsketch as ss
from skyloom.llm.common import ship

SCHEMA = "doc_id long, text string, node string, size int"


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = group[i], group[j]
                    group = [a if g == b else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group)}
    return sorted((d, len(s), least[g], d == least[g]) for (d, _), s, g in zip(rows, sets, group))


def run(spark, rows, **more):
    ship(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in ss.setsketch_dedup(df, **more).collect())


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], [rnd.choice(vocabulary) for _ in range(40)]
    for _ in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 400))]
        rows += [" ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 30))) for _ in range(rnd.randrange(1, 9))]
    rows += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 60))]) for _ in range(40)]
    rows += ["", None, "  \t", "one", "ONE", "one two", "one two three", "one two three four", rows[0].upper().replace(" ", "\n"), rows[3], "é É", "É é", "a b c d " * 20000, "A b c d " * 20001]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


def test_brute_force(spark):
    rows = corpus(4)
    want = brute(rows)
    assert 20 < sum(not r[3] for r in want) < len(rows) - 60
    assert run(spark, rows) == want
    # narrow windows and small shards: links between windows and shards are found by the second pass
    assert run(spark, rows, window=3, shard=10) == want
    assert run(spark, rows[:0]) == []


def test_hot_group_and_rows_of_one_id(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rnd, base, 2))) for i in range(1, 1500)] + [(i, "same text of many copies here") for i in range(5000, 6000)]
    rows += [(9000 + i, " ".join(f"c{rnd.randrange(10**6)}" for _ in range(60))) for i in range(100)]
    got = run(spark, rows)
    assert [r[0] for r in got if r[3]] == [1, 5000, *range(9000, 9100)]
    rows = [(None, "first words of a text"), (None, "quite other words here"), (7, "first words of a text"), (8, "quite other words here too"), (8, "nothing alike in this one"), (8, "nothing alike in this one"), (None, "")]
    key = lambda r: (r[0] or 0, r[1], r[2] or 0)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in ss.setsketch_dedup(df).collect()), key=key)
    assert got == sorted([(None, 3, None, True), (None, 2, None, True), (7, 3, None, False), (8, 3, 8, True), (8, 3, 8, True), (8, 3, 8, True), (None, 0, None, True)], key=key)


def test_estimates():
    """Registers of similar sets, their merging, and the likelihood's estimate."""
    rng = np.random.default_rng(5)
    u = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    a, b = u[:3000], u[300:3400]
    ka, kb = ss.registers(a), ss.registers(b)
    assert (np.maximum(ka, kb) == ss.registers(np.union1d(a, b))).all()
    assert abs(ss.cardinality(ka) / 3000 - 1) < 0.25 and ss.cardinality(ss.registers(u[:0])) == 0
    off = []
    for _ in range(60):
        u = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        a, b = u[:3000], u[300:3400]
        ka, kb = ss.registers(a), ss.registers(b)
        best = ss.similarity(3000, np.array([3100]), np.array([(ka > kb).sum()]), np.array([(ka < kb).sum()]), np.array([(ka == kb).sum()]))[0][0]
        grid = np.linspace(0.01, 0.96, 2000)
        like = ss._log_likelihood(grid, 3000 / 6100, 3100 / 6100, (ka > kb).sum(), (ka < kb).sum(), (ka == kb).sum())
        assert abs(grid[like.argmax()] - best) < 1e-3
        off.append(best - 2700 / 3400)
    assert abs(np.mean(off)) < 0.015 and 0.01 < np.std(off) < 0.06


def test_distinct_shingles(spark):
    ship(spark)
    rows = [(i, " ".join(f"t{j}" for j in range(10 * i, 10 * i + 30)), "a" if i % 2 else "b", 0) for i in range(100)]
    docs = spark.createDataFrame([*rows, (1, None, "none", 0)], SCHEMA)
    got = {r.node: r.estimate for r in ss.distinct_shingles(docs, "node").collect()}
    true = {n: len(set().union(*(shingles(t) for _, t, m, _ in rows if m == n))) for n in "ab"}
    assert got["none"] == 0 and all(abs(got[n] / true[n] - 1) < 0.3 for n in "ab")


def test_documents(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in ss.setsketch_dedup(docs).collect()) == brute(rows)
