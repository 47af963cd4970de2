"""One document of each group of near copies stays: against brute force over all pairs."""

import random
import re

import numpy as np

from skyloom.llm.common import ship
from skyloom.llm.similar import _Sets, similar_components
from skyloom.llm.simhash import keep_one

SCHEMA = "doc_id long, text string, source string, node string, bucket int"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = group[i], group[j]
                    group = [a if g == b else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group)}
    return sorted(least.values())


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def test_keep_one(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], [rnd.choice(vocabulary) for _ in range(40)]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 450))]
        rows += [" ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 25))) for _ in range(rnd.randrange(1, 9))]
    rows += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(60)]) for _ in range(40)]
    rows += ["", None, "  \t", "one", "ONE", "one two three four", "one two three", rows[0].upper().replace(" ", "\n"), rows[3]]
    rnd.shuffle(rows)
    rows = list(enumerate(rows, 1))
    ship(spark)
    docs = spark.createDataFrame([(d, t, None, "x", 3) for d, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in keep_one(docs).collect())
    assert got == brute(rows)
    assert 40 < len(got) < len(rows) - 30
    assert keep_one(docs).columns == docs.columns
    again = keep_one(docs.where("doc_id < 50").union(docs.where("doc_id < 50")).union(spark.createDataFrame([(None, "lone text", "a", "b", 1)], SCHEMA)))
    assert sorted(r[0] for r in again.where("doc_id is not null").select("doc_id").collect()) == brute(rows[:49])
    assert again.where("doc_id is null").count() == 1
    assert keep_one(docs.limit(0)).count() == 0


def test_keep_one_rows_of_one_id(spark):
    """Rows without an id and rows of a repeated id stay if their texts are unlike; only copies go."""
    rnd = random.Random(6)
    say = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    nulls = [(None, say()) for _ in range(12)]
    base, lone = say(), [say() for _ in range(5)]
    keep = [*nulls, (1, base), (2, lone[0]), (3, lone[1]), (3, lone[2]), (3, lone[3]), (9, lone[4]), (9, "")]
    gone = [(None, nulls[0][1]), (7, nulls[1][1]), (2, base.upper()), (2, base + " end"), (3, lone[1]), (9, None)]
    ship(spark)
    docs = spark.createDataFrame([(d, t, None, "x", 3) for d, t in keep + gone], SCHEMA).repartition(3)
    got = [(r.doc_id, r.text or "") for r in keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted(keep, key=str)
    # unlike texts without an id are components of their own: a chain is joined across windows all the same
    chain = [" ".join((base.split() * 4)[i:] + [f"e{j}" for j in range(i)]) for i in range(0, 40, 4)]
    many = spark.createDataFrame([(None, t) for t in chain * 2 + [say() for _ in range(20)]], "doc_id long, text string")
    found = similar_components(many, 5, 0.8, window=3, shard=10).collect()
    assert len({r.component_key for r in found}) == len(brute(list(enumerate(chain)))) + 20


def test_keep_one_on_documents(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in keep_one(docs).select("doc_id").collect()) == brute(rows)


def test_hot_group(spark):
    """More near copies of one text than a window holds, and unlike texts that share a passage."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [" ".join(base)] + [" ".join(edited(rnd, base, 1)) for _ in range(2500)]
    rows += [" ".join(f"c{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    ship(spark)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(docs).select("doc_id").collect()) == [0, *range(2501, 2801)]


def test_narrow_windows(spark):
    """Windows of three and blocks of twelve texts: links between windows, which roots do not show, are found all the same."""
    rnd = random.Random(11)
    rows = []
    for _ in range(12):
        words = [f"w{rnd.randrange(50)}" for _ in range(120)]
        for _ in range(25):  # each a step from the one before, so that only neighbours are similar
            rows.append(" ".join(words))
            words = edited(rnd, words, 1)
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_components(docs, 5, 0.8, window=3, shard=10).collect()
    assert sorted(r.doc_id for r in found if r.doc_id == r.component_id) == brute(rows)


def test_near():
    x = np.sort(np.random.default_rng(4).choice(2**32, 6000, replace=False).astype("<u4"))
    s = _Sets([a.tobytes() for a in (x[:5000], x[500:5500], x[:300], x[30:330], x[33:333], x[:1])])
    assert s.near(0, np.array([1, 2, 5]), 4500 / 5500).tolist() == [True, False, False]
    assert not s.near(0, np.array([1]), 0.82).any()
    assert s.near(2, np.array([4, 3, 2]), 0.81).tolist() == [False, True, True]


def test_spread_join(spark):
    """A frequent key by broadcast, the rest by a shuffle: the rows of a plain join."""
    from skyloom.llm.common import spread_join

    left = spark.createDataFrame([(7 if i % 2 else i % 50, i) for i in range(400)] + [(999, -1)], "k long, i long")
    right = spark.createDataFrame([(k, k * k) for k in range(50)], "k long, v long")
    for how in ("inner", "left"):
        assert sorted(map(tuple, spread_join(left, right, "k", how, least=30).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_stars_of_one_centre(spark, monkeypatch):
    from skyloom.llm import components

    monkeypatch.setattr(components, "FEW", 10)
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(500, 501), (501, 502)], "a long, b long")
    values = spark.createDataFrame([(i, 1000 - i) for i in range(503)], "node long, value long")
    got = {r.node: r.label for r in components.smallest_reachable(links, values).collect()}
    assert got == {**{i: 1000 - 299 for i in range(300)}, **{i: 1000 - 502 for i in (500, 501, 502)}}


def test_components_by_stars_and_by_tasks(spark, monkeypatch):
    """Few links, links that others imply, and a long chain of links: the labels of a union of sets."""
    from skyloom.llm import components

    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(300, 400)] + [(rnd.randrange(250), rnd.randrange(250)) for _ in range(150)] + [(a, b) for a in range(500, 530) for b in range(500, 530)]
    label = {i: i for p in pairs for i in p}
    for a, b in pairs * 2:
        least, gone = sorted((label[a], label[b]))
        label = {k: least if v == gone else v for k, v in label.items()}
    want = {k: v + 7 for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}
    links, values = spark.createDataFrame(pairs, "a long, b long").repartition(3), spark.createDataFrame([(i, i + 7) for i in range(600)], "node long, value long")
    for few in (20_000, 400, 60, 5):
        monkeypatch.setattr(components, "FEW", few)
        assert {r.node: r.label for r in components.smallest_reachable(links, values).collect()} == want
