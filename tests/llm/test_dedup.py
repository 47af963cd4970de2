"""Substring dedup and SimHash against brute force."""

import hashlib
import random

import pytest
import xxhash

from skyloom.llm.common import ship
from skyloom.llm.simhash import simhash_dedup
from skyloom.llm.substring_dedup import merged, substring_dedup

SCHEMA = "doc_id long, text string, bucket string, fp string, starts int"


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "x", None, 3) for r in rows], SCHEMA).repartition(3)


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice("ab cd efg hij é ñandú Klm the of".split()) + rnd.choice("xyzuvw")
    passage = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two")]
    for i in range(40):
        own = [word() for _ in range(rnd.randrange(5, 200))]
        if i % 3 == 0:
            at = rnd.randrange(0, 40)
            own[3:3] = passage[at : at + rnd.randrange(5, 30)]
        rows.append((rnd.randrange(10, 10_000), " ".join(own) + "\n"))
    rows += [(20_000 + i, rows[8][1]) for i in range(30)]  # exact copies
    for i in range(30):  # near copies
        own = rows[9][1].split()
        own[rnd.randrange(len(own))] = f"other{i}"
        rows.append((30_000 + i, " ".join(own)))
    return rows + [rows[10], (None, rows[11][1]), (rows[12][0], "again " + rows[13][1])]


def brute_windows(rows, k=13):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            least[key] = min(least.get(key, 10**9), -(10**9) if d is None else d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < (-(10**9) if d is None else d):
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_substring_dedup(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = corpus()
    got = substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_windows(rows)
    assert ordered(map(tuple, got)) == ordered(want)
    assert sum(r[2] for r in want) > 500


def test_substring_dedup_repeats_within_a_text(spark, monkeypatch):
    """Texts that repeat a window within themselves, under one id too, while its smaller holder lies in another partition or batch."""
    import pyarrow as pa

    from skyloom.llm import substring_dedup as module

    rnd = random.Random(11)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = say(20)
    rows = []
    for i in range(24):
        text = " ".join(say(rnd.randrange(3)) + passage + say(rnd.randrange(4)) + passage[: rnd.randrange(13, 21)] + say(2) + passage)
        rows += [(100 + i, text), (100 + i, text + " " + " ".join(passage))][: 1 + i % 2]
    rows += [(5, " ".join(passage)), (200, rows[3][1]), (200, rows[3][1]), (300, "a " * 40), (301, "a " * 50), (None, " ".join(passage[:14] * 2))]
    got = substring_dedup(frame(spark, rows).repartition(len(rows))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_windows(rows))

    monkeypatch.setattr(module, "_BATCH_WORDS", 100)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "row_key": i, "text": t} for i, (d, t) in enumerate(rows) if d is not None])
    sent = list(module._windows([batch], 1, 13))
    assert len(sent) > 5
    spans = {}
    for b in module._count(iter(sent)):
        for r in b.to_pylist():
            spans.setdefault(r["row_key"], []).append(r["span"])
    for i, (want, (d, t)) in enumerate(zip(brute_windows([r for r in rows if r[0] is not None]), [r for r in rows if r[0] is not None])):
        assert sum(z - a for a, z in module.merged(spans.get(i, []), 13)) == want[2]


@pytest.mark.parametrize("most", [0, 20])
def test_substring_dedup_of_crowded_anchors(spark, most):
    """Anchors that are split by the windows' own hashes change nothing."""
    rows = corpus() + [(50_000 + i, f"to be or not to be that is {i} what we ask again today {i} and then some more words of our own {i}") for i in range(60)]
    got = substring_dedup(frame(spark, rows), most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_windows(rows))


def test_long_texts(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen " * 8000
    rows = [(1, long), (2, "zero " + long), (3, "a " * 200_000)]
    got = substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(brute_windows(rows))
    assert len(simhash_dedup(frame(spark, rows)).collect()) == 3


def test_runs_longer_than_a_span(monkeypatch):
    import numpy as np

    from skyloom.llm import substring_dedup as module

    monkeypatch.setattr(module, "_LONGEST", 4)
    first, spans = module._spans(np.zeros(11, int), np.arange(11) + 3)
    assert merged(spans, 13) == [(3, 26)] and len(first) == 3


def test_intervals():
    import numpy as np

    at = lambda start, n=1: start << 24 | n
    assert merged(np.array([at(5, 2), at(19), at(40), at(5), at(33), at(41, 3)]), 13) == [(5, 32), (33, 56)]
    assert merged(np.array([], int), 13) == []


def brute_fp(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    rows = corpus()
    fps = [(d, brute_fp(t, 4)) for d, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    value = lambda i: -(10**9) if rows[i][0] is None else rows[i][0]
    least = {g: min((value(i) for i in range(len(rows)) if group[i] == g)) for g in group}
    want = [(d, f"{fp:016x}", None if least[group[i]] < 0 else least[group[i]]) for i, (d, fp) in enumerate(fps)]
    got = simhash_dedup(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(want)
    assert len({w[2] for w in want}) < len(rows) - 30


def test_links_cover_all_pairs(spark):
    """Random chains of fingerprints at small distances: the links' components are those of all pairs."""
    from skyloom.llm.components import smallest_reachable
    from skyloom.llm.simhash import links

    rnd = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(rnd.randrange(1, 8)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    group = {x: x for x in fps}
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4 and group[x] != group[y]:
                a, b = group[x], group[y]
                group = {k: a if g == b else g for k, g in group.items()}
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    ship(spark)
    table = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, value long")
    got = dict(smallest_reachable(links(table), table.withColumnRenamed("fp", "node")).collect())
    least = {g: min(i for i, x in enumerate(fps) if group[x] == g) for g in set(group.values())}
    size = {g: list(group.values()).count(g) for g in least}
    assert got == {signed(x): least[group[x]] for x in fps if size[group[x]] > 1}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0
    assert simhash_dedup(empty).count() == 0
