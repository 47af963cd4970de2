"""Hard negatives against brute force over all rows."""

import math
import random

from skyloom.llm import hard_negatives as hn
from skyloom.llm.common import ship

SCHEMA = "vec_id long, label int, embedding array<float>, norm string"


def brute(rows, every=100, low=30, high=90):
    rows = [(i, d, (l + 1) % 10 if d % 7 == 0 else l, [math.floor(256 * x) for x in e]) for i, (d, l, e) in enumerate(rows) if d is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, a, la, va in rows:
        if a % every:
            continue
        order = sorted((-dot(va, v), d, j, label) for j, d, label, v in rows if j != i)
        for ps, p, _, _ in [x for x in order if x[3] == la][:5]:
            fits = [(s, d) for s, d, _, label in order if label != la and low * -ps <= 100 * -s <= high * -ps][:10]
            out += [(a, p, r, d, -ps, -s) for r, (s, d) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **more):
    ship(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = []
    for d in range(400):
        size = rnd.choice([0.02, 0.3, 1, 4])
        rows.append((d, rnd.randrange(4), [f32(size * rnd.uniform(-0.4, 1)) for _ in range(6)]))
    rows += [(d, 2, rows[7][2]) for d in range(1000, 1150)]  # a hot vector, ties
    rows += [(None, 1, [1.0]), (3000, None, [1.0]), (3100, 1, None), (3200, 1, [1.0, None]), (3300, 1, [float("nan")]), (3400, 1, [float("inf")]), (3500, 1, []), (-100, 1, [1.0, 0.5]), (3600, 9, [0.0] * 6)]
    assert run(spark, rows, every=20) == brute(rows, 20)
    monkeypatch.setattr(hn, "BUCKET", 7)
    monkeypatch.setattr(hn, "PACK", 5)
    assert run(spark, rows, every=20) == brute(rows, 20)


def test_rows_of_one_id_and_large_scores(spark):
    rows = [(100, 1, [1.0, 2.0]), (100, 1, [2.0, 1.0]), (100, 1, [2.0, 1.0]), (101, 2, [0.5, 0.5]), (101, 2, [0.5, 0.5]), (102, 3, [0.1, 1.0])]
    assert run(spark, rows) == brute(rows)
    big = [(100, 1, [2.0**40, 1.0]), (1, 1, [2.0**40, 3.0]), (2, 2, [2.0**39, 5.0]), (3, 2, [2.0**39, 4.0])]
    got = run(spark, big)
    assert [r[3] for r in got] == [r[3] for r in brute(big)] == [2, 3]
    assert run(spark, [(1, 1, [1.0])]) == [] and run(spark, rows[:0]) == []


def test_pruning(monkeypatch):
    """Buckets under the bound are never multiplied."""
    import numpy as np
    import pandas as pd

    pack = hn._Pack(pd.DataFrame({"row": [0], "label": [1], "norm": [2.0], "v": [[2]], "scores": [[10]]}), 1, False, 30, 90)
    one = lambda x: (np.array([x]), np.array([x]), np.array([2]), np.array([[x]]))
    pack.meet(4.0, *one(4))
    assert pack.best == [[[(8, 4, 4)]]] and pack.least.tolist() == [8.0]
    monkeypatch.setattr(hn.np, "pad", None)  # a product would fail
    pack.meet(3.0, *one(3))
    assert pack.found()["score"].tolist() == [8]
