"""Top N by bisection against sorting."""

import random

from pyspark.sql import functions as F

from netquarry.llm import topn


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, "g string, i string, s double, t int")
    got = topn.top_n(df, F.col("g"), F.col("i"), F.col("s"), F.col("t"), n, **kw).collect()
    return {(r.group_key, r.rank_no): r.identifier for r in got}


def expected(rows, n):
    best = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or s != s:
            continue
        key = (-s + 0.0, float("inf") if t is None else t)
        if (g, i) not in best or key < best[g, i]:
            best[g, i] = key
    out = {}
    for g in {g for g, _ in best}:
        ranked = sorted((k, i.encode()) for (h, i), k in best.items() if h == g)[:n]
        out |= {(g, r): i.decode() for r, (_, i) in enumerate(ranked, 1)}
    return out


def test_ties_nulls_and_uneven_groups(spark):
    rng = random.Random(5)
    rows = []
    for g, size in (("hot", 2000), ("mid", 40), ("few", 3), (None, 5)):
        for _ in range(size):
            s = rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.5, round(rng.random(), 2)])
            rows.append((g, f"shared::prefix::node_{rng.randrange(600):03d}é"[: rng.choice([23, 24])], s, rng.choice([None, 0, 1, 2])))
    rows += [("same", f"very::long::common::prefix::{k:04d}", 1.0, 1) for k in range(300)]
    rows.append(("nul", None, 1.0, 1))
    for n, kw in ((1, {}), (5, {}), (5, {"hot": 50})):
        assert run(spark, rows, n, **kw) == expected(rows, n)


def test_empty_and_zero_bytes(spark):
    assert run(spark, [], 5) == {}
    rows = [("g", "a", 1.0, 0), ("g", "a\0", 1.0, 0), ("g", "a\0\0", 1.0, 0)]
    assert run(spark, rows, 2) == {("g", 1): "a", ("g", 2): "a\0"}
