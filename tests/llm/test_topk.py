import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import topk


def brute(rows, k, is_query):
    vs = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in vs if is_query(i)}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in vs if j != i and len(w) == len(v)))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    v = topk.scaled(df, "vec_id", "embedding", 64.0)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.filter(F.col("id") % 20 == 0), v, k).collect()}


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # many ties
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1020, []), (1040, [1.0, 2.0]), (1041, [3.0, 1.0]), (1060, [0.0] * 6)]
    assert run(spark, rows, 5) == brute(rows, 5, lambda i: i % 20 == 0)


def test_large_components_repeats_and_few_candidates(spark):
    rows = [(0, [3e12, 1.0]), (1, [2e12, 5.0]), (2, [-4e9, 7.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0])]
    got = run(spark, rows, 20)
    big = lambda x: int(np.floor(64 * np.float64(np.float32(x))))
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert (0, 1, 1, clip(big(3e12) * big(2e12) + 64 * 320)) in got
    assert sum(q == 20 and v == 21 for q, _, v, _ in got) == 2 and not any(q == v for q, _, v, _ in got)
    assert run(spark, rows[:0] or [(5, [1.0])], 3) == set()


def test_stops_before_the_lists_end():
    """Skewed vectors: the bound ends the search early, and the answer is still exact."""
    rng = np.random.default_rng(2)
    x = (rng.exponential(size=(4000, 8)) ** 4 * 10).astype(np.int64)
    q = np.zeros((3, 8), np.int64)
    q[[0, 1, 2], [1, 4, 6]] = 5
    ids, vec, score = topk.threshold_search(np.array([-1, -2, -3]), q, np.arange(4000), x, 10, met_out=(met := []))
    assert len(met) == 3 and max(met) < 0.5
    for i, v in zip((-1, -2, -3), q):
        s = x @ v
        want = sorted(range(4000), key=lambda j: (-s[j], j))[:10]
        assert list(vec[ids == i]) == want and list(score[ids == i]) == [s[j] for j in want]
