"""Exact top-k search by Fagin's threshold algorithm.

Vectors are dealt into blocks; a block keeps one list of its vectors per dimension, sorted by that
component. For a query the lists are read from the end that its component favours, in rounds of doubling
depth. Vectors met for the first time in a round are scored by random access, a whole batch of queries with
one matrix product. The bound on any vector not met is the largest score that the list values at the depth
reached and the block's largest norm allow together; a query stops when that bound is below its kth score
(not when equal: an unmet tie could have a smaller id), or when every vector is met. One block is searched
before the others, which then stop at its kth score as well and return only what reaches it. The blocks'
answers are merged by a window of k rows per query and block.

Scores are exact integers: float matrix products only where every possible sum is below 2**53 (2**24
in single precision), int64 below 2**62, Python integers saturated to the range of long beyond; components are held between -2**62 and 2**62.

Defined results: rows without an id and vectors null or with null or non-finite components take no part; vectors of another
length than the query's are no candidates; empty vectors score 0; a repeated query row counts once;
repeated candidate rows each take a place; a row with the query's own id is never its candidate; with
fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.shared import materialise

BLOCK = 65536  # candidates of a task
QUERIES = 16384  # queries of a task
BATCH = 64  # queries that share one matrix product
FOUND = "query_id long, vec_id long, score long"


def scaled(df: DataFrame, key: str, vector: str, factor: float) -> DataFrame:
    """id, v: floor(factor * component) of the vectors that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = lambda y: F.greatest(F.lit(float(-(2**62))), F.least(F.lit(float(2**62)), y))
    whole = F.transform(v, lambda x: F.floor(held(F.lit(factor) * x.cast("double"))).cast("long"))
    return df.filter(F.col(key).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def _matrices(q: np.ndarray, x: np.ndarray):
    """Both sides in the narrowest type whose sums are exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    for kind, limit in ((np.float32, 2**24), (np.float64, 2**53), (np.int64, 2**62)):
        if most < limit:
            return q.astype(kind), x.astype(kind)
    return q.astype(object), x.astype(object)


def _bounds(a: np.ndarray, most: np.ndarray, norm: float) -> np.ndarray:
    """For each row of a (not negative) an upper bound of a . y over all y <= most in every component and |y| <= norm.

    By duality, sum(a * y) - (|y|**2 - norm**2) / (2 * t) at y = min(t * a, most) is one for every t > 0; the least of
    a few is taken, and the sum over all of most, which needs no norm. Rounded up against errors of floating point."""
    best = (a * most).sum(axis=1)
    size = np.linalg.norm(a, axis=1)
    for factor in (1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 5.0, 9.0):
        t = (factor * norm / np.maximum(size, 1e-300))[:, None]
        y = np.minimum(t * a, most)
        best = np.minimum(best, (a * y).sum(axis=1) - ((y * y).sum(axis=1) - norm * norm) / (2 * t[:, 0] + 1e-300))
    return best + 1e-9 * (1 + np.abs(best))


def threshold_search(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, met_out: list | None = None):
    """(query id, vec id, score) of each query's k best in one block; floor: a score that k vectors elsewhere reach, below
    which nothing is of use (the least long: none). met_out gets each query's share of vectors met."""
    order = np.argsort(xid, kind="stable")
    xid, x = xid[order], x[order]
    n, dims = x.shape
    floor = np.full(len(qid), np.iinfo(np.int64).min) if floor is None else floor
    exact_q, exact_x = _matrices(q, x)
    lists = np.argsort(x, axis=0, kind="stable").T  # per dimension, rising
    values = np.take_along_axis(x.T, lists, axis=1).astype(np.float64)
    norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) * (1 + 1e-12)
    out = []
    for lo in range(0, len(qid), BATCH):
        ids, part, least = qid[lo : lo + BATCH], exact_q[lo : lo + BATCH], floor[lo : lo + BATCH]
        signed = q[lo : lo + BATCH].astype(np.float64)
        active = np.arange(len(ids))
        met = np.zeros(n, bool)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, exact_q.dtype))] * len(ids)
        depth = 0
        while len(active):
            deeper = min(n, 2 * (depth or k))
            up, down = (part[active] > 0).any(axis=0), (part[active] < 0).any(axis=0)
            fresh = np.zeros(n, bool)
            fresh[lists[up, n - deeper : n - depth]] = True  # sorted access from the high end
            fresh[lists[down, depth:deeper]] = True  # and from the low end
            if not dims or deeper == n:
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~met)
            met |= fresh
            depth = deeper
            scores = part[active] @ exact_x[rows].T if dims else np.zeros((len(active), len(rows)), exact_q.dtype)
            s = signed[active]
            bound = _bounds(np.abs(s), np.where(s > 0, values[:, n - depth], -values[:, depth - 1]), norm) if dims else np.zeros(len(active))
            done, stay = met.all(), []
            for at, i in enumerate(active):
                s, r = scores[at], rows
                if len(s) > k:  # all that reach the kth score; ties are cut by id below
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    sel = np.flatnonzero(s >= kth)
                    s, r = s[sel], r[sel]
                other = xid[r] != ids[i]
                if not other.all():  # the query's own row took a place: choose again without it
                    s, r = scores[at], rows
                    other = xid[r] != ids[i]
                r, s = np.concatenate([best[i][0], r[other]]), np.concatenate([best[i][1], s[other]])
                top = np.lexsort((r, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], r[j]))[:k], int)
                best[i] = r[top], s[top]
                if not done and not (bound[at] < least[i] or len(top) == k and bound[at] < float(best[i][1][-1])):
                    stay.append(i)
                elif met_out is not None:
                    met_out.append(met.mean())
            active = np.array(stay, int)
        for i, (r, s) in enumerate(best):
            s = np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in s], np.int64) if s.dtype == object else s.astype(np.int64)
            r, s = r[s >= least[i]], s[s >= least[i]]
            out.append((np.full(len(r), ids[i]), xid[r], s))
    return [np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries, candidates: id, v. Each query's k best of all candidates but its own: query_id, rank, vec_id, score."""
    n, m = candidates.count(), queries.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    # Deal by row, not by id: repeated ids spread as others do. The row number is the same on every rerun.
    c = candidates.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    c = c.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = queries.dropDuplicates(["id", "v"]).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = [F.col("group").cast("long"), F.col("block").cast("long"), F.size("v").cast("long")]
    key_names = ["g", "b", "dims"]
    c = c.select(*(x.alias(a) for x, a in zip(keys, key_names, strict=True)), "id", "v")
    q = q.select(*(x.alias(a) for x, a in zip(keys, key_names, strict=True)), "id", "v", F.lit(None).cast("long").alias("floor"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        a, b = (np.concatenate(d["v"].to_list()).astype(np.int64).reshape(len(d), int(d["dims"].iloc[0])) for d in (left, right))
        floor = np.array([np.iinfo(np.int64).min if pd.isna(f) else int(f) for f in left["floor"]], np.int64)
        found = threshold_search(left["id"].to_numpy(), a, right["id"].to_numpy(), b, k, floor)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    fresh = lambda d: d.select(*(F.col(n).alias(n) for n in d.columns)).groupBy(*key_names)  # noqa: E731  both sides may come from one table
    run = lambda x, y: fresh(x).cogroup(fresh(y)).applyInPandas(search, FOUND)
    if blocks == 1:
        found = run(q, c)
    else:  # the first block's kth scores hold for the others; as text, so that nulls do not make them floats
        first = materialise(run(q.filter("b = 0"), c.filter("b = 0")), "topk-first")
        # A query id that stands for several vectors has no one kth score.
        single = q.filter("b = 0").groupBy("id").agg(F.count("*").alias("m")).filter("m = 1").select("id")
        kth = first.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").cast("string").alias("kth")).filter(F.col("m") >= k)
        kth = kth.join(single, kth["query_id"] == single["id"], "left_semi").select(F.col("query_id").alias("id"), "kth")
        rest = q.filter("b > 0").drop("floor").join(kth, "id", "left").select(*key_names, "id", "v", F.col("kth").alias("floor"))
        found = first.unionByName(run(rest, c.filter("b > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
