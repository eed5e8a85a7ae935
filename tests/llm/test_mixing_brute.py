"""The whole mixture against a plain version of it, draw by draw."""

import math
import struct

import xxhash

from sheetwise.llm import mixing
from tests.llm.test_mixing import documents, water


def hashed(*values):
    """Spark's xxhash64: each value's bytes, seeded by the hash of those before."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_taken(rows, shard_slots, low=32, high=2048, seed=7):
    sizes = [(d, s, len((t or "").split())) for d, t, s in rows]
    totals = {}
    for _, s, n in sizes:
        totals[s] = totals.get(s, 0) + n
    names, want = sorted((s for s in totals if s is not None)) + ([None] if None in totals else []), water(totals)
    src = {}
    for i, s in enumerate(names):
        size = totals[s]
        blk = max(1, min(max(low, min(high, size >> 17)), size // 512))
        need = max(1, math.ceil(size / blk))
        a = math.ceil(math.sqrt(need))
        b = math.ceil(need / a)
        src[i] = {"blk": blk, "a": a, "b": b, "n": a * b, "quota": min(round(want[s] * a * b / size), 3 * a * b) if size else 0}
    lo, at = {}, 0
    for i, s in src.items():
        lo[i], at = at, at + s["quota"]
    total = at
    draws = {}
    for slot in range(total):
        u = hashed(("q", slot), ("i", seed)) % total
        i = max(k for k in src if lo[k] <= u and src[k]["quota"])
        draws.setdefault(i, []).append((slot // shard_slots, slot))
    times, spare = {}, []

    def block(i, g):
        s, epoch = src[i], g // src[i]["n"]
        left, right = divmod(g % s["n"], s["b"])
        for r in range(4):
            if r % 2 == 0:
                left = (left + hashed(("q", right), ("q", i), ("q", epoch), ("i", seed), ("i", r)) % s["a"]) % s["a"]
            else:
                right = (right + hashed(("q", left), ("q", i), ("q", epoch), ("i", seed), ("i", r)) % s["b"]) % s["b"]
        k = i, left * s["b"] + right
        times[k] = times.get(k, 0) + 1

    for i in src:
        n, q = len(draws.get(i, [])), src[i]["quota"]
        for g in range(min(n, q)):
            block(i, g)
        spare.append(max(0, n - q))
    moved = sum(spare)
    for i in src:  # what other sources drew too often fills up those that drew too few
        n, q = len(draws.get(i, [])), src[i]["quota"]
        for g in range(n, min(q, n + moved)):
            block(i, g)
            moved -= 1
    out = {}
    buckets = max(1, round(len(rows) ** 0.5))
    for i, s in enumerate(names):
        mine = [(d, n) for d, x, n in sizes if x == s]
        mine.sort(key=lambda r: (hashed(("q", r[0]), ("q", r[1])) % buckets, r[0] is not None, r[0] or 0, r[1]))
        start = 0
        for d, n in mine:
            took = sum(times.get((i, w // src[i]["blk"]), 0) for w in range(start, start + n))
            out.setdefault((d, n), []).append(took)
            start += n
    return {k: sorted(v) for k, v in out.items()}


def test_the_mixture_equals_a_plain_one(spark):
    for seed in (1, 5):
        rows, df = documents(spark, seed)
        got = {}
        for r in mixing.taken(mixing.mix(df, shard_slots=64)).collect():
            got.setdefault((r.doc_id, r.size), []).append(r.taken)
        assert {k: sorted(v) for k, v in got.items()} == plain_taken(rows, 64)
