"""Rows that coincide are compared once: results equal plain versions, and few pairs are formed."""

import random

import pytest
from pyspark.sql import functions as F

from sheetwise.functions.geom import Box
from sheetwise.operators import assemble, extract, graph, metrics, regions, spatial, windows

BOX = "page long, {} long, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture
def pairs(monkeypatch):
    """The number of pairs of each grid join."""
    made, join = [], spatial.grid_join

    def counted(*args, **more):
        out = graph.written(join(*args, **more))
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "grid_join", counted)
    return made


def boxes(n, places, seed=3):
    rng = random.Random(seed)
    at = [(float(rng.randrange(60)), float(rng.randrange(60)), float(rng.choice([8, 9, 12]))) for _ in range(places)]
    return [(1, i, x, y, x + w, y + 8.0) for i in range(n) for x, y, w in [rng.choice(at)]]


def test_vouchers_of_copies(spark, pairs):
    rows = boxes(400, 10) + [(1, 7, 0.0, 0.0, 8.0, 8.0)]  # one mark has two rows
    mid = [(r[1], (r[2] + r[4]) / 2, (r[3] + r[5]) / 2) for r in rows]
    want = {k: sum(k != o and abs(x - u) <= 9 and abs(y - v) <= 6 for j, x, y in mid if j == k for o, u, v in mid) for k, _, _ in mid}
    got = spatial.vouched(spark.createDataFrame(rows, BOX.format("box")), Box.of(), "box", ["page"], 9.0, 6.0)
    assert {r.box: r.vouchers for r in got.collect()} == {k: n for k, n in want.items() if n >= 2}
    assert sum(pairs) <= 11 * 11


def test_greedy_matching_of_copies(spark, pairs):
    rows = boxes(150, 12) + [(1, 900 + i, 5.0, 5.0, 5.0, 9.0) for i in range(3)]  # three without area
    iou = lambda a, b: (lambda w, h: w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h) if w > 0 and h > 0 else 0.0)(min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3]))
    meets = lambda a, b: a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    left, right, want = set(), set(), set()
    for c, a, b in sorted((-round(iou(a, b), 4), a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and meets(a, b)):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, -c))
    same, lefts, rights = metrics.pair_copies(spark.createDataFrame(rows, BOX.format("box")), "box", 4)
    a, b = (s.select("page", F.col("box").alias(f"{p}box"), *(F.col(c).alias(f"{p}{c}") for c in Box._fields)) for s, p in ((lefts, "a_"), (rights, "b_")))
    from sheetwise.functions.geom import iou as overlap

    met = spatial.grid_join(a, b, Box.of("a_"), Box.of("b_"), ["page"], 16.0, F.col("a_box") < F.col("b_box")).withColumn("cost", -F.round(overlap(Box.of("a_"), Box.of("b_")), 4))
    got = {(r.a_box, r.b_box, -r.cost) for r in graph.greedy_match(met, ["page"], "a_box", "b_box", ["cost"]).collect()} | {(r.a_box, r.b_box, 1.0) for r in same.collect()}
    assert got == want
    assert sum(pairs) <= 15 * 15


def test_junctions_of_copies(spark, pairs):
    rng = random.Random(9)
    rows = [(1, i, float(rng.randrange(5)) * 3, 0.0, i % 11) for i in range(200)] + [(1, 300, None, 0.0, 1)]
    seeds, own = [], {}
    for r in rows[:200]:
        near = [s for s in seeds if abs(s[2] - r[2]) <= 3]
        own[r[1]] = near[0][1] if near else r[1]
        seeds += [] if near else [r]
    df = spark.createDataFrame(rows, "page long, point long, x double, y double, line long")
    assert {r.point: r.seed for r in regions.seed_junctions(df, 3.0).collect()} == own | {300: 300}
    assert sum(pairs) <= 25


@pytest.mark.parametrize("kind", ["colour", "composite"])
def test_clusters_of_copies(spark, pairs, kind):
    rows = boxes(300, 25)
    if kind == "colour":
        near = lambda a, b: ((a[2] + a[4] - b[2] - b[4]) / 2) ** 2 + ((a[3] + a[5] - b[3] - b[5]) / 2) ** 2 <= 36
    else:
        near = lambda a, b: a[2] <= b[4] + 1 and b[2] <= a[4] + 1 and a[3] <= b[5] + 1 and b[3] <= a[5] + 1
    group = {r[1]: r[1] for r in rows}
    for a in rows:
        for b in rows:
            if a[1] < b[1] and near(a, b) and group[a[1]] != group[b[1]]:
                lo, hi = sorted((group[a[1]], group[b[1]]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    want = sorted((g, sum(v == g for v in group.values())) for g in set(group.values()))
    df = spark.createDataFrame(rows, BOX.format("path")).selectExpr("*", f"{kind == 'composite'} AS black", "'symbol' AS kind", "1.0D AS u", "CAST(array() AS array<struct<ax:double,ay:double,bx:double,by:double>>) AS segments")
    if kind == "colour":
        got = sorted((r.cluster, r.marks) for r in extract.colour_clusters(df, 6.0).collect())
    else:
        got = sorted((r.symbol, len(r.members)) for r in extract.composites(df, 1.0, None).collect())
    assert got == want
    assert sum(pairs) <= 25 * 25


def test_nearest_of_copies(spark, pairs):
    rng = random.Random(5)
    pts = [(1, i % 200, float(rng.randrange(6)) * 10, 0.0) for i in range(300)]
    places = [(1, i, float(rng.randrange(6)) * 10 + 4, 0.0) for i in range(100)]
    want = {k: min((abs(x - u), o) for _, j, x, _ in pts if j == k for _, o, u, _ in places) for _, k, _, _ in pts}
    a, b = spark.createDataFrame(pts, "page long, seg long, ax double, ay double"), spark.createDataFrame(places, "page long, box long, cx double, cy double")
    got = spatial.nearest(a, b, (F.col("ax"), F.col("ay")), (F.col("cx"), F.col("cy")), ["page"], "seg", "box", 30.0)
    assert {r.seg: (r.gap, r.box) for r in got.collect()} == want
    assert sum(pairs) <= 72


def test_touches_of_copies(spark, pairs):
    rows = boxes(600, 5)
    lines = spark.createDataFrame([(1, 1, 0.0, 30.0, 70.0, 30.0), (1, 2, 20.0, 0.0, 20.0, 70.0)], "page long, line long, ax double, ay double, bx double, by double")
    want = {(n, r[1]) for r in rows for n, (ax, ay, bx, by) in ((1, (0, 30, 70, 30)), (2, (20, 0, 20, 70))) if r[2] - 1 <= bx and ax <= r[4] + 1 and r[3] - 1 <= by and ay <= r[5] + 1}
    got = assemble.touches(lines, spark.createDataFrame(rows, BOX.format("symbol")), 1.0).collect()
    assert len(got) == len(want) and {(r.line, r.symbol) for r in got} == want
    assert sum(pairs) <= 2 * 5


def copied_lines(n, places, seed=4):
    """Lines among few places; some have two rows, one has no coordinates."""
    rng = random.Random(seed)
    at = [(x, y, *rng.choice([(x + 9, y), (x, y + 9)])) for x, y in ((float(rng.randrange(80)), float(rng.randrange(80))) for _ in range(places))]
    return [(1, i if i % 10 else i // 20, *rng.choice(at)) for i in range(n)] + [(1, n, None, None, None, None)]


LINE = "page long, line long, ax double, ay double, bx double, by double"


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_close_keys_of_copies(spark, pairs, batch):
    rows = copied_lines(300, 12)
    ends = [(k, p) for _, k, ax, ay, bx, by in rows[:-1] for p in ((ax, ay), (bx, by))]
    want = {(1, a, b) for a, p in ends for b, q in ends if a < b and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 9}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in spatial.close_keys(spark.createDataFrame(rows, LINE), ["page"], "line", [("ax", "ay"), ("bx", "by")], 3.0).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and set(got) == want
    assert sum(pairs) < len(want) / 3


def test_conductors_of_copies(spark, pairs):
    rows = copied_lines(300, 12)
    group = {r[1]: r[1] for r in rows}
    ends = {(k, p) for _, k, ax, ay, bx, by in rows[:-1] for p in ((ax, ay), (bx, by))}
    for a, p in ends:
        for b, q in ends:
            if a < b and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 25 and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {k: lo if g == hi else g for k, g in group.items()}
    got = assemble.conductor_groups(spark.createDataFrame([*rows, (None, 5, 1.0, 1.0, 2.0, 2.0)], LINE), 5.0).collect()
    assert sorted((r.page or 0, r.line, r.conductor) for r in got) == sorted([(0, 5, 5), *((1, k, g) for k, g in group.items())])
    assert sum(pairs) <= 24 * 24


def test_neighbours_of_copies(spark, pairs):
    lines, symbols = spark.createDataFrame(copied_lines(200, 6), LINE).selectExpr("*", "IF(line % 2 = 0, 'dashed', NULL) AS style", "line % 3 = 0 AS bridged"), spark.createDataFrame(boxes(60, 6), BOX.format("symbol"))
    touched = assemble.touches(lines, symbols, 20.0)
    want = sorted(map(repr, windows.consecutive_pairs(touched, ["page", "line"], ["t", "symbol"], "symbol").collect()))
    edges = sorted(map(repr, assemble.port_edges(lines, touched).distinct().collect()))
    plain = sum(pairs)
    pairs.clear()
    assert want and sorted(map(repr, assemble.neighbours_along(lines, symbols, 20.0).collect())) == want
    assert sum(pairs) < plain / 4
    assert sorted(map(repr, assemble.bound_edges(lines, symbols, 20.0).collect())) == edges
