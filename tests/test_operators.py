import math
import random

from pyspark.sql import functions as F

from sheetwise.functions import geom
from sheetwise.functions.geom import Box
from sheetwise.operators import attach, classify, graph, rules, spatial, windows

REQ = "ordinal int, tag string, part string, field string, min double, max double, unit string"
LIM = "key string, field string, min double, max double, unit string"


def requirements():
    rows = []
    for n, (tag, part, psi, lo, hi) in enumerate([("F-715A", None, 275, 100, 100), ("F-715B", None, 275, 100, 100), ("V-745", None, 300, 375, 375), ("E-742", "shell", 300, 375, 375), ("E-742", "tube", 300, 250, 250), ("AC-746", None, 350, -20, 400)]):
        rows += [(n, tag, part, "pressure", float(psi), float(psi), "psig"), (n, tag, part, "temperature", float(lo), float(hi), "degF")]
    return rows


def limits(change=None):
    out = [(f"{t}:{p}" if p else t, f, a, b, u) for _, t, p, f, a, b, u in requirements()]
    return [change(r) for r in out] if change else out


def findings(spark, req, lim, recall=0.9):
    return rules.limit_findings(spark.createDataFrame(req, REQ), spark.createDataFrame(lim, LIM), recall).collect()


def test_limits_agree_and_each_fault_is_caught(spark):
    good = findings(spark, requirements(), limits())
    assert sum(r.status == "verified" for r in good) == 12 and not any(r.severity == "critical" for r in good)
    wrong = findings(spark, requirements(), limits(lambda r: (*r[:2], 250.0, 250.0, r[4]) if r[:2] == ("V-745", "pressure") else r))
    assert [(r.subject, r.field) for r in wrong if r.severity == "critical"] == [("V-745", "pressure")]
    unit = findings(spark, requirements(), limits(lambda r: (*r[:4], "barg") if r[:2] == ("V-745", "pressure") else r))
    assert sum(r.severity == "critical" for r in unit) == 1
    absent = [r for r in limits() if r[0] != "V-745"]
    assert {r.severity for r in findings(spark, requirements(), absent) if r.check == "equipment_not_found_in_drawing"} == {"medium"}
    low = [r for r in findings(spark, requirements(), absent, 0.1) if r.check == "equipment_not_found_in_drawing"]
    assert [(r.severity, r.confidence, r.graph_incomplete) for r in low] == [("low", 0.1, True)]
    lost = [(9, None, None, "pressure", 1.0, 1.0, "psig")]
    assert [(r.check, r.severity) for r in findings(spark, lost, limits())] == [("sop_subject_unresolved", "low")]
    whole = findings(spark, [r for r in requirements() if r[2] == "tube"], [("E-742", "pressure", 300.0, 300.0, "psig")])
    assert sorted(r.status for r in whole) == ["needs_review", "verified"]


def test_grid_joins_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, rng.uniform(0, 3), rng.uniform(0, 40)]), rng.uniform(0, 5)
        rows.append((i, i % 3, x, y, x + w, y + h))
    df = spark.createDataFrame(rows, "i int, page int, x0 double, y0 double, x1 double, y1 double")
    a, b = (df.select("page", *(F.col(c).alias(p + c) for c in ("i", "x0", "y0", "x1", "y1"))) for p in "ab")
    box = lambda p: Box(*(F.col(p + c) for c in ("x0", "y0", "x1", "y1")))
    got = [(r.ai, r.bi) for r in spatial.grid_join(a, b, box("a"), box("b"), ["page"], 7.0, F.col("ai") < F.col("bi")).collect()]
    meets = lambda p, q: p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    assert sorted(got) == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and meets(p, q))
    pa, pb = (df.select("page", F.col("i").alias(p + "i"), F.col("x0").alias(p + "x"), F.col("y0").alias(p + "y")) for p in "ab")
    near = spatial.distance_join(pa, pb, (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), ["page"], 6.0, F.col("ai") < F.col("bi"))
    assert sorted((r.ai, r.bi) for r in near.collect()) == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 6)


def test_segment_meets_box_by_sampling(spark):
    rng = random.Random(2)
    rows = [tuple(float(rng.randrange(-6, 7)) for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    box = Box(*(F.lit(v) for v in (-2.0, -1.0, 2.0, 3.0)))
    c = [F.col(n) for n in ("ax", "ay", "bx", "by")]
    for r in df.select(*c, geom.segment_meets(*c, box).alias("m"), geom.segment_distance(F.lit(0.5), F.lit(0.5), *c).alias("d")).collect():
        points = [(r.ax + (r.bx - r.ax) * t / 2520, r.ay + (r.by - r.ay) * t / 2520) for t in range(2521)]
        assert r.m == any(-2 - 1e-9 <= x <= 2 + 1e-9 and -1 - 1e-9 <= y <= 3 + 1e-9 for x, y in points)
        assert abs(r.d - min(math.hypot(x - 0.5, y - 0.5) for x, y in points)) < 1e-2


def test_islands_and_modes(spark):
    rows = [(1, 0, 5), (2, 1, 20), (3, 8, 9), (4, 23, 24), (5, 30, 31)]
    df = spark.createDataFrame([("p", *r) for r in rows], "page string, id int, lo int, hi int")
    got = lambda running: {r.id: r.island for r in windows.islands(df, ["page"], "lo", "hi", "id", 4, running).collect()}
    assert got(True) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1} and got(False) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}
    m = windows.modal(spark.createDataFrame([("p", 1, 2.0), ("p", 2, 1.0), ("p", 3, 1.0), ("p", 4, 2.0), ("q", 5, 1.0)], "g string, s int, v double"), ["g"], "v", "s", 2).collect()
    assert [(r.g, r.v, r.n) for r in m] == [("p", 2.0, 2)]


def test_graph_operators(spark):
    edges = spark.createDataFrame([("src", "valve", "l1"), ("valve", "dst", None), ("x", "y", None), ("y", "x", None)], "src string, dst string, via string")
    start = spark.createDataFrame([("valve",)], "node string")
    walk = lambda d, n=12: {r.node: r.depth for r in graph.walk(edges, start, d, n).collect()}
    assert walk("downstream") == {"valve": 0, "dst": 1} and walk("upstream") == {"valve": 0, "src": 1} and walk("undirected") == {"valve": 0, "src": 1, "dst": 1} and walk("downstream", 0) == {"valve": 0}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"src": "dst", "valve": "dst", "dst": "dst", "x": "x", "y": "x"}
    assert graph.unordered(edges).count() == 3
    near = {(r.neighbour, r.direction) for r in graph.neighbours(edges).filter("node = 'valve'").collect()}
    assert near == {("src", "in"), ("dst", "out")}


def test_greedy_match_is_the_sequential_one(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(2), a, b, float(rng.randrange(6))) for a in range(12) for b in range(12) if rng.random() < 0.4]
    got = graph.greedy_match(spark.createDataFrame(pairs, "page int, l int, r int, cost double"), ["page"], "l", "r", ["cost"]).collect()
    used, want = set(), set()
    for page, a, b, c in sorted(pairs, key=lambda p: (p[0], p[3], p[1], p[2])):
        if not {(page, "l", a), (page, "r", b)} & used:
            used |= {(page, "l", a), (page, "r", b)}
            want.add((page, a, b, c))
    assert {tuple(r) for r in got} == want


def test_greedy_match_of_many_equal_boxes(spark):
    """Equal costs let a round accept one pair a page: 150 equal boxes need 149 in turn."""
    pairs = [(page, a, b, -1.0) for page in (1, 2) for a in range(150) for b in range(a + 1, 150)]
    got = graph.greedy_match(spark.createDataFrame(pairs, "page int, l int, r int, cost double"), ["page"], "l", "r", ["cost"]).collect()
    assert sorted(map(tuple, got)) == [(page, a, a + 1, -1.0) for page in (1, 2) for a in range(149)]


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(501), 501)
    edges = spark.createDataFrame([*zip(order, order[1:]), (1000, 1000)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {v: 0 for v in order} | {1000: 1000}


def test_sheets_and_modules(spark):
    rows = [(792.0, 1224.0, "ANSI_B", "ISA"), (2448.0, 1584.0, "ANSI_D", "ISA"), (594 * 72 / 25.4, 841 * 72 / 25.4, "ISO_A1", "ISO"), (300.0, 400.0, "custom", "unknown")]
    df = spark.createDataFrame(rows, "w double, h double, s string, u string").withColumn("d", classify.detect_sheet(F.col("w"), F.col("h")))
    assert all((r.d.sheet, r.d.unit_system) == (r.s, r.u) for r in df.collect())
    m = classify.module_of(spark.createDataFrame([(1, 2.0), (1, 2.2), (2, 3.0)], "page int, module double"), ["page"]).collect()
    assert {r.page: round(r.confidence, 3) for r in m} == {1: round(1 - 2 * 0.1 / 2.1, 3), 2: 0.45}


def test_lines_through_a_point_tie_at_no_distance(spark):
    # 1 / 49 * 49 is less than 1: a foot point that is computed would put the longer line behind the shorter one.
    lines = spark.createDataFrame([(1, 1, -1.0, 5.0, 3.0, 5.0), (1, 2, 0.0, 5.0, 49.0, 5.0)], "page long, line long, ax double, ay double, bx double, by double")
    regions = spark.createDataFrame([(1, 7, '2"-KW-7', 0.0, 4.0, 2.0, 6.0, "horizontal")], "page long, region long, text string, x0 double, y0 double, x1 double, y1 double, orientation string")
    assert [(r.line, r.distance) for r in attach.line_labels(lines, regions, 8.0).collect()] == [(2, 0.0)]
