import math
import random

import pytest
from pyspark.sql import functions as F

from sheetwise.functions.geom import Box
from sheetwise.operators import attach, extract

PATH = "page long, path long, items array<struct<op:string,pts:array<struct<x:double,y:double>>>>, colour array<double>, filled boolean, u double"


def line(page, path, *pts, colour=None, u=2.0):
    return (page, path, [("l", [pts[i], pts[i + 1]]) for i in range(len(pts) - 1)], colour, False, u)


def prims(spark, paths):
    return extract.primitives(spark.createDataFrame(paths, PATH))


def test_primitives(spark):
    rows = [line(1, 1, (0.0, 0.0), (50.0, 0.0)), (1, 2, [("re", [(0.0, 0.0), (3.0, 2.0)])], [0.9, 0.0, 0.0], False, 2.0), (1, 3, [("c", [(0.0, 0.0), (9.0, 9.0), (5.0, 5.0), (1.0, 2.0)])], [0.0, 0.1, 0.1], False, 2.0), (1, 4, [], None, False, 2.0), line(1, 5, (0.0, 0.0), (200.0, 0.0), (200.0, 100.0))]
    got = {r.path: r for r in prims(spark, rows).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert [got[i].kind for i in (1, 2, 3, 5)] == ["pipe", "symbol", "symbol", "frame"]
    assert len(got[2].segments) == 4 and not got[2].black and got[3].black and got[3].curves == 1 and got[1].black


def test_merge_bridges_small_gaps_and_chains_dashes(spark):
    rows = [line(1, 1, (0.0, 10.0), (20.0, 10.0)), line(1, 2, (21.5, 10.0), (40.0, 10.0)), line(1, 3, (45.0, 10.0), (60.0, 10.0)), line(1, 4, (30.0, 30.0), (30.0, 50.0)), line(1, 5, (30.0, 49.0), (30.0, 70.0))]
    got = sorted((r.ax, r.ay, r.bx, r.by, r.pieces, r.gaps) for r in extract.merge_lines(prims(spark, rows)).collect())
    assert [g[4] for g in got] == [2, 2, 1] and got[0][:4] == (0.0, 10.0, 40.0, 10.0) and got[0][5] == [1.5]
    assert sorted((round(got[1][1]), round(got[1][3]))) == [30, 70]
    dashes = [(1, i, 2.0, 10.0 * i, 5.0, 10.0 * i + 6, 5.0) for i in range(6)] + [(1, 20, 2.0, 0.0, 90.0, 6.0, 90.0)]
    chains = extract.chain_dashes(spark.createDataFrame(dashes, "page long, line long, u double, ax double, ay double, bx double, by double")).collect()
    assert [(r.pieces, r.members, r.style) for r in chains] == [(6, [0, 1, 2, 3, 4, 5], "dashed")]


def test_signature_ignores_scale_place_and_quarter_turns(spark):
    shape = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 6.0), (0.0, 0.0, 4.0, 6.0)]
    moved = [(10 + 3 * a, 5 + 3 * b, 10 + 3 * c, 5 + 3 * d) for a, b, c, d in shape]
    turned = [(-b, a, -d, c) for a, b, c, d in shape]
    flat = [(0.0, 1.0, 5.0, 1.0)]
    rows = [(i, s, min(min(p[0], p[2]) for p in s) * 1.0, min(min(p[1], p[3]) for p in s) * 1.0, max(max(p[0], p[2]) for p in s) * 1.0, max(max(p[1], p[3]) for p in s) * 1.0) for i, s in enumerate([shape, moved, turned, flat])]
    df = spark.createDataFrame(rows, "i int, s array<struct<ax:double,ay:double,bx:double,by:double>>, x0 double, y0 double, x1 double, y1 double")
    got = {r.i: r.g for r in df.select("i", extract.shape_signature(F.col("s"), Box.of()).alias("g")).collect()}
    assert got[0] == got[1] and got[3] == "degenerate" and len(got[0]) == 144 and got[0].count("1") == got[2].count("1")


def test_composites_and_dedupe(spark):
    rows = [line(1, 1, (0.0, 0.0), (4.0, 0.0), (4.0, 4.0)), line(1, 2, (5.0, 0.0), (9.0, 3.0)), line(1, 3, (40.0, 0.0), (44.0, 4.0)), line(2, 4, (0.0, 0.0), (4.0, 4.0))]
    p = prims(spark, rows).withColumn("kind", F.lit("symbol"))
    assert sorted(tuple(r.members) for r in extract.composites(p, 2.4).collect()) == [(1, 2), (3,), (4,)]
    s = [(1, 1, 0.0, 0.0, 4.0, 4.0, 0.5), (1, 2, 0.3, 0.0, 4.3, 4.0, 0.9), (1, 3, 0.0, 0.0, 8.0, 4.0, 0.1), (2, 4, 0.0, 0.0, 4.0, 4.0, 0.0)]
    df = spark.createDataFrame(s, "page long, symbol long, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert sorted(r.symbol for r in extract.dedupe_symbols(df, 1.0).collect()) == [2, 3, 4]


def test_border_and_colour_clusters(spark):
    frame = (1, 1, [("re", [(10.0, 10.0), (590.0, 390.0)])], None, False, 2.0)
    dots = [line(1, 10 + i, (100.0 + i, 50.0), (100.5 + i, 50.5), colour=[1.0, 0.0, 0.0]) for i in range(5)] + [line(1, 30, (400.0, 300.0), (401.0, 301.0), colour=[0.0, 1.0, 0.0])]
    p = prims(spark, [frame, *dots])
    pages = spark.createDataFrame([(1, 600.0, 400.0), (2, 10.0, 20.0)], "page long, width double, height double")
    assert {r.page: (r.x0, r.y1) for r in extract.border(p, pages).collect()} == {1: (22.0, 378.0), 2: (0.0, 20.0)}
    assert sorted(r.marks for r in extract.colour_clusters(p, 40.0).collect()) == [1, 5]


def test_text_rows_split_stacks_and_keep_vertical_labels(spark):
    marks, n = [], 0
    for y in (0.0, 4.0):  # two rows of letters one above the other
        for k in range(4):
            marks.append((1, n, 2.0 * k, y, 2.0 * k + 1.5, y + 2.0, 2.0))
            n += 1
    for k in range(5):  # a vertical label
        marks.append((1, n, 60.0, 2.0 * k, 62.0, 2.0 * k + 1.5, 2.0))
        n += 1
    marks.append((1, n, 90.0, 90.0, 93.0, 90.1, 2.0))  # a dash
    random.Random(1).shuffle(marks)
    df = spark.createDataFrame(marks, "page long, path long, x0 double, y0 double, x1 double, y1 double, u double")
    got = sorted((r.orientation, r.marks) for r in extract.text_rows(df).collect())
    assert got == [("horizontal", [0, 1, 2, 3]), ("horizontal", [4, 5, 6, 7]), ("vertical", [8, 9, 10, 11, 12])]


def plain_rows(marks, u, along=1.6, gap=0.15):
    """Text rows by judging the best remaining candidate again and again."""
    rows = []
    for horizontal in (True, False):
        lo, hi, a, b = (2, 4, 1, 3) if horizontal else (1, 3, 2, 4)

        def bands(ms, lo=lo, hi=hi):
            out, reach = [], None
            for m in sorted(ms, key=lambda m: m[lo]):
                out = [*out, [m]] if reach is None or m[lo] > reach + gap * u else [*out[:-1], [*out[-1], m]]
                reach = m[hi] if reach is None else max(reach, m[hi])
            return out

        for band in bands(marks):
            band = sorted(band, key=lambda m: m[a] + m[b])
            at = [0, *(i for i in range(1, len(band)) if (band[i][a] + band[i][b] - band[i - 1][a] - band[i - 1][b]) / 2 > along * u), len(band)]
            rows += [(horizontal, band[i:j], bands) for i, j in zip(at, at[1:])]
    out, taken = [], set()
    while rows := [(h, [m for m in r if m[0] not in taken], f) for h, r, f in rows]:
        rows = [x for x in rows if x[1]]
        if not rows:
            break
        best = max(rows, key=lambda x: (len(x[1]), x[0]))
        rows.remove(best)
        horizontal, row, bands = best
        w, h = max(m[3] for m in row) - min(m[1] for m in row), max(m[4] for m in row) - min(m[2] for m in row)
        across, deepest = (h, max(m[4] - m[2] for m in row)) if horizontal else (w, max(m[3] - m[1] for m in row))
        if (min(w, h) if len(row) == 1 else across) < 0.4 * u:
            continue
        if len(row) > 1 and across > 1.6 * deepest:
            parts = bands(row)
            rows += [(horizontal, p, bands) for p in parts] if len(parts) > 1 else []
            continue
        taken |= {m[0] for m in row}
        out.append(sorted(m[0] for m in row))
    return sorted(out)


def test_text_rows_equal_judging_one_by_one(spark):
    rng = random.Random(9)
    pages = {}
    for page in range(4):
        pages[page] = [(i, x := rng.randrange(60) / 2, y := rng.randrange(60) / 2, x + rng.choice([0.1, 1.0, 1.5, 2.0]), y + rng.choice([0.1, 1.0, 2.0, 3.0])) for i in range(70)]
    df = spark.createDataFrame([(p, *m, 2.0) for p, ms in pages.items() for m in ms], "page long, path long, x0 double, y0 double, x1 double, y1 double, u double")
    got = {}
    for r in extract.text_rows(df).collect():
        got.setdefault(r.page, []).append(r.marks)
    assert {p: sorted(r) for p, r in got.items()} == {p: plain_rows(ms, 2.0) for p, ms in pages.items()}
    assert extract.text_rows(df.limit(0)).count() == 0


def test_dashes_content_and_chains(spark):
    dash = lambda i, x, n=1, u=2.0: line(1, i, (x, 0.0), (x + 1.0, 0.0))
    p = prims(spark, [dash(i, 3.0 * i) for i in range(12)])
    got = extract.dash_candidates(p.withColumn("kind", F.lit("glyph"))).orderBy("line").collect()
    assert [(r.line, r.path) for r in got] == [(1_000_000 + i, i) for i in range(12)]
    rows = [(1, 0.0, 40.0, 2.0, 20.0, [1_000_001, 1_000_002]), (2, 0.0, 40.0, 2.0, 5.0, [1_000_003]), (3, 0.0, 10.0, 2.0, 9.0, [7, 8, 1_000_004]), (4, 0.0, 18.0, 2.0, 9.0, [9, 1_000_005])]
    chains = spark.createDataFrame(rows, "page long, lo double, hi double, u double, ink double, members array<long>")
    done = extract.accepted_chains(chains)
    assert {r.page: r.verdict for r in done.collect()} == {1: "kept", 2: "dropped", 3: "dissolved", 4: "kept"}
    assert sorted(r.line for r in extract.dissolved_lines(done).collect()) == [7, 8]
    content = spark.createDataFrame([(1, 0.0, -5.0, 30.0, 5.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    stamp = spark.createDataFrame([(1, 8.0, -1.0, 14.0, 1.0), (1, 20.0, -1.0, 23.0, 1.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    kept = extract.content_parts(p, content, stamp).filter("is_content").select("path").collect()
    assert sorted(r.path for r in kept) == [i for i in range(12) if 3 * i + 0.5 <= 30 and not (8 <= 3 * i + 0.5 <= 14 or 20 <= 3 * i + 0.5 <= 23)]
    clusters = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 60), (1, 2, 0.0, 0.0, 90.0, 90.0, 60), (1, 3, 0.0, 0.0, 1.0, 1.0, 49)], "page long, cluster long, x0 double, y0 double, x1 double, y1 double, marks long")
    pages = spark.createDataFrame([(1, 100.0, 100.0)], "page long, width double, height double")
    assert [r.cluster for r in extract.excluded_clusters(clusters, pages).collect()] == [1]


NODE = "page long, node string, kind string, x0 double, y0 double, x1 double, y1 double, confidence double"
REGION = "page long, region long, text string, x0 double, y0 double, x1 double, y1 double, orientation string, text_confidence double"


@pytest.fixture
def make(spark):
    def build(nodes, regions):
        n = spark.createDataFrame([(1, k, kind, *map(float, b), 0.9) for k, kind, b in nodes], NODE)
        r = spark.createDataFrame([(1, i, t, *map(float, b), "horizontal", c) for i, (t, b, c) in enumerate(regions)], REGION)
        return n, r

    return build


def test_bubble_rows_make_a_tag(make):
    n, r = make([("i", "instrument", (0, 0, 14, 14))], [("PI", (5, 3, 9, 5), 0.9), ("123", (4, 8, 10, 10), 0.8)])
    got = attach.bubble_rows(n, r).collect()
    assert [(x.canonical, x.confidence, x.regions) for x in got] == [("PI-123", 0.8, [0, 1])]


def test_bubbles_share_no_row_and_take_no_line_number(make):
    n, r = make([("i", "instrument", (0, 0, 14, 14)), ("j", "instrument", (2, 0, 16, 14)), ("k", "instrument", (40, 0, 54, 14))], [("FIC", (5, 3, 9, 5), 0.9), ("88", (4, 8, 10, 10), 0.8), ('2"-KW-7', (5, 11, 9, 13), 0.9), ("no", (45, 3, 49, 5), 0.9)])
    got = attach.bubble_rows(n, r).collect()
    assert [(x.node, x.canonical, x.regions) for x in got] == [("i", "FIC-88", [0, 1])]


def test_all_phases_in_one_call(spark, make):
    n, r = make(
        [("i", "instrument", (0, 0, 14, 14)), ("v", "component", (100, 0, 104, 4)), ("x", "unknown", (200, 0, 204, 4))],
        [("TI", (5, 3, 9, 5), 0.9), ("31", (4, 8, 10, 10), 0.8), ("V-386", (105, 1, 112, 3), 0.7), ("MV-55-09", (300, 0, 310, 2), 0.9), (None, (201, 1, 203, 3), 0.0), ('2"-KW-7', (40, 4, 50, 6), 0.9), ('3"-KW-8', (40, 4, 50, 6), 0.9), ('4"-KW-9', (40, 90, 50, 92), 0.9)],
    )
    lines = spark.createDataFrame([(1, 7, 20.0, 3.0, 90.0, 3.0)], "page long, line long, ax double, ay double, bx double, by double")
    edges = spark.createDataFrame([(1, "i", "v", [7], None)], "page long, source string, target string, line_ids array<long>, line_number string")
    out = attach.attach(n, r, lines, edges, 2.0)
    assert {(x.node, x.region, x.method, x.label) for x in out["bound"].collect()} == {("i", 0, "bubble_rows", "TI-31"), ("v", 2, "adjacent", "V-386"), ("x", 4, "legacy_radius", "region@202,2")}
    assert [x.line_number for x in out["edges"].collect()] == ['2"-KW-7']
    assert {(x.region, x.reason.split()[0] + " " + x.reason.split()[1]) for x in out["unbound"].collect()} == {(3, "no compatible"), (6, "conductor already"), (7, "no conductor")}
    assert out["ledger"].first().asDict() == {"parsed_regions": 5, "composed_bubbles": 1, "bound_nodes": 2, "bound_edges": 1, "legacy_labels": 1, "unbound": 3}
    assert attach.unbound_warnings(out["unbound"], 2).first().warning.startswith("3 convention tags parsed but not bound: MV-55-09 (no")


def test_adjacent_goes_by_the_gap_one_to_one(make):
    n, r = make([("a", "component", (0, 0, 4, 4)), ("b", "component", (100, 0, 104, 4))], [("MV-100-01", (5, 1, 40, 3), 0.9), ("V-102", (96, 1, 99, 3), 0.9), ("V-101", (80, 1, 98.5, 3), 0.9)])
    got = {(x.node, x.region) for x in attach.adjacent(n, r, 4.0, 0.0).collect()}
    assert got == {("a", 0), ("b", 1)}
    n, r = make([("a", "component", (0, 0, 10, 3))], [("[123A]", (0, 0, 10, 3), 0.9)])
    assert attach.adjacent(n, r, 4.0, 0.0).count() == 0


def test_radius_labels_unread_regions(make):
    n, r = make([("a", "unknown", (0, 0, 4, 4)), ("b", "unknown", (50, 0, 54, 4))], [(None, (1, 1, 3, 3), 0.0), ("#?!", (51, 1, 53, 3), 0.5)])
    assert {(x.node, x.label) for x in attach.by_radius(n, r, 2.0, 1.0).collect()} == {("a", "region@2,2"), ("b", "#?!")}


def test_line_numbers_reach_the_edges_of_their_conductor(spark, make):
    r = spark.createDataFrame([(1, 0, '1"-D2S', 20.0, 5.4, 30.0, 7.4, "horizontal", 0.9), (1, 1, '2"-P101', 20.0, 5.4, 30.0, 7.4, "vertical", 0.9)], REGION)
    lines = spark.createDataFrame([(1, 7, 0.0, 4.0, 50.0, 4.0), (1, 8, 25.0, 90.0, 25.0, 95.0)], "page long, line long, ax double, ay double, bx double, by double")
    got = attach.line_labels(lines, r, 4.0).collect()
    assert [(x.region, x.line) for x in got] == [(0, 7)] and math.isclose(got[0].distance, 2.4)
    edges = spark.createDataFrame([(1, "a", "b", [7], None), (1, "b", "c", [7, 9], "kept"), (1, "c", "d", [9], None)], "page long, source string, target string, line_ids array<long>, line_number string")
    labels = spark.createDataFrame([(1, 3, 7, "second"), (1, 0, 7, "first")], "page long, region long, line long, number string")
    assert {x.source: x.line_number for x in attach.label_edges(edges, labels).collect()} == {"a": "first", "b": "kept", "c": None}
