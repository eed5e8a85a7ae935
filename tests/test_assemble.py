from pyspark.sql import functions as F

from sheetwise.operators import assemble, metrics, probe

LINE = "page long, line long, ax double, ay double, bx double, by double, style string, bridged boolean"
SYMBOL = "page long, symbol long, x0 double, y0 double, x1 double, y1 double, symbol_class string, diameter double, confidence double"


def test_build_joins_along_lines_and_through_ends_but_not_crossings(spark):
    box = lambda s, x, y, c="unknown", d=2.0: (1, s, x - 2.0, y - 2.0, x + 2.0, y + 2.0, c, d, 0.9)
    symbols = [box(1, 0.0, 0.0), box(2, 50.0, 0.0), box(3, 100.0, 0.0, "instrument"), box(4, 100.0, 80.0), box(5, 300.0, 300.0), box(6, 400.0, 300.0, "instrument"), box(7, 30.0, 60.0), (2, 8, -2.0, -2.0, 2.0, 2.0, "unknown", 1.0, 0.9)]
    lines = [(1, 1, 0.0, 0.0, 98.0, 0.0, "solid", False), (1, 2, 98.5, 2.9, 98.5, 40.0, "solid", True), (1, 3, 98.5, 40.5, 98.5, 78.0, "dashed", False), (1, 4, 30.0, -40.0, 30.0, 60.0, "solid", False)]
    nodes, edges = assemble.build(spark.createDataFrame(lines, LINE), spark.createDataFrame(symbols, SYMBOL), 1.0)
    assert {(r.symbol, r.kind) for r in nodes.collect()} == {(1, "unknown"), (2, "unknown"), (3, "instrument"), (4, "unknown"), (6, "instrument"), (7, "unknown")}
    got = {(r.source, r.target): (r.evidence, r.confidence, r.line_ids) for r in edges.collect()}
    assert got == {(1, 2): ("port_binding", 0.85, [1]), (2, 3): ("port_binding", 0.85, [1]), (1, 3): ("endpoint_junction", 0.55, [1]), (3, 4): ("endpoint_junction", 0.55, [2, 3])}
    assert len({r.key for r in nodes.collect()}) == nodes.count() and all(r.key[:3] == r.kind[:3] for r in nodes.collect())
    s = {r.kind: (r.nodes, r.isolated) for r in assemble.summary(nodes.withColumn("label", F.lit(None).cast("string")), edges).collect()}
    assert s == {"unknown": (4, 1), "instrument": (2, 1)}


def test_scores(spark):
    b = "page long, id string, x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "b", 20.0, 0.0, 30.0, 10.0)], b)
    pred = spark.createDataFrame([(1, "p", 1.0, 0.0, 11.0, 10.0), (1, "q", 0.0, 0.0, 10.0, 10.0), (1, "r", 26.0, 0.0, 36.0, 10.0)], b)
    m = metrics.match_boxes(truth, pred, 0.3)
    assert {(r.truth, r.pred) for r in m.collect()} == {("a", "q")}
    assert {r.threshold: r.hits for r in metrics.threshold_sweep(truth, pred).collect()} == {0.1: 2, 0.3: 1, 0.5: 1, 0.7: 1}
    tags = spark.createDataFrame([(1, "q", "V-1"), (1, "r", "V-2")], "page long, pred string, tag string")
    want = spark.createDataFrame([(1, "a", "V-9"), (1, "b", "V-2")], "page long, truth string, canonical string")
    assert tuple(metrics.attachment_scores(want, m, tags).first()) == (0, 1, 1, 1)
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "page long, source string, target string")
    both = metrics.match_boxes(truth, pred, 0.1)
    assert [tuple(r) for r in metrics.translated_edges(edges, both).collect()] == [(1, "q", "r")]
    t = "page long, id long, text string, x0 double, y0 double, x1 double, y1 double"
    labels = spark.createDataFrame([(1, 1, "PI-1", 0.0, 0.0, 4.0, 2.0), (1, 2, "V-2", 50.0, 0.0, 54.0, 2.0)], t)
    reads = spark.createDataFrame([(1, 1, "pi - 1", 1.0, 0.0, 5.0, 2.0), (1, 2, "PI-1", 0.5, 0.0, 5.5, 2.0), (1, 3, "V-3", 50.0, 0.0, 54.0, 2.0)], t)
    assert tuple(metrics.text_scores(labels, reads, 6.0).first()) == (1, 3, 2)
    c = "lo long, hi long, line string"
    assert tuple(metrics.line_claims(spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (2, 3, "y")], c), spark.createDataFrame([(1, 2, "x"), (2, 3, "z")], c)).first()) == (1, 2, 2)


def test_probe(spark):
    s = "page long, type string, width double, colour string, dashes string, items array<struct<op:string>>"
    rows = [(1, "s", 0.5, "k", "[] 0", [("l",), ("l",)]), (1, "s", 0.5, "r", "[3 2] 0", [("c",)]), (1, "f", None, None, None, [])]
    r = spark.createDataFrame([(1, 0.7, 150.0), (1, 0.6, 300.0), (2, 0.02, 72.0)], "page long, area_ratio double, dpi double")
    got = {x.page: x for x in probe.nature(probe.capabilities(spark.createDataFrame(rows, s), r)).collect()}
    assert got[1].by_type_width == {"s@0.5": 2, "f": 1} or got[1].by_type_width == {"s@0.5": 2, "f@none": 1}
    assert got[1].colours == 2 and got[1].line_segments == 2 and got[1].beziers == 1 and got[1].dash_arrays and got[1].raster_area == 1.0 and got[1].raster_dominant and got[1].several_paints
    assert got[2].raster_incidental and not got[2].several_widths and got[2].vector_paths == 0
