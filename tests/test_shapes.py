"""Keys of equal shape, block by block and tile by tile, against plain versions."""

import random

from sheetwise.operators import assemble, attach, graph, shapes, spatial

LINE = "page long, line long, ax double, ay double, bx double, by double"
INF, NAN = float("inf"), float("nan")


def lines(n, places, seed=6):
    """Lines on two pages across tiles; some have several rows, equal or not, or lack an end."""
    rng = random.Random(seed)
    at = [(rng.uniform(-900, 900), rng.uniform(-50, 50)) for _ in range(places)]
    pick = lambda: rng.choice([*at, at[0], (-0.0, 0.0), (0.0, 3.0), (None, 1.0)])
    return [(i % 2, i if i % 6 else i // 12, *pick(), *pick()) for i in range(n)] + [(0, 1, 0.0, 0.0, 9.0, 0.0)] * 2 + [(1, n, NAN, 1.0, None, 2.0), (1, n + 1, None, None, None, None), (None, 2, 0.0, 0.0, 1.0, 1.0)]


def points(rows):
    got = [(p, k, q) for p, k, ax, ay, bx, by in rows for q in ((ax, ay), (bx, by)) if p is not None and None not in q]
    return [(p, k, q) for p, k, q in got if q[0] == q[0] and q[1] == q[1]]


def test_conductors_are_connected_in_blocks(spark, monkeypatch):
    """A chain of lines in one cell needs no rounds over its lines: only what parts have in common is left to join."""
    seen, plain = [], graph.components

    def counted(edges, *names):
        seen.append(edges.count())
        return plain(edges, *names)

    monkeypatch.setattr(graph, "components", counted)
    chain = spark.createDataFrame([(1, 400 - i, float(i % 20), float(i // 20), float((i + 1) % 20), float((i + 1) // 20)) for i in range(399)], LINE)
    assert {r.conductor for r in assemble.conductor_groups(chain, 0.5).collect()} == {2}
    assert seen == [0]


def test_conductors_of_odd_lines(spark):
    rows = lines(260, 160)
    group = {r[:2]: r[1] for r in rows if r[0] is not None}
    for p, a, q in (ends := points(rows)):
        for o, b, r in ends:
            if p == o and q == r and group[p, a] != group[p, b]:
                lo, hi = sorted((group[p, a], group[p, b]))
                group = {k: lo if g == hi and k[0] == p else g for k, g in group.items()}
    got = assemble.conductor_groups(spark.createDataFrame(rows, LINE), 1e-9).collect()
    assert sorted((r.page if r.page is not None else -1, r.line, r.conductor) for r in got) == sorted([(-1, 2, 2), *((*k, g) for k, g in group.items())])


def test_close_keys_shuffle_rows_only(spark):
    """Arrays of keys are paired where they stand: after the rows are dealt to tiles nothing is joined, grouped or dealt again."""
    rows = spark.createDataFrame([(1, i, float(i % 7), 0.0, float(i % 7), 9.0) for i in range(60)], LINE)
    plan = spatial.close_keys(rows, ["page"], "line", [("ax", "ay"), ("bx", "by")], 3.0)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Generate explode") == 2
    assert not any(word in above for word in ("Exchange", "Join", "Aggregate"))


def test_close_keys_of_odd_lines(spark, monkeypatch):
    """Across tiles, in small parts and slices, with several rows of a key, and without some ends."""
    rows = lines(260, 60) + [(0, 901, INF, 0.0, 1e300, -1e300), (0, 902, INF, 0.0, 1e300, -1e300)]
    ends = points(rows)
    for radius in (3.0, 0.0):
        close = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= radius * radius if max(map(abs, (*a, *b))) < 1e9 else a == b and INF not in a  # noqa: B023, E731
        want = {(p, a, b) for p, a, q in ends for o, b, r in ends if p == o and a < b and close(q, r)}
        got = [tuple(r) for r in spatial.close_keys(spark.createDataFrame(rows, LINE), ["page"], "line", [("ax", "ay"), ("bx", "by")], radius).collect()]
        assert len(got) == len(want) and set(got) == want


def test_close_lists_in_small_parts(monkeypatch):
    """Parts and slices of a few keys give each pair once, by the function that a task runs."""
    import pyarrow as pa

    monkeypatch.setattr(shapes, "PART", 3)
    monkeypatch.setattr(shapes, "SLICE", 10)
    monkeypatch.setattr(shapes, "BLOCK", 20)
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(5)), 0.0, 0.0, float(rng.randrange(9))) for i in range(120)]
    sent = pa.table([[0] * 120, *map(list, zip(*rows, strict=True)), [None] * 120, [0] * 120], schema=pa.schema([("page", pa.int64()), ("line", pa.int64()), *((c, pa.float64()) for c in ("ax", "ay", "bx", "by")), ("_more", pa.string()), ("_t", pa.int64())]))
    got = []
    for b in shapes.join_tiles(sent.to_batches(max_chunksize=9), ["page"], "line", [("ax", "ay"), ("bx", "by")], 2.0):
        for r in b.to_pylist():
            got += [(min(x, y), max(x, y)) for x in r["_a"] for y in r["_b"] if not r["_same"] or x < y]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 4 for p in (a[1:3], a[3:]) for q in (b[1:3], b[3:]))}
    assert len(got) == len(want) and set(got) == want


def test_line_labels_of_copies(spark, monkeypatch):
    """Lines with equal ends and regions of one place are looked at once; the smallest line wins, nulls last."""
    made, join = [], spatial.grid_join

    def counted(*args, **more):
        out = graph.written(join(*args, **more))
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "grid_join", counted)
    rng = random.Random(8)
    at = [(x, y, *rng.choice([(x + 30, y), (x, y + 30), (x + 30, y)])) for x, y in ((rng.randrange(60) * 1.0, rng.randrange(60) * 1.0) for _ in range(12))]
    rows = [(i % 2, 900 - i if i % 50 else None, *rng.choice(at)) for i in range(400)] + [(None, 1, *at[0]), (1, 2, None, 0.0, 1.0, 0.0)]
    spots = [(rng.randrange(60) * 1.0, rng.randrange(60) * 1.0, rng.choice(["horizontal", "vertical"])) for _ in range(8)]
    texts = [(i % 2, i if i % 9 else i // 30, '2"-KW-77', x, y, x + 4, y + 2, o) for i in range(90) for x, y, o in [rng.choice(spots)]] + [(0, 700, None, 0.0, 0.0, 60.0, 60.0, "vertical"), (0, 701, '2"-KW-7', None, 0.0, 4.0, 2.0, "vertical")]

    def gap(px, py, ax, ay, bx, by):
        return (max(ax - px, px - bx, 0) ** 2 + max(ay - py, py - by, 0) ** 2) ** 0.5

    want = {}
    for p, k, text, x0, y0, x1, y1, o in texts:
        for q, line, *e in rows:
            if text and x0 is not None and q == p and None not in e and (e[1] == e[3]) == (o == "horizontal") and (d := gap((x0 + x1) / 2, (y0 + y1) / 2, *e)) <= 8:
                want[p, k] = min(want.get((p, k), (9e9,)), (d, line is None, line))
    df = spark.createDataFrame(texts, "page long, region long, text string, x0 double, y0 double, x1 double, y1 double, orientation string")
    got = attach.line_labels(spark.createDataFrame(rows, LINE), df, 8.0).collect()
    assert len(got) == len(want) and {(r.page, r.region): (round(r.distance, 9), r.line) for r in got} == {k: (round(d, 9), line) for k, (d, _, line) in want.items()}
    assert 0 < sum(made) <= 2 * 12 * 8
