import random


from sheetwise.operators import extract, graph, regions


def test_junctions_equal_looking_at_ends_one_by_one(spark):
    rng = random.Random(4)
    rows = [(p, i, float(rng.randrange(40)), float(rng.randrange(40)), rng.randrange(30)) for p in range(3) for i in range(120)]
    want = set()
    for p in range(3):
        ends, used = [r for r in rows if r[0] == p], set()
        for r in ends:
            if r[1] in used:
                continue
            group = [e for e in ends if e[1] >= r[1] and e[1] not in used and (e[2] - r[2]) ** 2 + (e[3] - r[3]) ** 2 <= 16]
            used |= {e[1] for e in group}
            if len({e[4] for e in group}) > 1:
                want.add((p, r[1], round(sum(e[2] for e in group) / len(group), 6), round(sum(e[3] for e in group) / len(group), 6), tuple(sorted({e[4] for e in group}))))
    df = spark.createDataFrame(rows, "page long, point long, x double, y double, line long").repartition(5)
    assert {(r.page, r.seed, round(r.x, 6), round(r.y, 6), tuple(r.lines)) for r in regions.junctions(df, 4.0).collect()} == want


def test_deduplication_goes_in_order_of_confidence(spark):
    rng = random.Random(7)
    rows = [(1, i, x := rng.random() * 12, y := rng.random() * 12, x + rng.choice([1.0, 1.5, 4.0]), y + 1.0, rng.choice([0.5, 0.7, 0.9])) for i in range(120)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if not any(((r[2] + r[4] - k[2] - k[4]) / 2) ** 2 + ((r[3] + r[5] - k[3] - k[5]) / 2) ** 2 <= 1 and abs((r[4] - r[2]) - (k[4] - k[2])) <= 1 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "page long, symbol long, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert sorted(r.symbol for r in extract.page_symbols(df.limit(50), df.subtract(df.limit(50)), 1.0).collect()) == sorted(k[1] for k in kept)


def test_a_chain_keeps_every_second(spark):
    pairs = spark.createDataFrame([(1, i, i + 1) for i in range(10)], "page long, first long, second long")
    items = spark.createDataFrame([(1, i) for i in range(11)], "page long, k long")
    assert sorted(r.k for r in graph.first_kept(items, pairs, ["page"], "k").collect()) == list(range(0, 11, 2))
    assert graph.first_kept(items.limit(0), pairs.limit(0), ["page"], "k").count() == 0


def test_plan_of_a_page_without_marks(spark):
    hint = spark.createDataFrame([(1, i, 0.0, 0.0, 9.0, 9.0) for i in range(12)], "page long, region long, x0 double, y0 double, x1 double, y1 double")
    marks = spark.createDataFrame([(2, 1, 0.0, 0.0, 1.0, 1.0)], "page long, path long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.hints, r.coverage, r.plan) for r in regions.region_plan(marks, hint).collect()} == {(1, 12, 1.0, "hints"), (2, 0, 0.0, "clusters")}
