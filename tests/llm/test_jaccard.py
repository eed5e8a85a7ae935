import random
import re

from pyspark.sql import functions as F

from sheetwise.llm import jaccard, shared


def brute(rows, percent=80):
    sets, out = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
        sets.setdefault(d, []).append(s)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (sorted(map(len, sets[d])), root(d)) for d in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("rep", F.lit("y")).repartition(3)
    got = {}
    for r in jaccard.near_duplicates(df).collect():
        n, c = got.setdefault(r.doc_id, ([], set()))
        n.append(r.n_shingles)
        c.add(r.component_id)
    assert {d: (sorted(n), *c) for d, (n, c) in got.items()} == {d: (n, c) for d, (n, c) in brute(rows).items()}


def edited(rng, words, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


def test_corner_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A\nb  c\td"), (8, "a b c d e"), (9, "a b c d e f"), (10, "é È"), (11, "é è")]
    rows += [(12, "x y z u v w x y z u v w " * 40), (13, "x y z u v w " * 7), (14, "p q r s t u v"), (14, "a b c d"), (14, "a b c d"), (15, "q " * 30_000)]
    check(spark, rows)
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(nameless).collect())[1:] == [(0, 2, None), (3, 2, 3)]
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_through_every_index(spark, monkeypatch):
    """Small limits, so that rare tokens, combinations, single frequent tokens, families and blocks all take part."""
    monkeypatch.setattr(jaccard, "RARE", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(800)]
    rows, i = [], 0
    for size, length in ((60, 90), (50, 140), (30, 400), (4, 300), (3, 30), (2, 12)):
        base = rng.choices(words, k=length)
        for _ in range(size):
            rows.append((i, edited(rng, words, base, rng.randrange(0, max(2, length // 22)))))
            i += 3
    passage = " ".join(rng.choices(words, k=60))
    for _ in range(25):
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(10, 120))) + " " + passage))
        i += 3
    rng.shuffle(rows)
    check(spark, rows)


def test_components_of_long_chains(spark):
    """A chain of shuffled ids, and 0, n, n - 1, ..., 1, which labels cross an edge a round unless roots are hooked."""
    order = random.Random(2).sample(range(300), 300)
    down = [1000, *range(1150, 1000, -1)]
    edges = [*zip(order, order[1:]), *zip(down, down[1:]), (5000, 5001)]
    got = {r.v: r.label for r in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {v: 0 for v in order} | {v: 1000 for v in down} | {5000: 5000, 5001: 5000}


def test_distinct_documents_keeps_equal_rows_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "x y"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3)
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard.distinct_documents(docs).collect())
    assert got == [(0, "x"), (0, "x"), (1, "a b c d e f"), (1, "p q r s t u"), (3, ""), (4, "x y")]
