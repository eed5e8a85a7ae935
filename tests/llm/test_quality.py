import random
import re

from pyspark.sql import functions as F

from sheetwise.llm import quality


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover), failed


def test_figures_equal_the_plain_ones(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a b c d e " * 9, "x" * 20_000, "é " * 12, "a\n b\na\n b\n\n \n", "q w e r t y " + "q w e r t y"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a ", "bb ", "c", "\n", "# ", "d\t", "$", "line one\n"]) for _ in range(rng.randrange(120))))
    rows = list(enumerate(texts)) + [(1, ""), (4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_w", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect())
    assert got == sorted((i, *plain(t)) for i, t in rows)
    assert all(not r.kept for r in quality.judge(df).collect() if r.base_failed)
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.kept_documents(df).columns == df.columns


def test_order_is_by_rejection_per_cost(spark):
    clean = " ".join(f"word{i} other{i * 7}" for i in range(40))
    rows = [(i, " ".join(f"w{i}x{j}###" for j in range(30))) for i in range(200)] + [(i + 500, clean + str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = quality.plan(quality.base(df), 400)
    assert {n for n, _, _ in order} == set(quality.rules()) and [r / c for _, c, r in order] == sorted((r / c for _, c, r in order), reverse=True)
    cost = {n: c for n, c, _ in order}
    assert cost["symbols"] < cost["no_letters"]  # arithmetic on figures against a regular expression over the text
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert kept == {i for i, _ in rows if i >= 500}
