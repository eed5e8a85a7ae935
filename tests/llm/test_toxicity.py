import random

from pyspark.sql import functions as F

from sheetwise.llm import toxicity


def test_fold():
    assert toxicity.fold("IDIOT idіоt 1d10t ïdiot ｉｄｉｏｔ i​diot").split() == ["idiot"] * 6
    assert toxicity.fold("trash$$$ cl0wn### tr@sh $tupid").split() == ["trash", "ciown", "trash", "stupid"]
    assert toxicity.fold("192.168.0.1 2024 x&y").split() == ["x", "y"]
    assert toxicity.fold(None).split() == []


def test_exceptions_void_words_inside_them():
    m = toxicity.Model({"trash": 2.0}, ["trash can"])
    assert m.weight("trash can") == 0 and m.weight("the trash. can") == 0 and m.weight("trash, cans trash") == 4
    assert m.weight("") == 0 and m.weight(None) == 0 and toxicity.Model().weight("trash") == 0


def test_learns_and_scores(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = rng.choices(words, k=rng.randrange(20, 200))
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "m0ron", "trash"]))
        elif i % 5 == 0:
            w.insert(0, "trash can")
        rows.append((i, " ".join(w), int(bad)))
    rows += [(700, None, 1), (701, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("k", F.lit(1)).withColumn("w", F.lit(2))
    model = toxicity.learn_from_tables(df.select("doc_id", "text", "k", "w"), df.select("doc_id", "toxic"))
    assert set(model.lexicon) >= {"idiot", "moron"} and "trash can" in model.exceptions
    got = toxicity.score_texts(df, model).filter(toxicity.is_held_out(F.col("doc_id"))).filter("toxic is not null and text is not null").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) >= 0.98 * len(got)
    assert toxicity.learn_from_tables(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0)).lexicon == {}
    assert toxicity.score_texts(df.limit(0), model).count() == 0


def plain_weight(model, text):
    """Every lexicon word of the folded text, unless a phrase that covers it stands there."""
    t = " ".join(toxicity.fold(text).split())
    t = f" {t} "
    spots = lambda p: [i for i in range(len(t)) if t.startswith(f" {p} ", i)]
    covered = [(i, i + len(p) + 1) for p in model.exceptions for i in spots(p)]
    return sum(w for p, w in model.lexicon.items() for i in spots(p) if not any(a <= i and i + len(p) + 1 <= b for a, b in covered))


def test_weights_equal_a_plain_search():
    rng = random.Random(5)
    m = toxicity.Model({"bad": 2.0, "worse": 3.5, "can": 1.0}, ["bad can", "worse than bad", "can can"])
    for _ in range(300):
        text = " ".join(rng.choices(["bad", "b4d", "worse", "than", "can", "fine", "BÄD", "can."], k=rng.randrange(14)))
        assert abs(m.weight(text) - plain_weight(m, text)) < 1e-9
    long = "bad can worse fine " * 60_000
    assert abs(m.weight(long) - 3.5 * 60_000) < 1e-6


def test_clashing_labels_teach_nothing(spark):
    rows = [(i, f"{'vile ' * (i % 2)}word{i} other{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = [(i, i % 2) for i in range(400)]
    model = toxicity.learn_from_tables(docs, spark.createDataFrame(labels + labels, "doc_id long, toxic int"))
    assert set(model.lexicon) == {"viie"}
    clash = spark.createDataFrame(labels + [(i, 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    assert toxicity.learn_from_tables(docs, clash).lexicon == {}
