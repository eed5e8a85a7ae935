import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sheetwise.llm import mixing, pii  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        w = rng.choices(words, k=rng.randrange(30, 300))
        if i % 6 == 0:
            for _ in range(3):
                w.insert(5, rng.choice(["idiot", "moron"]))
        if i % 9 == 1:
            w.insert(7, "a.b@c.org")
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(w), "en", f"s{i % 4}" if i % 7 else None, 0))
    rows += [(200, rows[1][1], "en", "s0", 0), (201, rows[2][1] + " tail", "en", "s1", 0), (202, None, "en", "s1", 0), (203, "", None, None, 0), (203, "", None, None, 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.reject_toxic(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {i for i in texts if i >= 200 or i % 6}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir).cache()
    groups = brute([(i, texts[i]) for i in ids])
    assert {r.doc_id for r in single.collect()} == {i for i in ids if groups[i][1] == i} and not {200, 201} & {r.doc_id for r in single.collect()}
    masked = corpus_pipeline.mask_personal_data(spark, single, sf_dir).cache()
    assert masked.columns == columns and masked.count() == single.count()
    assert all(r.n_chars == len(r.text) and not pii.base_spans(r.text) for r in masked.collect() if r.text is not None)
    mixed = corpus_pipeline.mix_sources(spark, masked, sf_dir).cache()
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(masked)).collect()}
    got, whole = {}, {r.doc_id: (r.text or "").split() for r in masked.collect()}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        it = iter(whole[r.doc_id])
        assert all(w in it for w in r.text.split())  # words of the document, in order
    assert got == {d: n for d, n in taken.items() if n}
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(got)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_odd_tables(spark, sf_dir):
    """Clashing names, nulls, a very long text, repeated rows and an empty table go through every stage."""
    long = " ".join(f"w{i % 977} v{i % 1009}" for i in range(60_000))
    rows = [(None, None, None), (None, "some words without an id " * 3, "s"), (1, "", "s"), (2, long, None), (2, long, None), (3, "a few words here, mail a.b@c.org now", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("_toxicity", "_key", "_size", "_nth", "_runs", "_row", "_text", "size", "n", "rep", "spans", "gone", "component_id", "start", "cls"):
        docs = docs.withColumn(c, F.lit("x"))
    columns = docs.columns
    for table, want in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf_dir).cache()
            assert table.columns == columns and {r["_key"] for r in table.collect()} <= {"x"}, name
            if name == "pii":
                assert table.count() == want
        if want:
            texts = [r.text for r in table.collect() if r.doc_id == 2]
            assert texts and all(set(t.split()) <= set(long.split()) for t in texts)
        packed = corpus_pipeline.pack_sequences(spark, table, sf_dir)
        assert (packed.count() > 0) == bool(want)
