import random

from pyspark.sql import functions as F

from sheetwise.llm import mixing


def water(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 3.0 * sizes[s] for s in capped}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def documents(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        source = rng.choice(["big"] * 6 + ["a", "b", "Z", "é", None, "tiny"])
        n = rng.randrange(0, 120) if source != "tiny" else rng.randrange(3)
        rows.append((i, " \n".join(rng.choices(["w", "xx", "é"], k=n)) if n % 9 else None, source))
    rows += [(None, "no id at all", "a"), (None, "no id", "b"), (7, "twice a b c", "a"), (7, "twice a b c", "a"), (8, " lead and trail \t", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("epoch", F.lit("y"))


def test_totals_meet_targets_and_no_document_exceeds_three_times_its_size(spark):
    rows, df = documents(spark)
    got = mixing.taken(mixing.mix(df)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2, 0.03 * want[s])
    again = mixing.taken(mixing.mix(df.repartition(5))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_slots_are_numbered_once_per_epoch(spark):
    _, df = documents(spark, 2)
    m = mixing.mix(df, shard_slots=50)
    slots = m.slots.collect()
    assert len({(s.source_id, s.epoch, s.block) for s in slots}) == len(slots) and sorted(s.slot for s in slots) == list(range(len(slots)))
    counts = {}
    for s in slots:
        counts.setdefault(s.shard, {}).setdefault(s.source_id, []).append(1)
    assert len({tuple(sorted((k, len(v)) for k, v in c.items())) for c in counts.values()}) > 1  # shards differ as draws do


def test_mixed_documents_keep_columns_and_empty_tables(spark):
    _, df = documents(spark, 3)
    df = df.withColumn("n_chars", F.lit(0).cast("long"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, want = {}, {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r.size == "x" and r.epoch == "y"
    for r in mixing.taken(mixing.mix(df)).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}
    empty = df.limit(0)
    assert mixing.taken(mixing.mix(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0
