"""Mixing sources to target weights (native).

The tokens of each source are laid end to end and packed into blocks of a fixed length. Output shards
of `shard_slots` slots draw their source counts as a multinomial: each slot draws its source by a hash
of its number. The draws of a source are numbered over all shards; number g is block
permutation_e(g mod blocks) of epoch e = g div blocks, where the permutation is a keyed Feistel network
over the source's block numbers. Draws beyond a source's quota are handed to the sources that drew too
few, so that totals meet the targets while shards keep their multinomial counts. Slots are joined with
blocks by (source, block).

Defined results: a null text has no words; a null source is a source of its own, last in order; sources
of no words have target 0 and give nothing; a null doc_id stays null; an empty table gives an empty result; repeated rows are
documents of their own; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.llm.shared import SPACE, materialise, running_total, words

LIMIT = 3  # a source's target and a document's share stop at so many times its size
PARTS = 4096  # of the number line that draws are looked up in


@dataclass
class Mixture:
    docs: DataFrame  # doc_id, source, size, source_id, source_size, target, start, blk_len
    slots: DataFrame  # shard, slot, source_id, epoch, block
    pieces: DataFrame  # doc_id, size, source_id, start, block, piece_start (word of the document), piece_len


def targets(sizes: DataFrame) -> DataFrame:
    """source, size -> one row per source with source_id, weight, source_size, target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Targets are least(LIMIT * size,
    weight * level), level being the one at which they add up to all sizes: what resharing the excess
    until none is above ends in.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    s = s.withColumn("weight", (F.col("source_id") % 3 + 1).cast("double"))
    cap = F.lit(float(LIMIT)) * F.col("source_size")
    by = Window.orderBy(cap / F.col("weight"), "source_id")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.max("level").over(Window.partitionBy()))
    return s.withColumn("target", F.least(cap, F.col("weight") * F.col("level"))).drop("level")


def _feistel(i: Column, a: Column, b: Column, *key: Column, rounds: int = 4) -> Column:
    """A keyed bijection of 0 .. a * b - 1."""
    left, right = F.floor(i / b).cast("long"), i % b
    for r in range(rounds):
        if r % 2 == 0:
            left = (left + F.pmod(F.xxhash64(right, *key, F.lit(r)), a)) % a
        else:
            right = (right + F.pmod(F.xxhash64(left, *key, F.lit(r)), b)) % b
    return left * b + right


def _lookup(points: DataFrame, at: str, ranges: DataFrame, lo: str, n: str, total: int) -> DataFrame:
    """Join each point with the one range [lo, lo + n) that holds it, as an equi-join over PARTS of the line."""
    width = max(1, -(-total // PARTS))
    r = ranges.filter(F.col(n) > 0).withColumn("_part", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(lo) + F.col(n) - 1) / width))))
    p = points.withColumn("_part", F.floor(F.col(at) / width))
    return p.join(r, "_part").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(lo) + F.col(n))).drop("_part")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", shard_slots: int = 4096, min_block: int = 32, max_block: int = 2048, seed: int = 7) -> Mixture:
    """Draw a mixture of all documents' words. A source's block length is its size / 2**17, held between
    min_block and max_block, and below size / 512 for small sources."""
    spark: SparkSession = docs.sparkSession
    sizes = materialise(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size")), "mix-sizes")
    s = targets(sizes)
    size = F.col("source_size")
    s = s.withColumn("blk_len", F.greatest(F.lit(1), F.least(F.greatest(F.lit(min_block), F.least(F.lit(max_block), F.floor(size / (1 << 17)))), F.floor(size / 512))).cast("long"))
    s = s.withColumn("_need", F.greatest(F.lit(1), F.ceil(size / F.col("blk_len"))).cast("long"))
    s = s.withColumn("fa", F.ceil(F.sqrt("_need")).cast("long")).withColumn("fb", F.ceil(F.col("_need") / F.col("fa")).cast("long"))
    s = s.withColumn("n_blocks", F.col("fa") * F.col("fb")).drop("_need")
    quota = F.when(size > 0, F.least(F.rint(F.col("target") * F.col("n_blocks") / size).cast("long"), LIMIT * F.col("n_blocks"))).otherwise(0)
    s = s.withColumn("quota", quota.cast("long"))
    s = s.withColumn("quota_lo", F.coalesce(F.sum("quota").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = materialise(s, "mix-sources")
    total, n_docs = s.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0], sizes.count()

    # Lay the documents of each source end to end.
    named = sizes.join(s, sizes["source"].eqNullSafe(s["source"])).select(sizes["*"], "source_id", "source_size", "target", "blk_len")
    placed = materialise(running_total(named, ["source_id"], ["doc_id", "size"], "size", "start", max(1, round(n_docs**0.5))), "mix-docs")

    # Draw: each slot a source, numbered within the source over all shards.
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("u"))
    drawn = _lookup(slots, "u", s.select("source_id", "quota_lo", "quota"), "quota_lo", "quota", total).select("slot", "shard", "source_id")
    mine = Window.partitionBy("shard", "source_id").orderBy("slot")
    drawn = drawn.withColumn("j", F.row_number().over(mine) - 1)
    counts = materialise(drawn.groupBy("source_id", "shard").agg(F.count("*").alias("n")), "mix-counts")
    far = Window.partitionBy("source_id").orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("source_id", "_far").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts_far = counts.withColumn("_far", F.floor(F.col("shard") / 1024))
    tops = counts_far.groupBy("source_id", "_far").agg(F.sum("n").alias("n")).select("source_id", "_far", F.coalesce(F.sum("n").over(far), F.lit(0)).alias("_top"))
    bases = counts_far.join(tops, ["source_id", "_far"]).select("source_id", "shard", (F.col("_top") + F.coalesce(F.sum("n").over(near), F.lit(0))).alias("_base"))
    drawn = drawn.join(bases, ["source_id", "shard"]).withColumn("g", F.col("_base") + F.col("j"))

    # Hand the draws beyond a quota to the sources that drew too few.
    had = counts.groupBy("source_id").agg(F.sum("n").alias("had"))
    all_before = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(had, "source_id", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    s = s.withColumn("over", F.greatest(F.lit(0), F.col("had") - F.col("quota"))).withColumn("under", F.greatest(F.lit(0), F.col("quota") - F.col("had")))
    s = s.withColumn("over_lo", F.coalesce(F.sum("over").over(all_before), F.lit(0))).withColumn("under_lo", F.coalesce(F.sum("under").over(all_before), F.lit(0)))
    s = materialise(s, "mix-quotas")
    n_over = s.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    drawn = drawn.join(s.select("source_id", "quota", "over_lo"), "source_id")
    kept = drawn.filter(F.col("g") < F.col("quota")).select("slot", "shard", "source_id", "g")
    spare = drawn.filter(F.col("g") >= F.col("quota")).select("slot", "shard", (F.col("over_lo") + F.col("g") - F.col("quota")).alias("r"))
    moved = _lookup(spare, "r", s.select("source_id", "under_lo", "under", "had"), "under_lo", "under", n_over)
    moved = moved.select("slot", "shard", "source_id", (F.col("had") + F.col("r") - F.col("under_lo")).alias("g"))
    picked = kept.unionByName(moved).join(s.select("source_id", "fa", "fb", "n_blocks"), "source_id")
    epoch = F.floor(F.col("g") / F.col("n_blocks")).cast("long")
    picked = picked.withColumn("epoch", epoch)
    block = _feistel(F.col("g") % F.col("n_blocks"), F.col("fa"), F.col("fb"), F.col("source_id"), F.col("epoch"), F.lit(seed))
    picked = picked.select("shard", "slot", "source_id", "epoch", block.alias("block"))

    last = F.col("start") + F.col("size") - 1
    pieces = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("blk_len")), F.floor(last / F.col("blk_len")))))
    lo = F.greatest(F.col("start"), F.col("block") * F.col("blk_len"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("blk_len"))
    pieces = pieces.select("doc_id", "size", "source_id", "start", "block", (lo - F.col("start")).alias("piece_start"), (hi - lo).alias("piece_len"))
    return Mixture(placed, materialise(picked, "mix-slots"), pieces)


def taken(m: Mixture) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mixture takes of each document, repeats counted."""
    times = m.slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
    got = m.pieces.join(times, ["source_id", "block"]).groupBy("source_id", "start", "size").agg(F.sum(F.col("piece_len") * F.col("times")).alias("taken"))
    out = m.docs.join(got, ["source_id", "start", "size"], "left")  # a start names one document that has words
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: for each document and epoch one row whose text is the words taken in that
    epoch, in order and with their white space. n_chars is the new text's length; other columns stay."""
    m = mix(docs, **options)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    runs = m.pieces.join(m.slots.select("source_id", "block", "epoch"), ["source_id", "block"])
    copies = runs.groupBy("source_id", "size", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("piece_start", "piece_len"))).alias("_runs"))
    # Rows of one doc_id and size stand in for each other: number them alike on both sides.
    rank = lambda *by: F.row_number().over(Window.partitionBy("_key", "_size").orderBy(*by))
    rows = m.docs.filter(F.col("size") > 0).select(name.alias("_key"), F.col("size").alias("_size"), "source_id", "start").withColumn("_nth", rank("source_id", "start"))
    copies = copies.withColumnRenamed("size", "_size").join(rows, ["_size", "source_id", "start"]).select("_key", "_size", "_nth", "_runs")
    # The document's own columns travel in one, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*docs.columns).alias("_row"), name.alias("_key"), F.size(words(F.col("text"))).cast("long").alias("_size")).filter(F.col("_size") > 0)
    own = own.withColumn("_nth", rank(F.col("_row.source").asc_nulls_last(), F.xxhash64("_row.text")))
    # A word with the white space after it; white space before the first word is dropped.
    text = F.col("_row.text")
    units = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    both = own.join(copies, ["_key", "_size", "_nth"])
    lead = F.when(F.substring(text, 1, 1).isin(*" \t\n\x0b\x0c\r"), 1).otherwise(0)
    cut = lambda u: F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice(u, (r["piece_start"] + 1 + lead).cast("int"), r["piece_len"].cast("int")))), "")
    both = both.withColumn("_text", F.get(F.transform(F.array(units), cut), F.lit(0)))  # a let binding: the text is split once, not once a run
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return both.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
