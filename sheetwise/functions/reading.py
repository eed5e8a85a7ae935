"""Reads of recognised text: cleaning, closing gaps, repair within a budget of substitutions, and a cache of earlier reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import tags

# Characters that annotations are made of, and letters and digits that are taken for each other.
ALLOWED = r"""^[A-Z0-9 \-/"'.,()&*#°]+$"""
IDENTIFIER = r'^[A-Z0-9\-/".]+$'
CONFUSIONS = {"I": "1", "1": "I", "O": "0", "0": "OD", "D": "0", "8": "B", "B": "8", "4": "A", "A": "4", "5": "S", "S": "5", "2": "Z", "Z": "2"}


def _stripped(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def clean(text: Column) -> Column:
    """Upper case with single spaces and plain quotes; empty where the read cannot be an annotation."""
    t = F.regexp_replace(F.translate(_stripped(text), "″”", '""'), r"(?U)\s+", " ")
    return F.when(t.isin("", "-", ".") | ~t.rlike(ALLOWED), "").otherwise(t)


def close_gaps(text: Column) -> Column:
    """Without its spaces where that leaves one identifier."""
    joined = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(joined.rlike(IDENTIFIER), joined).otherwise(text)


def _one_more(tried: Column) -> Column:
    """From (text, last), last being the place changed last, all with one confusable character more changed behind it."""
    table = F.create_map(*(F.lit(x) for k, v in CONFUSIONS.items() for x in (k, v)))

    def behind(t):
        text, last = t["text"], t["last"]
        places = F.when(last < F.length(text), F.sequence(last + 1, F.length(text))).otherwise(F.array().cast("array<int>"))

        def at(i):
            options = F.split(F.coalesce(F.try_element_at(table, F.substr(text, i, F.lit(1))), F.lit("")), "")
            return F.transform(F.filter(options, lambda c: c != ""), lambda c: F.struct(F.concat(F.substr(text, F.lit(1), i - 1), c, F.substr(text, i + 1)).alias("text"), i.alias("last")))

        return F.flatten(F.transform(places, at))

    return F.flatten(F.transform(tried, behind))


def repair(reads: DataFrame, text: str = "text", budget: int = 0) -> DataFrame:
    """reads with repaired, tag and how (direct, spaces_removed, substituted; null: not repairable).

    A read that is a tag as it stands or without its spaces is taken, but for an off-page connector that only
    losing spaces makes. Within the budget, substitutions are tried then, and taken if all that give a tag give
    the same one."""
    raw = _stripped(F.col(text))
    out = reads.withColumn("_raw", raw).withColumn("_closed", close_gaps(F.col("_raw"))).withColumn("_tag", tags.parse(F.col("_closed")))
    good = F.col("_tag")["kind"] != "unknown"
    spaced = F.col("_closed") != F.col("_raw")
    weak = spaced & (F.col("_tag")["kind"] == "off_page_connector")
    out = out.withColumn("how", F.when(good & ~weak, F.when(spaced, "spaces_removed").otherwise("direct")))
    out = out.withColumn("repaired", F.when(F.col("how").isNotNull(), F.col("_closed"))).withColumn("tag", F.when(F.col("how").isNotNull(), F.col("_tag")))
    if budget > 0:
        level = F.array(F.struct(F.col("_closed").alias("text"), F.lit(0).alias("last")))
        tried = []
        for _ in range(budget):  # every place changes once at most, so no text comes from its own detours
            level = _one_more(level)
            tried.append(level)
        tried = F.transform(F.concat(*tried), lambda t: t["text"])
        found = F.filter(F.transform(tried, lambda t: F.struct(t.alias("text"), tags.parse(t).alias("tag"))), lambda s: s["tag"]["kind"] != "unknown")
        out = out.withColumn("_found", F.when(F.col("how").isNull() & ~good & (F.col("_raw") != ""), found))
        one = F.size(F.array_distinct(F.transform("_found", lambda s: s["tag"]["canonical"]))) == 1
        first = F.get("_found", F.lit(0))
        out = out.withColumn("repaired", F.when(one, first["text"]).otherwise(F.col("repaired"))).withColumn("tag", F.when(one, first["tag"]).otherwise(F.col("tag")))
        out = out.withColumn("how", F.when(one, "substituted").otherwise(F.col("how"))).drop("_found")
    return out.drop("_raw", "_closed", "_tag")


def repair_stats(repaired: DataFrame) -> DataFrame:
    how = F.col("how")
    return repaired.agg(F.count("*").alias("input"), F.count_if(how.isin("direct", "spaces_removed")).alias("direct"), F.count_if(how == "substituted").alias("repaired"), F.count_if(how.isNull()).alias("unrepairable"))


def split_by_cache(crops: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of crops (key, ...) against the cache of earlier reads (key, text, confidence, backend). A cached
    empty text is a read that failed before, and counts as a hit."""
    return crops.join(cache, "key"), crops.join(cache.select("key"), "key", "left_anti")
