"""Cross-reference rules as joins: procedure limits against drawing limits, absent and duplicate tags, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.quantity import matches

#: Severities in order of rank. Fixed values.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def absence_severity(recall: Column) -> Column:
    """What an absence may weigh: little where little of the drawing was read."""
    return F.when(recall > 0.8, "medium").otherwise("low")


def absence_confidence(recall: Column) -> Column:
    return F.least(F.lit(0.5), F.greatest(recall, F.lit(0.1)))


def recall_estimate(recognised: Column, regions: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(recognised.cast("double"), regions.cast("double"))), F.lit(0.0))


def limit_findings(requirements: DataFrame, limits: DataFrame, recall: float) -> DataFrame:
    """Requirements (ordinal, tag, part, field, min, max, unit) against limits (key, field, min, max, unit).

    Limits of an item's part go before those of the whole item. Items without limits give one finding per
    requirement and tag, fields without limits one each; agreement is reported too. A requirement without a
    tag is unresolved.
    """
    whole = F.lit(float(recall))
    req = requirements.withColumn("_own", F.when(F.col("part").isNotNull(), F.concat("tag", F.lit(":"), "part")).otherwise(F.col("tag")))
    keys = limits.select(F.col("key").alias("_key")).distinct()
    k1, k2 = keys.withColumn("_has_own", F.lit(True)), keys.withColumn("_has_tag", F.lit(True))
    req = req.join(k1, req["_own"] == k1["_key"], "left").drop("_key").join(k2, req["tag"] == k2["_key"], "left").drop("_key")
    req = req.withColumn("_use", F.when(F.col("_has_own"), F.col("_own")).when(F.col("_has_tag"), F.col("tag")))
    lim = limits.select(F.col("key").alias("_use"), F.col("field"), F.col("min").alias("l_min"), F.col("max").alias("l_max"), F.col("unit").alias("l_unit"))
    both = req.join(lim, ["_use", "field"], "left")
    agree = matches(F.col("min"), F.col("max"), F.col("unit"), F.col("l_min"), F.col("l_max"), F.col("l_unit"))
    missing = F.col("_use").isNull()
    no_field = F.col("l_unit").isNull()
    pick = lambda unresolved, absent, no, yes, differs: F.when(F.col("tag").isNull(), unresolved).when(missing, absent).when(no_field, no).when(agree, yes).otherwise(differs)
    out = both.select(
        "ordinal",
        F.col("tag").alias("subject"),
        "part",
        F.when(F.col("tag").isNull() | missing, F.lit(None)).otherwise(F.col("field")).alias("field"),
        pick(F.lit("sop_subject_unresolved"), F.lit("equipment_not_found_in_drawing"), F.lit("design_limit"), F.lit("design_limit"), F.lit("design_limit")).alias("check"),
        pick(F.lit("needs_review"), F.lit("needs_review"), F.lit("needs_review"), F.lit("verified"), F.lit("finding")).alias("status"),
        pick(F.lit("low"), absence_severity(whole), absence_severity(whole), F.lit("info"), F.lit("critical")).alias("severity"),
        pick(F.lit(0.6), absence_confidence(whole), absence_confidence(whole), F.lit(0.95), F.lit(0.9)).alias("confidence"),
        pick(F.lit(False), F.lit(True), F.lit(True), F.lit(False), F.lit(False)).alias("graph_incomplete"),
    )
    return out.distinct()


def absent_tags(referenced: DataFrame, known: DataFrame, tag: str = "tag") -> DataFrame:
    """Tags that the procedure names and the drawing lacks."""
    return referenced.select(tag).distinct().join(known.select(tag).distinct(), tag, "left_anti")


def duplicate_tags(tags: DataFrame, tag: str = "canonical") -> DataFrame:
    return tags.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def count_by_severity(findings: DataFrame) -> DataFrame:
    """Issues (all that is not verified) by severity."""
    return findings.filter(F.col("status") != "verified").groupBy("severity").agg(F.count("*").alias("n"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "check", "subject", "field", "ordinal")


def facility_scope(hints: DataFrame, titles: DataFrame) -> DataFrame:
    """doc, hints (array) and doc, title: the hints of each document that some title holds. Both are one row per document set."""
    text = titles.groupBy("doc").agg(F.lower(F.array_join(F.collect_list("title"), " ")).alias("_all"))
    both = hints.join(text, "doc").withColumn("shared", F.filter("hints", lambda h: F.col("_all").contains(h)))
    return both.select("doc", "shared", F.when(F.size("shared") > 0, "verified").otherwise("needs_review").alias("status"))


#: Columns of a finding.
FINDING = ("check", "status", "severity", "confidence", "subject", "graph_incomplete")


def _finding(df: DataFrame, check: str, status: str, severity: str, confidence: float, subject: Column, incomplete: bool = False) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), subject.alias("subject"), F.lit(incomplete).alias("graph_incomplete"))


def conformance_findings(tags: DataFrame) -> DataFrame:
    """Tags whose letters stand in another order than the standard's. tags: canonical, conformance, is_safety, is_sis."""
    return _finding(tags.filter("conformance = 'nonconformant_normalised'"), "tag_not_conformant", "finding", "low", 0.9, F.col("canonical"))


def duplicate_findings(tags: DataFrame) -> DataFrame:
    return _finding(duplicate_tags(tags), "duplicate_tag", "finding", "medium", 0.5, F.col("canonical"))


def legend_findings(unresolved: DataFrame) -> DataFrame:
    """One row where shapes are unresolved. unresolved: n."""
    return _finding(unresolved.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).filter("n > 0"), "symbol_requires_legend", "needs_review", "info", 1.0, F.col("n").cast("string"), True)


def safety_findings(tags: DataFrame) -> DataFrame:
    """One row each for safety devices and for safety-instrumented tags, with their sorted names; none where there are none."""
    names = lambda flag: tags.filter(flag).agg(F.array_join(F.array_sort(F.collect_set("canonical")), ", ").alias("names"), F.count("*").alias("n")).filter("n > 0")
    device = _finding(names("is_safety"), "safety_devices_identified", "verified", "info", 0.9, F.col("names"))
    return device.unionByName(_finding(names("is_sis"), "sis_tagging_present", "verified", "info", 0.8, F.col("names")))


def scope_findings(hints: DataFrame, titles: DataFrame) -> DataFrame:
    """Whether the procedure's title names a place that a drawing's title holds; nothing without hints or titles."""
    s = facility_scope(hints.filter(F.size("hints") > 0), titles)
    return s.select(F.lit("facility_scope").alias("check"), "status", F.when(F.col("status") == "verified", "info").otherwise("medium").alias("severity"), F.when(F.col("status") == "verified", 0.8).otherwise(0.5).alias("confidence"), F.array_join(F.array_sort("shared"), ", ").alias("subject"), F.lit(False).alias("graph_incomplete"))


def unknown_tag_findings(paragraphs: DataFrame, known: DataFrame) -> DataFrame:
    """Tags that paragraphs (text) name and the drawing (canonical) lacks."""
    from sheetwise.functions.tags import referenced_tags

    named = paragraphs.select(F.explode(referenced_tags(F.col("text"))).alias("tag"))
    return _finding(absent_tags(named, known.select(F.col("canonical").alias("tag"))), "sop_references_unknown_tag", "needs_review", "low", 0.4, F.col("tag"), True)


def cross_reference(tags: DataFrame, requirements: DataFrame, limits: DataFrame, paragraphs: DataFrame, hints: DataFrame, titles: DataFrame, unresolved: DataFrame, recall: float) -> DataFrame:
    """All findings, with field and ordinal where a limit is concerned."""
    plain = (conformance_findings(tags), duplicate_findings(tags), legend_findings(unresolved), safety_findings(tags), scope_findings(hints, titles), unknown_tag_findings(paragraphs, tags))
    out = limit_findings(requirements, limits, recall).select(*FINDING, "field", "ordinal")
    for f in plain:
        out = out.unionByName(f.select(*FINDING, F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("ordinal")))
    return out


def notes(recall: float, least: float = 0.5) -> list[str]:
    """What a reader must know before the findings."""
    return [f"Only {recall:.0%} of the drawing was read: an item that was not found may still be there."] if recall < least else []
