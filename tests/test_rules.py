from pyspark.sql import functions as F

from sheetwise.functions import tags
from sheetwise.operators import rules
from tests.test_operators import LIM, REQ, limits, requirements


def index(spark, raws):
    t = spark.createDataFrame([(r,) for r in raws], "raw string").withColumn("t", tags.parse(F.col("raw")))
    return t.select("t.canonical", "t.conformance", "t.is_safety", "t.is_sis").filter("canonical is not null")


def test_cross_reference(spark):
    t = index(spark, ["DPIT-745-16", "PI-715A", "PI-715A", "PSV-1001", "PSV-100", "TZT-100", "V-745"])
    req, lim = spark.createDataFrame(requirements(), REQ), spark.createDataFrame(limits(), LIM)
    paragraphs = spark.createDataFrame([("Open MV-101 and v-745, then PSV-100.",), ("nothing",)], "text string")
    hints = spark.createDataFrame([(1, ["ashford", "purge"])], "doc int, hints array<string>")
    titles = spark.createDataFrame([(1, "MAJORSVILLE CGP"), (1, "SHEET 2")], "doc int, title string")
    unresolved = spark.createDataFrame([(3,), (0,)], "n long")
    got = rules.cross_reference(t, req, lim, paragraphs, hints, titles, unresolved, 0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r.check, []).append((r.status, r.severity, r.subject))
    assert len(by["design_limit"]) == 12 and by["tag_not_conformant"] == [("finding", "low", "PDIT-745-16")]
    assert by["duplicate_tag"] == [("finding", "medium", "PI-715A")] and by["symbol_requires_legend"] == [("needs_review", "info", "3")]
    assert by["safety_devices_identified"] == [("verified", "info", "PSV-100, PSV-1001")] and by["sis_tagging_present"] == [("verified", "info", "TZT-100")]
    assert by["facility_scope"] == [("needs_review", "medium", "")] and by["sop_references_unknown_tag"] == [("needs_review", "low", "MV-101")]
    same = rules.scope_findings(hints, spark.createDataFrame([(1, "Ashford yard")], "doc int, title string")).collect()
    assert [(r.status, r.subject) for r in same] == [("verified", "ashford")]
    empty = rules.scope_findings(hints, titles.limit(0)).count() + rules.legend_findings(unresolved.limit(0)).count() + rules.safety_findings(t.limit(0)).count()
    assert empty == 0
    assert [r.severity for r in rules.ordered(rules.cross_reference(t, req, lim, paragraphs, hints, titles, unresolved, 0.9)).limit(2).collect()] == ["medium", "medium"]
