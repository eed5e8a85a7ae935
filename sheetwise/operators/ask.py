"""Questions to a graph: find a tag, describe a node, gather the evidence about it.

nodes: key, seq (order of insertion), tag, kind, label, page, confidence. edges: src, dst, via, line_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.operators import graph

#: What looks like a tag in a question. Fixed value.
TAG = r"([A-Za-z]{1,8}-\d+[A-Za-z0-9]*(?:-\d+[A-Za-z0-9]*)*)"


def _name() -> Column:
    return F.coalesce(F.when(F.col("tag") != "", F.col("tag")), F.col("label"), F.lit(""))


def find_tag(nodes: DataFrame, needle: str, limit: int = 12) -> DataFrame:
    """The first nodes, in order of insertion, whose tag, kind or key holds the needle. The limit is the feature."""
    needle = needle.strip().upper()
    text = F.upper(F.concat_ws(" ", _name(), F.coalesce("kind", F.lit("")), "key"))
    hits = nodes.filter(text.contains(needle)) if needle else nodes.limit(0)
    return hits.orderBy("seq").limit(limit)


def tag_candidates(questions: DataFrame, question: str = "question") -> DataFrame:
    """questions with candidates: the tags in them, the longest first, of equal length in order of the alphabet."""
    found = F.array_distinct(F.regexp_extract_all(question, F.lit(TAG), F.lit(1)))
    ranked = F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return questions.withColumn("candidates", F.transform(ranked, lambda r: r["t"]))


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the line numbers of their edges, sorted, each once."""
    ends = edges.select(F.col("src").alias("key"), "line_number").unionByName(edges.select(F.col("dst").alias("key"), "line_number"))
    lines = ends.filter("line_number is not null and line_number <> ''").groupBy("key").agg(F.array_sort(F.collect_set("line_number")).alias("line_numbers"))
    return nodes.join(lines, "key", "left").withColumn("line_numbers", F.coalesce("line_numbers", F.array().cast("array<string>")))


def ask(nodes: DataFrame, edges: DataFrame, question: str, max_depth: int = 12) -> dict[str, DataFrame]:
    """Evidence for one question: matches, and for the best match its description, neighbours and walks both ways."""
    spark = nodes.sparkSession
    row = tag_candidates(spark.createDataFrame([(question,)], "question string")).first()
    hits = None
    for candidate in row.candidates:
        found = find_tag(nodes, candidate, 1)
        if found.limit(1).count():
            hits = found
            break
    hits = hits if hits is not None else find_tag(nodes, question.strip())
    best = hits.orderBy("seq").limit(1).select(F.col("key").alias("node"))
    near = graph.neighbours(edges).join(best, "node")
    return {
        "matches": hits,
        "describe": describe(nodes.join(best, nodes["key"] == best["node"], "left_semi"), edges),
        "neighbours": near,
        "upstream": graph.walk(edges, best, "upstream", max_depth),
        "downstream": graph.walk(edges, best, "downstream", max_depth),
    }
