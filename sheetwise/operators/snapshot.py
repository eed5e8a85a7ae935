"""A run's stored tables, asked as a store's functions and policies ask them: snapshots, traces, surrogate ids, owners.

documents: doc, owner, created, run (its current one). nodes: run, key, kind, tag, page, confidence. edges: run, src, dst,
line_number, style. findings: run, check, status, severity, subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators import graph
from sheetwise.operators.rules import severity_rank


def current_run(documents: DataFrame, by: list[str]) -> DataFrame:
    """by, run: the current run of the newest document; of equally new ones that of the larger id."""
    return documents.groupBy(*by).agg(F.max_by("run", F.struct("created", "doc")).alias("run"))


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with kind and tag of both ends; edges with an end that is no node of the run are left out."""
    end = lambda c, p: nodes.select("run", F.col("key").alias(c), F.col("kind").alias(f"{p}_kind"), F.col("tag").alias(f"{p}_tag"))
    return edges.join(end("src", "src"), ["run", "src"]).join(end("dst", "dst"), ["run", "dst"])


def with_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges as (source_id, target_id, ...) by the surrogate ids (run, key, id) of their ends; edges with an unknown end go."""
    end = lambda c, to: ids.select("run", F.col("key").alias(c), F.col("id").alias(to))
    return edges.join(end("src", "source_id"), ["run", "src"]).join(end("dst", "target_id"), ["run", "dst"]).drop("src", "dst")


def owned(rows: DataFrame, documents: DataFrame, owner: str) -> DataFrame:
    """Rows of runs that belong to a document of the owner."""
    return rows.join(documents.filter(F.col("owner") == owner).select("run"), "run", "left_semi")


def snapshot(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """run, value: one JSON document of nodes, edges and findings, in order of key, of ends, and of severity; what a run
    has none of is an empty list. A run is one drawing, so its document is bounded by the drawing."""
    fields = lambda d: F.struct(*sorted(c for c in d.columns if c != "run"))

    def listed(d: DataFrame, order: list, name: str) -> DataFrame:
        kept = F.transform(F.array_sort(F.collect_list(F.struct(*order, fields(d).alias("_x")))), lambda s: s["_x"])
        return d.groupBy("run").agg(F.to_json(kept).alias(name))

    n, e = listed(nodes, ["key"], "nodes"), listed(edges, ["src", "dst"], "edges")
    f = listed(findings, [severity_rank(F.col("severity")).alias("_rank"), "check"], "findings")
    both = n.join(e, "run", "full").join(f, "run", "full")
    part = lambda c: F.concat(F.lit(f'"{c}":'), F.coalesce(c, F.lit("[]")))
    return both.select("run", F.concat(F.lit("{"), part("nodes"), F.lit(","), part("edges"), F.lit(","), part("findings"), F.lit("}")).alias("value"))


def trace_nodes(edges: DataFrame, nodes: DataFrame, starts: DataFrame, max_depth: int = 25) -> DataFrame:
    """depth and the node's columns of all that lies downstream of the starts (column node). Nodes that are not stored go."""
    reached = graph.trace(edges, starts, max_depth)
    return reached.join(nodes, reached["node"] == nodes["key"]).drop("node")


def trace_document(traced: DataFrame) -> DataFrame:
    """value: the trace as one JSON list by depth, then key; an empty one without rows. The walk's bound is the document's."""
    order = F.array_sort(F.collect_list(F.struct("depth", "key", "kind", "tag")))
    return traced.agg(F.coalesce(F.to_json(order), F.lit("[]")).alias("value"))


def composed(nodes: DataFrame) -> DataFrame:
    """Nodes of all sheets (column sheet, number of the sheet) as one graph: of equal keys that of the last sheet stays."""
    from pyspark.sql import Window

    return nodes.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sheet")))).filter("_rn = 1").drop("_rn")
