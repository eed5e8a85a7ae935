"""Writers: node-link JSON, findings as JSON lines, a Markdown report, and a run store of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.operators.rules import SEVERITIES, notes, severity_rank


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, column value: the node-link JSON document of one drawing's graph, in order of node and edge keys.
    A drawing's graph is one document by definition; do not call it for a whole corpus at once."""
    n = nodes.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(nodes.columns, key=lambda c: (c != "id", c)))))).alias("n"))
    e = edges.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(edges.columns, key=lambda c: (c != "source", c != "target", c)))))).alias("e"))
    both = n.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.concat(F.lit('{"directed": true, "edges": '), "e", F.lit(', "graph": {}, "multigraph": true, "nodes": '), "n", F.lit("}")).alias("value"))


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    node_link(nodes, edges).coalesce(1).write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines by severity, check and title or subject."""
    last = "title" if "title" in findings.columns else "subject"
    findings.orderBy(severity_rank(F.col("severity")), "check", F.col(last).asc_nulls_first()).coalesce(1).write.mode("overwrite").json(path)


def report(findings: DataFrame, title: str, recall: float) -> str:
    """A Markdown report: counts, what agrees first, then the issues by severity. The text's size is that of one document's findings."""
    counts = {r.severity: r.n for r in findings.filter("status <> 'verified'").groupBy("severity").agg(F.count("*").alias("n")).collect()}
    rows = findings.orderBy(severity_rank(F.col("severity")), "check", F.col("subject").asc_nulls_first(), F.col("field").asc_nulls_first()).collect()
    line = lambda r: f"| {r.severity} | {r.check} | {r.subject or ''} | {r.field or ''} | {r.confidence:.2f} |"
    head = ["| severity | check | subject | field | confidence |", "| --- | --- | --- | --- | --- |"]
    issues, fine = [r for r in rows if r.status != "verified"], [r for r in rows if r.status == "verified"]
    out = [f"# {title}", "", f"Estimated share of the drawing that was read: {recall:.0%}", "", "Issues: " + (", ".join(f"{counts[s]} {s}" for s in SEVERITIES if s in counts) or "none"), ""]
    out += ["## Verified", "", *head, *map(line, fine), ""] if fine else []
    out += ["## Findings", "", *head, *map(line, issues), ""]
    said = notes(recall)
    return "\n".join(out + (["## Notes", "", *(f"- {n}" for n in said), ""] if said else []))


def attribute_rows(nodes: DataFrame, key: str, extras: str, first_class: tuple[str, ...] = ()) -> DataFrame:
    """node attributes as rows: key, name, value of each entry of the map column that is not a column of its own."""
    kept = F.map_filter(F.col(extras), lambda k, v: v.isNotNull() & ~k.isin(*first_class)) if first_class else F.map_filter(F.col(extras), lambda k, v: v.isNotNull())
    return nodes.select(key, F.explode(kept).alias("name", "value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new lacks. Of rows of new with equal keys the one
    whose other columns come first in order stays."""
    w = Window.partitionBy(*keys).orderBy(*(c for c in new.columns if c not in keys))
    new = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_cache(reads: DataFrame, path: str) -> None:
    """Append reads (key, text, confidence, backend) to a cache, failed ones (empty texts) too, with the time of writing."""
    reads.select("key", "text", "confidence", "backend", F.current_timestamp().alias("written")).sortWithinPartitions("key").write.mode("append").parquet(path)


def store_run(spark: SparkSession, store: str | None, fallback: str, run_id: str, tables: dict[str, DataFrame]) -> str:
    """Write a run to the store, or, without one or where it refuses, to the fallback; returns a sentence that says which."""
    why = "no store is set"
    if store:
        try:
            write_run(spark, store, run_id, tables)
            return f"run {run_id} is in the store {store}"
        except Exception as e:  # whatever keeps the store from taking it must not lose the run
            why = f"the store {store} failed: {str(e).splitlines()[0]}"
    write_run(spark, fallback, run_id, tables)
    return f"run {run_id} is in {fallback}, as {why}"


def score_report(scores: DataFrame, title: str) -> str:
    """A Markdown table of scores (metric, hits, total, rate, low, high), one row a metric; withheld rates are said to be so.
    There are as many rows as metrics."""
    head = [f"# {title}", "", "| metric | rate | interval | counts |", "| --- | --- | --- | --- |"]
    line = lambda r: f"| {r.metric} | {'withheld' if r.rate is None else f'{r.rate:.1%}'} | {r.low:.1%} to {r.high:.1%} | {r.hits} of {r.total} |"
    return "\n".join([*head, *map(line, scores.orderBy("metric").collect()), ""])


def write_scores(scores: DataFrame, path: str) -> None:
    scores.orderBy("metric").coalesce(1).write.mode("overwrite").json(path)


def write_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Write a run's tables under root/<table>/run_id=<run_id>, and only then name it the current run."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").json(f"{root}/_current")


def read_run(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A table of a run, by default of the current one."""
    run_id = run_id or spark.read.json(f"{root}/_current").first().run_id
    return spark.read.parquet(f"{root}/{table}/run_id={run_id}")
