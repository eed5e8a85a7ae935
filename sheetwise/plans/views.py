"""Stand-in views: the supplied tables hold no drawings, so segments, boxes, tags, edges and limits are derived
from their keys by arithmetic that Spark and DuckDB evaluate alike. Every view keeps all rows of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, {column: SQL expression}). The same text runs in both engines.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_segments": ("lineitem", {
        "seg": "l_orderkey * 10 + l_linenumber", "page": "l_partkey % 16",
        "ax": "CAST((l_orderkey * 37) % 1000 AS DOUBLE)", "ay": "CAST((l_partkey * 91 + l_linenumber * 13) % 800 AS DOUBLE)",
        "ex": "CAST((l_orderkey * 37) % 1000 + CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END AS DOUBLE)",
        "ey": "CAST((l_partkey * 91 + l_linenumber * 13) % 800 + CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE l_quantity END AS DOUBLE)",
    }),
    "v_boxes": ("part", {
        "box": "p_partkey", "page": "p_partkey % 16",
        "x0": "CAST((p_partkey * p_partkey * 7 + p_partkey * 53) % 1000 AS DOUBLE)", "y0": "CAST((p_partkey * p_partkey * 3 + p_partkey * 29) % 800 AS DOUBLE)",
        "x1": "CAST((p_partkey * p_partkey * 7 + p_partkey * 53) % 1000 + 8 + p_size % 5 AS DOUBLE)", "y1": "CAST((p_partkey * p_partkey * 3 + p_partkey * 29) % 800 + 8 + p_size % 7 AS DOUBLE)",
    }),
    "v_intervals": ("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "page": "l_suppkey", "lo": "l_partkey * 7 % 100000", "hi": "l_partkey * 7 % 100000 + CAST(l_quantity AS BIGINT)"}),
    "v_tags": ("part", {"id": "p_partkey", "page": "p_partkey % 64", "raw": """CASE p_partkey % 14
        WHEN 0 THEN 'PI-' || CAST(100 + p_partkey % 900 AS STRING) WHEN 1 THEN ' pdi-' || CAST(700 + p_partkey % 40 AS STRING) || 'a'
        WHEN 2 THEN 'DPIT-' || CAST(700 + p_partkey % 40 AS STRING) || '-16' WHEN 3 THEN 'PSV-' || CAST(100 + p_partkey % 90 AS STRING) || 'A'
        WHEN 4 THEN 'P-' || CAST(700 + p_partkey % 50 AS STRING) WHEN 5 THEN 'T-386 B' WHEN 6 THEN 'MV-' || CAST(700 + p_partkey % 40 AS STRING) || '-0' || CAST(p_partkey % 9 AS STRING)
        WHEN 7 THEN CAST(1 + p_partkey % 8 AS STRING) || '"-PL-' || CAST(2000 + p_partkey % 100 AS STRING) || '-D' WHEN 8 THEN '1"-KW-4471-B-G-RS-' || CAST(p_partkey % 7 AS STRING)
        WHEN 9 THEN '[0' || CAST(100 + p_partkey % 300 AS STRING) || 'C]' WHEN 10 THEN 'ROTTERDAM' WHEN 11 THEN CAST(1000 + p_partkey % 9000 AS STRING)
        WHEN 12 THEN 'LSHH-' || CAST(700 + p_partkey % 40 AS STRING) ELSE 'TZT-' || CAST(100 + p_partkey % 400 AS STRING) || '-7' END"""}),
    "v_edges": ("lineitem", {"src": "l_suppkey * 2", "dst": "l_partkey * 2 + 1", "via": "l_linenumber"}),
    "v_chain": ("orders", {"src": "o_orderkey", "dst": "CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey ELSE o_orderkey + 1 END", "via": "o_custkey"}),
    "v_req": ("orders", {
        "ordinal": "o_orderkey", "tag": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'V-' || CAST(o_custkey AS STRING) END",
        "part": "CASE WHEN o_orderkey % 5 = 0 THEN 'shell' END", "field": "CASE WHEN o_orderkey % 2 = 0 THEN 'pressure' ELSE 'temperature' END",
        "min": "CAST(o_custkey % 50 AS DOUBLE)", "max": "CAST(o_custkey % 50 + o_orderkey % 3 AS DOUBLE)", "unit": "CASE WHEN o_orderkey % 2 = 0 THEN 'psig' ELSE 'degF' END",
    }),
    "v_limits": ("customer", {
        "key": "'V-' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 7 = 0 THEN ':shell' ELSE '' END", "field": "CASE WHEN c_custkey % 3 = 0 THEN 'temperature' ELSE 'pressure' END",
        "min": "CAST(c_custkey % 50 AS DOUBLE)", "max": "CAST(c_custkey % 50 + c_custkey % 2 AS DOUBLE)", "unit": "CASE WHEN c_custkey % 13 = 0 THEN 'barg' WHEN c_custkey % 3 = 0 THEN 'degF' ELSE 'psig' END",
    }),
    "v_paths": ("lineitem", {
        "page": "l_suppkey", "path": "l_orderkey * 10 + l_linenumber", "width": "CAST(l_discount AS DOUBLE)", "ink": "CAST(l_extendedprice AS DOUBLE)",
        "w": "CAST(l_quantity AS DOUBLE)", "h": "CAST(l_partkey % 40 AS DOUBLE)", "curves": "l_linenumber % 3", "filled": "l_linenumber % 4 = 0", "black": "l_orderkey % 5 > 0",
    }),
    "v_subjects": ("customer", {"id": "c_custkey", "subject": """CASE c_custkey % 6 WHEN 0 THEN 'F-' || CAST(700 + c_custkey % 90 AS STRING) || ' A and B filters'
        WHEN 1 THEN 'E-' || CAST(700 + c_custkey % 90 AS STRING) || ' (Tube) exchanger' WHEN 2 THEN 'v-318 / AC-' || CAST(700 + c_custkey % 90 AS STRING)
        WHEN 3 THEN 'P-264 C/D' WHEN 4 THEN 'no tag here' ELSE 'V-' || CAST(100 + c_custkey % 900 AS STRING) || 'A, V-12' END"""}),
    "v_cells": ("orders", {"id": "o_orderkey", "cell": """CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '-20 to ' || CAST(o_custkey AS STRING) WHEN 2 THEN CAST(o_custkey AS STRING) || '/' || CAST(o_custkey % 9 AS STRING)
        WHEN 3 THEN '690/1/50' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN 'n/a' ELSE CAST(o_custkey % 30 AS STRING) || ' THROUGH 7.25' END""",
        "header": "CASE o_orderkey % 6 WHEN 0 THEN 'Pressure (psig)' WHEN 1 THEN 'Temp (F)' WHEN 2 THEN 'Temperature, C' WHEN 3 THEN 'Flow' WHEN 4 THEN 'Design barg' ELSE 'Equipment' END"}),
    "v_nodes": ("part", {
        "key": "'n' || CAST(p_partkey AS STRING)", "seq": "p_partkey", "page": "p_partkey % 16", "sheet": "p_partkey % 3",
        "kind": "CASE p_partkey % 5 WHEN 0 THEN 'instrument' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE 'component' END",
        "tag": "CASE WHEN p_partkey % 3 = 0 THEN 'V-' || CAST(100 + p_partkey % 400 AS STRING) WHEN p_partkey % 3 = 1 THEN '' END",
        "label": "CASE p_partkey % 7 WHEN 0 THEN 'region@1,2' WHEN 1 THEN 'x' WHEN 2 THEN '12-34' WHEN 3 THEN p_brand WHEN 4 THEN '' END",
        "confidence": "CAST(p_size AS DOUBLE) / 50",
        "x0": "CAST((p_partkey * p_partkey * 7 + p_partkey * 53) % 1000 AS DOUBLE)", "y0": "CAST((p_partkey * p_partkey * 3 + p_partkey * 29) % 800 AS DOUBLE)",
        "x1": "CAST((p_partkey * p_partkey * 7 + p_partkey * 53) % 1000 + 8 + p_size % 5 AS DOUBLE)", "y1": "CAST((p_partkey * p_partkey * 3 + p_partkey * 29) % 800 + 8 + p_size % 7 AS DOUBLE)",
    }),
    "v_links": ("lineitem", {
        "src": "'n' || CAST(l_partkey AS STRING)", "dst": "'n' || CAST((l_partkey * 13 + l_linenumber * 7) % 23000 + 1 AS STRING)", "via": "l_orderkey * 10 + l_linenumber",
        "line_number": "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(l_linenumber AS STRING) || '\"-PL-' || CAST(l_suppkey % 9 AS STRING) END",
    }),
    "v_annots": ("orders", {
        "page": "o_custkey % 64", "annot": "o_orderkey", "title": "CASE o_orderkey % 4 WHEN 0 THEN 'AutoCAD SHX Text' WHEN 1 THEN 'free TEXT' WHEN 2 THEN NULL ELSE 'stamp' END",
        "content": "CASE o_orderkey % 5 WHEN 0 THEN 'said' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE '' END",
        "x0": "CAST(o_orderkey * 37 % 1000 AS DOUBLE)", "y0": "CAST(o_orderkey * 91 % 800 AS DOUBLE)",
        "x1": "CAST(o_orderkey * 37 % 1000 + o_orderkey % 6 * 25 AS DOUBLE)", "y1": "CAST(o_orderkey * 91 % 800 + 40 AS DOUBLE)",
    }),
    "v_marks": ("lineitem", {
        "page": "l_suppkey % 64", "path": "l_orderkey * 10 + l_linenumber", "x0": "CAST(l_partkey * 17 % 1000 AS DOUBLE)", "y0": "CAST(l_orderkey * 23 % 800 AS DOUBLE)",
        "x1": "CAST(l_partkey * 17 % 1000 + 1 + l_linenumber AS DOUBLE)", "y1": "CAST(l_orderkey * 23 % 800 + 2 AS DOUBLE)",
    }),
    "v_docs": ("customer", {"doc": "c_custkey", "owner": "'u' || CAST(c_custkey % 5 AS STRING)", "site": "c_nationkey", "created": "c_custkey * 37 % 100", "run": "c_custkey"}),
    "v_run_nodes": ("part", {"run": "p_partkey % 90 + 1", "key": "'k' || CAST(p_partkey AS STRING)", "id": "p_partkey * 31 + 5", "kind": "CASE WHEN p_partkey % 4 = 0 THEN 'valve' ELSE 'pump' END", "tag": "'T-' || CAST(p_size AS STRING)"}),
    "v_run_edges": ("part", {"run": "p_partkey % 90 + 1", "src": "'k' || CAST(p_partkey AS STRING)", "dst": "'k' || CAST((p_partkey + 90 * (p_size % 9)) AS STRING)", "style": "CASE WHEN p_size % 2 = 0 THEN 'dashed' ELSE 'solid' END"}),
    "v_run_findings": ("supplier", {"run": "s_suppkey % 120 + 1", "check": "'c' || CAST(s_suppkey AS STRING)", "severity": "CASE s_suppkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'critical' ELSE 'medium' END", "status": "'finding'"}),
    "v_reads": ("part", {"id": "p_partkey", "text": """CASE p_partkey % 9 WHEN 0 THEN ' pi-' || CAST(100 + p_partkey % 900 AS STRING) || ' ' WHEN 1 THEN 'M V-' || CAST(10 + p_partkey % 80 AS STRING) || ' -07' WHEN 2 THEN 'smudge…' WHEN 3 THEN '-'
        WHEN 4 THEN 'to  tank   ' || CAST(p_size AS STRING) WHEN 5 THEN '2”-NG-' || CAST(p_partkey AS STRING) WHEN 6 THEN '0 31' || CAST(p_partkey % 9 AS STRING) || 'C' WHEN 7 THEN NULL ELSE 'LSHH-' || CAST(100 + p_partkey % 9 AS STRING) END"""}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def sql(name: str) -> str:
    """The view as a subquery."""
    table, columns = VIEWS[name]
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"
