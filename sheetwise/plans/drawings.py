"""Queries of regions, display, stores, reads, rules and assembly, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import reading, tags
from sheetwise.functions.geom import Box
from sheetwise.operators import ask, assemble, attach, classify, display, extract, metrics, probe, regions, rules, snapshot
from sheetwise.plans.catalog import _MEETS, _PARSED, _table, query, tag_parse
from sheetwise.plans.views import sql, view
from sheetwise.sources import sinks

N, L = sql("v_nodes"), sql("v_links")


def _nodes(spark, sf):
    return view(spark, sf, "v_nodes").withColumn("box", display.box_array(Box.of()))


def _links(spark, sf):
    return view(spark, sf, "v_links")


# ---- display


@query(f"SELECT key, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM {N}")
def confidence_bands(spark, sf):
    return _nodes(spark, sf).select("key", display.confidence_band(F.col("confidence")).alias("band"))


@query(f"""SELECT key, CASE WHEN tag IS NOT NULL AND tag <> '' THEN tag WHEN label IS NOT NULL AND NOT starts_with(label, 'region@') AND length(label) >= 2 AND regexp_matches(label, '[A-Za-z]') THEN label END AS shown FROM {N}""")
def overlay_labels(spark, sf):
    return _nodes(spark, sf).select("key", display.overlay_label(F.col("tag"), F.col("label")).alias("shown"))


@query(f"SELECT key, coalesce(kind, 'unknown') AS kind, nullif(tag, '') AS tag, nullif(label, '') AS label, coalesce(page, 0) AS page, coalesce(confidence, 0.0) AS confidence FROM {N}")
def snapshot_defaults(spark, sf):
    return display.with_defaults(_nodes(spark, sf))


@query(f"WITH n AS (SELECT key FROM {N} WHERE page = 3) SELECT src, dst, via FROM {L} WHERE src IN (SELECT key FROM n) AND dst IN (SELECT key FROM n)")
def visible_edges(spark, sf):
    return display.visible(_nodes(spark, sf), _links(spark, sf), 3)[1].select("src", "dst", "via")


@query(f"SELECT via, (a.x0 + a.x1) / 2 AS ax, (a.y0 + a.y1) / 2 AS ay, (b.x0 + b.x1) / 2 AS bx, (b.y0 + b.y1) / 2 AS by_ FROM {L} e JOIN {N} a ON a.key = e.src JOIN {N} b ON b.key = e.dst")
def edge_centres(spark, sf):
    return display.edge_ends(_nodes(spark, sf), _links(spark, sf)).select("via", "ax", "ay", "bx", F.col("by").alias("by_"))


@query(f"SELECT key, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, key)::BIGINT AS draw FROM {N}")
def draw_order(spark, sf):
    return display.draw_order(_nodes(spark, sf)).select("key", F.col("draw").cast("long"))


@query(f"SELECT kind, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM {N} GROUP BY kind")
def page_numbers(spark, sf):
    return display.pages_of(_nodes(spark, sf), ["kind"]).select("kind", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(f"WITH p AS (SELECT DISTINCT page FROM {N}), s AS (SELECT page, 500.0::DOUBLE + page AS width, 300.0::DOUBLE AS height FROM p WHERE page % 3 = 0) SELECT p.page, coalesce(width, 1224.0) AS width, coalesce(height, 792.0) AS height FROM p LEFT JOIN s ON s.page = p.page")
def sheet_defaults(spark, sf):
    p = _nodes(spark, sf).select("page").distinct()
    s = p.filter("page % 3 = 0").select("page", (F.lit(500.0) + F.col("page")).alias("width"), F.lit(300.0).alias("height"))
    return display.with_sheets(p, s)


def _index(spark, sf):
    return display.drawing_index(_nodes(spark, sf), _links(spark, sf), view(spark, sf, "v_req").filter("tag is not null").select("tag"))


@query(f"SELECT page, count(*)::BIGINT AS nodes, count_if(tag IS NOT NULL AND tag <> '')::BIGINT AS tagged, count_if(key NOT IN (SELECT src FROM {L} UNION SELECT dst FROM {L}))::BIGINT AS isolated FROM {N} GROUP BY page")
def index_totals(spark, sf):
    return _index(spark, sf)[0]


@query(f"""WITH o AS (SELECT tag, min(page) AS page, 'drawing' AS origin FROM {N} WHERE tag IS NOT NULL AND tag <> '' GROUP BY tag)
SELECT * FROM o UNION ALL SELECT DISTINCT tag, NULL, 'procedure' FROM {sql("v_req")} WHERE tag IS NOT NULL AND tag NOT IN (SELECT tag FROM o)""")
def index_tags(spark, sf):
    return _index(spark, sf)[1]


@query("SELECT page, greatest(100, ceil(max(x1) * 1.04))::BIGINT AS width, greatest(100, ceil(max(y1) * 1.04))::BIGINT AS height FROM " + sql("v_boxes") + " GROUP BY page")
def page_extents(spark, sf):
    return display.page_extents(view(spark, sf, "v_boxes"))


@query(f"""SELECT key, seq FROM {N} WHERE contains(upper(coalesce(CASE WHEN tag <> '' THEN tag END, label, '') || ' ' || coalesce(kind, '') || ' ' || key), 'V-11') ORDER BY seq LIMIT 12""")
def search_nodes(spark, sf):
    return ask.find_tag(_nodes(spark, sf), " v-11", 12).select("key", "seq")


@query(r"""WITH f AS (SELECT c_custkey, list_distinct(regexp_extract_all(c_name || ' or V-' || c_custkey::VARCHAR || ' and MOV-12-' || c_nationkey::VARCHAR || 'b', '([A-Za-z]{1,8}-\d+[A-Za-z0-9]*(?:-\d+[A-Za-z0-9]*)*)', 1)) AS c FROM customer)
SELECT c_custkey, array_to_string(list_transform(list_sort(list_transform(c, lambda t: {'n': -length(t), 't': t})), lambda s: s.t), ',') AS candidates FROM f""")
def question_tags(spark, sf):
    c = _table(spark, sf, "customer").withColumn("question", F.concat("c_name", F.lit(" or V-"), F.col("c_custkey").cast("string"), F.lit(" and MOV-12-"), F.col("c_nationkey").cast("string"), F.lit("b")))
    return ask.tag_candidates(c).select("c_custkey", F.array_join("candidates", ",").alias("candidates"))


@query(f"""WITH e AS (SELECT src AS key, line_number FROM {L} UNION ALL SELECT dst, line_number FROM {L}), l AS (SELECT key, array_to_string(list_sort(list(DISTINCT line_number)), ';') AS l FROM e WHERE line_number IS NOT NULL AND line_number <> '' GROUP BY key)
SELECT n.key, coalesce(l, '') AS line_numbers FROM {N} n LEFT JOIN l ON l.key = n.key""")
def lines_at_nodes(spark, sf):
    return ask.describe(_nodes(spark, sf), _links(spark, sf)).select("key", F.array_join("line_numbers", ";").alias("line_numbers"))


# ---- stores

RN, RE, RF, D = sql("v_run_nodes"), sql("v_run_edges"), sql("v_run_findings"), sql("v_docs")


def _run(spark, sf):
    return view(spark, sf, "v_run_nodes"), view(spark, sf, "v_run_edges"), view(spark, sf, "v_run_findings")


@query(f"SELECT e.run, e.src, e.dst, a.kind AS src_kind, a.tag AS src_tag, b.kind AS dst_kind, b.tag AS dst_tag FROM {RE} e JOIN {RN} a ON a.run = e.run AND a.key = e.src JOIN {RN} b ON b.run = e.run AND b.key = e.dst")
def stored_edges(spark, sf):
    n, e, _ = _run(spark, sf)
    return snapshot.named_edges(e, n).select("run", "src", "dst", "src_kind", "src_tag", "dst_kind", "dst_tag")


@query(f"SELECT e.run, a.id AS source_id, b.id AS target_id, style FROM {RE} e JOIN {RN} a ON a.run = e.run AND a.key = e.src JOIN {RN} b ON b.run = e.run AND b.key = e.dst")
def surrogate_edges(spark, sf):
    n, e, _ = _run(spark, sf)
    return snapshot.with_ids(e, n).select("run", "source_id", "target_id", "style")


@query(f"SELECT run, key FROM {RN} n WHERE EXISTS (SELECT 1 FROM {D} d WHERE d.run = n.run AND d.owner = 'u2')")
def owned_nodes(spark, sf):
    return snapshot.owned(_run(spark, sf)[0], view(spark, sf, "v_docs"), "u2").select("run", "key")


@query(f"SELECT site, arg_max(run, created * 1000000 + doc) AS run FROM {D} GROUP BY site")
def newest_run(spark, sf):
    return snapshot.current_run(view(spark, sf, "v_docs"), ["site"])


@query(f"""WITH n AS (SELECT run, to_json(list({{'id': id, 'key': key, 'kind': kind, 'tag': tag}} ORDER BY key)) AS j FROM {RN} GROUP BY run), e AS (SELECT run, to_json(list({{'dst': dst, 'src': src, 'style': style}} ORDER BY src, dst)) AS j FROM {RE} GROUP BY run),
f AS (SELECT run, to_json(list({{'check': "check", 'severity': severity, 'status': status}} ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), "check")) AS j FROM {RF} GROUP BY run), r AS (SELECT run FROM n UNION SELECT run FROM e UNION SELECT run FROM f)
SELECT r.run, '{{"nodes":' || coalesce(n.j::VARCHAR, '[]') || ',"edges":' || coalesce(e.j::VARCHAR, '[]') || ',"findings":' || coalesce(f.j::VARCHAR, '[]') || '}}' AS value FROM r LEFT JOIN n ON n.run = r.run LEFT JOIN e ON e.run = r.run LEFT JOIN f ON f.run = r.run""")
def run_snapshots(spark, sf):
    return snapshot.snapshot(*_run(spark, sf))


_WALK = f"""WITH RECURSIVE c AS (SELECT DISTINCT src, dst FROM {sql("v_chain")} WHERE src <> dst), w(node, depth) AS (SELECT min(src), 0 FROM c UNION SELECT c.dst, w.depth + 1 FROM w JOIN c ON c.src = w.node WHERE w.depth < 25),
t AS (SELECT node, min(depth)::INT AS depth FROM w GROUP BY node), k AS (SELECT o_orderkey AS key, o_orderpriority AS kind, o_orderstatus AS tag FROM orders)"""


def _traced(spark, sf):
    e = view(spark, sf, "v_chain").filter("src <> dst")
    stored = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("tag"))
    return snapshot.trace_nodes(e, stored, e.agg(F.min("src").alias("node")))


@query(_WALK + " SELECT depth, key, kind, tag FROM t JOIN k ON k.key = t.node")
def trace_nodes(spark, sf):
    return _traced(spark, sf)


@query(_WALK + " SELECT coalesce(to_json(list({'depth': depth, 'key': key, 'kind': kind, 'tag': tag} ORDER BY depth, key))::VARCHAR, '[]') AS value FROM t JOIN k ON k.key = t.node")
def trace_document(spark, sf):
    return snapshot.trace_document(_traced(spark, sf))


@query(f"SELECT k AS key, sheet, seq FROM (SELECT 'm' || (seq // 3)::VARCHAR AS k, *, row_number() OVER (PARTITION BY seq // 3 ORDER BY sheet DESC) AS rn FROM {N}) WHERE rn = 1")
def composed_graph(spark, sf):
    n = _nodes(spark, sf).withColumn("key", F.concat(F.lit("m"), F.floor(F.col("seq") / 3).cast("string")))
    return snapshot.composed(n).select("key", "sheet", "seq")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, 'old' AS s FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS k, o_orderkey AS v, 'new' AS s FROM orders WHERE o_orderkey % 7 = 1)
SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, min(v), 'new' FROM n GROUP BY k""")
def upserted_rows(spark, sf):
    o = _table(spark, sf, "orders")
    rows = lambda where, name: o.filter(where).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.lit(name).alias("s"))
    return sinks.upsert(rows("o_orderkey % 2 = 0", "old"), rows("o_orderkey % 7 = 1", "new"), ["k"])


@query("""
SELECT p_partkey, 'brand' AS name, p_brand AS value FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_type IS NOT NULL
UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size IS NOT NULL
""")
def attribute_rows(spark, sf):
    p = _table(spark, sf, "part")
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"))
    return sinks.attribute_rows(p.withColumn("extras", m), "p_partkey", "extras", ("name",))


@query(f"""WITH c AS (SELECT box, page, round_even((x0 + x1) / 2 / 0.5, 0)::BIGINT::VARCHAR AS x, round_even((y0 + y1) / 2 / 0.5, 0)::BIGINT::VARCHAR AS y FROM {sql("v_boxes")})
SELECT box, 'com_' || page::VARCHAR || '_' || substr(sha1(page::VARCHAR || '|' || x || '|' || y || '|component'), 1, 12) AS stable_key FROM c""")
def stable_key(spark, sf):
    cx, cy = Box.of().centre
    return view(spark, sf, "v_boxes").select("box", assemble.stable_key(F.col("page"), cx, cy, F.lit("component"), 2.0).alias("stable_key"))


# ---- regions and marks

A, M = sql("v_annots"), sql("v_marks")
_HINT = "((contains(lower(coalesce(title, '')), 'text') OR contains(lower(coalesce(title, '')), 'shx')) AND trim(coalesce(content, '')) = '' AND x1 > x0 AND y1 > y0)"
_COVERED = f"SELECT DISTINCT m.page, path FROM {M} m JOIN (SELECT * FROM {A} WHERE {_HINT}) r ON r.page = m.page AND (m.x0 + m.x1) / 2 BETWEEN r.x0 AND r.x1 AND (m.y0 + m.y1) / 2 BETWEEN r.y0 AND r.y1"
_PLAN = f"""SELECT coalesce(c.page, h.page) AS page, coalesce(hints, 0) AS hints, coalesce(coverage, 1.0) AS coverage, CASE WHEN coalesce(hints, 0) >= 10 AND coalesce(coverage, 1.0) >= 0.6 THEN 'hints' WHEN coalesce(hints, 0) >= 10 THEN 'hints_and_clusters' ELSE 'clusters' END AS plan
FROM (SELECT m.page, count(k.path)::DOUBLE / count(*) AS coverage FROM {M} m LEFT JOIN ({_COVERED}) k ON k.page = m.page AND k.path = m.path GROUP BY m.page) c FULL JOIN (SELECT page, count(*)::BIGINT AS hints FROM {A} WHERE {_HINT} GROUP BY page) h ON h.page = c.page"""


def _hints(spark, sf):
    return regions.structural_regions(view(spark, sf, "v_annots"))


@query(f"SELECT page, annot AS region, x0, y0, x1, y1 FROM {A} WHERE {_HINT}")
def structural_regions(spark, sf):
    return _hints(spark, sf)


@query(f"SELECT page, count_if({_HINT})::BIGINT AS hints FROM {A} GROUP BY page")
def hint_counts(spark, sf):
    return regions.hint_counts(view(spark, sf, "v_annots"))


@query(f"SELECT page, hints, round(coverage, 6) AS coverage, plan FROM ({_PLAN})")
def region_plan(spark, sf):
    return regions.region_plan(view(spark, sf, "v_marks"), _hints(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT m.page, m.path FROM {M} m JOIN ({_PLAN}) p ON p.page = m.page LEFT JOIN ({_COVERED}) k ON k.page = m.page AND k.path = m.path WHERE plan = 'clusters' OR (plan = 'hints_and_clusters' AND k.path IS NULL)")
def loose_marks(spark, sf):
    return regions.marks_to_cluster(view(spark, sf, "v_marks"), _hints(spark, sf)).select("page", "path")


@query(f"SELECT page, x0, y0, x1, y1, 'structural' AS source FROM {A} WHERE {_HINT} UNION ALL SELECT page, x0, y0, x1, y1, 'clustered' FROM {sql('v_boxes')}")
def regions_of_both_kinds(spark, sf):
    return regions.all_regions(_hints(spark, sf), view(spark, sf, "v_boxes"))


@query(f"SELECT page, path FROM {M} WHERE path % 3 = 0 EXCEPT SELECT page, path FROM {M} WHERE path % 5 = 0")
def demoted_marks(spark, sf):
    m = view(spark, sf, "v_marks").select("page", "path")
    return regions.demoted(m.filter("path % 3 = 0"), m.filter("path % 5 = 0"))


@query(f"""WITH s AS (SELECT page, h, row_number() OVER (PARTITION BY page ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM {sql("v_paths")} WHERE h IS NOT NULL)
SELECT page, count(*)::BIGINT AS n, min(h) AS least, max(CASE WHEN i = least(floor(0.5 * n), n - 1) THEN h END) AS median, max(CASE WHEN i = least(floor(0.9 * n), n - 1) THEN h END) AS p90, max(h) AS most, round(avg(h), 6) AS mean FROM s GROUP BY page""")
def height_stats(spark, sf):
    return regions.height_stats(view(spark, sf, "v_paths"), ["page"], "h").withColumn("mean", F.round("mean", 6))


@query(f"SELECT page, count(*)::BIGINT AS lines, count_if(seg % 3 = 0)::BIGINT AS dashed, count_if(seg % 4 = 0)::BIGINT AS bridged, max((ex - ax) + (ey - ay)) AS longest, sum((ex - ax) + (ey - ay)) AS length FROM {sql('v_segments')} GROUP BY page")
def line_stats(spark, sf):
    s = view(spark, sf, "v_segments")
    s = s.select("page", F.when(F.col("seg") % 3 == 0, "dashed").otherwise("solid").alias("style"), (F.col("seg") % 4 == 0).alias("bridged"), ((F.col("ex") - F.col("ax")) + (F.col("ey") - F.col("ay"))).alias("len"))
    return regions.line_stats(s, ["page"])


@query("SELECT p_partkey % 50 AS page, count_if(p_size > 20)::VARCHAR || ' of ' || count(*)::VARCHAR || ' nodes have no connection' AS warning FROM part GROUP BY 1 HAVING count_if(p_size > 20) / count(*)::DOUBLE > 0.5")
def isolation_warnings(spark, sf):
    t = _table(spark, sf, "part").groupBy((F.col("p_partkey") % 50).alias("page")).agg(F.count("*").alias("nodes"), F.count_if(F.col("p_size") > 20).alias("isolated"))
    return regions.isolation_warnings(t)


@query("""WITH s AS (SELECT CASE WHEN p_size % 10 > 0 THEN p_retailprice END AS m, p_retailprice * (1 + p_size / 100.0) AS t, p_size % 4 = 0 AS ok FROM part)
SELECT count(*)::BIGINT AS samples, count(m)::BIGINT AS recovered, count_if(ok)::BIGINT AS sheets_right, round(median(abs(m - t) / t), 6) AS median_error, round(max(abs(m - t) / t), 6) AS worst_error FROM s""")
def calibration_scores(spark, sf):
    p = _table(spark, sf, "part").select(F.when(F.col("p_size") % 10 > 0, F.col("p_retailprice")).alias("module"), (F.col("p_retailprice") * (1 + F.col("p_size") / 100.0)).alias("truth"), (F.col("p_size") % 4).cast("string").alias("sheet"), F.lit("0").alias("true_sheet"))
    return regions.calibration_scores(p).withColumns({c: F.round(c, 6) for c in ("median_error", "worst_error")})


@query("SELECT p_partkey, list_contains([0.13, 0.18, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0], round(p_size / 25.0, 2)) OR round(p_size / 25.0, 2) IN (0.36, 0.71, 0.72) AND false AS plotted FROM part WHERE p_size % 5 <> 1")
def plotted_widths(spark, sf):
    # Hundredths of a millimetre are further than the tolerance from their neighbours, so only equal ones count.
    return _table(spark, sf, "part").filter("p_size % 5 <> 1").select("p_partkey", regions.is_plotted(F.round(F.col("p_size") / 25.0, 2)).alias("plotted"))


@query(f"SELECT annot, x1 - x0 >= 8 AND y1 - y0 >= 8 AS legible FROM {A}")
def legible_crops(spark, sf):
    return view(spark, sf, "v_annots").select("annot", regions.legible(Box.of()).alias("legible"))


_CLUSTERS = f"SELECT page, path % 97 AS cluster, min(x0) AS x0, min(y0) AS y0, min(x0) + 250 + page AS x1, min(y0) + 200 AS y1, count(*)::BIGINT AS marks FROM {M} GROUP BY 1, 2"


def _clusters(spark, sf):
    g = view(spark, sf, "v_marks").groupBy("page", (F.col("path") % 97).alias("cluster")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.count("*").alias("marks"))
    return g.select("page", "cluster", "x0", "y0", (F.col("x0") + 250 + F.col("page")).alias("x1"), (F.col("y0") + 200).alias("y1"), "marks")


@query(f"SELECT page, cluster, row_number() OVER (PARTITION BY page ORDER BY marks DESC, cluster)::BIGINT AS place FROM ({_CLUSTERS})")
def largest_clusters(spark, sf):
    return regions.largest_clusters(_clusters(spark, sf)).select("page", "cluster", F.col("place").cast("long"))


_EXCLUDED = f"SELECT page, cluster, x0, y0, x1, y1 FROM ({_CLUSTERS}) WHERE marks >= 9 AND (x1 - x0) * (y1 - y0) < 0.08 * 1000.0 * 800.0"


def _excluded(spark, sf):
    pages = view(spark, sf, "v_marks").select("page").distinct().select("page", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    return extract.excluded_clusters(_clusters(spark, sf), pages, least=9)


@query(_EXCLUDED)
def excluded_clusters(spark, sf):
    return _excluded(spark, sf).drop("marks")


@query(f"""SELECT m.page, path, (m.x0 + m.x1) / 2 BETWEEN 50 AND 950 AND (m.y0 + m.y1) / 2 BETWEEN 40 AND 760
  AND NOT EXISTS (SELECT 1 FROM ({_EXCLUDED}) e WHERE e.page = m.page AND (m.x0 + m.x1) / 2 BETWEEN e.x0 AND e.x1 AND (m.y0 + m.y1) / 2 BETWEEN e.y0 AND e.y1) AS is_content FROM {M} m""")
def content_parts(spark, sf):
    m = view(spark, sf, "v_marks")
    content = m.select("page").distinct().select("page", *(F.lit(v).alias(c) for c, v in zip(Box._fields, (50.0, 40.0, 950.0, 760.0))))
    return extract.content_parts(m, content, _excluded(spark, sf)).select("page", "path", "is_content")


_CHAINS = "SELECT o_orderkey AS page, 0.0::DOUBLE AS lo, (o_custkey % 60)::DOUBLE AS hi, 2.0::DOUBLE AS u, (o_custkey % 60) * (o_orderkey % 10) / 10.0::DOUBLE AS ink, CASE o_orderkey % 3 WHEN 0 THEN [1000000 + o_orderkey] WHEN 1 THEN [o_orderkey, 1000001] ELSE [o_orderkey, o_orderkey + 1] END AS members FROM orders WHERE o_custkey % 60 > 0"
_ACCEPTED = f"SELECT *, list_filter(members, lambda m: m < 1000000) AS real, CASE WHEN len(list_filter(members, lambda m: m < 1000000)) = 0 THEN CASE WHEN hi - lo >= 15 * u AND ink / (hi - lo) >= 0.35 THEN 'kept' ELSE 'dropped' END WHEN hi - lo < 8 * u THEN 'dissolved' ELSE 'kept' END AS verdict FROM ({_CHAINS})"


def _chains(spark, sf):
    o = _table(spark, sf, "orders").filter("o_custkey % 60 > 0")
    key = F.col("o_orderkey")
    members = F.when(key % 3 == 0, F.array(key + 1_000_000)).when(key % 3 == 1, F.array(key, F.lit(1_000_001).cast("long"))).otherwise(F.array(key, key + 1))
    hi = (F.col("o_custkey") % 60).cast("double")
    return extract.accepted_chains(o.select(key.alias("page"), F.lit(0.0).alias("lo"), hi.alias("hi"), F.lit(2.0).alias("u"), (hi * (key % 10) / 10.0).alias("ink"), members.alias("members")))


@query(f"SELECT page, verdict FROM ({_ACCEPTED})")
def accepted_chains(spark, sf):
    return _chains(spark, sf).select("page", "verdict")


@query(f"SELECT page, unnest(real) AS line FROM ({_ACCEPTED}) WHERE verdict = 'dissolved'")
def dissolved_lines(spark, sf):
    return extract.dissolved_lines(_chains(spark, sf))


@query()
def junctions(spark, sf):
    s = view(spark, sf, "v_boxes")
    ends = s.select("page", F.col("box").alias("point"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("box") % 97).alias("line"))
    return regions.junctions(ends, 40.0).select("page", "seed", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("SELECT p_type AS signature, count(*)::BIGINT AS members, min(p_partkey % 16 * 100000 + p_partkey) AS first_symbol FROM part GROUP BY p_type")
def shape_clusters(spark, sf):
    s = _table(spark, sf, "part").select((F.col("p_partkey") % 16).alias("page"), F.col("p_partkey").alias("symbol"), F.col("p_type").alias("signature"))
    return regions.shape_clusters(s).select("signature", "members", (F.col("first.page") * 100000 + F.col("first.symbol")).alias("first_symbol"))


# ---- primitives and assembly


@query(f"""SELECT page, seg, least(ax, ex) AS x0, least(ay, ey) AS y0, greatest(ax, ex) + 5 AS x1, greatest(ay, ey) + 3 AS y1, 5::BIGINT AS n_segments, greatest((ex - ax) + (ey - ay), 5.0) AS longest, (seg % 3)::BIGINT AS n_curves FROM {sql("v_segments")}""")
def path_primitives(spark, sf):
    # A line, a rectangle of 5 by 3 at its end, and up to two curves inside the rectangle.
    at = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    item = lambda op, *p: f"named_struct('op', '{op}', 'pts', array({', '.join(p)}))"
    curve = item("c", at("ex", "ey"), at("ex + 1", "ey + 1"), at("ex + 2", "ey + 2"), at("ex + 3", "ey"))
    items = f"concat(array({item('l', at('ax', 'ay'), at('ex', 'ey'))}, {item('re', at('ex', 'ey'), at('ex + 5', 'ey + 3'))}), array_repeat({curve}, CAST(seg % 3 AS INT)))"
    p = view(spark, sf, "v_segments").selectExpr("page", "seg", "seg AS path", f"{items} AS items", "CAST(NULL AS array<double>) AS colour", "false AS filled", "2.0D AS u")
    return extract.primitives(p).select("page", "seg", "x0", "y0", "x1", "y1", F.size("segments").cast("long").alias("n_segments"), "longest", F.col("curves").cast("long").alias("n_curves"))


def _lines(spark, sf):
    s = view(spark, sf, "v_segments")
    return s.select("page", F.col("seg").alias("line"), "ax", "ay", F.col("ex").alias("bx"), F.col("ey").alias("by"), F.when(F.col("seg") % 3 == 0, "dashed").otherwise("solid").alias("style"), (F.col("seg") % 4 == 0).alias("bridged"))


def _symbols(spark, sf):
    b = view(spark, sf, "v_boxes")
    return b.select("page", F.col("box").alias("symbol"), *Box._fields, F.when(F.col("box") % 9 == 0, "instrument").otherwise("unknown").alias("symbol_class"), (F.col("box") % 17).cast("double").alias("diameter"), F.lit(0.5).alias("confidence"))


@query(f"SELECT page, seg AS line, box AS symbol, round(t, 4) AS t FROM ({_MEETS})")
def conductor_touches(spark, sf):
    return assemble.touches(_lines(spark, sf), _symbols(spark, sf), 1.5).withColumn("t", F.round("t", 4))


@query(f"SELECT page, box AS symbol FROM {sql('v_boxes')} WHERE box % 9 = 0 OR box % 17 >= 12 OR box IN (SELECT box FROM ({_MEETS}))")
def promoted_symbols(spark, sf):
    s = _symbols(spark, sf)
    return assemble.promoted(s, assemble.touches(_lines(spark, sf), s, 1.5)).select("page", "symbol")


@query(f"""WITH m AS ({_MEETS}), w AS (SELECT page, seg, box AS source, lead(box) OVER (PARTITION BY page, seg ORDER BY t, box) AS target FROM m)
SELECT DISTINCT page, source, target, CASE WHEN seg % 3 = 0 THEN 'dashed' ELSE 'solid' END AS style, CASE WHEN seg % 4 = 0 THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence, seg AS line FROM w WHERE target IS NOT NULL AND target <> source""")
def conductor_edges(spark, sf):
    e = assemble.bound_edges(_lines(spark, sf), _symbols(spark, sf), 1.5)
    return e.select("page", "source", "target", "style", "confidence", F.get("line_ids", F.lit(0)).alias("line"))


@query(f"""SELECT page, coalesce(kind, 'none') AS kind, count(*)::BIGINT AS nodes, count(label)::BIGINT AS labelled, count_if(key NOT IN (SELECT src FROM {L} UNION SELECT dst FROM {L}))::BIGINT AS isolated FROM {N} GROUP BY 1, 2""")
def graph_summary(spark, sf):
    n = _nodes(spark, sf).withColumn("symbol", F.col("key")).withColumn("kind", F.coalesce("kind", F.lit("none")))
    here = n.select(F.col("key").alias("k"), F.col("page").alias("p"))
    both = _links(spark, sf).join(here, F.col("src") == F.col("k")).select(F.col("p").alias("page"), F.col("src").alias("source"), F.col("src").alias("target"))
    into = _links(spark, sf).join(here, F.col("dst") == F.col("k")).select(F.col("p").alias("page"), F.col("dst").alias("source"), F.col("dst").alias("target"))
    return assemble.summary(n, both.unionByName(into))


@query(f"""WITH r AS (SELECT page, box AS region, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py, box % 2 = 0 AS flat FROM {sql("v_boxes")}), l AS (SELECT page, seg, ax, ay, ex, ey, (ex - ax) + (ey - ay) AS len, ex > ax OR (ex = ax AND ey = ay) AS flat FROM {sql("v_segments")}),
d AS (SELECT r.page, region, seg, len, sqrt(pow(greatest(ax - px, px - ex, 0), 2) + pow(greatest(ay - py, py - ey, 0), 2)) AS distance FROM r JOIN l ON l.page = r.page AND l.flat = r.flat AND px BETWEEN ax - 8 AND ex + 8 AND py BETWEEN ay - 8 AND ey + 8),
w AS (SELECT *, row_number() OVER (PARTITION BY page, region ORDER BY distance, len DESC, seg) AS rn FROM d WHERE distance <= 8) SELECT page, region, seg AS line, round(distance, 4) AS distance FROM w WHERE rn = 1""")
def line_number_hits(spark, sf):
    b = view(spark, sf, "v_boxes")
    r = b.select("page", F.col("box").alias("region"), F.concat(F.lit('2"-KW-'), F.col("box").cast("string")).alias("text"), *Box._fields, F.when(F.col("box") % 2 == 0, "horizontal").otherwise("vertical").alias("orientation"), F.lit(0.9).alias("text_confidence"))
    return attach.line_labels(_lines(spark, sf), r, 8.0).withColumn("distance", F.round("distance", 4))


@query("""WITH e AS (SELECT l_suppkey AS page, l_orderkey AS source, l_partkey AS target, [l_linenumber, l_partkey % 9] AS lines, CASE WHEN l_quantity > 45 THEN 'kept' END AS own FROM lineitem),
l AS (SELECT s_suppkey AS page, 100 + s_nationkey AS region, s_suppkey % 9 AS line, s_name AS number FROM supplier UNION ALL SELECT s_suppkey, 50 + s_nationkey, s_suppkey % 5, 'x' || s_name FROM supplier)
SELECT DISTINCT e.page, source, target, coalesce(own, arg_min(number, region)) AS line_number FROM e LEFT JOIN l ON l.page = e.page AND list_contains(e.lines, l.line) GROUP BY e.page, source, target, lines, own""")
def labelled_edges(spark, sf):
    e = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.array(F.col("l_linenumber").cast("long"), (F.col("l_partkey") % 9).cast("long")).alias("line_ids"), F.when(F.col("l_quantity") > 45, "kept").alias("line_number"))
    s = _table(spark, sf, "supplier")
    one = s.select(F.col("s_suppkey").alias("page"), (100 + F.col("s_nationkey")).alias("region"), (F.col("s_suppkey") % 9).alias("line"), F.col("s_name").alias("number"))
    two = s.select(F.col("s_suppkey").alias("page"), (50 + F.col("s_nationkey")).alias("region"), (F.col("s_suppkey") % 5).alias("line"), F.concat(F.lit("x"), F.col("s_name")).alias("number"))
    return attach.label_edges(e.dropDuplicates(), one.unionByName(two)).select("page", "source", "target", "line_number").distinct()


# ---- reads

R = sql("v_reads")
_STRIPPED = "upper(trim(coalesce(text, '')))"
_CLEAN = f"regexp_replace(translate({_STRIPPED}, '″”', '\"\"'), '\\s+', ' ', 'g')"
_CLOSED = f"CASE WHEN regexp_matches(replace({_STRIPPED}, ' ', ''), '^[A-Z0-9\\-/\".]+$') THEN replace({_STRIPPED}, ' ', '') ELSE {_STRIPPED} END"


@query(f"SELECT id, CASE WHEN {_CLEAN} IN ('', '-', '.') OR NOT regexp_matches({_CLEAN}, '^[A-Z0-9 \\-/\"''.,()&*#°]+$') THEN '' ELSE {_CLEAN} END AS cleaned, {_CLOSED} AS closed FROM {R}")
def clean_reads(spark, sf):
    return view(spark, sf, "v_reads").select("id", reading.clean(F.col("text")).alias("cleaned"), reading.close_gaps(reading._stripped(F.col("text"))).alias("closed"))


_KIND = f"""(SELECT id, raw, t, CASE WHEN regexp_matches(t, '{tags.LINE_NUMBER}') THEN 'line_number' WHEN regexp_matches(t, '{tags.CONNECTOR}') AND NOT regexp_matches(t, '^\\d+$') THEN 'off_page_connector' WHEN regexp_matches(t, '{tags.VALVE}') OR regexp_matches(t, '{tags.INSTRUMENT}') THEN 'tag' ELSE 'unknown' END AS kind
FROM (SELECT id, {_STRIPPED} AS raw, translate({_CLOSED}, '″”', '""') AS t FROM {R}))"""
_HOW = f"SELECT id, CASE WHEN kind <> 'unknown' AND NOT (t <> raw AND replace(raw, ' ', '') = t AND kind = 'off_page_connector') THEN CASE WHEN raw LIKE '% %' AND replace(raw, ' ', '') = t THEN 'spaces_removed' ELSE 'direct' END END AS how FROM {_KIND}"


@query(_HOW)
def repaired_reads(spark, sf):
    return reading.repair(view(spark, sf, "v_reads")).select("id", "how")


@query(f"SELECT count(*)::BIGINT AS input, count(how)::BIGINT AS direct, 0::BIGINT AS repaired, count_if(how IS NULL)::BIGINT AS unrepairable FROM ({_HOW})")
def repair_stats(spark, sf):
    return reading.repair_stats(reading.repair(view(spark, sf, "v_reads")))


@query("SELECT 'hit' AS side, o_orderkey, c_name AS text FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0 UNION ALL SELECT 'miss', o_orderkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def cached_reads(spark, sf):
    crops = _table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    cache = _table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"), F.lit(0.5).alias("confidence"), F.lit("x").alias("backend"))
    hits, misses = reading.split_by_cache(crops, cache)
    return hits.select(F.lit("hit").alias("side"), "o_orderkey", "text").unionByName(misses.select(F.lit("miss").alias("side"), "o_orderkey", F.lit(None).cast("string").alias("text")))


@query("SELECT o_orderpriority, count_if(o_custkey % 3 = 0)::DOUBLE / count(*) AS rate FROM orders GROUP BY o_orderpriority")
def cache_hit_rates(spark, sf):
    g = _table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_custkey") % 3 == 0).alias("h"), F.count("*").alias("n"))
    return g.select("o_orderpriority", regions.cache_hit_rate(F.col("h"), F.col("n")).alias("rate"))


# ---- rules


@query(f"""WITH t AS ({_PARSED})
SELECT 'tag_not_conformant' AS "check", canonical AS subject, count(*)::BIGINT AS n FROM t WHERE conformance = 'nonconformant_normalised' GROUP BY canonical
UNION ALL SELECT 'duplicate_tag', canonical, 1 FROM t WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1
UNION ALL SELECT 'symbol_requires_legend', sum(p_size)::VARCHAR, 1 FROM part HAVING sum(p_size) > 0
UNION ALL SELECT 'safety_devices_identified', array_to_string(list_sort(list(DISTINCT canonical)), ', '), 1 FROM t WHERE is_safety HAVING count(*) > 0
UNION ALL SELECT 'sis_tagging_present', array_to_string(list_sort(list(DISTINCT canonical)), ', '), 1 FROM t WHERE is_sis HAVING count(*) > 0
UNION ALL SELECT 'sop_references_unknown_tag', tag, 1 FROM (SELECT DISTINCT 'PI-' || (100 + c_custkey % 900)::VARCHAR AS tag FROM customer) WHERE tag NOT IN (SELECT canonical FROM t WHERE canonical IS NOT NULL)""")
def rule_findings(spark, sf):
    t = tag_parse(spark, sf)
    paragraphs = _table(spark, sf, "customer").select(F.concat(F.lit("open pi-"), (100 + F.col("c_custkey") % 900).cast("string"), F.lit(" slowly")).alias("text"))
    unresolved = _table(spark, sf, "part").select(F.col("p_size").alias("n"))
    found = rules.conformance_findings(t)
    for f in (rules.duplicate_findings(t), rules.legend_findings(unresolved), rules.safety_findings(t), rules.unknown_tag_findings(paragraphs, t)):
        found = found.unionByName(f)
    return found.groupBy("check", "subject").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT n_nationkey AS doc, [lower(n_name), 'zzz'] AS hints FROM nation), t AS (SELECT c_nationkey AS doc, string_agg(lower('Site ' || CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE '-' END), ' ') AS all_ FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT CASE WHEN contains(all_, hints[1]) THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN contains(all_, hints[1]) THEN hints[1] ELSE '' END AS subject, count(*)::BIGINT AS n FROM h JOIN t ON t.doc = h.doc GROUP BY 1, 2""")
def scope_findings(spark, sf):
    n = _table(spark, sf, "nation")
    hints = n.select(F.col("n_nationkey").alias("doc"), F.array(F.lower("n_name"), F.lit("zzz")).alias("hints"))
    c = _table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    titles = c.select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("Site "), F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name")).otherwise("-")).alias("title"))
    return rules.scope_findings(hints, titles).groupBy("status", "subject").agg(F.count("*").alias("n"))


# ---- page natures and scores


@query("""WITH p AS (SELECT l_suppkey AS page, l_returnflag AS type, l_discount::DOUBLE AS width, l_quantity AS colour, l_linenumber AS n FROM lineitem), w AS (SELECT page, count(DISTINCT width) FILTER (width > 0) AS widths FROM p GROUP BY page)
SELECT p.page, count(*)::BIGINT AS vector_paths, count(DISTINCT colour)::BIGINT AS colours, count(DISTINCT type)::BIGINT AS paint_types, sum(n % 3)::BIGINT AS line_segments, sum(n % 2)::BIGINT AS beziers, bool_or(n = 7) AS dash_arrays, count(*) >= 50 AS has_vectors, any_value(widths) >= 2 AS several_widths FROM p JOIN w ON w.page = p.page GROUP BY p.page""")
def page_natures(spark, sf):
    n = F.col("l_linenumber")
    op = lambda name, k: F.array_repeat(F.struct(F.lit(name).alias("op")), k.cast("int"))
    p = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("type"), F.col("l_discount").cast("double").alias("width"), F.col("l_quantity").cast("string").alias("colour"), F.when(n == 7, "[3 2] 0").otherwise("[] 0").alias("dashes"), F.concat(op("l", n % 3), op("c", n % 2)).alias("items"))
    c = probe.nature(probe.capabilities(p))
    return c.select("page", "vector_paths", "colours", "paint_types", "line_segments", "beziers", "dash_arrays", "has_vectors", "several_widths")


@query("""WITH m AS (SELECT p_partkey AS truth, p_partkey + 7 AS pred FROM part WHERE p_partkey % 4 > 0), t AS (SELECT p_partkey AS truth, 'V-' || (p_partkey % 50)::VARCHAR AS canonical FROM part), p AS (SELECT p_partkey AS pred, 'V-' || ((p_partkey - 7 + p_size % 3) % 50)::VARCHAR AS tag FROM part WHERE p_size % 5 > 0)
SELECT count_if(tag = canonical)::BIGINT AS hits, count(tag)::BIGINT AS n_tagged, count(*)::BIGINT AS n_matched, (SELECT count(*) FROM p WHERE pred NOT IN (SELECT pred FROM m))::BIGINT AS unmatched FROM m JOIN t ON t.truth = m.truth LEFT JOIN p ON p.pred = m.pred""")
def attachment_scores(spark, sf):
    p = _table(spark, sf, "part")
    k, one = F.col("p_partkey"), F.lit(1).alias("page")
    name = lambda c: F.concat(F.lit("V-"), (c % 50).cast("string"))
    mapping = p.filter("p_partkey % 4 > 0").select(one, k.alias("truth"), (k + 7).alias("pred"))
    return metrics.attachment_scores(p.select(one, k.alias("truth"), name(k).alias("canonical")), mapping, p.filter("p_size % 5 > 0").select(one, k.alias("pred"), name(k - 7 + F.col("p_size") % 3).alias("tag")))


@query("""WITH m AS (SELECT p_partkey AS truth, p_partkey * 3 % 1009 AS pred FROM part WHERE p_partkey % 4 > 0), e AS (SELECT l_partkey AS s, l_partkey * 7 % 2000 + 1 AS t FROM lineitem)
SELECT DISTINCT least(a.pred, b.pred) AS lo, greatest(a.pred, b.pred) AS hi FROM e JOIN m a ON a.truth = e.s JOIN m b ON b.truth = e.t""")
def translated_edges(spark, sf):
    k, one = F.col("p_partkey"), F.lit(1).alias("page")
    mapping = _table(spark, sf, "part").filter("p_partkey % 4 > 0").select(one, k.alias("truth"), (k * 3 % 1009).alias("pred"))
    e = _table(spark, sf, "lineitem").select(one, F.col("l_partkey").alias("source"), (F.col("l_partkey") * 7 % 2000 + 1).alias("target"))
    return metrics.translated_edges(e, mapping).select("lo", "hi")


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS lo, l_partkey AS hi, l_linenumber % 2 AS line FROM lineitem), p AS (SELECT DISTINCT l_suppkey AS lo, l_partkey AS hi, l_linenumber % 3 AS line FROM lineitem WHERE l_quantity > 10)
SELECT (SELECT count(*) FROM t JOIN p USING (lo, hi, line))::BIGINT AS hits, (SELECT count(*) FROM t)::BIGINT AS n_truth, (SELECT count(*) FROM p)::BIGINT AS n_predicted""")
def line_claims(spark, sf):
    l = _table(spark, sf, "lineitem")  # noqa: E741
    rows = lambda d, k: d.select(F.col("l_suppkey").alias("lo"), F.col("l_partkey").alias("hi"), (F.col("l_linenumber") % k).alias("line"))
    return metrics.line_claims(rows(l, 2), rows(l.filter("l_quantity > 10"), 3))


# ---- calibration


@query(f"""WITH p AS (SELECT page, path, round_even(w, 2) AS d FROM (SELECT page, path, w / 4 + 5 AS w, h / 4 + 5 AS h, curves FROM {sql("v_paths")}) WHERE curves > 0 AND abs(w - h) <= 0.1 * w AND w > 0.004 * 300 AND w < 0.06 * 300),
c AS (SELECT page, d, count(*) AS n, min(path) AS f FROM p GROUP BY page, d), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, f) AS rn FROM c) SELECT page, d AS diameter, n::BIGINT AS n FROM r WHERE rn = 1 AND n >= 5""")
def symbol_diameters(spark, sf):
    p = view(spark, sf, "v_paths").select("page", "path", (F.col("w") / 4 + 5).alias("w"), (F.col("h") / 4 + 5).alias("h"), "curves", F.lit(300.0).alias("span"))
    return classify.symbol_diameters(p)


@query("""WITH e AS (SELECT p_partkey % 40 AS page, CASE p_size % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'text' ELSE 'stroke' END AS name, p_retailprice / 300.0 AS module, p_retailprice / 40.0 AS observable, p_size % 4 > 0 AND p_partkey % 40 > 5 AS trusted FROM part WHERE p_partkey % 40 > 0 OR p_partkey = 40),
t AS (SELECT page, bool_or(trusted) AS any_, max(CASE WHEN name = 'symbol' THEN observable END) AS symbol FROM e GROUP BY page), k AS (SELECT e.* FROM e JOIN t ON t.page = e.page WHERE trusted OR NOT any_),
m AS (SELECT page, median(module) AS module, count(*) AS n FROM k GROUP BY page), s AS (SELECT m.*, (SELECT max(abs(k.module - m.module) / m.module) FROM k WHERE k.page = m.page) AS spread FROM m),
w AS (SELECT s.*, CASE WHEN n = 1 THEN CASE WHEN any_ THEN 0.45 ELSE 0.25 END ELSE greatest(0.0, 1 - 2 * spread) END * CASE WHEN symbol / module < 5 OR symbol / module > 10 THEN 0.6 ELSE 1.0 END AS worth FROM s JOIN t ON t.page = s.page)
SELECT page, round(module, 6) AS module, n::BIGINT AS estimators, round(spread, 6) AS spread, round(worth, 3)::DOUBLE AS confidence, worth >= 0.35 AS usable FROM w""")
def page_scales(spark, sf):
    p = _table(spark, sf, "part").filter("p_partkey % 40 > 0 OR p_partkey = 40")
    page, size, price = F.col("p_partkey") % 40, F.col("p_size"), F.col("p_retailprice")
    name = F.when(size % 3 == 0, "symbol").when(size % 3 == 1, "text").otherwise("stroke")
    e = p.select(page.alias("page"), name.alias("name"), (price / 300.0).alias("module"), (price / 40.0).alias("observable"), ((size % 4 > 0) & (page > 5)).alias("trusted"))
    return classify.scales(e).withColumn("module", F.round("module", 6)).withColumn("spread", F.round("spread", 6))


@query(f"SELECT key, seq FROM {N} WHERE contains(upper(coalesce(tag, '')), 'INSTRUMENT') OR upper(kind) = 'INSTRUMENT' ORDER BY seq LIMIT 12")
def viewer_search(spark, sf):
    return display.search(_nodes(spark, sf), " instrument ").select("key", "seq")


# ---- lines, clusters and matches

S = sql("v_segments")


def _pipes(spark, sf):
    s = view(spark, sf, "v_segments").filter("(ex - ax) + (ey - ay) >= 3")
    segment = F.struct("ax", "ay", F.col("ex").alias("bx"), F.col("ey").alias("by"))
    return s.select("page", F.col("seg").alias("path"), F.lit(2.5).alias("u"), F.lit("pipe").alias("kind"), F.array(segment).alias("segments"))


@query(f"""WITH k AS (SELECT page, seg, CASE WHEN ex > ax THEN 0 ELSE 60 END::BIGINT AS k1, round_even(CASE WHEN ex > ax THEN ay ELSE -ax END / 1.5, 0)::BIGINT AS k2, CASE WHEN ex > ax THEN ax ELSE ay END AS lo, CASE WHEN ex > ax THEN ex ELSE ey END AS hi FROM {S} WHERE (ex - ax) + (ey - ay) >= 3),
r AS (SELECT *, lo - max(hi) OVER (PARTITION BY page, k1, k2 ORDER BY lo, hi, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM k),
i AS (SELECT *, sum(CASE WHEN step > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, k1, k2 ORDER BY lo, hi, seg ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT page, k1, k2, run::BIGINT AS run, count(*)::BIGINT AS pieces, sum(hi - lo) AS ink FROM i GROUP BY page, k1, k2, run""")
def merged_lines(spark, sf):
    return extract.merge_lines(_pipes(spark, sf)).select("page", "k1", "k2", "run", "pieces", F.round("ink", 4).alias("ink"))


@query(f"""WITH k AS (SELECT page, seg, round_even(ay / 1.5, 0)::BIGINT AS k2, ax AS lo, ex AS hi FROM {S} WHERE ex > ax AND ex - ax <= 15), n AS (SELECT *, count(*) OVER (PARTITION BY page, k2) AS n FROM k),
r AS (SELECT *, lo - lag(hi) OVER (PARTITION BY page, k2 ORDER BY lo, hi, seg) AS step FROM n WHERE n >= 4), i AS (SELECT *, sum(CASE WHEN step > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY page, k2 ORDER BY lo, hi, seg ROWS UNBOUNDED PRECEDING) AS run FROM r),
g AS (SELECT page, k2, run, count(*) AS pieces, sum(hi - lo) AS ink, min(lo) AS lo, max(hi) AS hi, median(CASE WHEN step > 0 AND step <= 10 THEN step END) AS mid, stddev_pop(CASE WHEN step > 0 AND step <= 10 THEN step END) AS spread, count(CASE WHEN step > 0 AND step <= 10 THEN 1 END) AS gaps FROM i GROUP BY page, k2, run)
SELECT page, k2, run::BIGINT AS run, pieces::BIGINT AS pieces, ink, lo, hi FROM g WHERE pieces >= 4 AND gaps > 0 AND mid BETWEEN 0.5 AND 8.75 AND (gaps < 3 OR spread / mid <= 0.85) AND ink / (hi - lo) <= 0.9""")
def dash_chains(spark, sf):
    s = view(spark, sf, "v_segments").filter("ex > ax").select("page", F.col("seg").alias("line"), F.lit(2.5).alias("u"), "ax", "ay", F.col("ex").alias("bx"), F.col("ey").alias("by"))
    return extract.chain_dashes(s).select("page", "k2", "run", "pieces", "ink", "lo", "hi")


@query(f"""WITH RECURSIVE e AS (SELECT page, seg, ax AS x, ay AS y FROM {S} UNION SELECT page, seg, ex, ey FROM {S}), l AS (SELECT DISTINCT a.page, a.seg AS a, b.seg AS b FROM e a JOIN e b ON a.page = b.page AND a.x = b.x AND a.y = b.y AND a.seg <> b.seg),
r AS (SELECT DISTINCT page, seg AS v, seg AS u FROM e UNION SELECT r.page, r.v, l.b FROM r JOIN l ON l.page = r.page AND l.a = r.u) SELECT page, v AS line, min(u) AS conductor FROM r GROUP BY page, v""")
def conductors(spark, sf):
    return assemble.conductor_groups(_lines(spark, sf), 0.8)


_FRAMES = "SELECT o_custkey % 64 AS page, o_orderkey AS path, (o_custkey % 300)::DOUBLE AS x0, (o_orderkey % 200)::DOUBLE AS y0, (o_custkey % 300 + o_orderkey * 7 % 1500)::DOUBLE AS x1, (o_orderkey % 200 + o_custkey * 11 % 900)::DOUBLE AS y1 FROM orders"


@query(f"""WITH f AS ({_FRAMES}), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, path) AS rn FROM f WHERE x1 - x0 > 120 AND x1 - x0 > 500 AND y1 - y0 > 400)
SELECT p.page, coalesce(x0 + 12, 0.0) AS x0, coalesce(y0 + 12, 0.0) AS y0, coalesce(x1 - 12, 1000.0) AS x1, coalesce(y1 - 12, 800.0) AS y1 FROM (SELECT DISTINCT page FROM f) p LEFT JOIN b ON b.page = p.page AND rn = 1""")
def border_boxes(spark, sf):
    o = _table(spark, sf, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    p = o.select((c % 64).alias("page"), k.alias("path"), *(v.cast("double").alias(n) for n, v in zip(Box._fields, (c % 300, k % 200, c % 300 + k * 7 % 1500, k % 200 + c * 11 % 900))), F.lit(2.0).alias("u"))
    pages = p.select("page").distinct().select("page", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    return extract.border(p.withColumn("longest", F.col("x1") - F.col("x0")), pages)


_SPOTS = "SELECT o_custkey % 16 AS page, o_orderkey AS path, (o_orderkey * 37 % 1000)::DOUBLE AS x0, (o_custkey * 91 % 800)::DOUBLE AS y0, (o_orderkey * 37 % 1000 + 4)::DOUBLE AS x1, (o_custkey * 91 % 800 + 6)::DOUBLE AS y1 FROM orders"


def _spots(spark, sf, **more):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    x, y = (k * 37 % 1000).cast("double"), (c * 91 % 800).cast("double")
    return _table(spark, sf, "orders").select((c % 16).alias("page"), k.alias("path"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 6).alias("y1"), *(v.alias(n) for n, v in more.items()))


def _clustered(where: str) -> str:
    return f"""WITH RECURSIVE m AS ({_SPOTS}), l AS (SELECT a.page, a.path AS a, b.path AS b FROM m a JOIN m b ON a.page = b.page AND a.path <> b.path AND {where}),
r AS (SELECT page, path AS v, path AS u FROM m UNION SELECT r.page, r.v, l.b FROM r JOIN l ON l.page = r.page AND l.a = r.u), c AS (SELECT page, v AS path, min(u) AS cluster FROM r GROUP BY page, v)
SELECT m.page, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*)::BIGINT AS marks FROM m JOIN c ON c.page = m.page AND c.path = m.path GROUP BY m.page, cluster"""


@query(_clustered("(a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 36"))
def colour_cluster_boxes(spark, sf):
    return extract.colour_clusters(_spots(spark, sf, black=F.lit(False)), 6.0)


@query(_clustered("abs(a.x0 - b.x0) <= 4 + 1 AND abs(a.y0 - b.y0) <= 6 + 1"))
def composite_symbols(spark, sf):
    none = F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")
    c = extract.composites(_spots(spark, sf, black=F.lit(True), kind=F.lit("symbol"), u=F.lit(2.0), segments=none), 1.0, None)
    return c.select("page", F.col("symbol").alias("cluster"), *Box._fields, F.size("members").cast("long").alias("marks"))


_TRUE = "SELECT p_partkey AS page, 0.0 AS x0, 0.0 AS y0, 10.0 AS x1, 10.0 AS y1, p_size % 11 AS d, p_size FROM part"


def _boxes_of_pages(spark, sf):
    p = _table(spark, sf, "part")
    d = (F.col("p_size") % 11).cast("double")
    row = lambda x: p.select(F.col("p_partkey").alias("page"), F.col("p_partkey").alias("id"), *(v.alias(n) for n, v in zip(Box._fields, (x, F.lit(0.0), x + 10, F.lit(10.0)))))
    return row(F.lit(0.0)), row(d)


@query(f"SELECT page, page AS truth, page AS pred FROM ({_TRUE}) WHERE (10 - d) * 10.0 / (200 - (10 - d) * 10.0) >= 0.3 AND d < 10")
def matched_boxes(spark, sf):
    return metrics.match_boxes(*_boxes_of_pages(spark, sf))


@query(f"SELECT t::DOUBLE AS threshold, count_if((10 - d) * 10.0 / (200 - (10 - d) * 10.0) >= t AND d < 10)::BIGINT AS hits FROM ({_TRUE}), (VALUES (0.1), (0.3), (0.5), (0.7)) v(t) GROUP BY t")
def swept_matches(spark, sf):
    return metrics.threshold_sweep(*_boxes_of_pages(spark, sf))


@query("SELECT count_if(p_size % 11 <= 6 AND p_size % 4 > 0)::BIGINT AS correct, count(*)::BIGINT AS n_reads, count(*)::BIGINT AS n_labels FROM part")
def matched_texts(spark, sf):
    truth, read = _boxes_of_pages(spark, sf)
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("page"), "p_size")
    text = F.concat(F.lit("pi 1"), F.col("page").cast("string"))
    return metrics.text_scores(truth.withColumn("text", text), read.join(p, "page").withColumn("text", F.when(F.col("p_size") % 4 > 0, F.upper(F.replace(text, F.lit(" "), F.lit("")))).otherwise("x")), 6.0)
