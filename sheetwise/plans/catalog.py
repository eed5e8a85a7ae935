"""Named queries over the supplied tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import geom, quantity, tags
from sheetwise.functions.geom import Box
from sheetwise.operators import assemble, classify, graph, metrics, rules, spatial, windows
from sheetwise.plans.views import sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RECALL = 0.9


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _box(prefix: str) -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


# ---- rules

_LIMITS = f"""
WITH q AS {sql("v_req")}, l AS {sql("v_limits")}, k AS (SELECT DISTINCT key FROM l),
u AS (SELECT q.*, CASE WHEN o.key IS NOT NULL THEN o.key ELSE w.key END AS use FROM q
  LEFT JOIN k o ON o.key = CASE WHEN part IS NULL THEN tag ELSE tag || ':' || part END LEFT JOIN k w ON w.key = tag),
b AS (SELECT u.*, l.unit AS lu, u.unit = l.unit AND abs(u.min - l.min) <= 1e-6 AND abs(u.max - l.max) <= 1e-6 AS agree FROM u LEFT JOIN l ON l.key = u.use AND l.field = u.field)
SELECT DISTINCT ordinal, tag AS subject, part, CASE WHEN tag IS NULL OR use IS NULL THEN NULL ELSE field END AS field,
  CASE WHEN tag IS NULL THEN 'sop_subject_unresolved' WHEN use IS NULL THEN 'equipment_not_found_in_drawing' ELSE 'design_limit' END AS "check",
  CASE WHEN tag IS NULL OR use IS NULL OR lu IS NULL THEN 'needs_review' WHEN agree THEN 'verified' ELSE 'finding' END AS status,
  CASE WHEN tag IS NULL THEN 'low' WHEN use IS NULL OR lu IS NULL THEN 'medium' WHEN agree THEN 'info' ELSE 'critical' END AS severity,
  CAST(CASE WHEN tag IS NULL THEN 0.6 WHEN use IS NULL OR lu IS NULL THEN 0.5 WHEN agree THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence,
  tag IS NOT NULL AND (use IS NULL OR lu IS NULL) AS graph_incomplete
FROM b
"""


@query(_LIMITS)
def limit_compare(spark, sf):
    return rules.limit_findings(view(spark, sf, "v_req"), view(spark, sf, "v_limits"), RECALL)


@query(f"SELECT severity, count(*)::BIGINT AS n FROM ({_LIMITS}) WHERE status <> 'verified' GROUP BY severity")
def count_by_severity(spark, sf):
    return rules.count_by_severity(limit_compare(spark, sf))


@query(f"SELECT DISTINCT tag FROM {sql('v_req')} WHERE tag IS NOT NULL EXCEPT SELECT DISTINCT key FROM {sql('v_limits')}")
def absent_tags(spark, sf):
    named = view(spark, sf, "v_req").filter(F.col("tag").isNotNull())
    return rules.absent_tags(named, view(spark, sf, "v_limits").select(F.col("key").alias("tag")))


# ---- tags

_NORM = "regexp_replace(regexp_replace(translate(upper(trim(raw)), '″”’‐‑‒–—', '\"\"\"-----'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')"
_PARSED = f"""
WITH n AS (SELECT id, page, {_NORM} AS t FROM {sql("v_tags")}),
s AS (SELECT *, regexp_matches(t, '{tags.LINE_NUMBER}') AS line, regexp_matches(t, '{tags.CONNECTOR}') AS con, regexp_extract(t, '{tags.CONNECTOR}', 1) AS ref,
  regexp_matches(t, '{tags.EQUIPMENT}') AS eq, regexp_extract(t, '{tags.EQUIPMENT}', 1) AS ec, regexp_matches(t, '{tags.VALVE}') AS va, regexp_matches(t, '{tags.INSTRUMENT}') AS ins FROM n),
f AS (SELECT *, CASE WHEN va THEN regexp_extract(t, '{tags.VALVE}', 1) ELSE regexp_extract(t, '{tags.INSTRUMENT}', 1) END AS fn,
  CASE WHEN va THEN regexp_extract(t, '{tags.VALVE}', 2) ELSE regexp_extract(t, '{tags.INSTRUMENT}', 2) END AS unit,
  CASE WHEN va THEN regexp_extract(t, '{tags.VALVE}', 3) ELSE regexp_extract(t, '{tags.INSTRUMENT}', 3) END AS seq,
  CASE WHEN va THEN regexp_extract(t, '{tags.VALVE}', 4) ELSE regexp_extract(t, '{tags.INSTRUMENT}', 4) END AS sfx FROM s),
g AS (SELECT *, regexp_matches(fn, '^D[FPTLW][A-Z]*$') AS variant, CASE WHEN regexp_matches(fn, '^D[FPTLW][A-Z]*$') THEN substr(fn, 2, 1) || 'D' || substr(fn, 3) ELSE fn END AS lt,
  CASE WHEN seq <> '' THEN unit || '-' || seq ELSE unit END AS num, fn LIKE 'MV%' OR (substr(fn, 1, 1) = 'M' AND fn LIKE '%V') AS valve FROM f),
h AS (SELECT *, lt IN ('FSV', 'PSE', 'PSV', 'TSE', 'TSV') AS saf FROM g),
m AS (SELECT *, CASE WHEN length(lt) > 1 AND strpos('DFJKMQSXYZ', substr(lt, 2, 1)) > 0 AND (length(lt) > 2 OR substr(lt, 2, 1) = 'D') AND (substr(lt, 2, 1) <> 'S' OR saf) THEN substr(lt, 2, 1) END AS mod FROM h),
r AS (SELECT *, CASE WHEN t = '' THEN 'unknown' WHEN line THEN 'line_number'
  WHEN (t LIKE '[%' OR (con AND NOT eq)) AND con AND regexp_matches(ref, '^\\d+$') AND t NOT LIKE '[%' THEN 'unknown'
  WHEN (t LIKE '[%' OR (con AND NOT eq)) AND con THEN 'off_page_connector' WHEN eq AND ec IN ('AC', 'C', 'E', 'F', 'P', 'T', 'V') THEN 'equipment'
  WHEN va OR ins THEN CASE WHEN valve THEN 'valve' ELSE 'instrument' END ELSE 'unknown' END AS kind FROM m)
SELECT id, page, kind, CASE kind WHEN 'unknown' THEN 'unparsed' WHEN 'line_number' THEN 'grammar_valid' WHEN 'off_page_connector' THEN 'grammar_valid' WHEN 'equipment' THEN 'grammar_valid'
    ELSE CASE WHEN variant THEN 'nonconformant_normalised' ELSE 'listed' END END AS conformance,
  CASE kind WHEN 'line_number' THEN t WHEN 'off_page_connector' THEN ref WHEN 'equipment' THEN ec || '-' || regexp_extract(t, '{tags.EQUIPMENT}', 2) || replace(regexp_extract(t, '{tags.EQUIPMENT}', 3), ' ', '')
    WHEN 'unknown' THEN NULL ELSE lt || '-' || num || sfx END AS canonical,
  CASE WHEN kind = 'instrument' THEN substr(lt, 1, 1) || coalesce(mod, '') || '-' || num END AS loop_id,
  CASE WHEN kind IN ('instrument', 'valve') THEN mod END AS modifier, kind IN ('instrument', 'valve') AND saf AS is_safety, kind IN ('instrument', 'valve') AND coalesce(mod = 'Z', false) AS is_sis
FROM r
"""


@query(_PARSED)
def tag_parse(spark, sf):
    t = view(spark, sf, "v_tags").withColumn("p", tags.parse(F.col("raw")))
    return t.select("id", "page", *(f"p.{c}" for c in ("kind", "conformance", "canonical", "loop_id", "modifier", "is_safety", "is_sis")))


@query(f"SELECT canonical, count(*)::BIGINT AS occurrences FROM ({_PARSED}) WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1")
def duplicate_tags(spark, sf):
    return rules.duplicate_tags(tag_parse(spark, sf))


@query(f"SELECT loop_id, count(*)::BIGINT AS members, count(DISTINCT page)::BIGINT AS pages FROM ({_PARSED}) WHERE loop_id IS NOT NULL GROUP BY loop_id")
def tag_loops(spark, sf):
    return tag_parse(spark, sf).filter("loop_id is not null").groupBy("loop_id").agg(F.count("*").alias("members"), F.count_distinct("page").alias("pages"))


@query(f"SELECT conformance, count(*)::BIGINT AS n, count_if(is_safety)::BIGINT AS safety, count_if(is_sis)::BIGINT AS sis FROM ({_PARSED}) GROUP BY conformance")
def conformance_counts(spark, sf):
    return tag_parse(spark, sf).groupBy("conformance").agg(F.count("*").alias("n"), F.count_if("is_safety").alias("safety"), F.count_if("is_sis").alias("sis"))


@query(f"""
WITH n AS (SELECT id, {_NORM} AS t FROM {sql("v_tags")}), b AS (SELECT id, regexp_extract(t, '{tags.LINE_NUMBER}', 1) AS size, string_split(regexp_extract(t, '{tags.LINE_NUMBER}', 2), '-') AS p FROM n WHERE regexp_matches(t, '{tags.LINE_NUMBER}'))
SELECT id, size, p[1] AS service, p[2] AS sequence, p[3] AS spec, p[4] AS extra1, p[5] AS extra2, CASE WHEN len(p) > 5 THEN array_to_string(p[6:], '-') END AS unparsed_fields FROM b
""")
def line_number_fields(spark, sf):
    t = view(spark, sf, "v_tags").withColumn("m", tags.line_fields(F.col("raw"))).filter("m is not null")
    names = ("size", *tags.LINE_FIELDS, "unparsed_fields")
    return t.select("id", *(F.try_element_at("m", F.lit(n)).alias(n) for n in names))


@query()
def subject_tags(spark, sf):
    s = view(spark, sf, "v_subjects")
    return s.select("id", F.array_join(tags.subject_tags(F.col("subject")), ",").alias("tags"), tags.subject_part(F.col("subject")).alias("part"))


@query(r"""
SELECT doc_id, len(list_distinct(list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\pL\pM\p{Nd}\p{Pc}]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{3,}')), lambda w: lower(w))))::BIGINT AS n_hints FROM documents
""")
def facility_hints(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.size(tags.facility_hints(F.coalesce("text", F.lit("")))).cast("long").alias("n_hints"))


# ---- quantities

_PRESSURE = " ".join(f"WHEN list_contains(k, '{u}') THEN '{u}'" for u in quantity.PRESSURE_UNITS)


@query(f"""
WITH q AS (SELECT id, cell, regexp_matches(cell, '{quantity.RANGE}') AS r, regexp_matches(cell, '{quantity.SCALAR}') AS s,
  TRY_CAST(regexp_extract(cell, '{quantity.RANGE}', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(cell, '{quantity.RANGE}', 2) AS DOUBLE) AS b, TRY_CAST(regexp_extract(cell, '{quantity.SCALAR}', 1) AS DOUBLE) AS c FROM {sql("v_cells")})
SELECT id, CASE WHEN r THEN least(a, b) WHEN s THEN c END AS min, CASE WHEN r THEN greatest(a, b) WHEN s THEN c END AS max FROM q
""")
def parse_quantities(spark, sf):
    q = view(spark, sf, "v_cells").withColumn("q", quantity.parse_quantity(F.col("cell"), F.lit("psig")))
    return q.select("id", "q.min", "q.max")


@query(f"""
WITH h AS (SELECT id, replace(lower(header), '°', ' deg ') AS t FROM {sql("v_cells")}), k AS (SELECT *, regexp_extract_all(t, '[a-z]+') AS k FROM h),
u AS (SELECT id, CASE {_PRESSURE} WHEN contains(t, 'temp') AND (list_contains(k, 'c') OR list_contains(k, 'degc')) THEN 'degC' WHEN contains(t, 'temp') THEN 'degF' END AS unit FROM k)
SELECT id, CASE WHEN unit LIKE 'deg%' THEN 'temperature' WHEN unit IS NOT NULL THEN 'pressure' END AS field, unit FROM u
""")
def units_from_headers(spark, sf):
    h = view(spark, sf, "v_cells").withColumn("u", quantity.unit_from_header(F.col("header")))
    return h.select("id", "u.field", "u.unit")


# ---- ordered scans


def _islands_sql(reach: str) -> str:
    return f"""
WITH v AS {sql("v_intervals")}, r AS (SELECT *, {reach} AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN lo - reach > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT page, island::BIGINT AS island, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi, count(*)::BIGINT AS pieces, sum(hi - lo)::BIGINT AS ink FROM i GROUP BY page, island
"""


@query(_islands_sql("max(hi) OVER (PARTITION BY page ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def islands_running_max(spark, sf):
    return windows.run_summary(windows.islands(view(spark, sf, "v_intervals"), ["page"], "lo", "hi", "id", 4), ["page"], "lo", "hi")


@query(_islands_sql("lag(hi) OVER (PARTITION BY page ORDER BY lo, hi, id)"))
def islands_lag(spark, sf):
    return windows.run_summary(windows.islands(view(spark, sf, "v_intervals"), ["page"], "lo", "hi", "id", 4, running=False), ["page"], "lo", "hi")


@query("""
WITH w AS (SELECT user_id, event_type AS item, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_item FROM events)
SELECT user_id, item, next_item FROM w WHERE next_item IS NOT NULL AND next_item <> item
""")
def consecutive_pairs(spark, sf):
    return windows.consecutive_pairs(_table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""
WITH c AS (SELECT page, h, count(*) AS n, min(path) AS f FROM {sql("v_paths")} GROUP BY page, h), s AS (SELECT *, sum(n) OVER (PARTITION BY page) AS samples, row_number() OVER (PARTITION BY page ORDER BY n DESC, f) AS rn FROM c)
SELECT page, h, n::BIGINT AS n, samples::BIGINT AS samples FROM s WHERE rn = 1 AND samples >= 5
""")
def modal_height(spark, sf):
    return windows.modal(view(spark, sf, "v_paths"), ["page"], "h", "path", 5)


@query(f"""
WITH h AS (SELECT page, width, sum(greatest(ink, 1e-6)) AS ink FROM {sql("v_paths")} WHERE width > 0 GROUP BY page, width), s AS (SELECT *, ink / sum(ink) OVER (PARTITION BY page) AS share FROM h)
SELECT page, min(width) AS narrow FROM s WHERE share >= 0.01 GROUP BY page
""")
def narrow_width(spark, sf):
    return windows.narrow_width(view(spark, sf, "v_paths"), ["page"], "width", "ink")


@query(f"""
WITH g AS (SELECT *, lo - lag(hi) OVER (PARTITION BY page ORDER BY lo, hi, id) AS gap FROM {sql("v_intervals")}),
s AS (SELECT page, count(*) AS pieces, median(gap) AS gap, stddev_pop(gap) AS spread, sum(hi - lo) AS ink, max(hi) AS span, count(gap) AS gaps FROM g GROUP BY page)
SELECT page, pieces::BIGINT AS pieces, gap::DOUBLE AS gap, CASE WHEN pieces >= 4 AND gaps > 0 AND span > 0 AND gap BETWEEN 2.0 AND 35.0 AND (gaps < 3 OR spread / greatest(gap, 1e-9) <= 0.85) AND ink / span <= 0.9 THEN 'dashed' ELSE 'solid' END AS style FROM s
""")
def dash_stats(spark, sf):
    from pyspark.sql import Window

    v = view(spark, sf, "v_intervals")
    v = v.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.partitionBy("page").orderBy("lo", "hi", "id"))).withColumn("ink", F.col("hi") - F.col("lo"))
    return windows.dash_stats(v, ["page"], "gap", "ink", "hi", 10.0).select("page", "pieces", F.col("gap").cast("double"), "style")


@query("SELECT p_size, median(p_retailprice)::DOUBLE AS module, count(*)::BIGINT AS n FROM part GROUP BY p_size")
def module_median(spark, sf):
    return classify.module_of(_table(spark, sf, "part"), ["p_size"], "p_retailprice").select("p_size", "module", "n")


# ---- spatial joins

_BOX_PAIRS = f"""
WITH a AS {sql("v_boxes")}, p AS (SELECT x.page, x.box AS a_box, y.box AS b_box, least(x.x1, y.x1) - greatest(x.x0, y.x0) AS w, least(x.y1, y.y1) - greatest(x.y0, y.y0) AS h,
  (x.x1 - x.x0) * (x.y1 - x.y0) + (y.x1 - y.x0) * (y.y1 - y.y0) AS areas FROM a x JOIN a y ON x.page = y.page AND x.box < y.box AND x.x0 <= y.x1 AND y.x0 <= x.x1 AND x.y0 <= y.y1 AND y.y0 <= x.y1)
SELECT page, a_box, b_box, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (areas - w * h) ELSE 0 END, 4) AS iou FROM p
"""


@query(_BOX_PAIRS)
def box_overlap_iou(spark, sf):
    boxes = view(spark, sf, "v_boxes")
    return _overlaps(boxes, boxes)


def _overlaps(lefts, rights):
    a, b = (s.select(F.col("box").alias(f"{p}box"), "page", *(F.col(c).alias(f"{p}{c}") for c in Box._fields)) for s, p in ((lefts, "a_"), (rights, "b_")))
    pairs = spatial.grid_join(a, b, _box("a_"), _box("b_"), ["page"], 16.0, F.col("a_box") < F.col("b_box"))
    return pairs.select("page", "a_box", "b_box", F.round(geom.iou(_box("a_"), _box("b_")), 4).alias("iou"))


def _segment_box(spark, sf):
    s = view(spark, sf, "v_segments")
    ends = [F.col(c) for c in ("ax", "ay", "ex", "ey")]
    hull = Box(F.least("ax", "ex"), F.least("ay", "ey"), F.greatest("ax", "ex"), F.greatest("ay", "ey"))
    box = _box("").grown(1.5)
    b = view(spark, sf, "v_boxes")
    pairs = spatial.grid_join(s, b, hull, box, ["page"], 32.0, geom.segment_meets(*ends, box))
    return pairs.withColumn("t", geom.along(*Box.of().centre, *ends))


_MEETS = f"""
WITH s AS {sql("v_segments")}, b AS {sql("v_boxes")}
SELECT s.page, seg, box, CASE WHEN ax = ex AND ay = ey THEN 0.0 ELSE least(greatest(((x0 + x1) / 2 - ax) * (ex - ax) + ((y0 + y1) / 2 - ay) * (ey - ay), 0.0) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)), 1.0) END AS t
FROM s JOIN b ON s.page = b.page AND ax <= x1 + 1.5 AND x0 - 1.5 <= ex AND ay <= y1 + 1.5 AND y0 - 1.5 <= ey
"""  # segments are parallel to an axis, so their hull is the segment


@query(f"SELECT page, seg, box, round(t, 4) AS t FROM ({_MEETS})")
def segment_meets_box(spark, sf):
    return _segment_box(spark, sf).select("page", "seg", "box", F.round("t", 4).alias("t"))


@query(f"""
WITH m AS ({_MEETS}), w AS (SELECT page, seg, box AS item, lead(box) OVER (PARTITION BY page, seg ORDER BY t, box) AS next_item FROM m)
SELECT page, seg, item, next_item FROM w WHERE next_item IS NOT NULL AND next_item <> item
""")
def port_bindings(spark, sf):
    lines = view(spark, sf, "v_segments").withColumnsRenamed({"seg": "line", "ex": "bx", "ey": "by"})
    found = assemble.neighbours_along(lines, view(spark, sf, "v_boxes").withColumnRenamed("box", "symbol"), 1.5)
    return found.withColumnRenamed("line", "seg")


@query(f"""
WITH s AS {sql("v_segments")}, e AS (SELECT seg, page, ax AS x, ay AS y FROM s UNION ALL SELECT seg, page, ex, ey FROM s)
SELECT DISTINCT a.page, a.seg AS lo, b.seg AS hi FROM e a JOIN e b ON a.page = b.page AND a.seg < b.seg AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9
""")
def endpoint_pairs(spark, sf):
    return spatial.close_keys(view(spark, sf, "v_segments"), ["page"], "seg", [("ax", "ay"), ("ex", "ey")], 3.0)


@query(f"""
WITH c AS (SELECT page, box, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {sql("v_boxes")})
SELECT a.page, a.box, count(*)::BIGINT AS vouchers FROM c a JOIN c b ON a.page = b.page AND a.box <> b.box AND abs(a.x - b.x) <= 90 AND abs(a.y - b.y) <= 60 GROUP BY a.page, a.box HAVING count(*) >= 2
""")
def vouchers(spark, sf):
    return spatial.vouched(view(spark, sf, "v_boxes"), Box.of(), "box", ["page"], 90.0, 60.0)


@query(f"""
WITH c AS (SELECT page, box, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {sql("v_boxes")}), s AS {sql("v_segments")},
p AS (SELECT s.page, seg, box, sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y)) AS gap FROM s JOIN c ON s.page = c.page AND x BETWEEN ax - 60 AND ax + 60 AND y BETWEEN ay - 60 AND ay + 60),
r AS (SELECT *, row_number() OVER (PARTITION BY page, seg ORDER BY gap, box) AS rn FROM p WHERE gap <= 60)
SELECT page, seg, box, round(gap, 4) AS gap FROM r WHERE rn = 1
""")
def nearest_box(spark, sf):
    c = view(spark, sf, "v_boxes").select("page", "box", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    s = view(spark, sf, "v_segments").select("page", "seg", "ax", "ay")
    near = spatial.nearest(s, c, (F.col("ax"), F.col("ay")), (F.col("cx"), F.col("cy")), ["page"], "seg", "box", 60.0)
    return near.withColumn("gap", F.round("gap", 4))


@query()
def greedy_match(spark, sf):
    boxes = graph.written(view(spark, sf, "v_boxes").select("box", "page", "x0", "y0", "x1", "y1"))
    same, lefts, rights = metrics.pair_copies(boxes, "box", 4)
    got = graph.greedy_match(_overlaps(lefts, rights).withColumn("cost", -F.col("iou")), ["page"], "a_box", "b_box", ["cost"])
    return same.select("page", "a_box", "b_box", F.lit(1.0).alias("iou")).unionByName(got.select("page", "a_box", "b_box", F.round(-F.col("cost"), 4).alias("iou")))


# ---- classification


@query(f"""
SELECT page, path, CASE WHEN (greatest(w, h) > 4 AND least(w, h) <= 5) OR (filled AND least(w, h) <= 2 AND greatest(w, h) > 3) THEN 'pipe' WHEN greatest(w, h) > 120 THEN 'frame'
  WHEN sqrt(w * w + h * h) < 10 AND greatest(w, h) < 3 THEN 'glyph' WHEN sqrt(w * w + h * h) <= 60 OR curves > 0 THEN 'symbol' ELSE 'other' END AS kind,
  curves > 0 AND black AND abs(w - h) <= 0.15 * greatest(w, h) AND w / 2 BETWEEN 5 AND 10 AS circle FROM {sql("v_paths")}
""")
def classify_paths(spark, sf):
    p = view(spark, sf, "v_paths")
    w, h = F.col("w"), F.col("h")
    kind = classify.kind_of_path(F.greatest(w, h), F.least(w, h), F.hypot(w, h), F.col("filled"), F.col("curves"), 2.0)
    return p.select("page", "path", kind.alias("kind"), classify.is_instrument_circle(w, h, F.col("curves"), F.col("black"), 2.0).alias("circle"))


_SHEETS = ", ".join(f"({i}, '{n}', '{s}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for i, (n, s, a, b) in enumerate(classify.sheets()))


@query(f"""
WITH p AS (SELECT p_partkey, CAST(600 + p_partkey % 1900 AS DOUBLE) AS w, CAST(780 + p_size * 33 AS DOUBLE) AS h FROM part),
e AS (SELECT p_partkey, i, n, s, greatest(abs(least(w, h) - a) / a, abs(greatest(w, h) - b) / b) AS error FROM p, (VALUES {_SHEETS}) AS t(i, n, s, a, b)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY error, i) AS rn FROM e)
SELECT p_partkey, CASE WHEN error <= 0.02 THEN n ELSE 'custom' END AS sheet, CASE WHEN error <= 0.02 THEN s ELSE 'unknown' END AS unit_system FROM r WHERE rn = 1
""")
def sheet_detect(spark, sf):
    p = _table(spark, sf, "part").withColumn("s", classify.detect_sheet((600 + F.col("p_partkey") % 1900).cast("double"), (780 + F.col("p_size") * 33).cast("double")))
    return p.select("p_partkey", "s.sheet", "s.unit_system")


# ---- graphs


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {sql("v_chain")} WHERE src <> dst), s AS (SELECT src AS node FROM e EXCEPT SELECT dst FROM e),
w(node, depth) AS (SELECT node, 0 FROM s UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 12)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY node
""")
def min_depth(spark, sf):
    e = view(spark, sf, "v_chain").filter("src <> dst")
    starts = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.trace(e, starts, 12)


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {sql("v_chain")} WHERE src <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(node, low) AS (SELECT src, src FROM b UNION SELECT b.dst, w.low FROM w JOIN b ON b.src = w.node)
SELECT node, min(low) AS component FROM w GROUP BY node
""")
def chain_components(spark, sf):
    return graph.components(view(spark, sf, "v_chain").filter("src <> dst"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {sql("v_edges")}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(node, low) USING KEY (node) AS (SELECT src, min(least(src, dst)) FROM b GROUP BY src UNION SELECT b.dst, min(w.low) FROM w JOIN b ON b.src = w.node JOIN recurring.w AS r ON r.node = b.dst WHERE w.low < r.low GROUP BY b.dst)
SELECT node, low AS component FROM w
""")
def components(spark, sf):
    return graph.components(view(spark, sf, "v_edges"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {sql("v_edges")}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 12)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY node
""")
def undirected_walk(spark, sf):
    e = view(spark, sf, "v_edges")
    return graph.walk(e, e.agg(F.min("src").alias("node")), "undirected", 12)


@query(f"SELECT src AS node, dst AS neighbour, 'out' AS direction, via FROM {sql('v_edges')} UNION ALL SELECT dst, src, 'in', via FROM {sql('v_edges')}")
def neighbours_both_sides(spark, sf):
    return graph.neighbours(view(spark, sf, "v_edges"))


@query(f"""
WITH e AS {sql("v_edges")}, n AS (SELECT src AS node, dst AS o, via FROM e UNION ALL SELECT dst, src, via FROM e)
SELECT node, count(*)::BIGINT AS degree, count(DISTINCT o)::BIGINT AS neighbours, array_to_string(list_sort(list(DISTINCT via)), ',') AS lines FROM n GROUP BY node
""")
def describe_nodes(spark, sf):
    n = graph.neighbours(view(spark, sf, "v_edges"))
    return n.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("neighbour").alias("neighbours"), F.array_join(F.array_sort(F.collect_set("via")).cast("array<string>"), ",").alias("lines"))


@query(f"""
WITH e AS {sql("v_edges")}, c AS (SELECT via AS k, src FROM e), x AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM {sql("v_chain")} WHERE src <> dst),
y AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM e WHERE src <> dst)
SELECT lo, hi FROM x INTERSECT SELECT lo, hi FROM y
""")
def unordered_pair_intersect(spark, sf):
    return graph.unordered(view(spark, sf, "v_chain")).intersect(graph.unordered(view(spark, sf, "v_edges")))


@query(f"""
WITH x AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM {sql("v_chain")} WHERE src <> dst), y AS (SELECT DISTINCT least(src, dst) AS lo, greatest(src, dst) AS hi FROM {sql("v_edges")} WHERE src <> dst)
SELECT (SELECT count(*) FROM x JOIN y USING (lo, hi))::BIGINT AS hits, (SELECT count(*) FROM x)::BIGINT AS n_truth, (SELECT count(*) FROM y)::BIGINT AS n_predicted
""")
def edge_scores(spark, sf):
    return metrics.edge_scores(graph.unordered(view(spark, sf, "v_chain")), graph.unordered(view(spark, sf, "v_edges")))


# ---- scores


@query("""
WITH s AS (SELECT lang, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS hits, count(*)::BIGINT AS total FROM labels JOIN documents USING (doc_id) GROUP BY lang),
w AS (SELECT *, hits / total::DOUBLE AS p, 1.96 * 1.96 AS z2 FROM s)
SELECT lang, hits, total, CASE WHEN total >= 5 THEN round(p, 4) END AS rate, round(greatest(0.0, (p + z2 / (2 * total) - 1.96 * sqrt(p * (1 - p) / total + z2 / (4.0 * total * total))) / (1 + z2 / total)), 4) AS low,
  round(least(1.0, (p + z2 / (2 * total) + 1.96 * sqrt(p * (1 - p) / total + z2 / (4.0 * total * total))) / (1 + z2 / total)), 4) AS high FROM w
""")
def wilson_by_lang(spark, sf):
    d = _table(spark, sf, "labels").join(_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("one", F.lit(1))
    d = d.withColumn("hit", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    s = metrics.pooled(d, ["lang"], "hit", "one")
    return s.select("lang", "hits", "total", *(F.round(c, 4).alias(c) for c in ("rate", "low", "high")))


@query("SELECT coalesce(least(1.0, count_if(quality = 1)::DOUBLE / nullif(count(*), 0)), 0.0)::DOUBLE AS recall FROM labels")
def recall_estimate(spark, sf):
    s = _table(spark, sf, "labels").agg(F.count_if(F.col("quality") == 1).alias("got"), F.count("*").alias("n"))
    return s.select(rules.recall_estimate(F.col("got"), F.col("n")).alias("recall"))
