"""Attaching text to the graph. Attachment names nodes and edges and never changes which there are.

nodes: page, node, kind, x0..y1, confidence. regions: page, region, text (null: unread), x0..y1, orientation,
text_confidence. Lengths are in units of the module u of the page, given as a number or column of regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geom, tags
from sheetwise.functions.geom import Box
from sheetwise.operators import graph, spatial

#: Which kinds of node a kind of tag may name, and which it prefers. Fixed values.
ALLOWED = {
    "instrument": ("instrument", "unknown"),
    "valve": ("component", "junction", "unknown"),
    "equipment": ("component", "junction", "unknown"),
    "off_page_connector": ("component", "junction", "unknown"),
}
PREFERRED = {"instrument": "instrument", "valve": "component", "equipment": "component"}
SELF_IOU = 0.5  # a region that covers a node so far is the node's own drawing


def _box(p: str) -> Box:
    return Box(*(F.col(f"{p}{c}") for c in Box._fields))


def _sides(nodes: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = nodes.select("page", "node", F.col("kind").alias("node_kind"), F.col("confidence").alias("node_confidence"), *(F.col(c).alias(f"n{c}") for c in Box._fields))
    r = regions.select("page", "region", "text", "orientation", "text_confidence", *(F.col(c).alias(f"r{c}") for c in Box._fields))
    return n, r


def bubble_rows(nodes: DataFrame, regions: DataFrame, cell: float = 32.0) -> DataFrame:
    """Rows of text inside an instrument, top to bottom, that together make a tag: page, node, tag, canonical, confidence, regions.

    Line numbers are no rows. A region inside several instruments goes to the first of them, by id, whose rows make a tag:
    in rounds, instruments that wait for none before them are judged, and what makes a tag takes its rows."""
    read = regions.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    read = read.filter(tags.parse(F.col("text"))["kind"] != "line_number")
    n, r = _sides(nodes.filter(F.col("kind") == "instrument"), read)
    cx, cy = _box("r").centre
    inside = spatial.grid_join(n, r.withColumn("cx", cx).withColumn("cy", cy), _box("n"), Box(F.col("cx"), F.col("cy"), F.col("cx"), F.col("cy")), ["page"], cell)
    waiting = graph.written(inside.select("page", "node", "node_confidence", "region", "ry0", "text", "text_confidence"))
    done = None
    while waiting.limit(1).count():
        first = F.min("node").over(Window.partitionBy("page", "region")) == F.col("node")
        ready = waiting.withColumn("_first", first).groupBy("page", "node", "node_confidence").agg(
            F.bool_and("_first").alias("ready"), F.array_sort(F.collect_list(F.struct("ry0", "region", "text"))).alias("rows"), F.min("text_confidence").alias("read")
        ).filter("ready")
        texts = F.transform("rows", lambda x: x["text"])
        g = ready.withColumn("dashed", tags.parse(F.array_join(texts, "-"))).withColumn("plain", tags.parse(F.array_join(texts, "")))
        fits = lambda c: F.col(f"{c}.kind").isin("instrument", "valve")
        g = g.withColumn("tag", F.when(fits("dashed"), F.col("dashed")).when(fits("plain"), F.col("plain")))
        g = graph.written(g.select("page", "node", "tag", F.col("tag.canonical").alias("canonical"), F.least("node_confidence", F.greatest("read", F.lit(0.1))).alias("confidence"), F.transform("rows", lambda x: x["region"]).alias("regions")))
        made = g.filter("tag is not null")
        done = made if done is None else done.unionByName(made)
        rest = waiting.join(g.select("page", "node"), ["page", "node"], "left_anti")
        waiting = graph.written(rest.join(made.select("page", F.explode("regions").alias("region")), ["page", "region"], "left_anti"))
    if done is None:
        kind = tags.parse(F.lit(""))
        done = waiting.select("page", "node", kind.alias("tag"), F.lit("").alias("canonical"), F.lit(0.0).alias("confidence"), F.array("region").alias("regions"))
    return done


def adjacent(nodes: DataFrame, regions: DataFrame, gate: float, bonus: float, cell: float = 32.0) -> DataFrame:
    """Parsed tags to nodes one to one, the least gap first, nodes of the preferred kind `bonus` nearer: page, node, region, gap, confidence."""
    t = regions.filter(F.col("text").isNotNull()).withColumn("tag_kind", tags.parse(F.col("text"))["kind"]).filter(F.col("tag_kind").isin(*ALLOWED))
    n, r = _sides(nodes, t)
    r = r.join(t.select("page", "region", "tag_kind"), ["page", "region"])
    may = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    liked = F.create_map(*(F.lit(x) for kv in PREFERRED.items() for x in kv))
    gap = geom.rect_gap(_box("r"), _box("n"))
    fits = F.array_contains(F.try_element_at(may, F.col("tag_kind")), F.col("node_kind")) & (geom.iou(_box("r"), _box("n")) < SELF_IOU) & (gap <= gate)
    wide = r.select("*", *(v.alias(f"g{c}") for c, v in zip(Box._fields, _box("r").grown(gate))))
    pairs = spatial.grid_join(n, wide, _box("n"), _box("g"), ["page"], cell, fits).withColumn("gap", gap)
    prefers = F.coalesce(F.try_element_at(liked, F.col("tag_kind")) == F.col("node_kind"), F.lit(False))
    pairs = pairs.withColumn("adjusted", F.col("gap") - F.when(prefers, bonus).otherwise(0.0))
    got = graph.greedy_match(pairs, ["page"], "region", "node", ["adjusted"])
    facts = pairs.select("page", "region", "node", "gap", F.least("node_confidence", F.greatest("text_confidence", F.lit(0.1))).alias("confidence"))
    return got.select("page", "region", "node").join(facts, ["page", "region", "node"])


def by_radius(nodes: DataFrame, regions: DataFrame, reach: float, bias: float, cell: float = 64.0) -> DataFrame:
    """Unread and unparsed regions to nodes one to one by the distance of centres, read ones `bias` nearer: page, node, region, label.
    Regions that parse as a tag take no part, bound or not."""
    regions = regions.filter(~F.coalesce(tags.parse(F.col("text"))["kind"] != "unknown", F.lit(False)))
    n, r = _sides(nodes, regions)
    nx, ny = _box("n").centre
    rx, ry = _box("r").centre
    distance = F.hypot(rx - nx, ry - ny)
    read = F.col("text").isNotNull() & (F.col("text") != "")
    adjusted = distance - F.when(read, bias).otherwise(0.0)
    radius = _box("n").longest / 2 + reach
    wide = n.select("*", *(v.alias(f"g{c}") for c, v in zip(Box._fields, Box(nx - radius - bias, ny - radius - bias, nx + radius + bias, ny + radius + bias))))
    pairs = spatial.grid_join(wide, r, _box("g"), Box(rx, ry, rx, ry), ["page"], cell, adjusted < radius).withColumn("adjusted", adjusted)
    got = graph.greedy_match(pairs, ["page"], "region", "node", ["adjusted"])
    named = regions.select("page", "region", "text", *Box._fields)
    mx, my = Box.of().centre
    label = F.when(read, F.col("text")).otherwise(F.concat(F.lit("region@"), F.bround(mx).cast("long"), F.lit(","), F.bround(my).cast("long")))
    return got.select("page", "region", "node").join(named, ["page", "region"]).select("page", "node", "region", label.alias("label"))


def line_labels(lines: DataFrame, regions: DataFrame, gate: float, degrees: float = 20.0, cell: float = 64.0) -> DataFrame:
    """Line numbers to the nearest conductor of their direction; ties to the longer, then the smaller id: page, region, line, distance.
    lines: page, line, ax, ay, bx, by.

    Of lines with equal ends only the smallest can win, and regions with one centre and direction have one winner, so both
    are looked at once; the winner of a place is an aggregate, and no pairs are sorted."""
    t = regions.filter(F.col("text").isNotNull()).filter(tags.parse(F.col("text"))["kind"] == "line_number")
    rx, ry = Box.of().centre
    r = graph.written(t.select("page", "region", rx.alias("px"), ry.alias("py"), F.when(F.col("orientation") == "horizontal", 0.0).otherwise(1.5707963267948966).alias("turn")))
    places = graph.written(r.select("page", "px", "py", "turn").distinct())
    coords = ["ax", "ay", "bx", "by"]
    shapes = lines.groupBy("page", *coords).agg(F.min("line").alias("line"))
    ends = [F.col(c) for c in coords]
    hull = Box(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    off = F.abs(geom.folded_angle(*ends) - F.col("turn"))
    fits = F.least(off, 3.141592653589793 - off) <= F.radians(F.lit(degrees))
    distance = geom.segment_distance(F.col("px"), F.col("py"), *ends)
    near = Box(F.col("px"), F.col("py"), F.col("px"), F.col("py")).grown(gate)
    pairs = spatial.grid_join(shapes, places, hull, near, ["page"], cell, fits & (distance <= gate))
    order = F.struct(distance.alias("distance"), (-geom.length(*ends)).alias("_longer"), F.col("line").isNull().alias("_nameless"), "line")
    won = pairs.groupBy("page", "px", "py", "turn").agg(F.min(order).alias("_won"))
    # A region with several rows takes the best of its places.
    own = r.join(won, ["page", "px", "py", "turn"]).groupBy("page", "region").agg(F.min("_won").alias("_won"))
    return own.select("page", "region", F.col("_won.line").alias("line"), F.col("_won.distance").alias("distance"))


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges (page, source, target, line_ids, line_number) with the line number of the first label on one of their conductors.
    labels: page, region, line, number. Edges that have a number keep it."""
    e = edges.withColumn("_e", F.xxhash64("page", "source", "target", F.array_join("line_ids", ",")))
    on = e.filter("line_number is null").select("page", "_e", F.explode("line_ids").alias("line")).join(labels, ["page", "line"])
    won = on.groupBy("page", "_e").agg(F.min(F.struct("region", "number")).alias("w")).select("page", "_e", F.col("w.number").alias("_number"))
    return e.join(won, ["page", "_e"], "left").withColumn("line_number", F.coalesce("line_number", "_number")).drop("_e", "_number")


#: Gates and bonuses of attachment in modules. Fixed values.
ATTACH_GAP, LINE_GAP, KIND_BONUS, RADIUS, READ_BIAS = 2.0, 2.0, 0.3, 1.0, 0.3


def attach(nodes: DataFrame, regions: DataFrame, lines: DataFrame, edges: DataFrame, u: float, gap: float = ATTACH_GAP, line_gap: float = LINE_GAP, bonus: float = KIND_BONUS, radius: float = RADIUS, bias: float = READ_BIAS) -> dict[str, DataFrame]:
    """All phases, each without what the ones before have bound: rows inside instruments, tags to the nearest node of
    their kind, other text by radius, line numbers to conductors and their edges.

    `bound`: page, node, region (the first of its rows), method, label, confidence. `edges`: with line_number. `unbound`:
    page, region, text, kind, reason of each parsed tag that found no place. `ledger`: one row of counts."""
    parsed = tags.parse(F.col("text"))
    known = graph.written(regions.withColumn("_kind", F.coalesce(parsed["kind"], F.lit("unknown"))).withColumn("_canonical", parsed["canonical"]))
    bubbles = graph.written(bubble_rows(nodes, regions))
    taken = bubbles.select("page", F.explode("regions").alias("region"))
    free = lambda n, *got: n.join(got[0], ["page", "node"], "left_anti") if len(got) == 1 else free(n.join(got[0], ["page", "node"], "left_anti"), *got[1:])
    rest = regions.join(taken, ["page", "region"], "left_anti")
    near = graph.written(adjacent(free(nodes, bubbles.select("page", "node")), rest, gap * u, bonus * u))
    rest = rest.join(near.select("page", "region"), ["page", "region"], "left_anti")
    other = graph.written(by_radius(free(nodes, bubbles.select("page", "node"), near.select("page", "node")), rest, radius * u, bias * u))
    text = regions.select("page", "region", F.col("text").alias("label"))
    own = nodes.select("page", "node", F.col("confidence").alias("confidence"))
    bound = bubbles.select("page", "node", F.get("regions", F.lit(0)).alias("region"), F.lit("bubble_rows").alias("method"), F.col("canonical").alias("label"), "confidence")
    bound = bound.unionByName(near.join(text, ["page", "region"]).select("page", "node", "region", F.lit("adjacent").alias("method"), "label", "confidence"))
    bound = bound.unionByName(other.join(own, ["page", "node"]).select("page", "node", "region", F.lit("legacy_radius").alias("method"), "label", "confidence"))

    numbers = known.filter("_kind = 'line_number'")
    on = graph.written(line_labels(lines, numbers.drop("_kind", "_canonical"), line_gap * u).join(numbers.select("page", "region", F.col("_canonical").alias("number")), ["page", "region"]))
    labelled = label_edges(edges, on)
    carried = edges.select("page", F.explode("line_ids").alias("line"), F.col("line_number").isNotNull().alias("_had"))
    # A label carries an edge if it is the first on one of the edge's lines.
    ends = edges.filter("line_number is null").withColumn("_e", F.monotonically_increasing_id()).select("page", "_e", F.explode("line_ids").alias("line")).join(on, ["page", "line"])
    used = ends.groupBy("page", "_e").agg(F.min("region").alias("region")).select("page", "region").distinct().withColumn("_used", F.lit(True))
    lines_with = carried.groupBy("page", "line").agg(F.lit(True).alias("_edges"))
    lost = numbers.join(on.select("page", "region", "line"), ["page", "region"], "left").join(used, ["page", "region"], "left").join(lines_with, ["page", "line"], "left").filter("_used is null")
    reason = F.when(F.col("line").isNull(), f"no conductor within {line_gap:.1f} modules with compatible orientation").when(F.col("_edges"), "conductor already labelled").otherwise("conductor carries no edges")
    unbound = lost.select("page", "region", "text", F.col("_kind").alias("kind"), reason.alias("reason"))
    claimed = taken.unionByName(near.select("page", "region"))
    pool = known.filter(F.col("_kind").isin(*ALLOWED)).join(claimed, ["page", "region"], "left_anti")
    unbound = unbound.unionByName(pool.select("page", "region", "text", F.col("_kind").alias("kind"), F.lit(f"no compatible node within {gap:.1f} modules").alias("reason")))
    unbound = graph.written(unbound)
    counts = (
        known.filter(F.col("_kind").isin(*ALLOWED, "line_number")).join(taken, ["page", "region"], "left_anti").agg(F.count("*").alias("parsed_regions")), bubbles.agg(F.count("*").alias("composed_bubbles")),
        bubbles.select("node").unionByName(near.select("node")).agg(F.count("*").alias("bound_nodes")), used.agg(F.count("*").alias("bound_edges")),
        other.agg(F.count("*").alias("legacy_labels")), unbound.agg(F.count("*").alias("unbound")),
    )
    ledger = counts[0].withColumn("_k", F.lit(1))
    for c in counts[1:]:
        ledger = ledger.join(c.withColumn("_k", F.lit(1)), "_k")
    return {"bound": bound, "edges": labelled, "unbound": unbound, "ledger": ledger.drop("_k")}


def unbound_warnings(unbound: DataFrame, preview: int = 6) -> DataFrame:
    """page, warning: how many parsed tags of a page found no place, and the first of them. The preview's length is the feature."""
    g = unbound.withColumn("_rn", F.row_number().over(Window.partitionBy("page").orderBy("region"))).groupBy("page")
    g = g.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= preview, F.struct("region", "text", "reason")))).alias("first"))
    some = F.array_join(F.transform("first", lambda x: F.concat(x["text"], F.lit(" ("), x["reason"], F.lit(")"))), "; ")
    return g.select("page", F.concat(F.col("n").cast("string"), F.lit(" convention tags parsed but not bound: "), some, F.when(F.col("n") > preview, ", ...").otherwise("")).alias("warning"))
