"""What a viewer of the graph asks for: bands, labels, visible parts, places to draw at, defaults.

nodes: key, tag, label, kind, page, confidence, box (array of four numbers or null). edges: src, dst, line_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geom import Box

#: Size of a sheet that is not known, in points. Fixed values.
DEFAULT_SHEET = (1224.0, 792.0)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def overlay_label(tag: Column, label: Column) -> Column:
    """The tag; else the label, unless it names a place, is shorter than two characters or has no letter; else nothing."""
    fine = label.isNotNull() & ~label.startswith("region@") & (F.length(label) >= 2) & label.rlike("[A-Za-z]")
    return F.when(tag.isNotNull() & (tag != ""), tag).when(fine, label)


def has_place(box: Column) -> Column:
    """Four finite numbers."""
    whole = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(box) == 4) & F.forall(box, whole), F.lit(False))


def visible(nodes: DataFrame, edges: DataFrame, page: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a page that have a place, and edges whose two ends are among them."""
    shown = nodes.filter((F.col("page") == page) & has_place(F.col("box")))
    keys = shown.select("key")
    kept = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return shown, kept


def edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the centres of both ends; edges with an end that has no place are left out."""
    at = lambda i, j: (F.get("box", F.lit(i)) + F.get("box", F.lit(j))) / 2
    placed = nodes.filter(has_place(F.col("box"))).select("key", at(0, 2).alias("x"), at(1, 3).alias("y"))
    end = lambda name, p: placed.select(F.col("key").alias(name), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    return edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")


def draw_order(nodes: DataFrame) -> DataFrame:
    """nodes with draw, their number within the page from the largest area to the smallest: small ones lie on top. Ties by key."""
    from pyspark.sql import Window

    area = (F.get("box", F.lit(2)) - F.get("box", F.lit(0))) * (F.get("box", F.lit(3)) - F.get("box", F.lit(1)))
    return nodes.withColumn("draw", F.row_number().over(Window.partitionBy("page").orderBy(area.desc_nulls_last(), "key")))


def pages_of(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, pages: the numbers of the pages that have nodes, rising."""
    return nodes.groupBy(*by).agg(F.sort_array(F.collect_set("page")).alias("pages"))


def with_sheets(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """pages (page) with width and height of their sheet (page, width, height), by default those of an unknown one."""
    width, height = DEFAULT_SHEET
    return pages.join(sheets.select("page", "width", "height"), "page", "left").withColumn("width", F.coalesce("width", F.lit(width))).withColumn("height", F.coalesce("height", F.lit(height)))


def with_defaults(nodes: DataFrame) -> DataFrame:
    """Nodes as a snapshot has them: no kind is unknown, no page the first, no confidence 0, and an empty text none."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return nodes.select("key", F.coalesce("kind", F.lit("unknown")).alias("kind"), text("tag").alias("tag"), text("label").alias("label"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def drawing_index(nodes: DataFrame, edges: DataFrame, procedure_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, tags): page, nodes, tagged, isolated; and tag, page, origin, the drawing's own first and then those that only
    the procedure (tag) names, without a page."""
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).distinct().withColumn("_joined", F.lit(True))
    named = F.col("tag").isNotNull() & (F.col("tag") != "")
    totals = nodes.join(ends, "key", "left").groupBy("page").agg(F.count("*").alias("nodes"), F.count_if(named).alias("tagged"), F.count_if(F.col("_joined").isNull()).alias("isolated"))
    own = nodes.filter(named).groupBy("tag").agg(F.min("page").alias("page")).withColumn("origin", F.lit("drawing"))
    other = procedure_tags.select("tag").distinct().join(own.select("tag"), "tag", "left_anti").select("tag", F.lit(None).cast(own.schema["page"].dataType).alias("page"), F.lit("procedure").alias("origin"))
    return totals, own.unionByName(other)


def box_array(box: Box) -> Column:
    return F.array(*box)


def page_extents(boxes: DataFrame, least: int = 100, margin: float = 1.04) -> DataFrame:
    """page, width, height that hold all boxes with a margin."""
    side = lambda c: F.greatest(F.lit(least), F.ceil(F.max(c) * margin)).cast("long")
    return boxes.groupBy("page").agg(side("x1").alias("width"), side("y1").alias("height"))


def search(nodes: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The first nodes, in order of insertion, whose tag holds the query or whose kind it is. The limit is the feature; a
    blank query finds nothing."""
    q = query.strip().upper()
    hit = F.upper(F.coalesce("tag", F.lit(""))).contains(q) | (F.upper("kind") == q)
    return nodes.filter(hit if q else F.lit(False)).orderBy("seq").limit(limit)
