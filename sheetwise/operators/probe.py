"""What a page is made of: counts of its paths by type and width, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of a page's nature. Fixed values.
LEAST_VECTORS, LEAST_TEXT, RASTER_DOMINANT, RASTER_INCIDENTAL = 50, 200, 0.5, 0.05


def capabilities(paths: DataFrame, rasters: DataFrame | None = None) -> DataFrame:
    """One row per page. paths: page, type, width, colour (string), dashes (string), items (array of structs with op).
    rasters: page, area_ratio, dpi."""
    by = paths.groupBy("page", "type", F.round("width", 4).alias("width")).agg(F.count("*").alias("n"))
    kinds = by.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("@", "type", F.coalesce(F.col("width").cast("string"), F.lit("none"))), "n")))).alias("by_type_width"), F.sum("n").alias("vector_paths"))
    widths = by.filter(F.col("width").isNotNull()).groupBy("page", "width").agg(F.sum("n").alias("n")).groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("width", "n")))).alias("by_width"))
    n_of = lambda op: F.size(F.filter("items", lambda i: i["op"] == op))
    other = paths.groupBy("page").agg(
        F.count_distinct("colour").alias("colours"), F.count_distinct("type").alias("paint_types"), F.sum(n_of("l")).alias("line_segments"), F.sum(n_of("c")).alias("beziers"),
        F.coalesce(F.bool_or(F.col("dashes").rlike(r"\[\s*[0-9.]")), F.lit(False)).alias("dash_arrays"),
    )
    out = kinds.join(widths, "page", "left").join(other, "page")
    if rasters is not None:
        r = rasters.groupBy("page").agg(F.least(F.lit(1.0), F.sum("area_ratio")).alias("raster_area"), F.max("dpi").alias("raster_dpi"))
        out = out.join(r, "page", "full")
    else:
        out = out.withColumn("raster_area", F.lit(0.0)).withColumn("raster_dpi", F.lit(None).cast("double"))
    return out.withColumn("raster_area", F.coalesce("raster_area", F.lit(0.0))).withColumn("vector_paths", F.coalesce("vector_paths", F.lit(0)))


def nature(caps: DataFrame, text_chars: str | None = None) -> DataFrame:
    """caps with has_vectors, raster_dominant, raster_incidental, several_widths, several_paints, and has_text where a column counts characters."""
    positive = F.size(F.filter(F.map_keys("by_width"), lambda w: w > 0))
    out = caps.withColumn("has_vectors", F.col("vector_paths") >= LEAST_VECTORS)
    out = out.withColumn("raster_dominant", (F.col("raster_area") >= RASTER_DOMINANT) & ~F.col("has_vectors"))
    out = out.withColumn("raster_incidental", (F.col("raster_area") > 0) & (F.col("raster_area") < RASTER_INCIDENTAL))
    out = out.withColumn("several_widths", F.coalesce(positive >= 2, F.lit(False))).withColumn("several_paints", F.coalesce(F.col("paint_types") >= 2, F.lit(False)))
    return out if text_chars is None else out.withColumn("has_text", F.col(text_chars) >= LEAST_TEXT)
