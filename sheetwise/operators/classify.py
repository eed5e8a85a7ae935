"""Classification rules over path measures, and page calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.windows import modal

#: Trimmed sheet sizes in points, shorter side first, by name and unit system. Fixed values (inches, millimetres).
SHEETS_IN = {"ANSI_A": (8.5, 11.0), "ANSI_B": (11.0, 17.0), "ANSI_C": (17.0, 22.0), "ANSI_D": (22.0, 34.0), "ANSI_E": (34.0, 44.0), "ARCH_A": (9.0, 12.0), "ARCH_B": (12.0, 18.0), "ARCH_C": (18.0, 24.0), "ARCH_D": (24.0, 36.0), "ARCH_E": (36.0, 48.0)}
SHEETS_MM = {"ISO_A4": (210.0, 297.0), "ISO_A3": (297.0, 420.0), "ISO_A2": (420.0, 594.0), "ISO_A1": (594.0, 841.0), "ISO_A0": (841.0, 1189.0)}
SHEET_TOLERANCE = 0.02


def kind_of_path(longest: Column, minor: Column, diagonal: Column, filled: Column, curves: Column, u) -> Column:
    """Kind of a path by its extents in units of u; the order of the rules matters."""
    pipe = ((longest > 2 * u) & (minor <= 2.5 * u)) | (filled & (minor <= 1.0 * u) & (longest > 1.5 * u))
    return (
        F.when(pipe, "pipe")
        .when(longest > 60 * u, "frame")
        .when((diagonal < 5 * u) & (longest < 1.5 * u), "glyph")
        .when((diagonal <= 30 * u) | (curves > 0), "symbol")
        .otherwise("other")
    )


def is_black(colour: Column) -> Column:
    """A colour (array of components) is black if its first three are dark; no colour counts as black."""
    return F.coalesce(F.forall(F.slice(colour, 1, 3), lambda c: c < 0.15), F.lit(True))


def is_instrument_circle(w: Column, h: Column, curves: Column, black: Column, u) -> Column:
    side = F.greatest(w, h)
    return (curves > 0) & black & (F.abs(w - h) <= 0.15 * side) & (w / u).between(5.0, 10.0)


def sheets() -> list[tuple[str, str, float, float]]:
    inch = [(n, "ISA", a * 72, b * 72) for n, (a, b) in SHEETS_IN.items()]
    return inch + [(n, "ISO", a * 72 / 25.4, b * 72 / 25.4) for n, (a, b) in SHEETS_MM.items()]


def detect_sheet(width: Column, height: Column) -> Column:
    """struct(sheet, unit_system): the sheet of least relative error within tolerance, else custom and unknown; of equals the first."""
    short, long = F.least(width, height), F.greatest(width, height)
    known = [F.struct(F.greatest(F.abs(short - a) / a, F.abs(long - b) / b).alias("error"), F.lit(i).alias("i"), F.lit(n).alias("sheet"), F.lit(s).alias("unit_system")) for i, (n, s, a, b) in enumerate(sheets())]
    best = F.array_min(F.array(*known))
    fits = best["error"] <= SHEET_TOLERANCE
    return F.struct(F.when(fits, best["sheet"]).otherwise("custom").alias("sheet"), F.when(fits, best["unit_system"]).otherwise("unknown").alias("unit_system"))


def module_of(estimates: DataFrame, by: list[str], value: str = "module") -> DataFrame:
    """One module per group: the median of trusted estimates, their largest relative deviation and what that is worth."""
    m = estimates.groupBy(*by).agg(F.median(value).alias("module"), F.count("*").alias("n"), F.collect_list(value).alias("_v"))
    spread = F.array_max(F.transform("_v", lambda x: F.abs(x - F.col("module")) / F.greatest(F.col("module"), F.lit(1e-9))))
    confidence = F.when(F.col("n") == 1, 0.45).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.col("spread")))
    return m.withColumn("spread", spread).withColumn("confidence", confidence).drop("_v")


#: Instrument circles in modules, what doubt leaves of a scale's confidence, and the least that is used.
CIRCLE_MODULES, OUT_OF_WINDOW, LONE, LONE_SUSPECT, LEAST_CONFIDENCE = (5.0, 10.0), 0.6, 0.45, 0.25, 0.35


def symbol_diameters(paths: DataFrame, least: int = 5) -> DataFrame:
    """page, diameter, n: the most frequent width, to two places, of a page's near-circular paths, if `least` have it; of
    equally frequent ones that met first. paths: page, path, w, h, curves, span (the page's longer side)."""
    w = F.col("w")
    round_ = (F.col("curves") > 0) & (w > 0) & (F.col("h") > 0) & (F.abs(w - F.col("h")) <= 0.1 * w) & (w > 0.004 * F.col("span")) & (w < 0.06 * F.col("span"))
    found = modal(paths.filter(round_).withColumn("diameter", F.bround(w, 2)), ["page"], "diameter", "path")
    return found.filter(F.col("n") >= least).select("page", "diameter", "n")


def scales(estimates: DataFrame) -> DataFrame:
    """page, module, estimators, spread, confidence, usable of estimates (page, name, module, observable, trusted).

    Trusted estimates count; where a page has none, all do, and a lone one is worth less. A symbol whose diameter is no usual
    number of modules lowers the confidence. Below LEAST_CONFIDENCE a scale is not usable: every threshold hangs on it."""
    any_trusted = F.max(F.col("trusted").cast("int")).over(Window.partitionBy("page")) == 1
    kept = estimates.withColumn("_any", any_trusted).filter(F.col("trusted") | ~F.col("_any"))
    symbol = estimates.groupBy("page").agg(F.max(F.when(F.col("name") == "symbol", F.col("observable"))).alias("_symbol"), F.max(F.col("trusted").cast("int")).alias("_trusted"))
    m = module_of(kept, ["page"]).join(symbol, "page")
    start = F.when(F.col("n") == 1, F.when(F.col("_trusted") == 1, LONE).otherwise(LONE_SUSPECT)).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.col("spread")))
    odd = F.coalesce(~(F.col("_symbol") / F.col("module")).between(*CIRCLE_MODULES), F.lit(False))
    worth = F.round(start * F.when(odd, OUT_OF_WINDOW).otherwise(1.0), 3)
    return m.select("page", "module", F.col("n").alias("estimators"), "spread", worth.alias("confidence"), (start * F.when(odd, OUT_OF_WINDOW).otherwise(1.0) >= LEAST_CONFIDENCE).alias("usable"))
