"""Readers of procedure files and graph interchange files.

Files are read by Spark's readers (`binaryFile`, `text`, `json`), so any Hadoop file system will do.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import tags
from sheetwise.functions.quantity import parse_quantity, unit_from_header

#: WordprocessingML and core-property names. Fixed values.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TITLE = "{http://purl.org/dc/elements/1.1/}title"
PART = "path string, kind string, seq int, row int, cells array<string>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, text: the stripped lines of text and Markdown files that are not empty, in order; title is the file's stem."""
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.withColumn("text", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter(F.col("text") != "")
    title = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]*?)(\.[^./]*)?$", 1)
    return lines.select("path", title.alias("title"), F.col("pos").alias("seq"), "text")


def _text_of(node) -> str:
    return unicodedata.normalize("NFKC", "".join(t.text or "" for t in node.iter(f"{W}t")))


def docx_parts(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(kind, seq, row, cells): the title, the body's paragraphs, and the rows of all tables, nested ones too. A cell that
    spans several columns is padded with blank cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" in z.namelist():
            title = ElementTree.fromstring(z.read("docProps/core.xml")).find(TITLE)
            if title is not None and (title.text or "").strip():
                yield "title", 0, 0, [title.text.strip()]
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    if body is None:
        return
    seq = 0
    for p in body.findall(f"{W}p"):
        if text := _text_of(p).strip():
            yield "paragraph", seq, 0, [text]
            seq += 1
    for seq, table in enumerate(body.iter(f"{W}tbl")):
        for n, row in enumerate(table.findall(f"{W}tr")):
            cells: list[str] = []
            for cell in row.findall(f"{W}tc"):
                span = cell.find(f"{W}tcPr/{W}gridSpan")
                cells += [_text_of(cell).strip(), *[""] * (int(span.get(f"{W}val", "1")) - 1 if span is not None else 0)]
            yield "cells", seq, n, cells


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """PART: titles, paragraphs and table rows of Word files."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *part) for p, c in zip(f.path, f.content, strict=True) for part in docx_parts(bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PART.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parts, PART)


def read_procedure(spark: SparkSession, path: str) -> DataFrame:
    """PART of a procedure file, by its suffix. Old Word files and unknown suffixes are refused."""
    suffix = re.search(r"\.([^./]*)$", path)
    kind = (suffix[1] if suffix else "").lower()
    if kind == "docx":
        return read_docx(spark, path)
    if kind in ("txt", "md", "markdown"):
        t = read_text(spark, path)
        return t.select("path", F.lit("paragraph").alias("kind"), "seq", F.lit(0).alias("row"), F.array("text").alias("cells"))
    raise ValueError(f"{path}: {'save the file as .docx' if kind == 'doc' else 'not a procedure file that can be read'}")


def requirements(parts: DataFrame) -> DataFrame:
    """Limits in table rows: path, ordinal, subject, tags, part, quantities (field, min, max, unit, raw), evidence. A table
    counts if a header names a unit; the first row is the header. Rows without a readable quantity are left out here
    and listed by `unread_rows`."""
    return _limit_rows(parts).filter(F.size("quantities") > 0)


def unread_rows(parts: DataFrame) -> DataFrame:
    return _limit_rows(parts).filter(F.size("quantities") == 0).select("path", "subject")


def _limit_rows(parts: DataFrame) -> DataFrame:
    cells = parts.filter("kind = 'cells'")
    head = cells.filter("row = 0").select("path", "seq", F.transform("cells", unit_from_header).alias("_units"))
    head = head.filter(F.exists("_units", lambda u: u.isNotNull()))
    rows = cells.filter("row > 0").join(head, ["path", "seq"]).filter(F.trim(F.get("cells", F.lit(0))) != "")

    def quantity(c, i):
        u = F.get("_units", i)
        q = parse_quantity(c, u["unit"])
        return F.when(u.isNotNull() & q.isNotNull(), F.struct(u["field"].alias("field"), q["min"].alias("min"), q["max"].alias("max"), q["unit"].alias("unit"), q["raw"].alias("raw")))

    found = F.filter(F.transform("cells", quantity), lambda q: q.isNotNull())
    subject = F.trim(F.get("cells", F.lit(0)))
    rows = rows.select(
        "path", "seq", "row", subject.alias("subject"), tags.subject_tags(subject).alias("tags"), tags.subject_part(subject).alias("part"), found.alias("quantities"),
        F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " | ").alias("evidence"),
    )
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("path").orderBy((F.size("quantities") == 0).cast("int"), "seq", "row")) - 1
    return rows.withColumn("ordinal", order).drop("seq", "row")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON files of directed multigraphs."""
    whole = spark.read.option("multiLine", True).json(path)
    columns = set(whole.columns)
    take = lambda name: whole.select(F.explode(name).alias("x")).select("x.*") if name in columns else None
    return take("nodes"), take("edges" if "edges" in columns else "links")


def read_findings(spark: SparkSession, path: str, schema: str = "check string, status string, severity string, subject string, confidence double") -> DataFrame:
    """Findings from JSON lines; a missing file is no findings."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def library(spark: SparkSession, root: str) -> DataFrame:
    """PDF and DOCX files under root: path relative to it, folder, name, size; hidden ones are left out, folders come first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    top = re.sub(r"^[a-zA-Z][\w+.-]*://?[^/]*(?=/)", "", root.rstrip("/"))  # without scheme and host, which a listing may spell otherwise
    relative = F.regexp_replace("path", r"^([a-zA-Z][\w+.-]*:/*[^/]*)?" + re.escape(top if top.startswith("/") else "/" + top) + "/", "")
    out = files.select(relative.alias("path"), "length").filter(F.col("path").rlike(r"(?i)\.(pdf|docx)$") & ~F.col("path").rlike(r"(^|/)\."))
    depth = F.size(F.split("path", "/"))
    return out.withColumn("kind", document_kind(F.col("path"))).orderBy((depth == 1).cast("int"), F.lower("path"))


def document_kind(path: Column) -> Column:
    """procedure: Word files and what lies in a top folder `sop`; drawing: other PDF files; else null."""
    low = F.lower(path)
    return F.when(low.endswith(".docx") | (F.split(low, "/")[0] == "sop"), "procedure").when(low.endswith(".pdf"), "drawing")


def confine(relative: str, root: str) -> str:
    """The path of a file under root. A path that is absolute, empty or leads out of root is refused."""
    parts: list[str] = []
    for p in relative.replace("\\", "/").split("/"):
        if p == ".." and not parts:
            raise ValueError(f"{relative}: leads out of {root}")
        if p == "..":
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if not parts or relative.startswith(("/", "\\")) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", relative):
        raise ValueError(f"{relative}: not a file under {root}")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def first_file(spark: SparkSession, folders: list[str], suffixes: tuple[str, ...]) -> str | None:
    """The first file, by name, with one of the suffixes, of the first folder that has any; folders that are missing have none."""
    from pyspark.errors import AnalysisException

    wanted = "(?i)(" + "|".join(map(re.escape, suffixes)) + ")$"
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").load(folder).select("path")
            found = files.filter(F.col("path").rlike(wanted)).agg(F.min("path")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        if found:
            return found
    return None


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Earlier reads (key, text, confidence, backend) of a folder of Parquet, of each key the last by `written`; a missing folder is an empty cache."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "key string, text string, confidence double, backend string")
        raise
    last = rows.groupBy("key").agg(F.max(F.struct("written", "text", "confidence", "backend")).alias("x"))
    return last.select("key", "x.text", "x.confidence", "x.backend")


#: Characters that mean something in HTML, and how they are written. Fixed values.
HTML_NAMES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


def escaped(text: Column) -> Column:
    for c, name in HTML_NAMES.items():  # the ampersand first: the others are written with it
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def as_html(parts: DataFrame) -> DataFrame:
    """path, html: a preview of each procedure (PART): its title, paragraphs in order, then its tables with the first row as header."""
    cell = lambda tag: F.array_join(F.transform("cells", lambda c: F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>"))), "")
    row = F.concat(F.lit("<tr>"), F.when(F.col("row") == 0, cell("th")).otherwise(cell("td")), F.lit("</tr>"))
    one = escaped(F.get("cells", F.lit(0)))
    line = F.when(F.col("kind") == "title", F.concat(F.lit("<h1>"), one, F.lit("</h1>"))).when(F.col("kind") == "paragraph", F.concat(F.lit("<p>"), one, F.lit("</p>"))).otherwise(row)
    rank = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "paragraph", 1).otherwise(2)
    table = F.when(F.col("kind") == "cells", F.col("seq"))
    blocks = parts.withColumn("_rank", rank).withColumn("_line", line).withColumn("_table", table)
    # Paragraphs by their number, rows of a table by theirs: the other of the two is the same for all of a block.
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row", "_line"))), lambda s: s["_line"]), "")
    blocks = blocks.groupBy("path", "_rank", "_table").agg(inner.alias("html"))
    blocks = blocks.withColumn("html", F.when(F.col("_rank") == 2, F.concat(F.lit("<table>"), "html", F.lit("</table>"))).otherwise(F.col("html")))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.coalesce("_table", F.lit(0)).alias("t"), "html"))), lambda s: s["html"])
    return blocks.groupBy("path").agg(F.array_join(whole, "\n").alias("html"))


def described(parts: DataFrame) -> DataFrame:
    """path, title, paragraphs, tables, rows of each procedure."""
    title = F.max(F.when(F.col("kind") == "title", F.get("cells", F.lit(0))))
    return parts.groupBy("path").agg(title.alias("title"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_distinct(F.when(F.col("kind") == "cells", F.col("seq"))).alias("tables"), F.count_if(F.col("kind") == "cells").alias("rows"))
