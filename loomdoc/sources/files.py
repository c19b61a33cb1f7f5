"""Document files as pages and blocks: text, Word documents, and PDF spans that another tool has read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import continued, in_a_table
from ..functions.text import is_contents

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
# Font sizes of heading levels, and of text without a size.
HEADING_SIZES = {1: 18.0, 2: 16.0, 3: 14.0}
OTHER_HEADING, PLAIN = 13.0, 11.0
KINDS = ("pdf", "docx", "txt", "md")


def unsupported(files: DataFrame) -> DataFrame:
    """Paths whose extension no reader here takes."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(~kind.isin(*KINDS)).select("path", kind.alias("kind"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: a row a text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _own_text(node) -> str:
    """Text below a node, in order; not that of compatibility fallbacks."""
    out: list[str] = []

    def walk(n) -> None:
        if n.tag == FALLBACK:
            return
        if n.tag == W + "t":
            out.append(n.text or "")
        elif n.tag == W + "tab":
            out.append("\t")
        for child in n:
            walk(child)

    walk(node)
    return "".join(out).strip()


def docx_blocks(data: bytes) -> list[tuple[str, float, bool]]:
    """Text, font size and whether it is a table, of each block of a Word document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
    out: list[tuple[str, float, bool]] = []
    for node in body if body is not None else []:
        if node.tag == W + "p":
            if text := _own_text(node):
                out.append((text, _size(node), False))
        elif node.tag == W + "tbl":
            rows = []
            for tr in node.iter(W + "tr"):
                cells = list(dict.fromkeys(_own_text(tc) for tc in tr.findall(W + "tc")))
                rows.append("| " + " | ".join(cells) + " |")
            if rows:
                out.append(("\n\n".join(rows), PLAIN, True))
    return out


def _size(paragraph) -> float:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    name = "" if style is None else style.get(W + "val", "")
    if name.lower().startswith("heading"):
        level = name[7:].strip()
        return HEADING_SIZES.get(int(level), OTHER_HEADING) if level.isdigit() else OTHER_HEADING
    size = paragraph.find(f".//{W}sz")
    return int(size.get(W + "val")) / 2 if size is not None else PLAIN


def docx_rows(files: DataFrame) -> DataFrame:
    """``path, block_idx, text, font_size, is_table, error`` of Word documents ``path, content``; a damaged file gives one row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at, data in frame[["path", "content"]].itertuples(index=False):
                try:
                    rows += [(at, i, *b, None) for i, b in enumerate(docx_blocks(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((at, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "block_idx", "text", "font_size", "is_table", "error"]).astype({"block_idx": "Int32", "is_table": "boolean", "font_size": "Float64"})

    return files.select("path", "content").mapInPandas(run, "path string, block_idx int, text string, font_size double, is_table boolean, error string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``docx_rows`` of the files below a folder, read by Spark's own stores."""
    return docx_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


def docx_file(lines: list[tuple[str, str | None]]) -> bytes:
    """A Word document of paragraphs: their texts, and names of styles."""
    body = ElementTree.Element(W + "body")
    for text, style in lines:
        p = ElementTree.SubElement(body, W + "p")
        if style:
            ElementTree.SubElement(ElementTree.SubElement(p, W + "pPr"), W + "pStyle").set(W + "val", style)
        # control characters have no place in XML
        ElementTree.SubElement(ElementTree.SubElement(p, W + "r"), W + "t").text = "".join(c for c in text if c >= " " and c not in "\ufffe\uffff" or c in "\t")
    document = ElementTree.Element(W + "document")
    document.append(body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(document, "utf-8", xml_declaration=True))
    return out.getvalue()


def page_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of PDF pages from spans ``document_id, page, height, x0, y0, x1, y1, text, font_size`` that a PDF tool has read:
    margins (top 5 %, bottom 8 %) are left out, spans of a line joined, wide gaps (over 20 points) with a bar."""
    inside = spans.filter((F.col("y0") >= 0.05 * F.col("height")) & (F.col("y1") <= 0.92 * F.col("height")))
    line = Window.partitionBy("document_id", "page", "y0").orderBy("x0")
    gap = F.col("x0") - F.lag("x1").over(line)
    parts = inside.withColumn("part", F.when(gap > 20, F.concat(F.lit(" | "), "text")).when(gap.isNotNull(), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    lines = parts.groupBy("document_id", "page", "y0").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "part"))), lambda s: s["part"]), "").alias("text"), F.min("x0").alias("x0"), F.max("font_size").alias("font_size"))
    order = Window.partitionBy("document_id").orderBy("page", "y0", "x0")
    return lines.select("document_id", "page", (F.row_number().over(order) - 1).alias("block_idx"), F.regexp_replace("text", r"[ \t]+", " ").alias("text"), "font_size")


def read_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Documents of JSON files, each a list or an object with ``documents``; the first ``limit`` by id, if given."""
    rows = spark.read.json(path, multiLine=True)
    if "documents" in rows.columns:
        rows = rows.select(F.inline("documents"))
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def pdf_pages(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``document_id, page, blocks`` (structs of text, y0, y1, font, is_table) of PDF pages, from spans ``document_id, page, height, x0, y0, x1, y1, text,
    font_size`` and boxes of tables ``document_id, page, x0, y0, x1, y1``.

    Margins and spans inside tables are left out, spans of a line joined (wide gaps with a bar), blocks that go on joined with the one before.
    Pages of contents among the first two are left out. A page is one row: what its sorts see is one page."""
    if tables is not None:
        boxes = tables.groupBy("document_id", "page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_tables"))
        spans = spans.join(boxes, ["document_id", "page"], "left")
        spans = spans.filter(F.col("_tables").isNull() | ~in_a_table(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("_tables"))).drop("_tables")
    inside = spans.filter((F.col("y0") >= 0.05 * F.col("height")) & (F.col("y1") <= 0.92 * F.col("height")))
    lines = inside.groupBy("document_id", "page", "y0").agg(F.sort_array(F.collect_list(F.struct("x0", "text", "x1"))).alias("s"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("font_size").alias("font"))
    gap = lambda s, i: s["x0"] - F.get("s", i - 1)["x1"]
    parts = F.transform("s", lambda s, i: F.concat(F.when(i == 0, "").when(gap(s, i) > 20, " | ").otherwise(" "), s["text"]))
    text = F.regexp_replace(F.array_join(parts, ""), r"[ \t]+", " ")
    items = lines.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", text.alias("text"), "y1", "font"))).alias("i"))
    blocks = continued(F.transform("i", lambda b: F.struct(b["text"].alias("text"), b["y0"].cast("double").alias("y0"), b["y1"].cast("double").alias("y1"), b["font"].cast("double").alias("font"), F.lit(False).alias("is_table"))))
    pages = items.select("document_id", "page", blocks.alias("blocks"))
    return pages.filter((F.col("page") > 2) | ~is_contents(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")))
