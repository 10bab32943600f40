"""Files of a knowledge base as tables, and the sinks of reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import table_pieces

#: Extensions that are read, and those that may be uploaded, with the size limit.
TEXT, IMAGES = ("md", "txt", "csv", "json"), ("png", "jpg", "jpeg", "webp")
SUPPORTED = (*TEXT, "pdf", "docx", "xlsx", *IMAGES)
UPLOADS, UPLOAD_BYTES = ("md", "txt", "pdf", "docx", "csv", "json"), 50 * 1024 * 1024
#: Characters of a group of spreadsheet rows.
SHEET_GROUP = 280
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, extension, size, modified) of the supported files right in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = files.select(F.url_decode(file_name(F.col("path"))).alias("name"), "length", "modificationTime")
    return rows.withColumn("extension", extension(F.col("name"))).filter(F.col("extension").isin(*SUPPORTED)).select("name", "extension", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def uploadable(name: Column, size: Column) -> Column:
    """Uploads have a list of types of their own, without spreadsheets and images."""
    return extension(name).isin(*UPLOADS) & (size <= UPLOAD_BYTES)


def docx_text(content: bytes) -> str:
    """Paragraphs, then the rows of tables with their cells joined by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    parts = [text(p) for p in body.findall(f"{_WORD}p")]
    for row in (r for table in body.findall(f"{_WORD}tbl") for r in table.findall(f"{_WORD}tr")):
        parts.append(" | ".join(c for c in (text(cell) for cell in row.findall(f"{_WORD}tc")) if c))
    return "\n\n".join(p for p in parts if p)


def _sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}

    def value(cell) -> str:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")).strip()
        v = cell.findtext(f"{_SHEET}v") or ""
        return (strings[int(v)] if cell.get("t") == "s" and v else v).strip()

    for sheet in tree("xl/workbook.xml").iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_LINK}id")].lstrip("/")
        rows = tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_SHEET}row")
        yield sheet.get("name"), [[v for v in (value(c) for c in row.iter(f"{_SHEET}c")) if v] for row in rows]


def xlsx_text(content: bytes, group: int = SHEET_GROUP) -> str:
    """Groups of rows, each below the sheet's mark and its first row."""
    parts = []
    for name, cells in _sheets(content):
        rows = [" | ".join(r) for r in cells if r]
        if not rows:
            continue
        parts += table_pieces(rows, group, (f"[Sheet: {name}]",))
    return "\n\n".join(parts)


def sheet_preview(content: bytes, rows: int = 500, columns: int = 60) -> dict[str, list[list[str]]]:
    """The first rows and columns of each sheet, for display."""
    return {name: [r[:columns] for r in cells[:rows]] for name, cells in _sheets(content)}


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """(page from 1, text) of the pages with text; needs the optional package pypdf."""
    from pypdf import PdfReader

    pages = ((i, (p.extract_text() or "").strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    return [(i, t) for i, t in pages if t]


def loaded(spark: SparkSession, folder: str, ocr=None) -> DataFrame:
    """(source, page, text, error) of the supported files of a folder, sorted by nothing: order by source.

    CSV and JSON files are text as they are. PDFs give a row a page. A file that can't be
    read gives a row with its error and no text, and never ends the job; blank texts are
    left out. ocr: bytes -> text, for images.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = files.select(F.url_decode(file_name(F.col("path"))).alias("source"), "content").withColumn("ext", extension(F.col("source"))).filter(F.col("ext").isin(*SUPPORTED))

    def read(ext: str, content: bytes) -> list[tuple[int | None, str]]:
        if ext == "pdf":
            return pdf_pages(content)
        if ext == "docx":
            return [(None, docx_text(content))]
        if ext == "xlsx":
            return [(None, xlsx_text(content))]
        if ext in IMAGES:
            if ocr is None:
                raise ValueError("no provider for images")
            return [(None, ocr(content))]
        return [(None, content.decode("utf-8"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, content, ext in zip(*(batch.column(k).to_pylist() for k in ("source", "content", "ext"))):
                try:
                    out += [(source, page, text.strip(), None) for page, text in read(ext, content) if text.strip()]
                except Exception as e:  # noqa: BLE001 - any file may be broken in any way
                    out.append((source, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "page", "text", "error"])

    return rows.mapInArrow(run, "source string, page int, text string, error string")


def whole_documents(pages: DataFrame) -> DataFrame:
    """(source, text): the pages of each source in order, with empty lines between."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("page"), "text")))
    return pages.filter("text is not null").groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, the name of the first column after a byte order mark for spreadsheet programs."""
    first, *others = rows.columns
    rows.select(F.col(f"`{first}`").alias(f"﻿{first}"), *[F.col(f"`{c}`") for c in others]).write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines of a report, in the place of an earlier one; columns without a value are written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def snapshot(rows: DataFrame, folder: str, version: str) -> str:
    """A table version of its own below `folder`; the caller publishes the path last."""
    path = f"{folder}/{re.sub('[^A-Za-z0-9_.-]', '_', version)}"
    rows.write.mode("errorifexists").parquet(path)
    return path
