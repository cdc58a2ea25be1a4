"""Scans of documents into segments, by file extension, and of evaluation sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.evaluation import with_defaults
from corpusloom.schemas import EVALUATION

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_heading = re.compile(X.HEADING)
_clause = re.compile(X.CLAUSE)
_line_ends = re.compile(X.LINE_ENDS)
#: White space by its Unicode property, as X.strip() removes it.
_white = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def _markdown(rows: list[list[str]]) -> str:
    rows = [r for r in ([" ".join(c.split()) for c in row] for row in rows) if any(r)]
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows else ""


def docx_segments(content: bytes, title: str) -> list[dict]:
    """Paragraphs and tables in their order; headings keep a stack, tables become Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    stack: list[str] = [title]
    out: list[dict] = []

    def add(text: str, path: str, heading: bool, table: bool) -> None:
        out.append({"text": text, "section_path": path, "page": None, "is_heading": heading, "is_table": table})

    for node in body if body is not None else []:
        if node.tag == f"{_W}p" and (text := _texts(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            found = _heading.search(style.get(f"{_W}val", "")) if style is not None else None
            if found:
                level = X.CJK_NUMERALS.get(found[2]) or int(found[2])
                stack = [*stack[:level], text]
            number = _clause.match(text)
            add(text, " > ".join([*stack, number[1]] if number else stack), bool(found), False)
        elif node.tag == f"{_W}tbl":
            table = _markdown([[_texts(c) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")])
            if table:
                add(table, " > ".join(stack), False, True)
    return out


def pdf_segments(content: bytes, title: str) -> list[dict]:
    """Lines of each page, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf on the executors") from e
    out = []
    for k, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        lines = [t for t in map(str.strip, (page.extract_text() or "").splitlines()) if t]
        out += [{"text": t, "section_path": f"{title} > 第{k}页", "page": k, "is_heading": False, "is_table": False} for t in lines]
    return out


def text_segments(content: bytes, title: str) -> list[dict]:
    """Lines that aren't blank, as line_segments() has them."""
    lines = (t.strip(_white) for t in _line_ends.split(content.decode("utf-8", "replace")))
    return [{"text": t, "section_path": title, "page": None, "is_heading": False, "is_table": False} for t in lines if t]


PARSERS = {"docx": docx_segments, "pdf": pdf_segments}


def parsed_file(name: str, content: bytes) -> list[dict]:
    """A file's segments, by its extension; files of no known extension are text."""
    title, dot, ext = name.rpartition(".")
    return PARSERS.get(ext.lower() if dot else "", text_segments)(content, title or name)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for kb, doc, name, content in pdf.itertuples(index=False):
            rows = [{"kb_id": kb, "document_id": doc, "file_name": name, "seg_no": k, **s} for k, s in enumerate(parsed_file(name, bytes(content)))]
            if rows:
                yield pd.DataFrame(rows).astype({"page": "Int32"})


SEGMENT_SCHEMA = "kb_id int, document_id long, file_name string, seg_no int, text string, section_path string, page int, is_heading boolean, is_table boolean"


def segments(spark: SparkSession, path: str, kb_id: int) -> DataFrame:
    """Segments of all files below path, of any store that Spark reads: .docx and .pdf by their parsers, all others as lines of
    text. The folder is read once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.lit(kb_id).alias("kb_id"), F.xxhash64("path").alias("document_id"), X.base_name(F.col("path")).alias("file_name"), "content")
    return files.mapInPandas(_parsed, SEGMENT_SCHEMA)


def evaluation_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON-lines evaluation set with defaults for what it leaves out; blank lines are skipped. limit takes the first
    queries by text."""
    rows = spark.read.schema(EVALUATION).json(path)
    rows = with_defaults(rows.filter("query is not null"))
    return rows.orderBy("query").limit(limit) if limit else rows


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> page_id, title, heading and the visible text, markup and scripts removed."""
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    text = X.strip(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    pick = lambda tag: X.strip(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", ""))
    return pages.select("page_id", pick("title").alias("title"), pick("h1").alias("heading"), text.alias("text"))
