"""Files of a folder as segments, headings, exact percentiles, and pages."""

from __future__ import annotations

import io
import math
import os
import sys
import types
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, evaluation
from corpusloom.sources import folder, pages, readers


def docx(paragraphs: list[tuple[str, str]]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>' for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def mixed(tmp_path):
    root = tmp_path / "files"
    (root / "deep").mkdir(parents=True)
    (root / "a.docx").write_bytes(docx([("Heading1", "One"), ("Normal", "1.2 text"), ("Heading2", "Two"), ("Normal", "more")]))
    (root / "deep" / "b.txt").write_text("x\n\n y \r\nz \n\x1f")
    (root / "deep" / "c.md").write_text("# title\nbody " * 50)
    (root / "none").write_bytes(b"\xff plain")
    (root / "empty.txt").write_text("")
    (root / ".hidden.txt").write_text("hidden")
    return root


def kept(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*[f.split()[0] for f in readers.SEGMENT_SCHEMA.split(", ")]).collect()), key=lambda r: (r[2], r[3]))


def test_a_folder_is_read_once_and_alike_by_both_scans(spark, mixed):
    folder.register(spark)
    by_source = spark.read.format(folder.NAME).option("kbId", 3).option("partitionBytes", 200).load(str(mixed))
    by_spark = readers.segments(spark, str(mixed), 3).filter("file_name <> '.hidden.txt'")
    assert kept(by_source) == kept(by_spark)
    assert {r[2] for r in kept(by_source)} == {"a.docx", "b.txt", "c.md", "none"}
    assert [r[4] for r in kept(by_source) if r[2] == "b.txt"] == ["x", "y", "z", "\x1f"]
    assert [r[5] for r in kept(by_source) if r[2] == "a.docx"] == ["a > One", "a > One > 1.2", "a > One > Two", "a > One > Two"]
    for df, scan in ((by_source, "BatchScan"), (by_spark, "FileScan binaryFile")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count(scan) == 1
    assert by_source.rdd.getNumPartitions() > 1


def test_files_are_dealt_by_their_bytes():
    got = [p.paths for p in folder.dealt([("a", 5), ("b", 4), ("c", 20), ("d", 1), ("e", 9), ("f", 0)], 10)]
    assert got == [("a", "b"), ("c",), ("d", "e", "f")]
    assert folder.dealt([], 10) == []


def test_a_folder_as_a_stream(spark, mixed, tmp_path):
    folder.register(spark)

    def run() -> None:
        stream = spark.readStream.format(folder.NAME).option("path", str(mixed)).load()
        out = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        out.trigger(availableNow=True).start().awaitTermination()

    run()
    rows = spark.read.schema(readers.SEGMENT_SCHEMA).parquet(f"{tmp_path}/out")
    first = rows.count()
    assert first == len(kept(spark.read.format(folder.NAME).load(str(mixed))))
    late = mixed / "late.txt"
    late.write_text("new line")
    now = os.stat(late).st_mtime_ns + 10**9
    os.utime(late, ns=(now, now))
    run()
    assert spark.read.parquet(f"{tmp_path}/out").filter("text = 'new line'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == first + 1


def test_pages_of_a_pdf(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    class Reader:
        def __init__(self, stream):
            self.pages = [Page(stream.read().decode()), Page(None), Page(" last \n\n")]

    module = types.ModuleType("pypdf")
    module.PdfReader = Reader
    monkeypatch.setitem(sys.modules, "pypdf", module)
    got = readers.parsed_file("Manual.PDF", b"one\n two ")
    assert [(s["text"], s["page"], s["section_path"]) for s in got] == [("one", 1, "Manual > 第1页"), ("two", 1, "Manual > 第1页"), ("last", 3, "Manual > 第3页")]
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pypdf"):
        readers.parsed_file("a.pdf", b"")


def test_heading_paths_are_those_of_the_file_parser(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for doc in range(25):
        paragraphs = []
        for k in range(int(rng.integers(1, 60))):
            level = int(rng.integers(1, 7)) if rng.random() < 0.5 else None
            style = "Normal" if level is None else rng.choice([f"Heading{level}", f"标题 {'一二三四五六'[level - 1]}", f"heading {level}"])
            paragraphs.append((str(style), f"{'3.1 ' if rng.random() < 0.2 else ''}t{k}"))
        for k, (s, (style, text)) in enumerate(zip(readers.docx_segments(docx(paragraphs), f"doc{doc}"), paragraphs, strict=True)):
            rows.append((doc, k, text, style))
            want[doc, k] = s["section_path"]
    df = spark.createDataFrame(rows, "document_id long, seg_no int, text string, style string").repartition(5)
    got = chunking.heading_paths(df, F.concat(F.lit("doc"), F.col("document_id").cast("string")), X.heading_level(F.col("style")))
    assert got.columns == [*df.columns, "section_path"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.document_id, r.seg_no): r.section_path for r in got.collect()} == want


@pytest.mark.parametrize("small", [1, 7, 10_000])
def test_percentiles_of_groups_of_any_shape(spark, small):
    rng = np.random.default_rng(6)
    groups = {
        "ties": [1.0] * 300 + [2.0] * 200, "one": [5.0], "two": [3.0, 9.0], "wide": (10.0 ** rng.integers(-300, 300, 400)).tolist(), "normal": rng.normal(size=500).tolist(),
        None: rng.integers(-5, 5, 400).astype(float).tolist(), "mixed": [0.0] * 50 + [math.inf] * 10 + [-1e300] * 3,
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("nulls", None)], "config string, latency double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["config"]: (r["latency"], r["n"]) for r in evaluation.exact_percentile(df, "config", "latency", p, small=small).collect()}
        assert got == {g: (sorted(vs)[max(1, math.ceil(p * len(vs))) - 1], len(vs)) for g, vs in groups.items()}


def test_pages_read_their_files_alone(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") % 500 > 0, F.col("id") % 40).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("c"))
    table = pages.PagedTable(spark, f"file://{tmp_path}/paged", ["a", "b"]).write(rows, files=20)
    assert table.count() == 5000
    want = [tuple(r) for r in rows.orderBy("a", "b").collect()]
    for skip, size in ((0, 10), (4321, 50), (4990, 50), (240, 400)):
        page = table.page(skip, size)
        assert [tuple(r) for r in page.collect()] == want[skip : skip + size]
        assert len(page.inputFiles()) <= size // 100 + 2
    assert table.page(5000, 10).count() == 0
    assert pages.PagedTable(spark, f"file://{tmp_path}/none", ["a"]).write(rows.limit(0)).page(0, 5).count() == 0
