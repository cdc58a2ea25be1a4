"""Segmentation as a scan, against the fold of whole documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, segmentation
from corpusloom.schemas import Budgets


def pieces(rng, n: int):
    size = rng.integers(1, 60, n)
    size[rng.random(n) < 0.05] = 300
    return size, rng.random(n) < rng.choice([0.0, 0.1]), rng.random(n) < rng.choice([0.0, 0.2, 1.0])


def test_a_bucket_s_map_says_what_walking_it_does():
    rng = np.random.default_rng(8)
    for _ in range(400):
        size, breaks, free = pieces(rng, int(rng.integers(1, 25)))
        least, out, begun, total = segmentation.bucket_map(size, breaks, free, 100)
        assert least == sorted(set(least)) and least[0] == 0
        for held in [*range(0, 130), 1000]:
            left, begins = segmentation.walk(size, breaks, free, held, 100)
            k = int(np.searchsorted(least, held, side="right")) - 1
            assert (held + total if out[k] < 0 else out[k], begun[k]) == (left, begins.sum())


SEGMENTS = "kb_id int, document_id long, file_name string, seg_no int, text string, section_path string, page int, is_heading boolean, is_table boolean"


@pytest.mark.parametrize("bucket", [1, 3, 50])
def test_scan_and_fold_give_the_same_parents(spark, bucket):
    rng = np.random.default_rng(9)
    rows = []
    for doc in range(30):
        paths = [f"p{int(k)}" if rng.random() < 0.9 else "" for k in np.cumsum(rng.random(80) < 0.1)]
        for k in range(int(rng.integers(1, 80))):
            text = ("1.2 " if rng.random() < 0.15 else "") + "x" * int(rng.integers(1, 90))
            rows.append((1, doc, f"f{doc}.txt", k * 2, text, paths[k] or None, int(k) if rng.random() < 0.3 else None, bool(rng.random() < 0.05), bool(rng.random() < 0.05)))
    df = spark.createDataFrame(rows, SEGMENTS).repartition(6)
    budgets = Budgets(parent=200)
    columns = ["document_id", "parent_index", "content", "section_path", "page", "parent_id", "kb_id", "file_name"]
    want = {tuple(r) for r in chunking.parents(df, budgets).select(*columns).collect()}
    got = [tuple(r) for r in segmentation.parents(df, budgets, bucket).select(*columns).collect()]
    assert set(got) == want and len(got) == len(want)
    assert segmentation.parents(df.limit(0), budgets).count() == 0


def test_texts_are_shuffled_once_and_no_group_goes_through_python(spark):
    rows = [(None if d % 5 == 0 else 1, d, f"f{d}.txt", k, "x" * (5 + (k * d) % 40), None, None, False, False) for d in range(30) for k in range(20)]
    df = spark.createDataFrame(rows, SEGMENTS)
    out = segmentation.parents(df, Budgets(parent=120), bucket=7)
    columns = ["kb_id", "document_id", "file_name", "parent_index", "content", "section_path", "parent_id"]
    want = chunking.parents(df, Budgets(parent=120)).select(*columns).collect()
    assert sorted(out.select(*columns).collect(), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FlatMapGroups" not in plan and sum("Exchange hashpartitioning" in line and "page" in line for line in plan.splitlines()) <= 1


def test_a_document_of_a_million_lines(spark):
    line = F.concat(F.lit("line "), F.col("id").cast("string"), F.repeat(F.lit(" word"), (F.col("id") % 9).cast("int")))
    df = spark.range(0, 1_000_000, numPartitions=16).select(
        F.lit(1).alias("kb_id"), F.lit(7).cast("long").alias("document_id"), F.lit("long.txt").alias("file_name"), F.col("id").cast("int").alias("seg_no"), line.alias("text"),
        F.lit("long").alias("section_path"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("is_heading"), F.lit(False).alias("is_table"),
    )
    got = segmentation.parents(df).agg(F.count("*").alias("n"), F.sum(F.xxhash64("parent_id", "parent_index").cast("decimal(38,0)")).alias("h"), F.sum(F.regexp_count("content", F.lit("line "))).alias("lines")).first()
    want = chunking.parents(df).agg(F.count("*").alias("n"), F.sum(F.xxhash64("parent_id", "parent_index").cast("decimal(38,0)")).alias("h")).first()
    assert (got.n, got.h) == (want.n, want.h) and got.lines == 1_000_000
