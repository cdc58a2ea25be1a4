"""The inverted index with bounds and the automaton of patterns, against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import patterns, retrieval, routing
from corpusloom.sources import postings


def brute(cells: list[tuple], asked: list[tuple], k: int) -> set:
    weights = defaultdict(lambda: defaultdict(float))
    for q, t, w in asked:
        if t is not None and w is not None:
            weights[q][t] += w
    by_chunk = defaultdict(dict)
    for kb, c, t, v in cells:
        by_chunk[kb or 0, c][t] = v
    out = set()
    for q, ws in weights.items():
        scores = defaultdict(list)
        for (kb, c), values in by_chunk.items():
            if ws.keys() & values.keys():
                scores[kb].append((-round(sum(w * values.get(t, 0.0) for t, w in ws.items()), 6), c))
        out |= {(q, kb, c, -s) for kb, found in scores.items() for s, c in sorted(found)[:k]}
    return out


def found(hits) -> set:
    return {(r.query_id, r.kb_id, r.chunk_id, round(r.score, 6)) for r in hits.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    """Frequent words everywhere, rare ones in few chunks; values of both signs; a chunk's words of one topic."""
    rng = np.random.default_rng(2)
    cells = []
    for c in range(1200):
        terms = {f"common{t}" for t in rng.integers(0, 8, 5)} | {f"topic{c % 40}_{t}" for t in rng.integers(0, 10, 4)} | {f"rare{rng.integers(0, 400)}"}
        cells += [((None, 1, 2)[c % 3], f"c{c:04}", t, round(float(rng.normal(1.0, 0.7)), 3)) for t in sorted(terms)]
    return cells, spark.createDataFrame(cells, "kb_id int, chunk_id string, term string, value double")


def test_index_finds_what_all_chunks_give(spark, corpus, tmp_path):
    cells, df = corpus
    rng = np.random.default_rng(3)
    asked = [(q, t, round(float(rng.normal(0.5, 1.0)), 3)) for q in range(25) for t in {f"common{rng.integers(0, 8)}", f"topic{q}_{q % 10}", f"rare{rng.integers(0, 400)}", "unknown"}]
    asked += [(3, "common1", 0.25), (3, "common1", 0.25), (4, None, 1.0), (5, "common2", None), (99, "nothing", 1.0)]
    index = postings.PostingIndex(spark, f"file://{tmp_path}/index").build(df, range_size=16)
    queries = spark.createDataFrame(asked, "query_id long, term string, weight double")
    for k in (1, 5, 500):
        assert found(index.search(queries, k)) == brute(cells, asked, k)
    assert found(index.search(queries, 5, kbs=[2])) == brute([c for c in cells if c[0] == 2], asked, 5)
    assert index.search(queries.limit(0), 5).count() == 0


def test_bounds_spare_ranges(spark, corpus, tmp_path):
    _, df = corpus
    index = postings.PostingIndex(spark, f"file://{tmp_path}/index").build(df.withColumn("value", F.abs("value")), range_size=8)
    rows = [(q, f"topic{q}_{t}", 5.0) for q in range(20) for t in range(10)] + [(q, "common3", 0.1) for q in range(20)]
    _, reads = index.search_and_reads(spark.createDataFrame(rows, "query_id long, term string, weight double"), 3)
    r = reads.agg(F.sum("ranges_read") / F.sum("ranges"), F.min("ranges")).first()
    assert r[0] < 0.5 and r[1] > 20


def test_bm25_of_odd_chunks(spark, tmp_path):
    rows = [(1, "a", "red blue red"), (1, "b", None), (None, "c", ""), (2, "d", "blue"), (None, "e", "green blue 红色设备")]
    chunks = spark.createDataFrame(rows, "kb_id int, chunk_id string, content string")
    queries = spark.createDataFrame([(1, "red BLUE"), (2, None), (3, "absent"), (4, "红色设备")], "query_id long, query string")
    index = postings.bm25_index(chunks, f"file://{tmp_path}/i")
    got = {(r.query_id, r.kb_id, r.chunk_id, round(r.sparse_score, 6)) for r in postings.bm25_search(queries, index, 3).collect()}
    want = {(r.query_id, r.kb_id, r.chunk_id, round(r.sparse_score, 6)) for r in retrieval.bm25_best(queries, chunks, 3).collect()}
    assert got == want and len(got) == 4
    none = postings.bm25_index(chunks.limit(0), f"file://{tmp_path}/none")
    assert postings.bm25_search(queries, none, 3).count() == 0


def test_index_shuffles_each_chunk_once_and_tells_repeated_ones(spark, tmp_path):
    """Blocks of queries, chunks of one id, and what a build and a search shuffle: no row for each posting."""
    rng = np.random.default_rng(4)
    words = [" ".join(f"w{w}" for w in rng.integers(0, 300, 60)) for _ in range(900)]
    chunks = spark.createDataFrame([(c % 3, f"c{c:03}", w) for c, w in enumerate(words)], "kb_id int, chunk_id string, content string")
    queries = spark.createDataFrame([(q, words[q]) for q in range(0, 900, 10)], "query_id long, query string")
    index = postings.bm25_index(chunks, f"file://{tmp_path}/i")
    assert index.blocks().count() == 9 and index.blocks().agg(F.sum(F.size("nth"))).first()[0] > 9 * 5000
    want = {tuple(r) for r in retrieval.bm25_best(queries, chunks, 4).collect()}
    hits = postings.bm25_search(queries, index, 4)
    assert {tuple(r) for r in hits.collect()} == want and len(want) == 90 * 3 * 4
    assert "Generate" not in hits._jdf.queryExecution().executedPlan().toString()
    whole = postings.WEIGHTS, postings.QUERY_BLOCK
    postings.WEIGHTS, postings.QUERY_BLOCK = 300 * 7, 8
    assert {tuple(r) for r in postings.bm25_search(queries, index, 4).collect()} == want
    postings.WEIGHTS, postings.QUERY_BLOCK = whole
    twice = spark.createDataFrame([(1, "a", "red blue"), (1, "a", "red"), (1, "b", "red")], "kb_id int, chunk_id string, content string")
    once = spark.createDataFrame([(1, "a", "red blue red"), (1, "b", "red")], "kb_id int, chunk_id string, content string")
    tf = [{(r.chunks[n], t) for r in postings.bm25_index(df, f"file://{tmp_path}/{k}").blocks().collect() for t, n in zip(np.repeat(r.terms, r.sizes), r.nth, strict=True)} for k, df in enumerate((twice, once))]
    assert tf[0] == tf[1] == {("a", "red"), ("a", "blue"), ("b", "red")}


# Patterns


def test_patterns_in_texts(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", 12)
    texts = {1: "aaaa banana", 2: "", 3: None, 4: "the cat sat on the cat", 5: "ÄÖ 红色红色", 6: "x" * 20_000 + "cat"}
    known = ["a", "aa", "ana", "cat", "the cat", "红色", "Ö", "zebra", "", None, "cat", "x" * 50]
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    got = {(r.id, r.pattern): r.times for r in patterns.contained(df, "id", "body", spark.createDataFrame([(p,) for p in known], "p string"), "p").collect()}
    assert got == {(i, p): t.count(p) for i, t in texts.items() if t for p in known if p and p in t}
    assert patterns.contained(df, "id", "body", spark.createDataFrame([], "p string"), "p").count() == 0


def test_names_are_resolved_without_holding_all_against_all(spark):
    kbs = spark.createDataFrame([(7, "pumps"), (3, "pump"), (5, "")], "kb_id int, name string")
    names = spark.createDataFrame([("pumps",), ("KB-12",), ("the pumps here",), ("nothing",), ("nothing",), (None,)], "name string")
    out = routing.resolve_names(names, kbs)
    got = {r["name"]: r["kb_id"] for r in out.collect()}
    assert got == {"pumps": 7, "KB-12": 12, "the pumps here": 3, "nothing": None, None: None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
