"""Bucketed stores, the clustered vector index, and the states of documents that are ingested."""

from __future__ import annotations

import os
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import buckets, vector_index
from corpusloom.streaming import ingest


def files_of(store, table: str) -> dict[str, str]:
    return store.state()["tables"][table]["files"]


def rows_of(df) -> set:
    return {tuple(r) for r in df.collect()}


# Bucketed stores


@pytest.fixture
def store(spark, tmp_path):
    s = buckets.BucketStore(spark, f"file://{tmp_path}/store", tables=("parents", "children"), buckets=16)
    docs = spark.range(200).withColumnRenamed("id", "document_id")
    s.replace({"parents": docs.withColumn("text", F.lit("old")), "children": docs.crossJoin(spark.range(3).withColumnRenamed("id", "n"))})
    return s


def test_a_change_rewrites_its_buckets_alone(spark, store, tmp_path):
    before = {t: files_of(store, t) for t in store.tables}
    assert len(before["parents"]) == 16
    written = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet"))
    one = spark.createDataFrame([(7, "new")], "document_id long, text string")
    assert store.replace({"parents": one, "children": one.select("document_id", F.lit(9).cast("long").alias("n"))}) == 1
    after = {t: files_of(store, t) for t in store.tables}
    for t in store.tables:
        assert len([b for b in after[t] if after[t][b] != before[t][b]]) == 1
    more = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")) - written
    assert 0 < more < written / 6
    assert store.read("parents").filter("text = 'new'").count() == 1 and store.read("parents").count() == 200
    assert rows_of(store.of_keys(one, "children")) == {(7, 9)} and store.read("children").count() == 598
    assert store.read("children", version=0).count() == 600


def test_readers_see_both_tables_of_a_change_or_none(spark, store, monkeypatch):
    write = store._write
    calls = []

    def fails_at_the_second(table, rows, touched):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("disk full")
        return write(table, rows, touched)

    monkeypatch.setattr(store, "_write", fails_at_the_second)
    one = spark.createDataFrame([(7, "new")], "document_id long, text string")
    with pytest.raises(OSError, match="disk full"):
        store.replace({"parents": one}, one)
    assert store.read("parents").filter("text = 'new'").count() == 0 and store.read("children").count() == 600
    monkeypatch.setattr(store, "_write", write)
    assert store.clean(dead_after=0) == 1
    assert store.read("parents").count() == 200 and store.read("children").count() == 600


def test_a_writer_that_meets_another_does_its_change_again(spark, store, tmp_path, monkeypatch):
    other = buckets.BucketStore(spark, f"file://{tmp_path}/store", tables=("parents", "children"))
    assert other.buckets == 16
    commit, met = store._commit, []

    def late(before, tables, mark):
        if not met:
            met.append(other.delete(spark.createDataFrame([(8,)], "document_id long")))
        return commit(before, tables, mark)

    monkeypatch.setattr(store, "_commit", late)
    assert store.delete(spark.createDataFrame([(7,)], "document_id long")) == 2
    assert store.read("parents").count() == 198 and store.read("children").count() == 594
    monkeypatch.setattr(store, "attempts", 1)
    met.clear()
    with pytest.raises(buckets.Conflict):
        store.delete(spark.createDataFrame([(9,)], "document_id long"))


def test_odd_rows_of_a_store(spark, tmp_path):
    s = buckets.BucketStore(spark, f"file://{tmp_path}/s", buckets=4)
    assert s.read() is None and s.commits() == [] and s.drop() is None and s.delete_where({"a": 1}) is None
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None), (2, "")], "document_id long, a string")
    s.replace({"rows": rows})
    assert s.read().count() == 5
    s.replace({"rows": rows.filter("document_id is null").limit(1).withColumn("more", F.lit(1))})
    assert rows_of(s.read()) == {(None, "a", 1), (1, None, None), (2, "", None)} and s.read().count() == 4
    s.upsert(spark.createDataFrame([(1, "x", 5), (1, "y", 7)], "document_id long, a string, more int"), ["document_id"], order="more")
    assert rows_of(s.read().filter("document_id = 1")) == {(1, "y", 7)}
    s.delete_where({"a": ["", "zz"]})
    assert rows_of(s.read()) == {(None, "a", 1), (1, "y", 7)}
    with pytest.raises(ValueError, match="have to hold"):
        s.upsert(rows, ["a"])
    with pytest.raises(ValueError, match="no commit"):
        s.read(version=99)
    s.replace({"rows": rows.limit(0)})
    s.drop()
    assert s.read().count() == 0 and s.read().columns == ["document_id", "a", "more"]


def test_cleaning_keeps_what_the_last_commits_name(spark, store):
    for k in range(4):
        store.replace({"parents": spark.createDataFrame([(k, f"v{k}")], "document_id long, text string")})
    gone = store.clean(keep=2)
    assert gone > 0 and store.commits() == [3, 4]
    assert store.read("parents").count() == 200 and store.read("parents", version=3).filter("text = 'v3'").count() == 0
    assert store.clean(keep=2) == 0


# The vector index


def clustered(rng, n: int, d: int, centres: int, spread: float) -> np.ndarray:
    at = rng.normal(size=(centres, d))
    return at[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, d))


def brute(x: pd.DataFrame, q: pd.DataFrame, k: int) -> set:
    out = set()
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    for qid, qv in zip(q["query_id"], q["embedding"]):
        for kb, g in x.groupby(x["kb_id"].fillna(0)):
            g = g[[len(v) == len(qv) for v in g["embedding"]]]
            if len(g):
                score = np.round(unit(np.stack(g["embedding"])) @ unit(np.asarray(qv)[None])[0], 12)
                best = sorted(zip(-score, g["chunk_id"]))[:k]
                out |= {(qid, int(kb), c, r) for r, (_, c) in enumerate(best, 1)}
    return out


def found(hits) -> set:
    return {(r.query_id, r.kb_id, r.chunk_id, r.dense_rank) for r in hits.collect()}


def test_index_finds_what_a_scan_finds_and_reads_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    v = clustered(rng, 3000, 16, 40, 0.05)
    x = pd.DataFrame({"kb_id": rng.integers(1, 3, 3000), "chunk_id": [f"c{k:05}" for k in range(3000)], "embedding": v.tolist()})
    x = pd.concat([x, pd.DataFrame({"kb_id": 1, "chunk_id": [f"same{k:03}" for k in range(400)], "embedding": [v[0].tolist()] * 400})])
    q = pd.DataFrame({"query_id": range(30), "embedding": (clustered(rng, 15, 16, 40, 0.05).tolist() + (v[:15] + 0.01).tolist())})
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", max_cells=50)
    index.put(spark.createDataFrame(x, "kb_id int, chunk_id string, embedding array<double>"))
    queries = spark.createDataFrame(q, "query_id long, embedding array<double>")
    hits, reads = index.search_and_reads(queries, 5)
    assert found(hits) == brute(x, q, 5)
    near = reads.filter("query_id >= 15").agg(F.sum("cells_read") / F.sum("cells"), F.sum("vectors_read") / F.sum("vectors")).first()
    assert near[0] < 0.5 and near[1] < 0.6


def test_index_follows_changes_and_filters(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 5))
    x = pd.DataFrame({"kb_id": [1 + k % 2 for k in range(400)], "chunk_id": [f"c{k:04}" for k in range(400)], "tag": [f"t{k % 3}" for k in range(400)], "embedding": v.tolist()})
    schema = "kb_id int, chunk_id string, tag string, embedding array<double>"
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index", max_cells=12)
    index.put(spark.createDataFrame(x, schema))
    q = pd.DataFrame({"query_id": range(10), "embedding": rng.normal(size=(10, 5)).tolist()})
    queries = spark.createDataFrame(q, "query_id long, embedding array<double>")
    before = files_of(index.store, "vectors")
    moved = x.iloc[:3].assign(embedding=[[9.0, 0.0, 0.0, 0.0, 0.1 * k] for k in range(3)], tag="new")
    index.put(spark.createDataFrame(moved, schema))
    after = files_of(index.store, "vectors")
    assert 1 <= len([b for b in after if after[b] != before.get(b)]) <= 4
    x = pd.concat([moved, x.iloc[3:]])
    index.delete(spark.createDataFrame([("c0005",), ("none",)], "chunk_id string"))
    index.delete_where({"tag": "t2"})
    x = x[(x["chunk_id"] != "c0005") & (x["tag"] != "t2")]
    assert index.read().count() == len(x)
    assert found(index.search(queries, 4)) == brute(x, q, 4)
    assert found(index.search(queries, 4, {"tag": ["t1", "new"], "kb_id": 1})) == brute(x[x["tag"].isin(["t1", "new"]) & (x["kb_id"] == 1)], q, 4)
    assert found(index.search(queries, 1000)) == brute(x, q, 1000)
    posted = index.search(queries, 4, {"tag": "t1"}, post_filter=True)
    assert {r.chunk_id for r in posted.collect()} <= set(x["chunk_id"][x["tag"] == "t1"])
    index.drop()
    assert index.search(queries, 4).count() == 0


def test_index_of_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(1, "a", [1.0, 0.0]), (None, "b", [0.0, 2.0]), (1, "c", [1.0, 0.0, 0.0]), (1, "d", None), (1, "e", []), (1, "f", [0.0, 0.0]), (1, "g", [nan, 1.0]), (1, "h", [1.0, None]), (1, "a", [1.0, 0.0])]
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    index.put(spark.createDataFrame(rows, "kb_id int, chunk_id string, embedding array<double>"))
    assert index.read().count() == 8
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.kb_id, r.chunk_id, round(r.dense_score, 9)) for r in index.search(queries, 2).collect()}
    assert got == {(1, 1, "a", 1.0), (1, 0, "b", 0.0), (2, 1, "c", 0.0)}


def test_dense_search_of_unlike_lengths(spark):
    from corpusloom.operators import retrieval

    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0, 1.0]), (1, "c", [0.6, 0.8]), (1, "d", []), (1, "e", None), (1, "f", [0.0, 0.0])], "kb_id int, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 3.0]), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.chunk_id, r.dense_rank) for r in retrieval.dense_topk(queries, rows, 5).collect()}
    assert got == {(1, "a", 1), (1, "c", 2), (2, "b", 1)}


# States of documents


EVENTS = "document_id long, stage string, at timestamp, message string, order long"


def event(spark, rows):
    """(document, stage, minute, message)"""
    made = [(d, s, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=m), said, k) for k, (d, s, m, said) in enumerate(rows)]
    return spark.createDataFrame(made, EVENTS)


#: Document 1 is indexed after an error, 2 fails by its errors, 3 is stuck, 4 is submitted again after its failure, 5 is under way.
STORY = [
    [(1, "submitted", 0, None), (2, "submitted", 0, None), (3, "submitted", 0, None), (4, "submitted", 0, None), (1, "parsing", 1, None), (3, "chunking", 2, None), (2, "error", 2, "e1"), (4, "error", 2, "x1")],
    [(1, "error", 10, "once"), (2, "error", 11, "e2"), (4, "error", 12, "x2"), (4, "error", 13, "x3")],
    [(1, "parsing", 20, None), (1, "storing", 21, None), (2, "error", 22, "e3"), (4, "submitted", 25, None), (4, "embedding", 26, None)],
    [(1, "indexed", 30, None), (4, "chunked", 45, None)],
    [(5, "submitted", 60, None), (5, "parsing", 61, None), (4, "storing", 62, None)],
    [(6, "submitted", 63, None)],
]
WANT = {1: ("indexed", 100, 1, None), 2: ("failed", 0, 3, "e3"), 3: ("failed", 45, 0, "stuck in chunking"), 4: ("storing", 80, 0, None), 5: ("parsing", 30, 0, None), 6: ("submitted", 0, 0, None)}


def test_states_of_a_batch(spark):
    got = {r.document_id: (r.state, r.progress, r.errors, r.message) for r in ingest.document_states(event(spark, sum(STORY, []))).collect()}
    assert got == WANT
    early = ingest.document_states(event(spark, sum(STORY[:2], []))).filter("document_id = 2").first()
    assert (early.state, early.progress, early.message) == ("retrying", 0, "e2")
    assert ingest.document_states(event(spark, sum(STORY, [])).limit(0)).count() == 0


def test_a_stream_follows_documents_and_fails_the_stuck_one(spark, tmp_path):
    rows = f"{tmp_path}/events"
    seen: list = []

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(rows)
        out = ingest.follow(stream, late="1 minute").writeStream.outputMode("update")
        q = out.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    for part in STORY:
        event(spark, part).coalesce(1).write.mode("append").parquet(rows)
        run()
    # The watermark of the last batch moves the timers in one more.
    event(spark, [(7, "submitted", 64, None)]).coalesce(1).write.mode("append").parquet(rows)
    run()
    last = {}
    for _, doc, state, progress, errors, _, message in seen:
        last[doc] = (state, progress, errors, message)
    assert {d: s for d, s in last.items() if d != 7} == WANT
    assert [s for _, d, s, *_ in seen if d == 3] == ["chunking", "failed"]
    assert [s for _, d, s, *_ in seen if d == 4] == ["retrying", "failed", "embedding", "chunked", "storing"]
