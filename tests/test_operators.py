"""Operators on small inputs that the test tables lack, most of all Chinese text."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata, providers
from corpusloom.functions import text as X
from corpusloom.operators import changes, chunking, evaluation, filters, ranking, retrieval, routing
from corpusloom.plans import pipeline
from corpusloom.schemas import Budgets, Retrieval
from corpusloom.sources import buckets, readers, stores
from corpusloom.streaming import ingest


def one(spark, **columns):
    """The values of expressions over one row of text columns."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(("f", "text", "want"), [
    (X.query_tokens, "报修工单 QX-9000 a b_c", ["报修工单", "报修", "修工", "工单", "QX-9000", "b_c"]),
    (X.rerank_tokens, "报修工单 QX-9000 a b_c", ["报修工单", "报修", "修工", "工单", "qx-9000", "b_c"]),
    (X.profile_tokens, "_ab -cd", ["ab", "cd"]),
    (X.query_tokens, "_ab -cd", ["_ab", "-cd"]),
    (X.query_tokens, None, []),
    (X.embedding_tokens, "AB ab", ["ab", "ab"]),
])
def test_tokens(spark, f, text, want):
    assert one(spark, t=f(F.lit(text).cast("string"))).t == want


def test_hash_embedding_places(spark):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["报修工单", "报修", "qx-9000", "abc"])], "id long, text string")
    got = {(r.id, r.idx, r.weight > 0) for r in retrieval.hash_embedding(rows, "id", "text").collect()}
    assert {(0, 129, False), (1, 176, True), (2, 102, False), (3, 63, False)} <= got


def test_hash_vectors_are_made_where_the_texts_are(spark):
    texts = ["报修工单 报修", None, "", "qx-9000 abc abc ABC", "a b c", "one two three four five six seven eight nine ten " * 30]
    rows = spark.createDataFrame([(i % 5, i, t) for i, t in enumerate(texts * 3)], "kb int, id long, text string").repartition(3)
    out = retrieval.hash_vectors(rows, "id", "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("Exchange REPARTITION", "")
    want = {r.id: r.embedding for r in retrieval.as_vectors(retrieval.hash_embedding(rows, "id", "text"), "id").collect()}
    assert {r.id: (r.kb, r.embedding) for r in out.collect()} == {i: (i % 5, v) for i, v in want.items()} and len(want) == 9
    again = rows.withColumn("id", F.col("id") % 4)
    want = {r.id: r.embedding for r in retrieval.as_vectors(retrieval.hash_embedding(again, "id", "text"), "id").collect()}
    got = [(r.id, r.embedding) for r in retrieval.hash_vectors(again, "id", "text").collect()]
    assert len(got) == again.count() and dict(got) == want
    counts = {r.id: dict(zip(r.terms, r.times, strict=True)) for r in retrieval.term_counts(rows, "id", "text").collect()}
    assert counts[3] == {"qx-9000": 1, "abc": 3} and counts[0] == {"报修工单": 1, "报修": 2, "修工": 1, "工单": 1} and 1 not in counts


def test_best_of_many_batches():
    rng = np.random.default_rng(5)
    scores, names = rng.integers(0, 30, (4, 900)).astype(float), np.array([f"c{k:04}" for k in rng.permutation(900)], dtype=object)
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[3] = -np.inf
    for width in (1, 7, 300):
        best = retrieval.Best(10)
        for at in range(0, 900, width):
            best.add(scores[:, at : at + width], names[at : at + width])
        best.merge()
        got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.chunk.tolist(), strict=True))
        want = [(q, *x) for q in range(3) for x in sorted((-s, c) for s, c in zip(scores[q], names, strict=True) if s > -np.inf)[:10]]
        assert got == want


def test_a_corpus_s_texts_stay_where_they_are(spark):
    """Parents are made without a shuffle, with what the documents say of them; a search joins only the texts it has found."""
    text = "\n".join(f"line {k} of some words about pumps" for k in range(60))
    rows = [(1, d, f"d{d}.txt", f"d{d}", "en", "a", f"{text} {d}") for d in range(40)] + [(2, 90, "n.txt", "n", "de", "b", None), (2, 91, "e.txt", "e", None, "b", " \n")]
    docs = spark.createDataFrame(rows, "kb_id int, document_id long, file_name string, title string, department string, doc_type string, text string")
    budgets = Budgets(parent=300)
    got = chunking.parents_of(docs, budgets, keep=("department", "doc_type"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    columns = ["kb_id", "document_id", "file_name", "parent_index", "content", "section_path", "page", "parent_id"]
    want = chunking.parents(chunking.line_segments(docs), budgets).select(*columns).collect()
    assert sorted(got.select(*columns).collect(), key=str) == sorted(want, key=str) and len(want) > 200
    assert {(r.document_id, r.department, r.doc_type) for r in got.collect()} == {(d, "en", "a") for d in range(40)}
    again = docs.unionByName(docs.filter("document_id = 3"))
    assert chunking.parents_of(again, budgets).count() == chunking.parents(chunking.line_segments(again), budgets).join(again.select("document_id"), "document_id").count()
    corpus = pipeline.Corpus.build(docs, budgets)
    hits = pipeline.Hits.find(spark.createDataFrame([(1, "line 7")], "query_id long, query string"), corpus, 3)
    assert 3 <= hits.texts.count() <= 6 < corpus.children.count() and hits.parents.count() <= 6


def test_parents_and_children():
    seg = lambda t, table=False: {"text": t, "section_path": "s", "page": None, "is_heading": False, "is_table": table}
    texts = lambda segs: ["\n\n".join(p["texts"]) for p in chunking.fold_parents(segs, 10)]
    assert texts([seg("abcdef"), seg("ghijkl"), seg("1.1 xyzzzz")]) == ["abcdef", "ghijkl\n\n1.1 xyzzzz"]
    assert texts([seg("t1"), seg("table", True), seg("t2")]) == ["t1", "table", "t2"]
    assert chunking.fold_children("aaaaaa\n\nbbbbbb", 10, 3) == ["aaaaaa", "aaa\n\nbbbbbb"]
    assert chunking.fold_children("aaaaaa\n\n" + "b" * 20, 10, 3) == ["aaaaaa", "aaa", "b" * 10, "b" * 10]
    assert chunking.fold_children("c" * 15, 10, 3) == ["c" * 15]
    assert chunking.fold_children(" \n\n ", 10, 3) == []


def test_budgets():
    assert Budgets(100, 30, 60).overlap == 10
    b = Budgets.for_ingestion(1000, 200)
    assert (b.parent, b.child, b.overlap) == (1000, 500, 120)


def test_stable_id(spark):
    got = one(spark, i=X.sha256_of(F.lit("parent"), F.lit(1), F.lit(7), F.lit(0), F.lit("abcdef"))).i
    assert got == "4c542448df6e793caac2c739bd366a6fd6050893db93fd93c4f24bb308e2908f"


def test_banded_diff(spark):
    old = spark.createDataFrame([(f"uuid_{i + 1}", i, h) for i, h in enumerate("ABCDE")], "uuid string, index long, content_hash string")
    new = spark.createDataFrame(list(enumerate("ACDDDDD")), "index long, content_hash string")
    got = {(r.action, r.uuid, r['index']) for r in changes.banded_diff(old, new).collect()}
    assert got == {("update", "uuid_1", 0), ("update", "uuid_3", 1), ("update", "uuid_4", 2), *(("create", None, k) for k in (3, 4, 5, 6)), ("delete", "uuid_2", None), ("delete", "uuid_5", None)}
    far = changes.banded_diff(old.filter("content_hash = 'A'"), spark.createDataFrame([(11, "A")], "index long, content_hash string"))
    assert {r.action for r in far.collect()} == {"delete", "create"}
    near = changes.banded_diff(old.filter("content_hash = 'A'"), spark.createDataFrame([(10, "A")], "index long, content_hash string"))
    assert {r.action for r in near.collect()} == {"update"}


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(1, k + 1, c) for k, c in enumerate(cs)], "query_id long, pos int, chunk_id string") for cs in ("ab", "bc")]
    got = [(r.chunk_id, round(r.rrf_score, 7)) for r in ranking.reciprocal_rank_fusion(lists, 10).orderBy("rrf_rank").collect()]
    assert got == [("b", 0.1742424), ("a", 0.0909091), ("c", 0.0833333)]


@pytest.mark.parametrize(("score", "want"), [
    ({"rrf": 1 / 61}, 0.9836066), ({"rrf": 2 / 61}, 1.0), ({"rerank": 3.4, "rrf": 1 / 61}, 1.0), ({"rerank": float("nan")}, 0.0), ({"lexical": 3.0}, 0.65),
    ({"lexical": 50.0}, 0.85), ({"dense": 0.4}, 0.4), ({"dense": 3.0}, 0.25), ({}, 0.0),
])
def test_confidence(spark, score, want):
    c = {k: F.lit(score.get(k)).cast("double") for k in ("rerank", "rrf", "sparse", "lexical", "dense")}
    assert one(spark, c=ranking.confidence(**c, constant=60, has_parents=F.lit(True))).c == pytest.approx(want, abs=1e-7)
    assert one(spark, c=ranking.confidence(**c, constant=60, has_parents=F.lit(False))).c == 0


def test_filters(spark):
    wanted = {"kb_id": [1, 2], "doc_type": "规章制度", "effective_date": {"$gte": "2024-01-01"}}
    assert filters.pushdown_text(wanted) == "`kb_id` in (1, 2) and `doc_type` = '规章制度' and `effective_date` >= '2024-01-01'"
    rows = spark.createDataFrame([(None,), ("2024-05-01",), ("医工",)], "x string")
    count = lambda e: filters.apply_filters(rows, {"x": e}).count()
    assert (count(["医工", ""]), count(["医工"]), count([]), count(None)) == (2, 1, 0, 1)
    assert (count({"$gte": "2024-01-01", "$lt": "2024-06-01"}), count({"$foo": 1})) == (1, 2)


def test_permissions():
    assert filters.permitted({"doc_type": "维修记录"}, ["医工"]) == {"doc_type": "维修记录", "department": ["医工"]}
    assert filters.permitted({}, None)["department"] == ["医工", "后勤", "其他", ""]
    assert filters.permitted({"department": "医工"}, ["后勤"])["department"] == []
    assert filters.permitted({"department": "医工"}, ["后勤"], superuser=True) == {"department": "医工"}


def test_collapse_to_parents(spark):
    rows = spark.createDataFrame([(1, 1, "c1", "p1", "x", 1.0), (1, 2, "c2", "p1", "y", 0.5), (1, 3, "c3", "p2", "z", 0.1)], "query_id long, rank int, chunk_id string, parent_id string, content string, score double")
    none = spark.createDataFrame([], "parent_id string, content string")
    got = ranking.collapse_to_parents(rows, none, 5).orderBy("parent_rank").collect()
    assert [(r.parent_id, r.child_ids, r.content) for r in got] == [("p1", ["c1", "c2"], "x"), ("p2", ["c3"], "z")]


def test_metrics(spark):
    got, want = lit("p3", "p2", "p1"), lit("p1", "p2")
    r = one(spark, a=evaluation.recall_at(got, want, 2), b=evaluation.reciprocal_rank(got, want), c=evaluation.ndcg_at(got, want, 3))
    assert (r.a, r.b, round(r.c, 7)) == (0.5, 0.5, 0.6934264)
    none = F.array().cast("array<string>")
    assert one(spark, a=evaluation.recall_at(got, none, 2), b=evaluation.reciprocal_rank(got, none), c=evaluation.ndcg_at(got, none, 3)) == (0, 0, 0)
    assert spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "x int").agg(evaluation.nearest_rank("x", 0.95).alias("p")).first().p == 40


def test_routing_expressions(spark):
    said = lambda t: one(spark, i=routing.intent(F.lit(t)), d=routing.domains(F.lit(t)))
    assert (said("你好！").i, said("你好，报修").i) == ("chitchat", "retrieval")
    assert said("设备报错和保洁").d == ["医工", "后勤"]
    assert said("x").d == ["其他"]
    answer = '```json\n{"intent":"retrieval","domain":["医工"],"rewritten_query":"设备维修流程","candidate_kbs":["kb_医疗设备维修"]}\n```'
    r = one(spark, r=routing.parse_route(F.lit(answer))).r
    assert (r.intent, r.domain, r.rewritten_query, r.candidate_kbs) == ("retrieval", ["医工"], "设备维修流程", ["kb_医疗设备维修"])
    kbs = spark.createDataFrame([(7, "kb_医疗设备维修")], "kb_id int, name string")
    names = spark.createDataFrame([("kb_医疗设备维修",), ("kb_12",), ("see kb_医疗设备维修!",), ("x",)], "name string")
    assert {r.name: r.kb_id for r in routing.resolve_names(names, kbs).collect()} == {"kb_医疗设备维修": 7, "kb_12": 12, "see kb_医疗设备维修!": 7, "x": None}


def test_refusal(spark):
    config = Retrieval()
    reason = lambda q, n, c, s: one(spark, r=ranking.refusal_reason(F.lit(q), F.lit("retrieval"), F.lit(n), F.lit(c), F.lit(s), config)).r
    asked = "请给出量子发动机 QX-9000 的维修参数。"
    assert reason(asked, 0, 0.9, 0.9) == "no_parent_context"
    assert reason(asked, 1, 0.1, 0.9) == "confidence_below_threshold:0.1000<0.2000"
    assert reason(asked, 1, 0.9, 0.0) == "explicit_refusal_trigger"
    assert reason("q", 1, 0.9, 0.1) == "query_support_below_threshold:0.1000<0.1800"
    assert reason("q", 1, 0.9, 0.5) is None
    assert one(spark, s=ranking.query_support(F.lit("如何 报修工单"), lit("报修 工单 x"))).s == 0.5


def test_refusal_prints_scores_as_sql_does(spark):
    config = Retrieval(support_threshold=1.0)
    scores = [k / n for n in (32, 96, 160) for k in range(n)] + [0.00015, 0.12345, 0.00025, 1e-9, 0.99995]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = df.select("s", ranking.refusal_reason(F.lit("q"), F.lit("retrieval"), F.lit(1), F.lit(0.9), F.col("s"), config).alias("r"), X.rounded(F.col("s") - 1, 4).alias("less")).collect()
    assert [(r.s, r.r, r.less) for r in got] == [(s, f"query_support_below_threshold:{s:.4f}<1.0000", f"{s - 1:.4f}") for s in scores]
    low = one(spark, r=ranking.refusal_reason(F.lit("q"), F.lit("retrieval"), F.lit(1), F.lit(0.03125), F.lit(0.9), config)).r
    assert low == "confidence_below_threshold:0.0312<0.2000"


def test_metadata(spark):
    s = lambda name, text: one(spark, s=metadata.suggest(F.lit(name), F.lit(text))).s
    a = s("智慧后勤运维管理平台操作手册.docx", "本文描述后勤报修工单、运维任务和操作流程。")
    assert (a.doc_type, a.department, a.title) == ("维修记录", "后勤", "智慧后勤运维管理平台操作手册")
    b = s("QX-9000_2024年3月手册.docx", "")
    assert (b.doc_type, b.department, b.equipment_model, b.effective_date) == ("设备手册", None, "QX-9000", "2024-03-01")


def test_text_helpers(spark):
    r = one(
        spark, table=X.table_markdown(F.array(lit("a ", "b|c"), lit("", " "), lit("1", "2"))), none=X.table_markdown(F.array(lit("", ""))), h=X.heading_level(F.lit("标题 三")), h2=X.heading_level(F.lit("Heading 2")),
        h0=X.heading_level(F.lit("Normal")), stem=X.stem(F.lit("a/b.c.txt")), mime=X.mime_type(F.lit("x.bin")), clause=X.clause_number(F.lit(" 第三条 x")), strip=X.strip(F.lit("　 x\t")),
        cite=X.link_citations(F.lit("a [[citation:3]] [citation:4]")), think=X.fence_thoughts(F.lit("<think>x</think>")), hot=X.temperature(F.lit(7.0)),
        json=X.json_object(F.lit('```json\nx {"a":{"b":1}} y\n```')), first=X.truthy(F.lit(0.0), F.lit(2.0)),
    )
    assert r.table == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |" and r.none == ""
    assert (r.h, r.h2, r.h0) == (3, 2, None)
    assert (r.stem, r.mime, r.clause, r.strip) == ("b.c", "application/octet-stream", "第三条", "x")
    assert (r.cite, r.think, r.hot, r.json, r.first) == ("a [citation](3) [citation](4)", "## 💭 深度思考\n```thinkx```", 1.0, '{"a":{"b":1}}', 2.0)


def test_lexical_scores_count_inside_words(spark):
    rows = [("c1", "报修工单报修 XbcX bc bcbcb"), ("c2", "nothing"), ("c3", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "报修 bc zz"), (2, "")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.lexical_score for r in retrieval.lexical_best(queries, chunks.withColumn("kb_id", F.lit(1)), 10).collect()}
    assert got == {(1, "c1"): sum(rows[0][1].count(t) for t in ("报修", "bc"))}


def test_dense_search_in_blocks_of_queries(spark):
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "c", [0.0, 2.0]), (2, "d", [0.0, 0.0]), (2, "e", None)], "kb_id int, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "query_id long, embedding array<double>")
    whole, parts = (retrieval.dense_topk(queries, vectors, 1, block=n).orderBy("query_id", "kb_id").collect() for n in (100, 2))
    assert whole == parts and len(whole) == 10
    assert [r.chunk_id for r in whole if r.query_id == 0] == ["b", "c"]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = ""
    for style, text in paragraphs:
        if style == "table":
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in text) + "</w:tbl>"
        else:
            body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Heading1", "One"), ("Normal", "1.2 text"), ("table", [["h", "i"], ["1", "2"]])]))
    (tmp_path / "b.txt").write_text("x\n\n y \r\nz")
    got = readers.segments(spark, str(tmp_path), 3).orderBy("file_name", "seg_no").collect()
    assert [(r.file_name, r.text, r.section_path, r.is_heading, r.is_table) for r in got if r.file_name == "a.docx"] == [
        ("a.docx", "One", "a > One", True, False), ("a.docx", "1.2 text", "a > One > 1.2", False, False), ("a.docx", "| h | i |\n| --- | --- |\n| 1 | 2 |", "a > One", False, True)
    ]
    assert [r.text for r in got if r.file_name == "b.txt"] == ["x", "y", "z"]


def test_evaluation_set(spark, tmp_path):
    rows = [{"query": "q1", "relevant_parent_ids": ["a"]}, {"query": "q2", "answerable": False, "type": "负例"}, {"query": "q3", "relevant_parent_ids": ["TODO_1"]}]
    (tmp_path / "set.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = readers.evaluation_set(spark, str(tmp_path / "set.jsonl"))
    s = evaluation.summary(got).first()
    assert (s.query_count, s.answerable_query_count, s.labeled_query_count, s.label_coverage) == (3, 2, 2, pytest.approx(2 / 3))
    assert {r.type for r in got.collect()} == {"事实型", "负例"}


@pytest.mark.parametrize("name", ["exact", "clustered"])
def test_store(spark, tmp_path, name):
    store = stores.make_store(name, spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (1, "b", None, [0.0, 1.0])], "kb_id int, chunk_id string, content string, embedding array<double>")
    assert store.read() is None
    store.put(rows)
    store.put(rows.filter("chunk_id = 'b'").withColumn("content", F.lit("new")))
    assert {r.chunk_id: r.content for r in store.read().collect()} == {"a": "x", "b": "new"}
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [r.chunk_id for r in store.search(queries, 1).collect()] == ["a"]
    assert store.search(queries, 1, {"chunk_id": "b"}, post_filter=True).count() == 0
    store.delete_where({})
    assert store.read().count() == 2
    store.delete_where({"chunk_id": "a"})
    assert [r.chunk_id for r in store.read().collect()] == ["b"]
    store.delete(rows)
    assert store.read().count() == 0
    with pytest.raises(ValueError, match="no vector store"):
        stores.make_store("nope", spark, "x")


def test_stream_replaces_documents(spark, tmp_path):
    schema = "kb_id int, document_id long, file_name string, text string"
    store = buckets.BucketStore(spark, f"file://{tmp_path}/chunks", tables=ingest.CHUNK_TABLES, buckets=8)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, store, f"{tmp_path}/cp", f"{tmp_path}/stages").awaitTermination()

    arrive([(1, 1, "a.txt", "one\ntwo"), (1, 2, "b.txt", "three")])
    assert store.read("parents").count() == 2
    arrive([(1, 1, "a.txt", "four")])
    assert {r.content for r in store.read("parents").collect()} == {"four", "three"}
    assert {r.content for r in store.read("children").collect()} == {"four", "three"}
    # A batch that the checkpoint has lost, but the store has not, is not put in again.
    assert store.done(("ingest", 1)) and not store.done(("ingest", 2))
    assert store.replace({"parents": store.read("parents").limit(0)}, gone=store.read("parents"), mark=("ingest", 1)) == 1
    assert store.read("parents").count() == 2
    assert spark.read.parquet(f"{tmp_path}/stages").filter("progress = 100").count() == 2


def test_streamed_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = ingest.latency_windows(stream).writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("latency").agg(F.sum("n")).first()[0] == 200


def test_containing_short_and_long_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x"), (3, "zz b c d e ff")], "document_id long, text string")
    items = spark.createDataFrame([(1, "b c d e f"), (2, "x"), (3, "q")], "item_id long, text string")
    got = {(r.item_id, r.document_id) for r in pipeline.containing(docs, items).collect()}
    assert got == {(1, 1), (1, 3), (2, 2)}


def test_providers(spark):

    rows = spark.createDataFrame([(1, 1, "a", "x", 1), (1, 2, "a", "aa", 2)], "query_id long, in_rank int, query string, content string, chunk_id long")
    providers.register_reranker("Length", providers.model_reranker(lambda qs, cs: [float(len(c)) for c in cs]))
    assert [r.content for r in providers.reranker("length")(rows, 1).collect()] == ["aa"]
    assert [r.content for r in providers.reranker("unknown")(rows, 1).collect()] == ["x"]
    providers.register_embedding("Size", providers.model_embedding(lambda: lambda texts: [[float(len(t))] for t in texts]))
    assert {tuple(r.embedding) for r in providers.embedding("size")(rows, "chunk_id", "content").collect()} == {(1.0,), (2.0,)}
    assert providers.embedding("local_hash")(rows, "chunk_id", "content").count() == 1
    assert providers.store_for("hybrid", "local_hash") == "exact"
    with pytest.raises(ValueError, match="no embedding"):
        providers.embedding("nope")


# Searches within tasks


def test_best_keeps_what_sorting_keeps():
    rng = np.random.default_rng(1)
    for _ in range(30):
        k, n = int(rng.integers(1, 5)), int(rng.integers(0, 40))
        chunks = np.array([f"c{i}" for i in rng.permutation(n)], dtype=object)
        scores = rng.integers(0, 4, (3, n)).astype(float)
        scores[scores == 0] = -np.inf
        best, at = retrieval.Best(k), 0
        while at < n:
            step = int(rng.integers(1, 12))
            best.add(scores[:, at : at + step], chunks[at : at + step])
            at += step
        got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.chunk.tolist(), strict=True))
        want = [(q, -s, c) for q in range(3) for s, c in sorted(((s, c) for s, c in zip(scores[q].tolist(), chunks, strict=True) if s > 0), key=lambda x: (-x[0], x[1]))[:k]]
        assert got == sorted(want)


def test_sparse_vectors_and_bm25_in_blocks(spark):
    chunks = spark.createDataFrame([(1, "a", "red red fish"), (1, "b", "blue fish"), (2, "c", "red"), (2, "d", ""), (2, "e", None)], "kb_id int, chunk_id string, content string")
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["red fish", "blue", "", "none"])], "query_id long, query string")
    one, many = (sorted(map(tuple, retrieval.bm25_best(queries, chunks, 3, block=b).collect())) for b in (1, 100))
    assert one == many and {(q, c) for q, _, c, _ in many} == {(0, "a"), (0, "b"), (0, "c"), (1, "b")}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    weight = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 2))
    assert {c: s for q, _, c, s in many if q == 0}["a"] == pytest.approx(idf(2) * (weight(2, 3) + weight(1, 3)), abs=1e-6)
    as_vector = lambda d, key, t: d.select(*key, F.map_from_arrays(F.array_distinct(F.split(t, " ")), F.transform(F.array_distinct(F.split(t, " ")), lambda x: F.lit(1.5))).alias("vector"))
    got = retrieval.sparse_best(as_vector(queries.filter("query <> ''"), ["query_id"], "query"), as_vector(chunks.filter("content <> ''"), ["kb_id", "chunk_id"], "content"), 1)
    assert sorted(map(tuple, got.collect())) == [(0, 1, "a", 4.5), (0, 2, "c", 2.25), (1, 1, "b", 2.25)]
    assert retrieval.sparse_topk(got, 1).filter("query_id = 0").first()["chunk_id"] == "a"
    assert retrieval.lexical_best(queries.limit(0), chunks, 3).count() == 0 and retrieval.bm25_best(queries, chunks.limit(0), 3).count() == 0


def test_retriever_modes(spark):
    assert [pipeline.sparse_kind(r, s, True) for r, s in (("dense", "hybrid"), ("hybrid_bm25", "hybrid"), ("hybrid_sparse", "hybrid"), ("hybrid_bm25", "exact"), ("hybrid_rrf", "hybrid"))] == [None, "bm25", "learned", "lexical", "lexical"]
    assert pipeline.sparse_kind("hybrid_sparse", "hybrid", False) == "lexical"
    rows = [(1, i, f"d{i}.txt", f"d{i}", "x", "y", t) for i, t in enumerate(["pump repair manual", "cleaning schedule of floors", "pump purchase contract"])]
    docs = spark.createDataFrame(rows, "kb_id int, document_id long, file_name string, title string, department string, doc_type string, text string")
    queries = spark.createDataFrame([(1, "pump repair"), (2, "你好")], "query_id long, query string")
    words = lambda d, key, t: d.select(key, F.map_from_arrays(F.array_distinct(F.split(t, " ")), F.transform(F.array_distinct(F.split(t, " ")), lambda x: F.lit(1.0))).alias("vector"))
    corpus = pipeline.Corpus.build(docs, sparse=lambda c: words(c, "chunk_id", "content"))
    hits = pipeline.Hits.find(queries, corpus, 5, kinds=("lexical", "bm25", "learned"), sparse=lambda q: words(q, "query_id", "query"))
    for mode in ("dense", "hybrid_rrf", "hybrid_bm25", "hybrid_sparse"):
        got = {r.query_id: r for r in pipeline.retrieve(hits, corpus, Retrieval(mode, retriever=mode, rerank=True), "hybrid").collect()}
        assert got[1].document_ids[0] == 0 and got[1].intent == "retrieval"
        assert got[2].intent == "chitchat" and got[2].parent_ids == [] and got[2].confidence == 1.0


def test_a_single_candidate_is_not_reranked(spark):
    rows = spark.createDataFrame([(1, "pump", "a", "pump text", 1), (2, "pump", "b", "pump text", 1), (2, "pump", "c", "text", 2)], "query_id long, query string, chunk_id string, content string, in_rank int")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("rrf_score", "dense_score", "sparse_score")})
    got = {r.chunk_id: r.rerank_score for r in providers.gated_reranker("local")(rows, 5).collect()}
    assert got["a"] is None and got["b"] > got["c"]


def test_filters_reach_the_scan(spark, sf_dir):
    rows = filters.pushed(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"lang": ["de", "it's"], "n_chars": {"$gte": 10}})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(lang, [de,it's])" in plan and "GreaterThanOrEqual(n_chars,10)" in plan
    assert filters.pushdown_text({"a": "", "b": [None, ""], "c": {"$gt": None}}) == ""


# Previews and states


def test_preview_stores_nothing(spark):
    docs = spark.createDataFrame([(7, 5, "手册 2024-03.txt", "操作 XY-100\n\nsecond line")], "kb_id int, document_id long, file_name string, text string")
    chunks, said = chunking.preview(docs)
    assert {(r.kb_id, r.document_id) for r in chunks.collect()} == {(0, 0)}
    r = said.first()
    assert r.sample == "操作 XY-100\nsecond line" and r.suggested.doc_type == "设备手册" and r.suggested.equipment_model == "XY-100"


def test_a_failed_batch_is_logged(spark, tmp_path):
    schema = "kb_id int, document_id long, file_name string, text string"

    class Broken(buckets.BucketStore):
        def replace(self, *args, **kwargs):
            raise OSError("disk full")

    store = Broken(spark, f"file://{tmp_path}/chunks", tables=ingest.CHUNK_TABLES)
    spark.createDataFrame([(1, 1, "a.txt", "one")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="disk full"):
        ingest.ingest(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, store, f"{tmp_path}/cp", f"{tmp_path}/stages").awaitTermination()
    log = spark.read.schema(ingest.STAGE_SCHEMA).parquet(f"{tmp_path}/stages")
    assert [r.stage for r in log.orderBy("at").collect()] == ["embedding", "parsing", "chunking", "chunked", "storing", "failed"]
    assert [(r.stage, r.progress) for r in ingest.states(log).collect()] == [("failed", 80)]
