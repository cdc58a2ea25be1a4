"""The registered queries over the test tables: a knowledge base is a source, a department a language."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metadata
from corpusloom.functions import text as X
from corpusloom.operators import changes, chunking, evaluation, filters, ranking, records, retrieval, routing, segmentation
from corpusloom.plans import pipeline
from corpusloom.schemas import ABLATION, Budgets, Retrieval
from corpusloom.session import new_path
from corpusloom.sources import postings, readers
from corpusloom.sources.buckets import BucketStore
from corpusloom.sources.kept_profiles import KeptProfiles, Rows
from corpusloom.sources.pages import PagedTable
from corpusloom.sources.stores import make_store
from corpusloom.sources.vector_index import VectorIndex
from corpusloom.streaming import ingest

#: What the events' types stand for as steps of an ingestion.
_STEPS = {"signup": "submitted", "view": "parsing", "click": "chunking", "purchase": "indexed", "error": "error"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.substring("source", 4, 10).cast("int").alias("kb_id"), F.col("doc_id").alias("document_id"), name.alias("file_name"), X.stem(name).alias("title"),
        F.col("lang").alias("department"), F.col("source").alias("doc_type"), "text", "n_chars",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, for operators that are compared with SQL."""
    return documents(spark, sf_dir).select("kb_id", F.col("document_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), "department")


# Filters


@query
def scan_filter_scalar(spark, sf_dir):
    return filters.apply_filters(documents(spark, sf_dir), {"department": "fr", "kb_id": 3}).select("document_id", "file_name")


@query
def filter_membership_null(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("department", F.nullif("department", F.lit("en")))
    return filters.apply_filters(rows, {"department": ["de", ""]}).select("document_id", "department")


@query
def filter_range_ops(spark, sf_dir):
    return filters.apply_filters(documents(spark, sf_dir), {"n_chars": {"$gte": 500, "$lt": 1500, "$ne": 700, "$unknown": 1}}).select("document_id", "n_chars")


@query
def filter_pushdown(spark, sf_dir):
    """Filters as SQL text; what is null or empty is left out."""
    wanted = {"lang": ["de", "", None, "it's"], "n_chars": {"$gte": 500, "$lt": 5000, "$ne": None}, "source": ""}
    return filters.pushed(table(spark, sf_dir, "documents"), wanted).select("doc_id", "lang")


@query
def permission_filter(spark, sf_dir):
    wanted = filters.permitted({"department": ["fr", "de", "es"]}, ["en", "es", "de"])
    return filters.apply_filters(documents(spark, sf_dir), wanted).select("document_id", "department")


@query
def superuser_bypass(spark, sf_dir):
    rows = documents(spark, sf_dir)
    none = filters.apply_filters(rows, filters.permitted({"department": "fr"}, ["en"])).withColumn("who", F.lit("user"))
    every = filters.apply_filters(rows, filters.permitted({"department": "fr"}, ["en"], superuser=True)).withColumn("who", F.lit("superuser"))
    return none.unionByName(every).select("who", "document_id")


@query
def ttl_filter(spark, sf_dir):
    now = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    return filters.expired(table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz")), now, 24, "at").select("o_orderkey")


# Text


def _tokens(spark, sf_dir, tokens):
    return items(spark, sf_dir).select("query_id", F.array_join(tokens(F.col("query")), " ").alias("tokens"))


@query
def tokenize_query(spark, sf_dir):
    return _tokens(spark, sf_dir, X.query_tokens)


@query
def tokenize_profile(spark, sf_dir):
    return _tokens(spark, sf_dir, X.profile_tokens)


@query
def tokenize_rerank(spark, sf_dir):
    return _tokens(spark, sf_dir, X.rerank_tokens)


@query
def segment_lines(spark, sf_dir):
    return chunking.line_segments(documents(spark, sf_dir)).select("document_id", "seg_no", "text", "section_path")


@query
def child_hard_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("document_id", F.posexplode(chunking.hard_split(F.col("text"), 350)).alias("piece_no", "piece"))
    return rows


@query
def stable_ids(spark, sf_dir):
    key = X.sha256_of(F.lit("parent"), F.col("kb_id"), F.col("document_id"), F.lit(0), F.col("text"))
    return documents(spark, sf_dir).select("document_id", key.alias("stable_id"), X.sha256_of(F.col("kb_id"), F.col("file_name"), F.sha2("text", 256), sep=":").alias("chunk_key"))


@query
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.sha2("text", 256).alias("content_hash"))


@query
def file_names(spark, sf_dir):
    name = F.col("file_name")
    return documents(spark, sf_dir).select("document_id", X.stem(name).alias("stem"), X.extension(name).alias("extension"), X.mime_type(name).alias("mime"), X.clean_file_name(F.concat(F.lit("a b/"), name)).alias("clean"))


@query
def clause_starts(spark, sf_dir):
    """Every document's text behind the clause number that its id spells."""
    text = F.concat((F.col("document_id") % 7).cast("string"), F.when(F.col("document_id") % 3 == 0, ".").otherwise(" "), F.col("document_id").cast("string"), F.lit(" "), "text")
    return documents(spark, sf_dir).select("document_id", X.clause_number(text).alias("clause"), X.section_path(F.array(F.lit("a"), F.lit("b")), text).alias("section_path"))


@query
def page_text(spark, sf_dir):
    return readers.pages_text(table(spark, sf_dir, "pages"))


# Chunks and changes


@query
def parent_chunks(spark, sf_dir):
    rows = chunking.parents(chunking.line_segments(documents(spark, sf_dir)))
    return rows.select("document_id", "parent_index", "content", "section_path", "parent_id")


@query
def parent_chunks_scanned(spark, sf_dir):
    """The same parents, by buckets of lines in place of whole documents."""
    rows = segmentation.parents(chunking.line_segments(documents(spark, sf_dir)), bucket=64)
    return rows.select("document_id", "parent_index", "content", "section_path", "parent_id")


@query
def child_chunks(spark, sf_dir):
    rows = chunking.children(chunking.parents(chunking.line_segments(documents(spark, sf_dir)), Budgets.for_ingestion()), Budgets.for_ingestion())
    return rows.select("document_id", "parent_index", "child_index", "content", "chunk_id")


@query
def chunk_preview(spark, sf_dir):
    """What a document's upload would suggest, and the sample that it is suggested from."""
    _, said = chunking.preview(documents(spark, sf_dir))
    return said.select("document_id", "sample", "suggested.doc_type", "suggested.title")


@query
def preview_chunks(spark, sf_dir):
    """The chunks that an upload would have, under the ids of nothing that is stored."""
    found, _ = chunking.preview(documents(spark, sf_dir))
    return found.select("upload", "document_id", "parent_index", "child_index", F.sha2("content", 256).alias("content_hash"), "chunk_id")


@query
def heading_paths(spark, sf_dir):
    """Every third line of a document as a heading, of a level that its length tells."""
    lines = chunking.line_segments(documents(spark, sf_dir))
    level = F.when(F.col("seg_no") % 3 == 0, F.length("text") % 6 + 1)
    return chunking.heading_paths(lines, F.col("section_path"), level).select("document_id", "seg_no", "section_path")


def _two_versions(spark, sf_dir):
    """Lines of every document as they are, and without each seventh, which is a new one instead."""
    old = chunking.line_segments(documents(spark, sf_dir)).select("document_id", F.col("seg_no").cast("long").alias("index"), "text")
    new = old.withColumn("text", F.when(F.col("index") % 7 == 3, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))).filter("index % 5 <> 4")
    hashed = lambda d: d.withColumn("content_hash", F.sha2("text", 256)).drop("text")
    return hashed(old).withColumn("uuid", F.concat_ws("-", "document_id", "index")), hashed(new)


@query
def chunk_diff_add(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return changes.to_add(new, old, ["document_id", "content_hash"])


@query
def chunk_diff_delete(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return changes.to_delete(new, old, ["document_id", "content_hash"])


@query
def chunk_diff_banded(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return changes.banded_diff(old, new, scope=["document_id"]).withColumn("index", F.coalesce("index", F.lit(-1).cast("long")))


@query
def ingested_parents(spark, sf_dir):
    """Parents in a store of chunks: every document, then a quarter again with new texts, while a tenth goes."""
    docs = documents(spark, sf_dir)
    store = BucketStore(spark, new_path(spark, "chunks"), tables=ingest.CHUNK_TABLES)

    def put(rows: DataFrame, gone: DataFrame | None = None) -> None:
        parents = chunking.parents(chunking.line_segments(rows))
        store.replace({"parents": parents, "children": chunking.children(parents)}, gone)

    put(docs)
    put(docs.filter("document_id % 4 = 0").withColumn("text", F.concat(F.lit("Again. "), F.substring("text", 1, 600))), docs.filter("document_id % 10 = 7"))
    kids = store.read("children").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return store.read("parents").join(kids, "parent_id").select("document_id", "parent_index", "content", "parent_id", (F.col("n_children") > 0).alias("has_children"))


@query
def dup_probe(spark, sf_dir):
    """Uploads of every document, a third under another name, against the documents of even id."""
    rows = documents(spark, sf_dir).select("kb_id", "document_id", "file_name", F.sha2("text", 256).alias("file_hash"))
    name = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("copy_"), "file_name")).otherwise(F.col("file_name"))
    return changes.not_yet_known(rows.withColumn("file_name", name), rows.filter("document_id % 2 = 0")).select("document_id", "file_name")


@query
def exact_dup_groups(spark, sf_dir):
    rows = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("content_hash"))
    return rows.agg(F.count("*").alias("n"), F.min("document_id").alias("first_id")).filter("n > 1")


@query
def upsert_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("document_id", "file_name", F.lit(1).alias("version"))
    newer = rows.filter("document_id % 4 = 0").withColumn("version", F.lit(2)).unionByName(rows.filter("document_id % 8 = 0").withColumn("version", F.lit(3)))
    return changes.merge_by_key(rows, newer, ["document_id"], "version")


@query
def insert_not_exists(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return changes.insert_missing(nation.filter("n_nationkey < 20"), nation, ["n_nationkey"])


@query
def delete_in(spark, sf_dir):
    doomed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return changes.delete_in(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), doomed, "o_custkey")


@query
def update_where(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return changes.update_where(rows, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("OVERDUE"), "c_acctbal": F.lit(0.0)})


# Search


def _told(hits: DataFrame, score: str = "dense_score") -> DataFrame:
    """Scores as the results show them; they are ranked before."""
    return hits.withColumn(score, F.round(score, 6))


@query
def hash_embedding(spark, sf_dir):
    rows = retrieval.hash_embedding(items(spark, sf_dir), "query_id", "query")
    return rows.select("query_id", "idx", F.round("weight", 6).alias("weight"))


@query
def hash_cosine_topk(spark, sf_dir):
    found = retrieval.hash_vectors(chunks(spark, sf_dir).select("kb_id", "chunk_id", "content"), "chunk_id", "content")
    return _told(retrieval.dense_topk(retrieval.hash_vectors(items(spark, sf_dir), "query_id", "query"), found, 3))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    stored = rows.select(F.col("label").alias("kb_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "embedding", "vec_id")
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), stored


@query
def dense_topk_per_kb(spark, sf_dir):
    asked, stored = _vectors(spark, sf_dir)
    return _told(retrieval.concatenated(retrieval.dense_topk(asked, stored, 5), "dense_rank"))


@query
def vector_index_topk(spark, sf_dir):
    """The same nearest vectors by a clustered index, which is written in two parts."""
    asked, stored = _vectors(spark, sf_dir)
    index = VectorIndex(spark, new_path(spark, "vector_index"))
    index.put(stored.filter("vec_id % 5 <> 4"))
    index.put(stored.filter("vec_id % 5 = 4"))
    return _told(index.search(asked, 5))


@query
def vector_index_filtered(spark, sf_dir):
    """Customers nearest by balance, nation and key in three dimensions, of two segments; some are deleted before."""
    rows = table(spark, sf_dir, "customer")
    at = F.array((F.col("c_acctbal") / 1000).cast("double"), (F.col("c_nationkey") - 12).cast("double"), (F.col("c_custkey") % 97 - 48).cast("double"))
    rows = rows.select(F.lit(1).alias("kb_id"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("chunk_id"), "c_custkey", F.col("c_mktsegment").alias("segment"), at.alias("embedding"))
    index = VectorIndex(spark, new_path(spark, "vector_index"))
    index.put(rows)
    index.delete(rows.filter("c_custkey % 10 = 3"))
    index.delete_where({"segment": "MACHINERY"})
    asked = rows.filter("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), "embedding")
    return _told(index.search(asked, 4, {"segment": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}))


@query
def store_changes(spark, sf_dir):
    """A vector store after two puts, of which the second replaces a third, and deletions by chunk and by filter."""
    _, stored = _vectors(spark, sf_dir)
    rows = stored.select("kb_id", "chunk_id", "vec_id", F.lit("first").alias("content"), "embedding")
    store = make_store("exact", spark, new_path(spark, "store"))
    store.put(rows)
    store.put(rows.filter("vec_id % 3 = 0").withColumn("content", F.lit("second")))
    store.delete(rows.filter("vec_id % 7 = 0"))
    store.delete_where({"kb_id": 2, "content": "first"})
    return store.read().select("kb_id", "chunk_id", "content")


@query
def dense_topk_filtered(spark, sf_dir):
    asked, stored = _vectors(spark, sf_dir)
    return _told(retrieval.dense_topk(asked, filters.apply_filters(stored, {"vec_id": {"$gte": 100}, "kb_id": [1, 2, 3]}), 5))


@query
def dense_postfilter(spark, sf_dir):
    asked, stored = _vectors(spark, sf_dir)
    kept = filters.apply_filters(stored, {"vec_id": {"$gte": 100}})
    return _told(retrieval.dense_topk(asked, stored, 5).join(kept.select("chunk_id"), "chunk_id", "left_semi"))


@query
def lexical_topk(spark, sf_dir):
    return retrieval.lexical_topk(items(spark, sf_dir), chunks(spark, sf_dir), 20)


@query
def bm25_topk(spark, sf_dir):
    return _told(retrieval.bm25_topk(items(spark, sf_dir), chunks(spark, sf_dir), 20), "sparse_score").select("query_id", "chunk_id", "sparse_score")


@query
def bm25_analyzer(spark, sf_dir):
    """BM25 of the terms of another analyzer."""
    found = retrieval.bm25_best(items(spark, sf_dir), chunks(spark, sf_dir), 5, analyzer="english")
    return _told(found, "sparse_score").select("query_id", "kb_id", "chunk_id", "sparse_score")


@query
def bm25_index_topk(spark, sf_dir):
    """BM25 from a stored index, which is built once for all queries."""
    index = postings.bm25_index(chunks(spark, sf_dir).withColumn("kb_id", F.lit(0)), new_path(spark, "bm25_index"))
    return _told(postings.bm25_search(items(spark, sf_dir), index, 20), "sparse_score").select("query_id", "chunk_id", "sparse_score")


@query
def bm25_index_analyzer(spark, sf_dir):
    """The same of another analyzer's terms, for each knowledge base."""
    index = postings.bm25_index(chunks(spark, sf_dir), new_path(spark, "bm25_index"), analyzer="english")
    return _told(postings.bm25_search(items(spark, sf_dir), index, 5, analyzer="english"), "sparse_score").select("query_id", "kb_id", "chunk_id", "sparse_score")


def _sparse_vectors(spark, sf_dir):
    """The vectors' positive components, as a sparse encoder would give them."""
    cells = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("term"), x.cast("double").alias("weight"))), lambda c: c["weight"] > 0)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_entries(cells).alias("vector"))
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return asked, vectors.select(F.lit(0).alias("kb_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "vector")


@query
def sparse_index_topk(spark, sf_dir):
    """Inner products of learned sparse vectors from a stored index."""
    asked, stored = _sparse_vectors(spark, sf_dir)
    hits = postings.sparse_search(asked, postings.sparse_index(stored, new_path(spark, "sparse_index")), 20)
    return _told(retrieval.sparse_topk(hits, 20), "sparse_score").select("query_id", "chunk_id", "sparse_score", "sparse_rank")


@query
def learned_sparse(spark, sf_dir):
    """Inner products of the vectors' positive components, as a sparse encoder would give them."""
    cells = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("term"), x.cast("double").alias("weight"))), lambda c: c["weight"] > 0)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_entries(cells).alias("vector"))
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    stored = vectors.select(F.lit(0).alias("kb_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "vector")
    return _told(retrieval.sparse_topk(retrieval.sparse_best(asked, stored, 20), 20), "sparse_score").select("query_id", "chunk_id", "sparse_score", "sparse_rank")


@query
def direct_kb_query(spark, sf_dir):
    """The three nearest documents of one knowledge base, without permissions, as an API key's holder gets them."""
    rows = chunks(spark, sf_dir).filter("kb_id = 3")
    found = retrieval.hash_vectors(rows.select("kb_id", "chunk_id", "content"), "chunk_id", "content")
    asked = retrieval.hash_vectors(items(spark, sf_dir), "query_id", "query")
    return _told(retrieval.dense_topk(asked, found, 3)).select("query_id", "chunk_id", "dense_score", "dense_rank")


# Ranking


def _two_lists(spark, sf_dir):
    lexical = retrieval.lexical_topk(items(spark, sf_dir), chunks(spark, sf_dir), 10).withColumn("pos", F.col("lexical_rank"))
    sparse = retrieval.bm25_topk(items(spark, sf_dir), chunks(spark, sf_dir), 10).withColumn("pos", F.col("sparse_rank"))
    return lexical, sparse


@query
def rrf_fusion(spark, sf_dir):
    return ranking.reciprocal_rank_fusion(list(_two_lists(spark, sf_dir)), 60).withColumn("rrf_score", F.round("rrf_score", 9))


def _lexical_candidates(spark, sf_dir):
    none = F.lit(None).cast("double")
    hits = retrieval.lexical_topk(items(spark, sf_dir), chunks(spark, sf_dir), 10)
    rows = hits.join(items(spark, sf_dir), "query_id").join(chunks(spark, sf_dir), "chunk_id")
    return rows.withColumns({"in_rank": F.col("lexical_rank"), "rrf_score": F.lit(1.0) / (60 + F.col("lexical_rank")), "dense_score": none, "sparse_score": none})


@query
def rerank_local(spark, sf_dir):
    return ranking.rerank_local(_lexical_candidates(spark, sf_dir), 4).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@query
def parent_dedup(spark, sf_dir):
    """Documents as children of a parent of ten documents; parents of an even number are stored, others fall back."""
    rows = _lexical_candidates(spark, sf_dir).withColumn("parent_id", F.concat(F.lit("p"), F.floor(F.col("chunk_id").cast("long") / 10).cast("string")))
    rows = rows.select("query_id", F.col("in_rank").alias("rank"), "chunk_id", "parent_id", "content", F.col("lexical_score").alias("score"))
    stored = documents(spark, sf_dir).filter("document_id % 20 = 0").select(F.concat(F.lit("p"), F.floor(F.col("document_id") / 10).cast("string")).alias("parent_id"), F.concat(F.lit("stored "), "file_name").alias("content"))
    out = ranking.collapse_to_parents(rows, stored, 5)
    return out.withColumns({"child_ids": F.array_join("child_ids", ","), "matched_children": F.array_join("matched_children", ",")})


@query
def confidence(spark, sf_dir):
    """From each event's value as one of the five scores."""
    e = table(spark, sf_dir, "events")
    score = lambda k: F.when(F.col("event_id") % 6 == k, F.col("value") / F.lit(25.0))
    conf = ranking.confidence(score(0), score(1) / F.lit(60.0), score(2), score(3), score(4), 60, F.col("event_id") % 11 != 0)
    return e.select("event_id", F.round(conf, 6).alias("confidence"))


def _supported(spark, sf_dir):
    rows = _lexical_candidates(spark, sf_dir).groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("in_rank", "content"))).alias("c"))
    rows = items(spark, sf_dir).join(rows.drop("query"), "query_id", "left").withColumn("contexts", F.coalesce(F.col("c.content"), F.array().cast("array<string>")))
    return rows.withColumn("support", F.round(ranking.query_support(F.col("query"), F.col("contexts")), 6))


@query
def query_support(spark, sf_dir):
    return _supported(spark, sf_dir).select("query_id", "support")


@query
def refusal_reason(spark, sf_dir):
    conf = F.round((F.col("query_id") % 10) / F.lit(10.0), 4)
    rows = _supported(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 4 == 0, F.concat("query", F.lit(" 编造"))).otherwise(F.col("query")))
    reason = ranking.refusal_reason(F.col("query"), F.lit("retrieval"), F.size("contexts"), conf, F.col("support"), Retrieval(support_threshold=0.9))
    return rows.select("query_id", reason.alias("reason"))


# Routing


def _kbs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.substring("source", 4, 10).cast("int").alias("kb_id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("description")
    )


def _profiles(spark, sf_dir):
    parents = documents(spark, sf_dir).select("kb_id", "document_id", F.lit(0).alias("parent_index"), F.col("text").alias("content"))
    return routing.profiles(_kbs(spark, sf_dir), documents(spark, sf_dir), parents)


@query
def kb_profile(spark, sf_dir):
    return _profiles(spark, sf_dir).select("kb_id", "document_count", F.array_join("departments", ",").alias("departments"), F.array_join("titles", ",").alias("titles"), "summary")


def _kept_profiles(spark, sf_dir):
    """Built from every document; then two knowledge bases and parts of others go, and a third has new texts and a confirmed
    department."""
    rows_of = lambda docs: Rows(docs, docs.select("kb_id", "document_id", F.lit(0).alias("parent_index"), F.col("text").alias("content")))
    docs = documents(spark, sf_dir)
    kept = KeptProfiles(spark, new_path(spark, "profiles"))
    kept.build(rows_of(docs))
    stay, again = (F.col("document_id") % 10 != 7) & (F.col("document_id") % 11 != 7), F.col("document_id") % 3 == 0
    newer = docs.filter(stay & again).withColumn("text", F.concat(F.lit("Again "), "text")).withColumn("department", F.lit("confirmed"))
    kept.change(rows_of(newer), rows_of(docs.filter(~stay | again)), rows_of(docs.filter(stay & ~again).unionByName(newer)))
    return kept


@query
def kept_profile(spark, sf_dir):
    p = _kept_profiles(spark, sf_dir).profiles(_kbs(spark, sf_dir))
    return p.select("kb_id", "document_count", F.array_join("departments", ",").alias("departments"), F.array_join("titles", ",").alias("titles"), "summary")


@query
def kept_keywords(spark, sf_dir):
    return _kept_profiles(spark, sf_dir).keywords()


def _keywords(spark, sf_dir, **how):
    p = _profiles(spark, sf_dir).withColumn("t", F.concat_ws(" ", "name", F.array_join("titles", " "), "sample"))
    return routing.keywords(p, "kb_id", "t", **how)


@query
def kb_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir)


@query
def kb_keywords_by_frequency(spark, sf_dir):
    return _keywords(spark, sf_dir, by_frequency=True)


def _profile_texts(spark, sf_dir):
    return routing.profile_text(_profiles(spark, sf_dir), _keywords(spark, sf_dir))


@query
def profile_match(spark, sf_dir):
    return routing.match_profiles(items(spark, sf_dir), _profile_texts(spark, sf_dir)).withColumn("matched_terms", F.array_join("matched_terms", ","))


@query
def route_heuristic(spark, sf_dir):
    return routing.route(items(spark, sf_dir), _profile_texts(spark, sf_dir)).withColumn("domain", F.array_join("domain", ","))


@query
def merge_candidates(spark, sf_dir):
    ids = lambda *xs: F.array(*[F.col("query_id") % x for x in xs])
    merged = routing.merge_candidates(ids(7, 5), ids(5, 3), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]))
    return items(spark, sf_dir).select("query_id", F.array_join(F.transform(merged, lambda x: x.cast("string")), ",").alias("kb_ids"))


@query
def resolve_names(spark, sf_dir):
    names = spark.range(30).select(F.element_at(F.array(F.lit("src"), F.lit("kb_"), F.lit("about src")), (F.col("id") % 3 + 1).cast("int")).alias("a"), "id")
    return routing.resolve_names(names.select(F.concat("a", F.col("id").cast("string")).alias("name")), _kbs(spark, sf_dir))


# Evaluation


def _relevant(spark, sf_dir):
    asked = items(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
    return pipeline.containing(documents(spark, sf_dir).select("document_id", "text"), asked)


@query
def relevance(spark, sf_dir):
    return _relevant(spark, sf_dir)


def _judged(spark, sf_dir):
    """The lexical ranking of documents and the documents that contain the item."""
    hits = retrieval.lexical_topk(items(spark, sf_dir), chunks(spark, sf_dir), 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("lexical_rank", "chunk_id"))).alias("h"))
    want = _relevant(spark, sf_dir).groupBy(F.col("item_id").alias("query_id")).agg(F.collect_set(F.col("document_id").cast("string")).alias("relevant"))
    rows = items(spark, sf_dir).join(hits, "query_id", "left").join(want, "query_id", "left")
    texts = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce(F.col("h.chunk_id"), texts).alias("retrieved"), F.coalesce("relevant", texts).alias("relevant"))


@query
def recall_at_5(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(evaluation.recall_at(F.col("retrieved"), F.col("relevant"), 5), 6).alias("recall"))


@query
def mrr(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(evaluation.reciprocal_rank(F.col("retrieved"), F.col("relevant")), 6).alias("rr"))


@query
def ndcg_at_10(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(evaluation.ndcg_at(F.col("retrieved"), F.col("relevant"), 10), 6).alias("ndcg"))


@query
def p95_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config")).agg(evaluation.nearest_rank("value", 0.95).alias("p95_latency_ms"), F.count("*").alias("n"))


@query
def exact_percentiles(spark, sf_dir):
    """The percentile by closing in on it; no task sorts more than 200 values of a group."""
    parts = [evaluation.exact_percentile(table(spark, sf_dir, "events"), "event_type", "value", p, small=200).withColumn("p", F.lit(p)) for p in (0.05, 0.5, 0.95)]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("event_type"), F.col("l_quantity").cast("double").alias("value"))
    parts.append(evaluation.exact_percentile(lines, "event_type", "value", 0.9, small=200).withColumn("p", F.lit(0.9)))
    return reduce(DataFrame.unionByName, parts)


@query
def evaluation_report(spark, sf_dir):
    """Events as results: the value is the latency, its parity and user tell the rest."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), (F.col("event_id") % 3 > 0).alias("answerable"), (F.col("event_id") % 5 > 0).alias("labeled"), ((F.col("user_id") % 4) / 4.0).alias("recall"),
        ((F.col("user_id") % 8) / 8.0).alias("rr"), ((F.col("user_id") % 16) / 16.0).alias("ndcg"), F.col("value").alias("latency_ms"), (F.col("user_id") % 2 == 0).alias("refused"),
    )
    return evaluation.report(e)


@query
def dataset_summary(spark, sf_dir):
    todo = F.when(F.col("query_id") % 6 == 0, F.lit("TODO_1")).otherwise(F.col("query_id").cast("string"))
    rows = items(spark, sf_dir).select((F.col("query_id") % 4 != 0).alias("answerable"), F.when(F.col("query_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(todo)).alias("relevant_parent_ids"))
    return evaluation.summary(rows)


@query
def label_counts(spark, sf_dir):
    return evaluation.value_counts(table(spark, sf_dir, "labels"), "quality")


def _search(spark, sf_dir):
    corpus = pipeline.Corpus.build(documents(spark, sf_dir), Budgets.for_ingestion())
    return corpus, pipeline.Hits.find(items(spark, sf_dir), corpus, max(c.candidates for c in ABLATION), profiles=_profile_texts(spark, sf_dir))


@query
def ablation_report(spark, sf_dir):
    corpus, hits = _search(spark, sf_dir)
    want = _relevant(spark, sf_dir).groupBy(F.col("item_id").alias("query_id")).agg(F.collect_set("document_id").alias("relevant"))
    return pipeline.ablation(hits, corpus, want, ABLATION)


@query
def retrieval_pipeline(spark, sf_dir):
    corpus, hits = _search(spark, sf_dir)
    out = pipeline.retrieve(hits, corpus, ABLATION[-1])
    return out.select("query_id", "intent", F.array_join("parent_ids", ",").alias("parent_ids"), F.round("confidence", 6).alias("confidence"), F.round("support", 6).alias("support"), "refusal_reason")


def _retrieved(out: DataFrame) -> DataFrame:
    return out.select("query_id", F.array_join("parent_ids", ",").alias("parent_ids"), F.round("confidence", 6).alias("confidence"), F.round("support", 6).alias("support"))


@query
def retrieval_bm25(spark, sf_dir):
    """Dense ranks fused with BM25 from a stored index, reranked."""
    corpus = pipeline.Corpus.build(documents(spark, sf_dir), Budgets.for_ingestion()).indexed(("bm25",))
    config = Retrieval("bm25", retriever="hybrid_bm25", rerank=True, top_k=5, candidates=10, refusal=False)
    hits = pipeline.Hits.find(items(spark, sf_dir), corpus, config.candidates, kinds=("bm25",))
    return _retrieved(pipeline.retrieve(hits, corpus, config, store="hybrid"))


@query
def retrieval_learned(spark, sf_dir):
    """Dense ranks fused with learned sparse vectors from a stored index; a term's weight is one and the logarithm of its count."""

    def weights(rows: DataFrame, key: str, text: str) -> DataFrame:
        counted = retrieval.term_counts(rows.select(key, *[c for c in ("kb_id",) if c in rows.columns], text), key, text)
        return counted.withColumn("vector", F.map_from_arrays("terms", F.transform("times", lambda n: 1 + F.log(n)))).drop("terms", "times")

    corpus = pipeline.Corpus.build(documents(spark, sf_dir), Budgets.for_ingestion(), sparse=lambda rows: weights(rows, "chunk_id", "content")).indexed(("learned",))
    config = Retrieval("learned", retriever="hybrid_sparse", top_k=5, candidates=10, refusal=False)
    hits = pipeline.Hits.find(items(spark, sf_dir), corpus, config.candidates, kinds=("learned",), sparse=lambda rows: weights(rows, "query_id", "query"))
    return _retrieved(pipeline.retrieve(hits, corpus, config, store="hybrid"))


@query
def trial_retrieval(spark, sf_dir):
    """A trial of one knowledge base: four times as many candidates as results, reranked."""
    rows = documents(spark, sf_dir).filter("kb_id = 3")
    corpus = pipeline.Corpus.build(rows, Budgets.for_ingestion())
    config = Retrieval("trial", retriever="hybrid_rrf", rerank=True, top_k=5, candidates=20, refusal=False)
    out = pipeline.retrieve(pipeline.Hits.find(items(spark, sf_dir), corpus, config.candidates), corpus, config)
    return out.select("query_id", F.array_join("parent_ids", ",").alias("parent_ids"), F.round("confidence", 6).alias("confidence"))


# Records


@query
def trace_latest(spark, sf_dir):
    return records.latest(filters.owned(table(spark, sf_dir, "events"), 7).select("event_id", "event_type", "value"), "event_id", 50)


@query
def trace_snapshot(spark, sf_dir):
    rows = _lexical_candidates(spark, sf_dir).withColumn("rank", F.col("lexical_rank"))
    return records.snapshot(rows).select("query_id", "chunk_id", "rank", "lexical_score", "preview")


@query
def trace_truncated(spark, sf_dir):
    rows = documents(spark, sf_dir).select("document_id", "text", F.split("text", " ").alias("words"))
    cut = {c: records.truncated(F.col(c), rows.schema[c].dataType) for c in ("text", "words")}
    return rows.select("document_id", cut["text"].alias("cut"), F.size(cut["words"]).cast("long").alias("n_items"))


@query
def trace_payload(spark, sf_dir):
    """A trace of each document, with a text in a structure in a list."""
    inner = F.array(F.struct(F.col("text").alias("body"), F.array("doc_type", "department").alias("tags")))
    rows = documents(spark, sf_dir).select("document_id", "file_name", inner.alias("parts"))
    return records.trace(rows, "document_id", F.expr("timestamp'1998-01-02 03:04:05'"))


@query
def scalar_variables(spark, sf_dir):
    """Orders of the customer with the largest balance, who is looked up as a variable."""
    owner = records.variable(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_acctbal").desc(), F.col("c_custkey"))
    return table(spark, sf_dir, "orders").filter(F.col("o_custkey") <= owner).select("o_orderkey", "o_custkey", owner.alias("owner"))


@query
def first_lookup(spark, sf_dir):
    return records.first_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("n_regionkey") == 1, F.col("n_name"))


@query
def dashboard_counts(spark, sf_dir):
    return records.counts({"kbs": _kbs(spark, sf_dir), "documents": documents(spark, sf_dir), "questions": items(spark, sf_dir), "chats": table(spark, sf_dir, "conversations").select("conv_id").distinct()})


@query
def task_states(spark, sf_dir):
    """Orders as uploads, their lines as tasks."""
    return records.task_states(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "F", "O")


@query
def task_uploads(spark, sf_dir):
    """Tasks with the file they belong to, if it is still there."""
    files = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("file_name"))
    return table(spark, sf_dir, "orders").join(files, "o_custkey", "left").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), "file_name")


@query
def score_format(spark, sf_dir):
    share = (F.col("o_orderkey") % 97) / F.lit(97.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fixed(share, 3).alias("score"), X.percent(share).alias("share"), X.megabytes(F.col("o_orderkey") * 1000).alias("size"))


@query
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.iso(F.when(F.col("event_id") % 5 != 0, F.col("ts"))).alias("at"))


@query
def page_offset(spark, sf_dir):
    return records.page(documents(spark, sf_dir).select("document_id", "file_name"), "document_id", 20, 25)


@query
def page_zoned(spark, sf_dir):
    """A deep page of orders by date and key, of a table of which only the page's files are read."""
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    paged = PagedTable(spark, new_path(spark, "paged"), ["o_orderdate", "o_orderkey"]).write(rows, files=16)
    return paged.page(1000, 40)


@query
def chat_history_last6(spark, sf_dir):
    out = records.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return out.select("conv_id", F.array_join("turns", "\n").alias("turns"))


@query
def doc_kb_join(spark, sf_dir):
    kbs = _kbs(spark, sf_dir).filter("kb_id % 2 = 0")
    return documents(spark, sf_dir).join(kbs, "kb_id").select("document_id", "name")


@query
def kb_docs_left(spark, sf_dir):
    kbs = _kbs(spark, sf_dir).select("kb_id").unionByName(spark.range(1).select(F.lit(999).alias("kb_id")))
    out = records.nested(kbs, documents(spark, sf_dir), "kb_id", ["document_id"], "docs")
    return out.select("kb_id", F.array_join(F.transform("docs", lambda d: d["document_id"].cast("string")), ",").alias("docs"))


@query
def kb_semi(spark, sf_dir):
    kbs = _kbs(spark, sf_dir).select("kb_id").unionByName(spark.range(1).select(F.lit(999).alias("kb_id")))
    return kbs.join(documents(spark, sf_dir).filter("department = 'de'").select("kb_id"), "kb_id", "left_semi")


@query
def chat_kb_bridge(spark, sf_dir):
    """Customers and suppliers of a nation meet through it, as chats and knowledge bases do through their bridge."""
    bridge = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return c.join(bridge, "n_nationkey").join(s, "n_nationkey").select("c_custkey", "n_name", "n_suppliers")


@query
def citation_lookup(spark, sf_dir):
    """Documents of which each is cited three times, some under a wrong knowledge base."""
    rows = documents(spark, sf_dir)
    cited = rows.select(F.when(F.col("document_id") % 3 == 0, 999).otherwise(F.col("kb_id")).alias("kb_id"), "document_id", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return records.cited_documents(cited, documents(spark, sf_dir), _kbs(spark, sf_dir))


# Metadata and messages

_NAMES = ("QX-9000_2024年3月手册.docx", "采购合同 2023-11-05.pdf", "后勤运维报修工单.md", "notes.txt")


@query
def metadata_suggest(spark, sf_dir):
    name = F.concat(F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("document_id") % 4 + 1).cast("int")))
    s = metadata.suggest(name, F.col("text"))
    return documents(spark, sf_dir).select("document_id", s.alias("s")).select("document_id", "s.title", "s.doc_type", "s.department", "s.equipment_model", "s.effective_date")


@query
def metadata_merge(spark, sf_dir):
    confirmed = F.when(F.col("document_id") % 3 == 0, "").when(F.col("document_id") % 3 == 1, F.lit("confirmed"))
    return documents(spark, sf_dir).select("document_id", metadata.confirmed_or(confirmed, F.col("department")).alias("department"))


@query
def metadata_confirm(spark, sf_dir):
    """Lines take over what was confirmed of their documents, unless that is empty."""
    lines = chunking.line_segments(documents(spark, sf_dir)).join(documents(spark, sf_dir).select("document_id", "department"), "document_id")
    said = documents(spark, sf_dir).filter("document_id % 2 = 0").select("document_id", F.when(F.col("document_id") % 4 == 0, "").otherwise("后勤").alias("department"))
    return changes.propagate(lines.select("document_id", "seg_no", "department"), said, "document_id", ["department"])


@query
def reindex_documents(spark, sf_dir):
    """Documents of even id come again with the first of their lines alone."""
    lines = chunking.line_segments(documents(spark, sf_dir)).select("document_id", "seg_no", "text")
    return changes.replace_documents(lines, lines.filter("document_id % 2 = 0 and seg_no = 0"))


@query
def envelope_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("context", F.to_json(F.struct("conv_id", "turn")))
    rows = rows.withColumn("message", X.envelope(F.col("context"), F.col("text")))
    return rows.select("conv_id", "turn", F.length("message").cast("long").alias("size"), X.envelope_context(F.col("message")).alias("context"), X.envelope_answer(F.col("message")).alias("answer"))


@query
def citation_rewrite(spark, sf_dir):
    mark = F.element_at(F.array(F.lit("[[citation:"), F.lit("[citation:"), F.lit("[[Citation:")), (F.col("doc_id") % 3 + 1).cast("int"))
    end = F.when(F.col("doc_id") % 3 == 1, "]").otherwise("]]")
    text = F.concat("text", F.lit(" "), mark, F.col("doc_id").cast("string"), end, F.lit(" <think>x</think>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.fence_thoughts(X.link_citations(text)).alias("text"))


@query
def router_json(spark, sf_dir):
    domain = F.when(F.col("query_id") % 2 == 0, F.lit('"医工"')).otherwise(F.lit('["医工","后勤"]'))
    kind = F.when(F.col("query_id") % 3 == 0, "chitchat").otherwise("foo")
    answer = F.concat(F.lit('```json\n{"intent":"'), kind, F.lit('","domain":'), domain, F.lit(',"rewritten_query":"q'), F.col("query_id").cast("string"), F.lit('","candidate_kbs":["a","b","a"]}\n```'))
    r = routing.parse_route(answer)
    rows = items(spark, sf_dir).select("query_id", r.alias("r"))
    return rows.select("query_id", "r.intent", F.array_join("r.domain", ",").alias("domain"), "r.rewritten_query", F.array_join("r.candidate_kbs", ",").alias("kbs"))


# Events


@query
def tumbling_latency(spark, sf_dir):
    return ingest.latency_windows(table(spark, sf_dir, "events"))


@query
def session_events(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


@query
def ingestion_states(spark, sf_dir):
    """Events as steps of documents: a user is a document."""
    stage = F.create_map(*[F.lit(x) for pair in _STEPS.items() for x in pair])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("at"), F.col("props").alias("message"), F.col("event_id").alias("order"))
    return ingest.document_states(rows, retries=1, patience="36 hours").withColumn("at", F.col("at").cast("timestamp_ntz"))
