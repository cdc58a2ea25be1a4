"""Retrieval from end to end: a corpus of chunks, searches under a configuration, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import providers
from corpusloom.operators import chunking, evaluation, ranking, retrieval, routing
from corpusloom.operators.filters import apply_filters
from corpusloom.operators.patterns import contained
from corpusloom.schemas import Budgets, Retrieval
from corpusloom.session import materialize, new_path
from corpusloom.sources.postings import PostingIndex, bm25_index, bm25_search, sparse_index, sparse_search


#: Keys of candidates that are broadcast at once.
MANY = 1_000_000


@dataclass
class Corpus:
    """documents (kb_id, document_id, file_name, title, department, doc_type, text), and its chunks with their vectors;
    sparse, if there is a sparse encoder, has maps of terms to weights (chunk_id, vector). bm25 and learned are stored indexes, which
    searches without filters read instead of the chunks."""

    documents: DataFrame
    parents: DataFrame
    children: DataFrame
    vectors: DataFrame
    sparse: DataFrame | None = None
    embedding: str = "local_hash"
    bm25: PostingIndex | None = None
    learned: PostingIndex | None = None

    def indexed(self, kinds: tuple[str, ...], analyzer: str = "default") -> Corpus:
        """The corpus with stored indexes of these kinds: bm25, learned."""
        path = new_path(self.children.sparkSession, "indexes")
        if "bm25" in kinds:
            self.bm25 = bm25_index(self.children, f"{path}/bm25", analyzer=analyzer)
        if "learned" in kinds:
            self.learned = sparse_index(self.with_kb(), f"{path}/learned")
        return self

    def with_kb(self) -> DataFrame:
        """The sparse vectors with their knowledge base, which an encoder may have kept."""
        return self.sparse if "kb_id" in self.sparse.columns else self.sparse.join(self.children.select("chunk_id", "kb_id"), "chunk_id")

    @staticmethod
    def build(documents: DataFrame, budgets: Budgets = Budgets(), embedding: str = "local_hash", sparse: Callable[[DataFrame], DataFrame] | None = None) -> Corpus:
        parents = materialize(chunking.parents_of(documents, budgets, keep=("department", "doc_type")), "parents")
        children = materialize(chunking.children(parents, budgets), "children")
        vectors = providers.embedding(embedding)(children.select("chunk_id", "kb_id", "department", "content"), "chunk_id", "content")
        if not {"kb_id", "department"} <= set(vectors.columns):
            vectors = vectors.join(children.select("chunk_id", "kb_id", "department"), "chunk_id")
        # Hashed vectors are made anew by each pass over them: on disk, they would be several times the texts.
        vectors = vectors if embedding.lower() == "local_hash" else materialize(vectors, "vectors")
        return Corpus(documents, parents, children, vectors, materialize(sparse(children), "sparse_vectors") if sparse else None, embedding)


def sparse_kind(retriever: str, store: str, learned: bool) -> str | None:
    """What is fused with dense ranks: nothing, BM25 or learned sparse vectors where the store has them, else lexical ranks."""
    if retriever == "dense":
        return None
    if store != "hybrid":
        return "lexical"
    return "bm25" if retriever == "hybrid_bm25" else "learned" if learned and retriever == "hybrid_sparse" else "lexical"


@dataclass
class Hits:
    """What all configurations share: each query's best chunks in each knowledge base, dense and by other scores (query_id,
    kb_id, chunk_id, score), its route, and these chunks' texts and parents. Small talk is not searched for."""

    queries: DataFrame
    dense: DataFrame
    others: dict[str, DataFrame]
    routes: DataFrame
    texts: DataFrame
    parents: DataFrame

    @staticmethod
    def find(
        queries: DataFrame, corpus: Corpus, k: int, filters: dict | None = None, profiles: DataFrame | None = None, kinds: tuple[str, ...] = ("lexical",), analyzer: str = "default",
        sparse: Callable[[DataFrame], DataFrame] | None = None,
    ) -> Hits:
        """queries (query_id long, query); profiles (kb_id, profile) are needed for configurations with a router, and sparse, an
        encoder of queries (query_id, vector), for learned sparse scores."""
        chunks, vectors = apply_filters(corpus.children, filters or {}), apply_filters(corpus.vectors, filters or {})
        routes = queries.select("query_id", F.lit(None).cast("int").alias("kb_id"), routing.intent(F.col("query")).alias("intent"))
        if profiles is not None:
            routes = routing.route(queries, profiles).select("query_id", "kb_id", "intent")
        routes = materialize(routes, "routes")
        searched = queries.join(routes.filter("intent <> 'chitchat'").select("query_id"), "query_id", "left_semi")
        asked = providers.embedding(corpus.embedding)(searched, "query_id", "query")
        others = {}
        for kind in kinds:
            if kind == "lexical":
                found = retrieval.lexical_best(searched, chunks, k).withColumnRenamed("lexical_score", "score")
            elif kind == "bm25" and corpus.bm25 and not filters:
                found = bm25_search(searched, corpus.bm25, k, analyzer=analyzer).withColumnRenamed("sparse_score", "score")
            elif kind == "bm25":
                found = retrieval.bm25_best(searched, chunks, k, analyzer=analyzer).withColumnRenamed("sparse_score", "score")
            elif corpus.learned and not filters:
                found = sparse_search(sparse(searched), corpus.learned, k).withColumnRenamed("sparse_score", "score")
            else:
                stored = corpus.with_kb().join(chunks.select("chunk_id"), "chunk_id", "left_semi")
                found = retrieval.sparse_best(sparse(searched), stored, k).withColumnRenamed("sparse_score", "score")
            others[kind] = materialize(found, f"{kind}_hits")
        dense = materialize(retrieval.dense_topk(asked, vectors, k), "dense_hits")
        texts = picked(corpus.children.select("chunk_id", "parent_id", "document_id", "content"), [d.select("chunk_id") for d in (dense, *others.values())], "chunk_id")
        return Hits(queries, dense, others, routes, texts, picked(corpus.parents.select("parent_id", "content"), [texts.select("parent_id")], "parent_id"))


def picked(rows: DataFrame, named: list[DataFrame], key: str) -> DataFrame:
    """The rows whose key is named, written: rows stay where they are, unless so many are named that a broadcast would not hold them."""
    ids = materialize(reduce(DataFrame.unionByName, named).distinct(), "picked_ids")
    return materialize(rows.join(F.broadcast(ids) if ids.count() <= MANY else ids, key, "left_semi"), "picked")


def retrieve(hits: Hits, corpus: Corpus, config: Retrieval, store: str = "exact") -> DataFrame:
    """A row per query: query_id, query, intent, parent_ids, document_ids, contexts, confidence, support, refusal_reason."""
    dense, kind = hits.dense.filter(F.col("dense_rank") <= config.candidates), sparse_kind(config.retriever, store, "learned" in hits.others)
    other = hits.others[kind] if kind else None
    if config.router:
        mine = hits.routes.select("query_id", "kb_id")
        dense, other = dense.join(mine, ["query_id", "kb_id"]), other.join(mine, ["query_id", "kb_id"]) if kind else None
    listed = retrieval.concatenated(dense, "dense_rank")
    if not kind:
        ranked = listed.select("query_id", "chunk_id", F.col("pos").alias("in_rank"), F.lit(None).cast("double").alias("rrf_score"))
    else:
        order = [F.col("score").desc(), F.col("chunk_id")]
        words = retrieval.ranked(other, ["query_id"], order, "pos", config.candidates)
        fused = ranking.reciprocal_rank_fusion([listed, words], config.rrf_constant)
        ranked = fused.select("query_id", "chunk_id", F.col("rrf_rank").alias("in_rank"), "rrf_score")
    ranked = ranked.join(listed.select("query_id", "chunk_id", "dense_score"), ["query_id", "chunk_id"], "left")
    if kind in ("bm25", "learned"):
        ranked = ranked.join(other.select("query_id", "chunk_id", F.col("score").alias("sparse_score")), ["query_id", "chunk_id"], "left")
    else:
        ranked = ranked.withColumn("sparse_score", F.lit(None).cast("double"))
    rows = ranked.join(hits.texts, "chunk_id").join(hits.queries, "query_id")
    if config.rerank:
        rows = providers.gated_reranker(config.reranker)(rows, max(config.candidates, config.top_k)).withColumn("rank", F.col("rerank_rank"))
    else:
        rows = rows.withColumns({"rank": F.col("in_rank"), "rerank_score": F.lit(None).cast("double")})
    scores = F.struct("rerank_score", "rrf_score", "dense_score", "document_id")
    best = ranking.collapse_to_parents(rows.withColumn("score", scores), hits.parents, config.top_k)
    listed = F.sort_array(F.collect_list(F.struct("parent_rank", "parent_id", "content", "score")))
    found = best.groupBy("query_id").agg(listed.alias("p"))
    out = hits.queries.join(hits.routes.drop("kb_id"), "query_id").join(found, "query_id", "left")
    out = out.withColumn("p", F.coalesce("p", F.array().cast(found.schema["p"].dataType)))
    none, top = F.lit(None).cast("double"), F.try_element_at("p", F.lit(1))["score"]
    conf = ranking.confidence(top["rerank_score"], top["rrf_score"], none, none, top["dense_score"], config.rrf_constant, F.size("p") > 0)
    out = out.withColumns({"confidence": F.when(F.col("intent") == "chitchat", 1.0).otherwise(conf), "support": ranking.query_support(F.col("query"), F.col("p.content"))})
    reason = ranking.refusal_reason(F.col("query"), F.col("intent"), F.size("p"), F.col("confidence"), F.col("support"), config)
    return out.select(
        "query_id", "query", "intent", F.col("p.parent_id").alias("parent_ids"), F.array_distinct(F.col("p.score.document_id")).alias("document_ids"),
        F.col("p.content").alias("contexts"), "confidence", "support", reason.alias("refusal_reason"),
    )


def evaluate(results: DataFrame, relevant: DataFrame, retrieved: str = "document_ids") -> DataFrame:
    """Adds a query's metrics; relevant (query_id, relevant array) may lack queries, which are negatives."""
    rows = results.join(relevant, "query_id", "left")
    known = F.coalesce("relevant", F.array().cast(relevant.schema["relevant"].dataType))
    rows = rows.withColumns({"relevant": known, "answerable": F.size(known) > 0, "labeled": F.lit(True), "refused": F.col("refusal_reason").isNotNull(), "latency_ms": F.lit(0.0)})
    got, want = F.col(retrieved), F.col("relevant")
    return rows.withColumns({"recall": evaluation.recall_at(got, want, 5), "rr": evaluation.reciprocal_rank(got, want), "ndcg": evaluation.ndcg_at(got, want, 10)})


def ablation(hits: Hits, corpus: Corpus, relevant: DataFrame, configs: tuple[Retrieval, ...]) -> DataFrame:
    """A row of metrics for each configuration; the searches are done once for all."""
    columns = ["query_id", "answerable", "labeled", "refused", "latency_ms", "recall", "rr", "ndcg"]
    runs = [materialize(evaluate(retrieve(hits, corpus, c), relevant).select(*columns, F.lit(c.name).alias("config")), "results") for c in configs]
    return evaluation.report(reduce(DataFrame.unionByName, runs)).drop("p95_latency_ms")


def containing(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(document_id, text) and (item_id, text) -> item_id, document_id of the documents that contain the item's text. An empty item is in
    all documents with a text."""
    found = contained(documents, "document_id", "text", items, "text")
    hits = found.join(items.select("item_id", F.col("text").alias("pattern")), "pattern").select("item_id", "document_id")
    empty = items.filter("text = ''").select("item_id")
    return hits.unionByName(empty.join(documents.filter("text is not null").select("document_id")))
