"""From candidates to parents: rank fusion, reranking, collapse to parents, and the gate on answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.retrieval import ranked
from corpusloom.schemas import Retrieval

# Words that carry no evidence, and requests that are never answered.
NO_EVIDENCE = ("请给出", "是什么", "如何", "哪些", "多少", "平台", "系统", "管理")
REFUSED = "(?i)火星基地|氧气循环|量子发动机|QX-9000|明天.*菜单|个人手机号|银行账号|初始密码|编造|不存在|未上传合同|采购合同.*付款"


def reciprocal_rank_fusion(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """Lists of (query_id, pos, chunk_id), pos from 1 on -> query_id, chunk_id, rrf_score, rrf_rank; ties by the first list
    and the place in it."""
    union = reduce(DataFrame.unionByName, [d.select("query_id", "pos", "chunk_id", F.lit(k).alias("list_no")) for k, d in enumerate(lists)])
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("pos"))), 12).alias("rrf_score"), F.min(F.struct("list_no", "pos")).alias("first")
    )
    return ranked(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("first.list_no"), F.col("first.pos"), F.col("chunk_id")], "rrf_rank").drop("first")


def rerank_local(candidates: DataFrame, top_n: int | None = None) -> DataFrame:
    """candidates (query_id, query, chunk_id, in_rank, content, rrf_score, dense_score, sparse_score, maybe child_text) ->
    with rerank_score and rerank_rank: 2 for each of the query's tokens in the text, a tenth for each of up to 20
    occurrences, and the scores so far. A query without tokens keeps its order."""
    tokens = X.rerank_tokens(F.col("query"))
    more = F.coalesce(F.col("child_text"), F.lit("")) if "child_text" in candidates.columns else F.lit("")
    text = F.lower(F.concat(F.coalesce(F.col("content"), F.lit("")), F.lit("\n"), more))
    # Few bytes may be much work: without a number Spark would leave all candidates to one task.
    rows = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "chunk_id")
    rows = rows.withColumns({"_tokens": tokens, "_text": text})
    counts = F.transform("_tokens", lambda t: F.when(F.contains(F.col("_text"), t), X.count_of(F.col("_text"), t)).otherwise(0))
    rows = rows.withColumn("_counts", counts)
    hits = F.size(F.filter("_counts", lambda n: n > 0))
    times = F.aggregate("_counts", F.lit(0).cast("long"), lambda s, n: s + n)
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = hits * 2.0 + F.least(times, F.lit(20)) * 0.1 + (known("rrf_score") * 20.0 + known("dense_score") + known("sparse_score"))
    score = F.when(F.size("_tokens") > 0, F.round(score, 9))
    rows = rows.withColumn("rerank_score", score).drop("_tokens", "_text", "_counts")
    return ranked(rows, ["query_id"], [F.col("rerank_score").desc_nulls_last(), F.col("in_rank")], "rerank_rank", top_n)


def collapse_to_parents(children: DataFrame, parents: DataFrame, top_k: int) -> DataFrame:
    """children (query_id, rank, chunk_id, parent_id, content, score) -> the top_k parents of each query in the order of their
    best child: parent_id, parent_rank, best_rank, score (the best child's), child_ids (all), matched_children (the
    first five), content: the parent's, or where it is missing the best child's."""
    rows = children.withColumn("parent_id", F.coalesce("parent_id", "chunk_id")).filter("parent_id is not null")
    grouped = rows.groupBy("query_id", "parent_id").agg(
        F.min("rank").alias("best_rank"), F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("kids"),
        F.min_by("content", "rank").alias("child_content"), F.min_by("score", "rank").alias("score"),
    )
    grouped = ranked(grouped, ["query_id"], [F.col("best_rank"), F.col("parent_id")], "parent_rank", top_k)
    stored = parents.select("parent_id", F.col("content").alias("parent_content"))
    return grouped.join(stored, "parent_id", "left").select(
        "query_id", "parent_id", "parent_rank", "best_rank", "score", F.col("kids.chunk_id").alias("child_ids"),
        F.slice(F.col("kids.chunk_id"), 1, 5).alias("matched_children"), F.coalesce("parent_content", "child_content").alias("content"),
    )


def confidence(rerank: Column, rrf: Column, sparse: Column, lexical: Column, dense: Column, constant: Column | int, has_parents: Column) -> Column:
    """From the first score there is: reranked as it is, fused in units of the best place, lexical from 0.35 up to 0.85, dense if
    it lies in 0 to 1, all clamped; 0 without parents."""
    c = constant if isinstance(constant, Column) else F.lit(constant)
    lexical_like = X.truthy(sparse, lexical, F.lit(0.0))
    near = F.when((dense >= 0) & (dense <= 1), dense).otherwise(1.0 / (1.0 + F.greatest(dense, F.lit(0.0))))
    out = (
        F.when(~has_parents, 0.0)
        .when(rerank.isNotNull(), X.clamp(rerank))
        .when(rrf.isNotNull(), X.clamp(rrf * F.greatest(c, F.lit(1))))
        .when(sparse.isNotNull() | lexical.isNotNull(), X.clamp(0.35 + F.least(lexical_like, F.lit(5.0)) / 10.0))
        .when(dense.isNotNull(), X.clamp(near))
    )
    return F.coalesce(out, F.lit(0.0))


def query_support(query: Column, contexts: Column) -> Column:
    """The part of the query's tokens, but for words without evidence, that the first three contexts hold."""
    tokens = F.filter(X.query_tokens(query), lambda t: ~t.isin(*NO_EVIDENCE))
    joined = F.array_join(F.slice(contexts, 1, 3), "\n")
    return F.when((F.size(tokens) > 0) & (F.size(contexts) > 0), F.size(F.filter(tokens, lambda t: F.contains(joined, t))) / F.size(tokens)).otherwise(0.0)


def refusal_reason(query: Column, intent: Column, n_parents: Column, conf: Column, support: Column, config: Retrieval) -> Column:
    """Why no answer is given, or null: no context, low confidence, a refused request, low support, in this order."""
    low_conf = F.concat(F.lit("confidence_below_threshold:"), X.rounded(conf, 4), F.lit(f"<{config.confidence_threshold:.4f}"))
    low_support = F.concat(F.lit("query_support_below_threshold:"), X.rounded(support, 4), F.lit(f"<{config.support_threshold:.4f}"))
    reason = (
        F.when(n_parents == 0, "no_parent_context")
        .when(conf < config.confidence_threshold, low_conf)
        .when(F.coalesce(query, F.lit("")).rlike(REFUSED), "explicit_refusal_trigger")
        .when(support < config.support_threshold, low_support)
    )
    return F.when(F.lit(config.refusal) & (intent == "retrieval"), reason)
