"""Registries of what turns texts into vectors and of what reranks: the engine's own, and those a user adds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ranking, retrieval

#: name -> (rows, key, text column) -> (key, embedding), and rows' other columns where the encoder keeps them.
EMBEDDINGS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}
#: name -> (candidates, top_n) -> candidates with rerank_score and rerank_rank.
RERANKERS: dict[str, Callable[[DataFrame, int | None], DataFrame]] = {}


def register_embedding(name: str, encode: Callable[[DataFrame, str, str], DataFrame]) -> None:
    EMBEDDINGS[name.lower()] = encode


def register_reranker(name: str, rerank: Callable[[DataFrame, int | None], DataFrame]) -> None:
    RERANKERS[name.lower()] = rerank


def model_embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """An embedding by a model that each task loads once and calls on batches of texts."""

    def encode(rows: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(model(list(texts.fillna(""))))

        return rows.select(key, F.pandas_udf(run, "array<double>")(text).alias("embedding"))

    return encode


def model_reranker(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[DataFrame, int | None], DataFrame]:
    """A reranker by a function of queries and contents; a candidate that it gives no score keeps its place behind the others."""

    def rerank(candidates: DataFrame, top_n: int | None) -> DataFrame:
        def run(q: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(score(list(q.fillna("")), list(c.fillna(""))), dtype="float64")

        rows = candidates.withColumn("rerank_score", F.pandas_udf(run, "double")("query", "content"))
        order = [F.col("rerank_score").desc_nulls_last(), F.col("in_rank")]
        return retrieval.ranked(rows, ["query_id"], order, "rerank_rank", top_n)

    return rerank


def local_hash(rows: DataFrame, key: str, text: str) -> DataFrame:
    return retrieval.hash_vectors(rows, key, text)


def unranked(candidates: DataFrame, top_n: int | None) -> DataFrame:
    """The candidates in their order, cut to top_n."""
    rows = candidates.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.col("in_rank")})
    return rows.filter(F.col("in_rank") <= top_n) if top_n else rows


register_embedding("local_hash", local_hash)
register_reranker("local", ranking.rerank_local)
for _name in ("", "none", "disabled"):
    register_reranker(_name, unranked)


def embedding(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    if name.lower() not in EMBEDDINGS:
        raise ValueError(f"no embedding named {name}; there are {', '.join(sorted(EMBEDDINGS))}")
    return EMBEDDINGS[name.lower()]


def reranker(name: str) -> Callable[[DataFrame, int | None], DataFrame]:
    """An unknown name passes candidates through."""
    return RERANKERS.get(name.lower(), unranked)


def gated_reranker(name: str) -> Callable[[DataFrame, int | None], DataFrame]:
    """The reranker, but a query's only candidate is passed on without a score."""
    rerank = reranker(name)

    def run(candidates: DataFrame, top_n: int | None) -> DataFrame:
        several = F.count("*").over(Window.partitionBy("query_id")) > 1
        rows = rerank(candidates.withColumn("several", several), top_n)
        return rows.withColumn("rerank_score", F.when(F.col("several"), F.col("rerank_score"))).drop("several")

    return run


def store_for(store: str, embedding_name: str) -> str:
    """A store with learned sparse vectors is of no use with hashed ones: the exact store takes its place."""
    return "exact" if store.lower() == "hybrid" and embedding_name.lower() == "local_hash" else store
