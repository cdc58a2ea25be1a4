"""Vector stores by name: upsert by chunk, deletion by chunk or filter, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.filters import apply_filters, pushed
from corpusloom.operators.retrieval import dense_topk
from corpusloom.sources.buckets import BucketStore
from corpusloom.sources.vector_index import VectorIndex

TEXT_CHARS, PATH_CHARS = 65535, 2048


class VectorStore:
    """Chunks with an embedding, in buckets of the hash of chunk_id, searched by a scan; missing scalars are empty, long texts are cut
    to what the store's columns hold."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.rows = BucketStore(spark, path, key="chunk_id", tables=("chunks",), buckets=buckets)

    def read(self) -> DataFrame | None:
        return self.rows.read()

    def put(self, chunks: DataFrame) -> None:
        """Adds chunks; those that are there are replaced. Only the buckets that hold them are rewritten."""
        self.rows.upsert(stored(chunks), ["chunk_id"])

    def delete(self, doomed: DataFrame) -> None:
        if self.read() is not None:
            self.rows.delete(doomed)

    def delete_where(self, filters: dict) -> None:
        """Nothing for an empty filter."""
        self.rows.delete_where(filters)

    def drop(self) -> None:
        self.rows.drop()

    def search(self, queries: DataFrame, k: int, filters: dict | None = None, post_filter: bool = False) -> DataFrame:
        """The k nearest of what the filters, pushed down to the scan, leave; post_filter: what they leave, matched row by
        row, of the k nearest."""
        rows = self.read()
        kept = apply_filters(rows, filters or {}) if post_filter else pushed(rows, filters or {})
        hits = dense_topk(queries, rows if post_filter else kept, k)
        return hits.join(kept.select("chunk_id"), "chunk_id", "left_semi") if post_filter else hits


class ClusteredStore(VectorIndex):
    """Chunks with an embedding in a clustered index."""

    def put(self, chunks: DataFrame) -> None:
        super().put(stored(chunks))


def stored(chunks: DataFrame) -> DataFrame:
    kinds = dict(chunks.dtypes)
    rows = chunks.select(*[F.coalesce(F.col(c), F.lit("" if k == "string" else 0)).alias(c) if k in ("string", "int", "bigint", "double") else F.col(c) for c, k in kinds.items()])
    cut = {c: F.substring(c, 1, n) for c, n in (("content", TEXT_CHARS), ("section_path", PATH_CHARS)) if c in kinds}
    return rows.withColumns(cut) if cut else rows


Store = VectorStore | ClusteredStore
STORES: dict[str, Callable[..., Store]] = {"exact": VectorStore, "clustered": ClusteredStore}


def register_store(name: str, make: Callable[..., Store]) -> None:
    STORES[name.lower()] = make


def make_store(name: str, spark: SparkSession, path: str) -> Store:
    if name.lower() not in STORES:
        raise ValueError(f"no vector store named {name}; there are {', '.join(sorted(STORES))}")
    return STORES[name.lower()](spark, path)


def append_traces(traces: DataFrame, path: str) -> None:
    traces.withColumn("trace_id", F.expr("uuid()")).write.mode("append").parquet(path)

