"""Explicit schemas of the corpus tables, and the engine's defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("kb_id", T.IntegerType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("seg_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("section_path", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("is_heading", T.BooleanType()),
    T.StructField("is_table", T.BooleanType()),
])

EVALUATION = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("kb_ids", T.ArrayType(T.IntegerType())),
    T.StructField("relevant_parent_ids", T.ArrayType(T.StringType())),
    T.StructField("answerable", T.BooleanType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("expected_answer", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("evidence_keywords", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Budgets:
    """Sizes of chunks in code points. The overlap is at most a third of a child."""

    parent: int = 1200
    child: int = 350
    overlap: int = 60

    def __post_init__(self) -> None:
        object.__setattr__(self, "overlap", min(self.overlap, self.child // 3))

    @classmethod
    def for_ingestion(cls, chunk_size: int = 1000, chunk_overlap: int = 200) -> Budgets:
        return cls(max(chunk_size, 800), min(max(chunk_size, 200), 500), min(chunk_overlap, 120))


@dataclass(frozen=True)
class Retrieval:
    """One retrieval configuration; name labels its rows in reports.

    retriever is dense alone, or fuses it with lexical ranks (hybrid_rrf), BM25 (hybrid_bm25) or learned sparse vectors
    (hybrid_sparse); reranker, embedding and analyzer name entries of their registries.
    """

    name: str = "default"
    retriever: str = "dense"
    rerank: bool = False
    reranker: str = "local"
    router: bool = False
    top_k: int = 5
    candidates: int = 20
    rrf_constant: int = 60
    confidence_threshold: float = 0.20
    support_threshold: float = 0.18
    refusal: bool = True
    filters: dict = field(default_factory=dict)


#: The ablation: dense; parents from more candidates; fused with lexical ranks; reranked; routed with refusal.
ABLATION = (
    Retrieval("dense", candidates=10, refusal=False),
    Retrieval("parents", candidates=20, refusal=False),
    Retrieval("hybrid", retriever="hybrid_rrf", candidates=20, refusal=False),
    Retrieval("reranked", retriever="hybrid_rrf", rerank=True, candidates=30, refusal=False),
    Retrieval("routed", retriever="hybrid_rrf", rerank=True, router=True, candidates=30, refusal=True),
)

#: Departments of users without a list of their own; the empty one admits documents without a department.
DEFAULT_DEPARTMENTS = ("医工", "后勤", "其他", "")
