"""A stored inverted index with bounds: exact best chunks by sums of weights, scoring only ranges that may hold one.

The chunks of a knowledge base are dealt to ranges of some hundred. A row of the index is a range: its terms, each term's largest
and smallest value, and its postings. No chunk of a range scores more than the sum of its terms' bounds, and these
are read without the postings. A search scores each query's most promising ranges, and then those whose bound is not
below the k-th score found there. A block of queries is held against a range by a product of matrices, where the range
is read; only each task's own k best of a query and knowledge base are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.retrieval import QUERY_BLOCK, SUM_DIGITS, B, Best, K1, ranked
from corpusloom.session import materialize

#: Chunks of a range, about; ranges that each query and knowledge base begins with.
RANGE, FIRST = 128, 4
#: Numbers in the matrix of a block's queries and their terms, about; queries of a block at most.
WEIGHTS, MOST = 1 << 21, 8192
#: Bounds are held with this part of slack, so that the order of additions never excludes a range.
SLACK = 1e-9

_ROW = "kb_id int, range int, chunks array<string>, terms array<string>, sizes array<int>, hi array<double>, lo array<double>, nth array<int>, value array<double>"
_HITS = "query_id long, kb_id int, chunk_id string, score double"


def inverted(chunks: list[str], terms: pa.ListArray, values: np.ndarray | None, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> list:
    """The row of a range but for its place. A chunk's value of a term is the sum of values, or what weigh makes of the term's number in it and of its size."""
    names, chunk = np.unique(np.array(chunks, dtype=object), return_inverse=True)
    flat = terms.flatten().dictionary_encode()
    known = np.array(flat.dictionary.to_pylist(), dtype=object)
    order = np.argsort(known)
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    row = np.repeat(chunk, terms.value_lengths().to_numpy(zero_copy_only=False))
    cells, at, times = np.unique(place[flat.indices.to_numpy(zero_copy_only=False)] * len(names) + row, return_inverse=True, return_counts=True)
    nth = cells % len(names)
    value = weigh(times.astype(np.float64), np.bincount(row, minlength=len(names))[nth]) if weigh else np.bincount(at, values, len(cells))
    starts = np.searchsorted(cells // len(names), np.arange(len(known)))
    hi, lo = (f.reduceat(value, starts) if len(value) else value for f in (np.maximum, np.minimum))
    return [names.tolist(), known[order].tolist(), np.diff(np.append(starts, len(cells))), hi, lo, nth, value]


class Asked:
    """A block of queries as a matrix of the weights of their terms."""

    def __init__(self, part: pd.DataFrame):
        self.ids, query = np.unique(part["query_id"].to_numpy(np.int64), return_inverse=True)
        self.names, term = np.unique(part["term"].to_numpy(dtype=object), return_inverse=True)
        self.weight, self.has = np.zeros((len(self.ids), len(self.names))), np.zeros((len(self.ids), len(self.names)), np.float32)
        self.weight[query, term], self.has[query, term] = part["weight"].to_numpy(np.float64), 1.0

    def found_in(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(places in a range's terms, places in the block's) of those that both have."""
        if not hasattr(self, "place"):
            self.place = pa.array(self.names.tolist(), pa.string())
        at = pc.index_in(terms, self.place).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(at == at)
        return there, at[there].astype(np.int64)

    def bounds(self, mine: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, whether it holds a term) of a range for each query."""
        weight = self.weight[:, mine]
        return np.maximum(np.maximum(weight * hi, weight * lo), 0.0).sum(axis=1), self.has[:, mine].any(axis=1)


def _lists(batch: pa.RecordBatch, k: int, *names: str) -> list[np.ndarray]:
    return [batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in names]


class PostingIndex:
    """(kb_id, chunk_id, term, value), one row for each chunk and term, written once below path; about holds figures of the corpus."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, cells: DataFrame, range_size: int = RANGE, **about: float) -> PostingIndex:
        """A null kb_id is 0; cells without a term or a value count for nothing."""
        kb, cell = F.coalesce(F.col("kb_id"), F.lit(0)).cast("int").alias("kb_id"), F.struct(F.col("term").cast("string").alias("term"), F.col("value").cast("double").alias("value"))
        rows = cells.filter("term is not null and value is not null").groupBy(kb, F.col("chunk_id").cast("string").alias("chunk_id")).agg(F.collect_list(cell).alias("cells"))
        sizes = rows.groupBy("kb_id").agg(F.count("*").alias("chunks"))
        return self.build_rows(rows, sizes, F.col("cells.term"), F.col("cells.value"), range_size=range_size, **about)

    def build_rows(self, rows: DataFrame, sizes: DataFrame, terms: Column, values: Column | None = None, weigh: Callable | None = None, range_size: int = RANGE, **about: float) -> PostingIndex:
        """rows (kb_id, chunk_id, what terms and values are made of), a row for each chunk, of which sizes tells the number (kb_id, chunks). A row is shuffled once, and its
        postings are made where its range is."""
        kb = F.coalesce(F.col("kb_id"), F.lit(0)).cast("int")
        # A row for each knowledge base; Spark broadcasts it where it is small.
        ranges = sizes.groupBy(kb.alias("kb_id")).agg(F.greatest(F.ceil(F.coalesce(F.sum("chunks"), F.lit(0)) / F.lit(range_size)), F.lit(1)).alias("ranges"))
        ranges = materialize(ranges, "ranges")
        placed = rows.withColumns({"kb_id": kb, "chunk_id": F.col("chunk_id").cast("string")}).join(ranges, "kb_id").withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.col("ranges")).cast("int"))
        valued = values is not None
        number = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = placed.drop("ranges").repartition(number, "kb_id", "range").sortWithinPartitions("kb_id", "range")
        dealt = dealt.select("kb_id", "range", "chunk_id", terms.alias("terms"), *([values.alias("values")] if valued else []))

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row_of(place: tuple, parts: list[pa.RecordBatch]) -> list:
                whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                given = whole.column("values").flatten().to_numpy(zero_copy_only=False) if valued else None
                return [*place, *inverted(whole.column("chunk_id").to_pylist(), whole.column("terms"), given, weigh)]

            def batch_of(made: list[list]) -> pa.RecordBatch:
                of = lambda kind: lambda column: pa.array(column, kind)
                kinds = [of(pa.int32()), of(pa.int32()), *[of(pa.list_(t)) for t in (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64())]]
                return pa.RecordBatch.from_arrays([f([r[k] for r in made]) for k, f in enumerate(kinds)], ["kb_id", "range", "chunks", "terms", "sizes", "hi", "lo", "nth", "value"])

            held: list[pa.RecordBatch] = []
            now, made = None, []
            for batch in batches:
                kb, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kb_id", "range"))
                starts = np.flatnonzero(np.append(True, (kb[1:] != kb[:-1]) | (of[1:] != of[:-1]))) if len(kb) else []
                for at, end in zip(starts, [*starts[1:], len(kb)], strict=True):
                    if (here := (int(kb[at]), int(of[at]))) != now:
                        if held:
                            made.append(row_of(now, held))
                        now, held = here, []
                        if len(made) >= 16:
                            yield batch_of(made)
                            made = []
                    held.append(batch.slice(at, end - at))
            if held:
                made.append(row_of(now, held))
            if made:
                yield batch_of(made)

        dealt.mapInArrow(invert, _ROW).write.option("compression", "zstd").parquet(f"{self.path}/blocks")
        self.spark.createDataFrame([(k, float(v)) for k, v in about.items()], "name string, value double").coalesce(1).write.parquet(f"{self.path}/about")
        return self

    def about(self) -> dict[str, float]:
        return {r["name"]: r["value"] for r in self.spark.read.parquet(f"{self.path}/about").collect()}

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(f"{self.path}/blocks")

    def document_frequency(self, terms: DataFrame) -> DataFrame:
        """(term) -> (term, df): chunks that hold it."""
        wanted = materialize(terms.select("term").filter("term is not null").distinct(), "wanted_terms")
        found = self.blocks().select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("n"))
        return found.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))

    def search(self, asked: DataFrame, k: int, kbs: list[int] | None = None) -> DataFrame:
        return self.search_and_reads(asked, k, kbs)[0]

    def search_and_reads(self, asked: DataFrame, k: int, kbs: list[int] | None = None, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, weight) -> query_id, kb_id, chunk_id, score: for each query and knowledge base the k of the largest sum of weight times value
        among chunks that hold one of its terms, ties by chunk_id; and (query_id, kb_id, ranges, ranges_read). Weights of a repeated
        term are added up; a null weight or term counts for nothing. Without bounds that exclude it, a range is read: no hit is lost."""
        asked = materialize(asked.filter("term is not null and weight is not null").groupBy("query_id", "term").agg(F.sum("weight").cast("double").alias("weight")), "asked_terms")
        blocks = self.blocks() if kbs is None else self.blocks().filter(F.col("kb_id").isin(kbs))
        n, terms = asked.agg(F.count_distinct("query_id"), F.count_distinct("term")).first()
        parts = max(-(-n // MOST), min(-(-n // QUERY_BLOCK), -(-n * terms // WEIGHTS)))
        of = F.pmod(F.xxhash64("query_id"), F.lit(max(parts, 1)))
        found = [self._search(part, blocks, k, first) for p in range(parts) if len(part := asked.filter(of == p).toPandas())]
        if not found:
            none = lambda schema: self.spark.createDataFrame([], schema)
            return none(_HITS), none("query_id long, kb_id int, ranges long, ranges_read long")
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))

    def _search(self, part: pd.DataFrame, blocks: DataFrame, k: int, first: int) -> tuple[DataFrame, DataFrame]:
        asked = Asked(part)
        order = [F.col("score").desc(), F.col("chunk_id")]
        keys = ["query_id", "kb_id"]

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    there, mine = asked.found_in(batch.column("terms")[r].values)
                    hi, lo = (x[there] for x in _lists(batch, r, "hi", "lo"))
                    most, has = asked.bounds(mine, hi, lo)
                    at = np.flatnonzero(has)
                    place = [pa.array(np.full(len(at), batch.column(c)[r].as_py(), np.int32)) for c in ("kb_id", "range")]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[at]), *place, pa.array(most[at])], ["query_id", "kb_id", "range", "bound"])

        bounds = blocks.select("kb_id", "range", "terms", "hi", "lo").mapInArrow(bound, "query_id long, kb_id int, range int, bound double")
        ranges = materialize(ranked(bounds, keys, [F.col("bound").desc(), F.col("range")], "place"), "bounded_ranges")

        def best(rows: DataFrame, known: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
            """The k best of each query and knowledge base in the ranges: for the queries (by) that a row names, or for those whose bound in it is not below what is known of the
            knowledge base: queries, and their k-th score so far."""

            def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                kept: dict[int, Best] = {}
                least = {}
                for batch in batches:
                    for r in range(batch.num_rows):
                        kb = batch.column("kb_id")[r].as_py()
                        there, mine = asked.found_in(batch.column("terms")[r].values)
                        sizes, hi, lo, nth, value = _lists(batch, r, "sizes", "hi", "lo", "nth", "value")
                        if known is None:
                            at = np.searchsorted(asked.ids, _lists(batch, r, "by")[0])
                        else:
                            if kb not in least:
                                least[kb] = np.full(len(asked.ids), -np.inf)
                                if kb in known:
                                    least[kb][known[kb][0]] = known[kb][1]
                            most, has = asked.bounds(mine, hi[there], lo[there])
                            at = np.flatnonzero(has & (most * (1 + SLACK) + SLACK >= least[kb]))
                        if not len(at):
                            continue
                        names = np.array(batch.column("chunks")[r].values.to_pylist(), dtype=object)
                        starts = np.cumsum(sizes) - sizes
                        term = np.repeat(np.arange(len(there)), sizes[there])
                        from_ = np.repeat(starts[there] - (np.cumsum(sizes[there]) - sizes[there]), sizes[there]) + np.arange(len(term))
                        x = np.zeros((len(there), len(names)))
                        x[term, nth[from_]] = value[from_]
                        holds = np.zeros(x.shape, np.float32)
                        holds[term, nth[from_]] = 1.0
                        scores = np.full((len(asked.ids), len(names)), -np.inf)
                        has = asked.has[np.ix_(at, mine)] @ holds > 0
                        scores[at] = np.where(has, np.round(asked.weight[np.ix_(at, mine)] @ x, SUM_DIGITS) + 0.0, -np.inf)
                        if kb not in kept:
                            kept[kb] = Best(k, None if known is None else least[kb].copy())
                        kept[kb].add(scores, names)
                for kb, b in kept.items():
                    b.merge()
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[b.query]), pa.array(np.full(len(b.query), kb, np.int32)), pa.array(b.chunk.tolist(), pa.string()), pa.array(b.score)], ["query_id", "kb_id", "chunk_id", "score"])

            return ranked(rows.mapInArrow(score, _HITS), keys, order, "nth", k).drop("nth")

        # Some ranges of each query and knowledge base tell a score that the k best have at least.
        near = ranges.filter(F.col("place") <= first).groupBy("kb_id", "range").agg(F.collect_list("query_id").alias("by"))
        near = materialize(best(blocks.join(F.broadcast(near), ["kb_id", "range"])), "first_hits")
        reached = near.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).filter("kth is not null")
        reached = materialize(reached, "reached")
        known = {kb: (np.searchsorted(asked.ids, g["query_id"].to_numpy()), g["kth"].to_numpy()) for kb, g in reached.toPandas().groupby("kb_id")}
        read = ranges.join(reached, keys, "left").withColumn("more", F.col("kth").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("kth")))
        more = materialize(read.filter("more").select("kb_id", "range").distinct(), "more_ranges")
        hits = best(blocks.join(F.broadcast(more), ["kb_id", "range"], "left_semi"), known)
        reads = read.groupBy(*keys).agg(F.count("*").alias("ranges"), F.count_if(F.col("more") | (F.col("place") <= first)).alias("ranges_read"))
        return hits, reads


def bm25_index(chunks: DataFrame, path: str, k1: float = K1, b: float = B, analyzer: str = "default") -> PostingIndex:
    """An index of (kb_id, chunk_id, content) for bm25_search(): a value is a term's part of the score but for its rarity."""
    terms = X.ANALYZERS[analyzer](F.coalesce("content", F.lit("")))
    # Grouped by size first, so that a text's terms are made once.
    sizes = chunks.groupBy("kb_id", F.size(terms).alias("size")).agg(F.count("*").alias("n")).groupBy("kb_id").agg(F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("chunks"), F.sum(F.col("size") * F.col("n")).alias("size"))
    sizes = materialize(sizes, "chunk_sizes")
    n, size = sizes.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = size / n if n else 1.0

    def weigh(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))

    rows = chunks.select("kb_id", "chunk_id", "content")
    return PostingIndex(chunks.sparkSession, path).build_rows(rows, sizes.select("kb_id", "chunks"), terms, weigh=weigh, n=n)


def bm25_search(queries: DataFrame, index: PostingIndex, k: int, analyzer: str = "default", kbs: list[int] | None = None) -> DataFrame:
    """(query_id, query) -> query_id, kb_id, chunk_id, sparse_score: what bm25_best() finds, from the index alone."""
    n = index.about()["n"]
    asked = queries.select("query_id", F.explode(F.array_distinct(X.ANALYZERS[analyzer](F.coalesce("query", F.lit(""))))).alias("term"))
    df = index.document_frequency(asked)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.search(asked.join(df, "term").select("query_id", "term", idf.alias("weight")), k, kbs).withColumnRenamed("score", "sparse_score")


def sparse_index(vectors: DataFrame, path: str) -> PostingIndex:
    """An index of (kb_id, chunk_id, vector), maps of terms to weights, for sparse_search()."""
    rows = vectors.select("kb_id", "chunk_id", F.map_filter("vector", lambda _, w: w.isNotNull()).alias("vector")).filter("size(vector) > 0")
    sizes = rows.groupBy("kb_id").agg(F.count("*").alias("chunks"))
    return PostingIndex(vectors.sparkSession, path).build_rows(rows, sizes, F.map_keys("vector").cast("array<string>"), F.map_values("vector").cast("array<double>"))


def sparse_search(queries: DataFrame, index: PostingIndex, k: int, kbs: list[int] | None = None) -> DataFrame:
    """(query_id, vector) -> query_id, kb_id, chunk_id, sparse_score: what sparse_best() finds, from the index alone."""
    asked = queries.select("query_id", F.explode("vector").alias("term", "weight")).withColumn("term", F.col("term").cast("string"))
    return index.search(asked, k, kbs).withColumnRenamed("score", "sparse_score")
