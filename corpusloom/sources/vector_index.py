"""A clustered vector index: exact nearest vectors by cosine, reading only cells that a bound does not exclude.

Vectors lie in cells around centres that are fitted on a bounded sample; the angle between vectors is a metric, so no member of
a cell is nearer to a query than the query's angle to the centre less the cell's covering angle. A search reads each query's
nearest cells first, and then those whose bound is below the k-th angle found there. Cells are the buckets of a
BucketStore, so a change rewrites the cells that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.filters import apply_filters
from corpusloom.operators.retrieval import best_pairs, ranked, units
from corpusloom.session import materialize
from corpusloom.sources.buckets import BucketStore

#: Cells of an index at most; vectors and numbers of the sample that centres are fitted on, at most; rounds of fitting.
MAX_CELLS, SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS = 1024, 65_536, 8_000_000, 8
#: Vectors, and queries, that one task holds against each other.
BLOCK, QUERY_BLOCK = 4096, 4096
#: Bounds are held with this margin in radians, so that rounding never excludes a cell.
MARGIN = 1e-6

_HITS = "query_id long, kb_id int, chunk_id string, dense_score double"


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def fit_centres(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n unit vectors or fewer, by rounds of assignment and mean over the sample's unit vectors."""
    rng = np.random.default_rng(seed)
    centres = np.unique(x[rng.choice(len(x), min(n, len(x)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: numbers, not all zero, whose squares add up to one."""
    norm = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))


class _Cells(BucketStore):
    """A store whose key is its bucket."""

    def bucket(self, key: Column) -> Column:
        return key.cast("int")


class VectorIndex:
    """kb_id int, chunk_id string, embedding, and any other columns, one row for each chunk_id.

    Vectors of each length have centres of their own, fitted at the first put on a sample of at most SAMPLE_ROWS vectors and
    SAMPLE_NUMBERS numbers, about the root of their number and at most max_cells. Vectors without a direction are stored in cell -1,
    and not found. Null knowledge bases are 0 when searching. Columns cell and angle are the index's.
    """

    def __init__(self, spark: SparkSession, path: str, max_cells: int = MAX_CELLS):
        self.spark, self.path, self.max_cells = spark, path, max_cells
        self.store = _Cells(spark, path, key="cell", tables=("vectors", "cells"), buckets=max_cells)
        self._centres: dict[int, tuple[int, np.ndarray]] | None = None

    # Centres

    def centres(self) -> dict[int, tuple[int, np.ndarray]]:
        """Length of vectors -> (number of its first cell, unit vectors); at most max_cells for each length."""
        if self._centres is None:
            found: dict[int, list] = {}
            for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect():
                found.setdefault(len(r["centre"]), []).append((r["cell"], r["centre"]))
            self._centres = {d: (rows[0][0], np.array([c for _, c in rows])) for d, rows in found.items()}
        return self._centres

    def _fit(self, vectors: DataFrame) -> None:
        good = vectors.filter(usable(F.col("embedding"))).select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        rows, first = [], 0
        for r in good.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
            d, n = r["d"], r["count"]
            cells = int(min(self.max_cells, max(1, round(n**0.5))))
            wanted = min(n, SAMPLE_ROWS, 64 * cells, max(cells, SAMPLE_NUMBERS // d))
            share = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * wanted / n)) + 1
            sample = good.filter((F.size("v") == d) & share).select("v").limit(wanted).toArrow()
            x = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in fit_centres(units(x), cells) if len(x) else []:
                rows.append((first, c.tolist()))
                first += 1
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")

    def _placed(self, vectors: DataFrame) -> DataFrame:
        """vectors with cell and angle."""
        names = [c for c in vectors.columns if c not in ("cell", "angle")]
        centres = self.spark.sparkContext.broadcast(self.centres())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                # Vectors without a direction have come as null.
                column = batch.column(batch.num_columns - 1)
                for d, x, where in by_length(column):
                    if d in centres.value:
                        first, c = centres.value[d]
                        cosines = x @ c.T
                        near = cosines.argmax(axis=1)
                        cell[where], angle[where] = first + near, np.arccos(np.clip(cosines[np.arange(len(x)), near], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cell), pa.array(angle)], [*names, "cell", "angle"])

        rows = vectors.select(*names, F.when(usable(F.col("embedding")), F.transform("embedding", lambda x: x.cast("double"))).alias("_unit"))
        schema = vectors.select(*names).schema
        return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], "cell int", "angle double"]))

    # Changes

    def read(self) -> DataFrame | None:
        rows = self.store.read("vectors")
        return None if rows is None else rows.drop("cell", "angle")

    def _put(self, new: DataFrame | None, ids: DataFrame) -> None:
        """One commit: ids' rows go from the cells that hold them, new rows (placed) come to theirs, and these cells are measured again."""
        old = self.store.read("vectors")
        touched = new.select("cell") if new is not None else None
        if old is not None:
            held = old.select("chunk_id", "cell").join(ids, "chunk_id", "left_semi").select("cell")
            touched = held if touched is None else touched.union(held)
        if touched is None:
            return
        touched = materialize(touched.distinct(), "touched_cells")

        def rows(before: DataFrame | None) -> DataFrame | None:
            kept = None if before is None else before.join(ids, "chunk_id", "left_anti")
            return new if kept is None else kept if new is None else kept.unionByName(new, allowMissingColumns=True)

        def measured(_: DataFrame | None) -> DataFrame | None:
            now = rows(self.store._rows("vectors", self.store.state(), {r["cell"] for r in touched.collect()}))
            kb = F.coalesce(F.col("kb_id"), F.lit(0)).cast("int")
            return None if now is None else now.groupBy("cell", kb.alias("kb_id")).agg(F.count("*").alias("n"), F.max("angle").alias("far"))

        self.store._change(touched, {"vectors": rows, "cells": measured}, None)

    def put(self, vectors: DataFrame) -> None:
        """Adds vectors; those of chunk_ids that are there are replaced. Of rows that repeat a chunk_id, one stays."""
        same = F.xxhash64(F.to_json(F.struct(*vectors.columns)))
        vectors = materialize(ranked(vectors, ["chunk_id"], [same], "_nth", 1).drop("_nth"), "new_vectors")
        if not self.store.folder.names("centres"):
            self._fit(vectors)
        self._put(materialize(self._placed(vectors), "placed_vectors"), vectors.select("chunk_id"))

    def delete(self, doomed: DataFrame) -> None:
        self._put(None, materialize(doomed.select("chunk_id").distinct(), "doomed"))

    def delete_where(self, filters: dict) -> None:
        """Nothing for an empty filter."""
        rows = self.read()
        if rows is not None and filters:
            self.delete(apply_filters(rows, filters))

    def drop(self) -> None:
        self.store.drop()

    # Search

    def _stats(self, filters: dict | None) -> DataFrame:
        """(kb_id, cell, n, far): of all rows, or of those that the filters leave, for which the vectors themselves are not read."""
        if not filters:
            return self.store.read("cells").filter("cell >= 0")
        rows = apply_filters(self.store.read("vectors"), filters).filter("cell >= 0")
        return rows.groupBy(F.coalesce(F.col("kb_id"), F.lit(0)).cast("int").alias("kb_id"), "cell").agg(F.count("*").alias("n"), F.max("angle").alias("far"))

    def _probes(self, queries: DataFrame, stats: DataFrame, k: int) -> DataFrame:
        """(query_id, kb_id, cell, lower, first): the cells that may hold one of the k nearest; first: those nearest to the query
        that hold k vectors together."""
        # A row for each knowledge base and cell: the index's, not the vectors', number.
        cells = stats.orderBy("kb_id", "cell").toPandas()
        shared = self.spark.sparkContext.broadcast((self.centres(), {kb: (g["cell"].to_numpy(), g["n"].to_numpy(), g["far"].to_numpy()) for kb, g in cells.groupby("kb_id")}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, by_kb = shared.value
            for batch in batches:
                ids = batch.column("query_id").to_numpy()
                for d, x, where in by_length(batch.column("embedding")):
                    if d not in centres:
                        continue
                    start, c = centres[d]
                    apart = angles(x, c)
                    for kb, (cell, n, far) in by_kb.items():
                        here = (cell >= start) & (cell < start + len(c))
                        cell_, n_, far_ = cell[here] - start, n[here], far[here]
                        if not len(cell_):
                            continue
                        gap = apart[:, cell_]
                        lower, upper = np.maximum(0.0, gap - far_), gap + far_
                        enough = lambda by: np.cumsum(n_[by], axis=1)  # noqa: B023, E731
                        order = np.argsort(upper, axis=1, kind="stable")
                        at = np.minimum((enough(order) < k).sum(axis=1), len(cell_) - 1)
                        bound = np.where(n_.sum() >= k, np.take_along_axis(upper, order, 1)[np.arange(len(x)), at], np.inf)
                        near = np.argsort(gap, axis=1, kind="stable")
                        before = enough(near) - n_[near]
                        first = np.zeros(gap.shape, bool)
                        np.put_along_axis(first, near, before < k, 1)
                        q, j = np.nonzero(first | (lower <= bound[:, None] + MARGIN))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[where][q]), pa.array(np.full(len(q), kb, np.int32)), pa.array((cell_[j] + start).astype(np.int32)), pa.array(lower[q, j]), pa.array(first[q, j])], ["query_id", "kb_id", "cell", "lower", "first"]
                        )

        return queries.mapInArrow(run, "query_id long, kb_id int, cell int, lower double, first boolean")

    def _scan(self, probes: DataFrame, queries: DataFrame, k: int, filters: dict | None) -> DataFrame:
        """The k best of each (query, knowledge base) in each block of vectors. A cell's vectors and queries are dealt to blocks, and a task holds
        one of each against each other."""
        per_cell = materialize(probes.groupBy("cell").agg(F.countDistinct("query_id").alias("asked")), "asked_cells")
        asked = {r["cell"]: r["asked"] for r in per_cell.collect()}
        rows = self.store._rows("vectors", self.store.state(), set(asked))
        rows = apply_filters(rows, filters or {}).select(F.coalesce(F.col("kb_id"), F.lit(0)).cast("int").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "cell", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        sizes = self.store.read("cells").groupBy("cell").agg(F.sum("n").alias("n"))
        blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / F.lit(size)), F.lit(1)).cast("int")
        # A row for each cell.
        dealt = F.broadcast(per_cell.join(sizes, "cell").select("cell", blocks("n", BLOCK).alias("parts"), blocks("asked", QUERY_BLOCK).alias("asks")))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = rows.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).withColumn("ask", each("asks")).drop("parts", "asks")
        wanted = probes.groupBy("query_id", "cell").agg(F.collect_set("kb_id").alias("kbs")).join(queries, "query_id")
        wanted = wanted.join(dealt, "cell").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int")).withColumn("part", each("parts")).drop("parts", "asks")

        def hold(vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(vectors) and len(asking):
                y = units(np.stack(vectors["embedding"].to_numpy()))
                x = units(np.stack(asking["embedding"].to_numpy()))
                kbs, ids = vectors["kb_id"].to_numpy(), vectors["chunk_id"].to_numpy()
                for kb in np.unique(kbs):
                    q, v = np.array([kb in s for s in asking["kbs"]]), kbs == kb
                    if q.any():
                        at, chunk, score = best_pairs(x[q], y[v], ids[v], k)
                        found.append(pd.DataFrame({"query_id": asking["query_id"].to_numpy()[q][at], "kb_id": kb, "chunk_id": chunk, "dense_score": score}))
            return pd.concat(found) if found else pd.DataFrame({"query_id": [], "kb_id": [], "chunk_id": [], "dense_score": []})

        keys = ["cell", "part", "ask"]
        return rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(hold, _HITS)

    def search(self, queries: DataFrame, k: int, filters: dict | None = None, post_filter: bool = False) -> DataFrame:
        """queries (query_id long, embedding) -> query_id, kb_id, chunk_id, dense_score, dense_rank: for each query and knowledge base the k of
        largest cosine among the rows that the filters leave, ties by chunk_id; post_filter: of the k nearest, those that they leave."""
        if post_filter:
            kept = apply_filters(self.read(), filters or {}).select(F.col("chunk_id").cast("string").alias("chunk_id"))
            return self.search(queries, k).join(kept, "chunk_id", "left_semi")
        return self.search_and_reads(queries, k, filters)[0]

    def search_and_reads(self, queries: DataFrame, k: int, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """The hits of search(), and (query_id, kb_id, cells, cells_read, vectors, vectors_read)."""
        queries = materialize(queries.filter(usable(F.col("embedding"))).select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vector_queries")
        stats = materialize(self._stats(filters), "cell_stats")
        probes = materialize(self._probes(queries, stats, k), "probes")
        order = [F.col("dense_score").desc(), F.col("chunk_id")]
        rank = lambda hits: ranked(hits, ["query_id", "kb_id"], order, "dense_rank", k)
        first = materialize(rank(self._scan(probes.filter("first"), queries, k, filters)), "first_hits")
        farthest = first.groupBy("query_id", "kb_id").agg(F.when(F.count("*") >= k, F.acos(F.least(F.min("dense_score"), F.lit(1.0)))).alias("reach"))
        more = probes.filter("not first").join(farthest, ["query_id", "kb_id"], "left")
        more = materialize(more.filter(F.col("reach").isNull() | (F.col("lower") <= F.col("reach") + MARGIN)).drop("reach"), "more_probes")
        hits = first.drop("dense_rank")
        if not more.isEmpty():
            hits = hits.unionByName(self._scan(more, queries, k, filters))
        read = probes.filter("first").unionByName(more).join(stats, ["kb_id", "cell"]).groupBy("query_id", "kb_id").agg(F.count("*").alias("cells_read"), F.sum("n").alias("vectors_read"))
        whole = stats.groupBy("kb_id").agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"))
        return rank(hits), read.join(whole, "kb_id").select("query_id", "kb_id", "cells", "cells_read", "vectors", "vectors_read")


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, unit vectors, rows) of a column of lists; null and empty ones are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        where = np.flatnonzero(lengths == d)
        yield d, units(column.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)), where
