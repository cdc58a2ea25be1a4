"""Candidate search: hashed embeddings, dense, lexical and BM25 top-k, over batches of queries.

Every operator takes all queries at once, in blocks of a bounded number that are broadcast. Chunks stay where they are: a task
scores its own by products of matrices and keeps the k best of each query, so the shuffle holds k rows a query and task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

DIMENSION = 384
#: Queries that one pass over the chunks broadcasts; runs of which a task remembers the tokens.
QUERY_BLOCK, REMEMBERED = 256, 200_000
#: Scores are ranked to so many digits, so that the order of equal ones does not hang on the order of additions: cosines, and
#: sums of weights, which are larger.
DIGITS, SUM_DIGITS = 12, 9
K1, B = 1.2, 0.75
RUN = r"[一-鿿]+|[A-Za-z0-9_-]+"


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str, most: int | None = None) -> DataFrame:
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return df.filter(F.col(name) <= most) if most else df


def hash_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, weight): each token adds 1 or -1 at a place that its SHA-256 gives; vectors have length 1."""
    tokens = rows.select(key, F.explode(X.embedding_tokens(F.col(text))).alias("token"))
    tokens = tokens.groupBy(key, "token").agg(F.count("*").alias("n"))
    digest = F.sha2(F.col("token"), 256)
    number = lambda start, size: F.conv(F.substring(digest, start, size), 16, 10).cast("long")
    sign = F.when(number(9, 2) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    cells = tokens.groupBy(key, (number(1, 8) % DIMENSION).cast("int").alias("idx")).agg(F.sum(sign).alias("raw")).filter("raw <> 0")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return cells.select(key, "idx", (F.col("raw") / norm).alias("weight"))


def as_vectors(cells: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, embedding) of (key, idx, weight)."""
    filled = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    return filled.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def repeated(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().filter("count > 1").isEmpty()


def texts_once(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with the texts of a key's rows, a line each."""
    return rows.groupBy(key).agg(F.array_join(F.collect_list(text), "\n").alias(text))


def bag(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, term's place, distinct terms, times): each list's distinct terms, by row."""
    flat = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False))
    n = max(len(flat.dictionary), 1)
    cells, times = np.unique(row * n + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return cells // n, cells % n, flat.dictionary, times


def row_local(rows: DataFrame, key: str, text: str, terms: Callable[[Column], Column], columns: dict[str, str], run: Callable[[pa.ListArray], tuple[np.ndarray, list[pa.Array]]], slice_rows: int = 1024) -> DataFrame:
    """rows without text, with the columns (name: type) that run makes of lists of terms: run gives the places of the rows that stay, and their columns.

    Nothing is shuffled. Where a key has several rows, their texts are taken together first."""
    if repeated(rows, key):
        return row_local(texts_once(rows, key, text), key, text, terms, columns, run, slice_rows).join(rows.drop(text), key)
    given = rows.select(*[c for c in rows.columns if c != text], terms(F.col(text)).alias("_terms"))
    kept = given.drop("_terms").schema
    names = kept.names

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                stay, made = run(part.column("_terms"))
                left = part.select(names).take(pa.array(stay))
                yield pa.RecordBatch.from_arrays([*left.columns, *made], [*names, *columns])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} {t}" for c, t in columns.items()]
    return given.mapInArrow(encode, ", ".join(types))


class HashedTokens:
    """The place and sign of tokens, of which a task remembers those it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, token: str) -> int:
        """Twice the place, and 1 more where the token is subtracted."""
        if (at := self.known.get(token)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            digest = hashlib.sha256(token.encode()).digest()
            at = self.known[token] = int.from_bytes(digest[:4]) % DIMENSION * 2 + digest[4] % 2
        return at


def hash_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows without text, with embedding: as_vectors() of hash_embedding(), row by row. Texts without a vector are left out."""
    hashed = HashedTokens()

    def run(terms: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
        row, term, names, times = bag(terms)
        at = np.array([hashed.of(t) for t in names.to_pylist()], np.int64)[term]
        raw = np.bincount(row * DIMENSION + at // 2, np.where(at % 2 == 0, times, -times), len(terms) * DIMENSION).reshape(-1, DIMENSION)
        stay = np.flatnonzero((raw != 0).any(axis=1))
        raw = raw[stay]
        weights = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)) + 0.0
        return stay, [pa.ListArray.from_arrays(pa.array(np.arange(len(stay) + 1, dtype=np.int32) * DIMENSION), pa.array(weights.ravel()))]

    return row_local(rows, key, text, X.embedding_tokens, {"embedding": "array<double>"}, run)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows without text, with terms and times: the distinct tokens of each text that has some, and how often it holds them."""

    def run(terms: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
        row, term, names, times = bag(terms)
        stay, sizes = np.unique(row, return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return stay, [pa.ListArray.from_arrays(ends, names.take(pa.array(term))), pa.ListArray.from_arrays(ends, pa.array(times))]

    return row_local(rows, key, text, X.embedding_tokens, {"terms": "array<string>", "times": "array<long>"}, run)


def query_blocks(queries: DataFrame, block: int) -> Iterator[pd.DataFrame]:
    """The queries in blocks of about that many, by the hash of their ids: what one pass over the chunks broadcasts."""
    n = -(-queries.count() // block)
    of = F.pmod(F.xxhash64("query_id"), F.lit(max(n, 1)))
    for k in range(n):
        part = queries.filter(of == k).orderBy("query_id").toPandas()
        if len(part):
            yield part


class Best:
    """The k best chunks of each query so far, ties by chunk_id, in one group of chunks; merge() before they are read."""

    def __init__(self, k: int, least: np.ndarray | None = None):
        """least: scores below which no chunk of a query is wanted."""
        self.k, self.least = k, least
        self.query, self.score, self.chunk = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, chunks: np.ndarray) -> None:
        """scores: a row for each query, a column for each chunk; those that are not finite don't count."""
        if self.least is None:
            self.least = np.full(len(scores), -np.inf)
        there = (scores >= self.least[:, None]) & (scores > -np.inf)
        if scores.shape[1] > self.k:
            # Whatever is below a batch's own k-th score, or below that of all so far, is none of the best.
            there &= scores >= np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
        query, at = np.nonzero(there)
        if len(query):
            self.waiting.append((query, scores[query, at], chunks[at]))
            self.held += len(query)
            # Sorted when about as many wait as stay, not for each batch.
            if self.held > max(4096, 2 * self.k * len(scores)):
                self.merge()

    def merge(self) -> Best:
        if self.waiting:
            query, score, chunk = (np.concatenate(x) for x in zip((self.query, self.score, self.chunk), *self.waiting, strict=True))
            order = np.lexsort((chunk.astype(str), -score, query))
            query = query[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            query, nth, order = query[nth < self.k], nth[nth < self.k], order[nth < self.k]
            self.query, self.score, self.chunk = query, score[order], chunk[order]
            self.least[query[nth == self.k - 1]] = self.score[nth == self.k - 1]
            self.waiting, self.held = [], 0
        return self


def best_in_tasks(chunks: DataFrame, columns: list[Column], block: pd.DataFrame, k: int, scorer: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], rows: int = 1024) -> DataFrame:
    """(query_id, kb_id, chunk_id, score) of each task's k best chunks of each knowledge base for each query of the block.

    scorer makes, once in a task, what gives the scores of a batch's chunks, a row for each query. Only what tasks keep
    is shuffled by what ranks them.
    """
    names = block["query_id"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, best = scorer(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                scores, kbs = score(part), part.column("kb_id").to_numpy(zero_copy_only=False)
                chunk = np.array(part.column("chunk_id").to_pylist(), dtype=object)
                for kb in np.unique(kbs).tolist():
                    here = np.flatnonzero(kbs == kb)
                    best.setdefault(kb, Best(k)).add(scores[:, here], chunk[here])
        for kb, b in best.items():
            b.merge()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[b.query]), pa.array(np.full(len(b.query), kb), pa.int32()), pa.array(b.chunk.tolist(), pa.string()), pa.array(b.score)], ["query_id", "kb_id", "chunk_id", "score"]
            )

    kb = F.coalesce(F.col("kb_id"), F.lit(0)).cast("int").alias("kb_id")
    return chunks.select(kb, F.col("chunk_id").cast("string").alias("chunk_id"), *columns).mapInArrow(run, "query_id long, kb_id int, chunk_id string, score double")


def _all(passes: list[DataFrame], chunks: DataFrame) -> DataFrame:
    none = chunks.sparkSession.createDataFrame([], "query_id long, kb_id int, chunk_id string, score double")
    return reduce(DataFrame.unionByName, passes or [none])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """queries (query_id long, embedding) and vectors (kb_id int, chunk_id string, embedding) -> query_id, kb_id,
    chunk_id, dense_score, dense_rank: for each query and knowledge base the k of largest cosine, ties by chunk_id.

    Null, empty and zero vectors are left out, and vectors are only held against queries of their length. Each block of queries
    is a pass over the vectors, which stay where they are: a task keeps its own k best, and only these are shuffled.
    """
    stored = vectors.filter("embedding is not null")
    column = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    passes = []
    for part in query_blocks(queries.filter("embedding is not null").select("query_id", "embedding"), block):
        asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = part["embedding"].map(len).to_numpy()
        for d in np.unique(size[size > 0]).tolist():
            x = units(np.stack([np.asarray(v, np.float64) for v in part["embedding"][size == d]]))
            there = (x != 0).any(axis=1)
            asked[d] = np.flatnonzero(size == d)[there], x[there]

        def scorer(asked=asked, n=len(part)):
            def score(batch: pa.RecordBatch) -> np.ndarray:
                lists = batch.column("embedding")
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                out = np.full((n, batch.num_rows), -np.inf)
                for d, (at, q) in asked.items():
                    here = np.flatnonzero(size == d)
                    x = units(lists.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                    out[np.ix_(at, here)] = np.where((x != 0).any(axis=1), np.round(q @ x.T, DIGITS) + 0.0, -np.inf)
                return out

            return score

        passes.append(best_in_tasks(stored, [column], part, k, scorer))
    out = _all(passes, vectors).withColumnRenamed("score", "dense_score")
    return ranked(out, ["query_id", "kb_id"], [F.col("dense_score").desc(), F.col("chunk_id")], "dense_rank", k)


def units(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_pairs(q: np.ndarray, x: np.ndarray, chunks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, chunk, score) of the k best of x for each row of q, all unit vectors, ties by chunk."""
    scores = np.round(q @ x.T, DIGITS) + 0.0
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        at, of = np.nonzero(scores >= least[:, None])
    else:
        at, of = (a.ravel() for a in np.indices(scores.shape))
    score, chunk = scores[at, of], chunks[of]
    order = np.lexsort((chunk.astype(str), -score, at))
    at = at[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], chunk[order][top], score[order][top]


def concatenated(hits: DataFrame, rank: str, kb_order: Column | None = None) -> DataFrame:
    """Adds pos, a hit's place in the query's list: knowledge bases one after the other, not sorted again."""
    return ranked(hits, ["query_id"], [kb_order if kb_order is not None else F.col("kb_id"), F.col(rank)], "pos")


class TokenCounts:
    """How often tokens occur in runs, also inside of them; a token is looked up by its first characters."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.n = tokens, len(tokens)
        self.by_start: dict[str, list[int]] = {}
        for k, t in enumerate(tokens):
            if t:
                self.by_start.setdefault(t[:3], []).append(k)
        self.sizes = sorted({len(g) for g in self.by_start})
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, run: str) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, times) of a run."""
        if run not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            grams = {run[i : i + n] for n in self.sizes for i in range(len(run) - n + 1)}
            found = [(k, run.count(self.tokens[k])) for g in grams & self.by_start.keys() for k in self.by_start[g]]
            found = [x for x in found if x[1]]
            self.known[run] = np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.float64)
        return self.known[run]

    def matrix(self, runs: pa.ListArray) -> np.ndarray:
        """Occurrences of each token in each list of runs."""
        flat = runs.flatten().dictionary_encode()
        found = [self.of(r) for r in flat.dictionary.to_pylist()]
        sizes = np.array([len(k) for k, _ in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        tokens, times = (np.concatenate(x) if found else np.zeros(0) for x in ([k for k, _ in found], [n for _, n in found]))
        row = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        run = flat.indices.to_numpy(zero_copy_only=False)
        each = sizes[run]
        at = np.repeat(starts[run] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.bincount(np.repeat(row, each) * self.n + tokens[at].astype(np.int64), times[at], len(runs) * self.n).reshape(len(runs), self.n)


def _asked(part: pd.DataFrame, terms: str) -> tuple[list[str], np.ndarray]:
    """The distinct terms of a block's queries, and which query has which."""
    names = sorted({t for ts in part[terms] for t in ts})
    place = {t: k for k, t in enumerate(names)}
    has = np.zeros((len(part), len(names)))
    for q, ts in enumerate(part[terms]):
        has[q, [place[t] for t in ts]] = 1.0
    return names, has


def lexical_best(queries: DataFrame, chunks: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, query) and (kb_id, chunk_id, content) -> query_id, kb_id, chunk_id, lexical_score: for each query and
    knowledge base the k chunks with most occurrences of the query's tokens, also inside of words; above 0, ties by chunk_id.

    A token holds characters of one class, so it occurs inside runs of that class alone: a task counts the tokens of a
    block of queries in each distinct run once, and a chunk's scores are a product of matrices.
    """
    tokens = queries.select("query_id", X.query_tokens(F.coalesce("query", F.lit(""))).alias("tokens")).filter(F.size("tokens") > 0)
    runs = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(RUN), F.lit(0)).alias("runs")
    passes = []
    for part in query_blocks(tokens, block):
        names, has = _asked(part, "tokens")

        def scorer(names=names, has=has):
            counts = TokenCounts(names)

            def score(batch: pa.RecordBatch) -> np.ndarray:
                scores = has @ counts.matrix(batch.column("runs")).T
                return np.where(scores > 0, scores, -np.inf)

            return score

        passes.append(best_in_tasks(chunks, [runs], part, k, scorer, rows=256))
    out = _all(passes, chunks).withColumn("lexical_score", F.col("score").cast("long")).drop("score")
    return ranked(out, ["query_id", "kb_id"], [F.col("lexical_score").desc(), F.col("chunk_id")], "kb_rank", k).drop("kb_rank")


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best over all knowledge bases, ties by chunk_id, with lexical_rank."""
    hits = lexical_best(queries, chunks.withColumn("kb_id", F.lit(0)), k).drop("kb_id")
    return ranked(hits, ["query_id"], [F.col("lexical_score").desc(), F.col("chunk_id")], "lexical_rank", k)


def bm25_best(queries: DataFrame, chunks: DataFrame, k: int, k1: float = K1, b: float = B, analyzer: str = "default", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, query) and (kb_id, chunk_id, content) -> query_id, kb_id, chunk_id, sparse_score: for each query and
    knowledge base the k chunks of largest Okapi BM25 of analysed terms; idf is ln(1 + (N - df + 0.5) / (df + 0.5))."""
    analyse = X.ANALYZERS[analyzer]
    terms = chunks.select(*[c for c in ("kb_id", "chunk_id") if c in chunks.columns], analyse(F.coalesce("content", F.lit(""))).alias("terms")).filter(F.size("terms") > 0)
    n, mean = terms.agg(F.count("*"), F.avg(F.size("terms"))).first()
    asked = queries.select("query_id", F.array_distinct(analyse(F.coalesce("query", F.lit("")))).alias("terms")).filter(F.size("terms") > 0)
    passes = []
    for part in query_blocks(asked, block) if n else []:
        names, has = _asked(part, "terms")
        # As many rows as the block has terms.
        few = F.broadcast(chunks.sparkSession.createDataFrame([(t,) for t in names], "term string"))
        df = terms.select(F.explode(F.array_distinct("terms")).alias("term")).join(few, "term").groupBy("term").count().collect()
        df = {r["term"]: r["count"] for r in df}
        idf = np.array([math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in names])

        def scorer(names=names, has=has, idf=idf):
            place = {t: i for i, t in enumerate(names)}

            def score(batch: pa.RecordBatch) -> np.ndarray:
                lists = batch.column("terms")
                flat, size = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                at = np.array([place.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(len(lists)), size)[at >= 0]
                tf = np.bincount(row * len(names) + at[at >= 0], minlength=len(lists) * len(names)).reshape(len(lists), -1)
                weight = idf * tf * (k1 + 1) / (tf + (k1 * (1 - b + b * size / mean))[:, None])
                there = has @ (tf > 0).T > 0
                return np.where(there, np.round(has @ weight.T, SUM_DIGITS), -np.inf)

            return score

        passes.append(best_in_tasks(terms, [F.col("terms")], part, k, scorer, rows=256))
    out = _all(passes, chunks).withColumnRenamed("score", "sparse_score")
    return ranked(out, ["query_id", "kb_id"], [F.col("sparse_score").desc(), F.col("chunk_id")], "kb_rank", k).drop("kb_rank")


def sparse_best(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Learned sparse vectors, (query_id, vector) and (kb_id, chunk_id, vector) with maps of terms to weights -> query_id,
    kb_id, chunk_id, sparse_score: the k of largest inner product of those that share a term."""
    parts = lambda v: [F.map_keys(v).cast("array<string>").alias("terms"), F.map_values(v).cast("array<double>").alias("weights")]
    asked = queries.filter("size(vector) > 0").select("query_id", *parts("vector"))
    stored = vectors.filter("size(vector) > 0")
    passes = []
    for part in query_blocks(asked, block):
        names, has = _asked(part, "terms")
        place = {t: i for i, t in enumerate(names)}
        weight = np.zeros_like(has)
        for q, (ts, ws) in enumerate(zip(part["terms"], part["weights"], strict=True)):
            weight[q, [place[t] for t in ts]] = ws

        def scorer(place=place, has=has, weight=weight):
            def score(batch: pa.RecordBatch) -> np.ndarray:
                lists = batch.column("terms")
                flat, size = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                at = np.array([place.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy(zero_copy_only=False)]
                cells = np.repeat(np.arange(len(lists)), size)[at >= 0] * len(place) + at[at >= 0]
                shape, n = (len(lists), len(place)), len(lists) * len(place)
                x = np.bincount(cells, batch.column("weights").flatten().to_numpy(zero_copy_only=False)[at >= 0], n).reshape(shape)
                there = has @ np.bincount(cells, minlength=n).reshape(shape).T > 0
                return np.where(there, np.round(weight @ x.T, SUM_DIGITS) + 0.0, -np.inf)

            return score

        passes.append(best_in_tasks(stored, parts("vector"), part, k, scorer, rows=256))
    out = _all(passes, vectors).withColumnRenamed("score", "sparse_score")
    return ranked(out, ["query_id", "kb_id"], [F.col("sparse_score").desc(), F.col("chunk_id")], "kb_rank", k).drop("kb_rank")


def sparse_topk(best: DataFrame, k: int) -> DataFrame:
    """The k best over all knowledge bases of what bm25_best() or sparse_best() gives, ties by chunk_id, with sparse_rank."""
    return ranked(best.drop("kb_id"), ["query_id"], [F.col("sparse_score").desc(), F.col("chunk_id")], "sparse_rank", k)


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return sparse_topk(bm25_best(queries, chunks.withColumn("kb_id", F.lit(0)), k), k)
