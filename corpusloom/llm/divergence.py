"""Source divergence audit: how far each source's words are from its language's and from each other source's.

Sort-based streaming. A task sorts the terms of some megabytes of text by (language, term, source, document) and scans the
runs for document frequencies and counts; these partial runs are shuffled by (language, term), sorted again by
(language, term, source), and a second scan adds them up and keeps the terms of enough documents. A third scan of
the kept runs gives each task's sums for pairs of sources and each source's foremost terms, which are added up and
ranked. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, release

#: What lies between terms.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that hold a term which is kept; ranks of terms that are told.
LEAST_DOCS, TOP = 3, 200
#: Probabilities are whole numbers of this part.
UNIT = 1_000_000_000
#: Characters of text that a task sorts at once; cells of numbers that it holds for pairs of sources.
SORTED_CHARS, CELLS = 6_000_000, 2_000_000

PARTIAL = "lang_no int, term string, grp int, df long, n long"
KEPT = "lang_no int, term string, grps array<int>, counts array<long>"
OUT = "lang string, source string, part string, item string, value long, rank int"


def probability(counts: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + v)), in whole numbers of any size."""
    if counts.size and counts.max() >= 2**63 // UNIT - 1:
        return (1 + UNIT * (counts.astype(object) + 1) // (total.astype(object) + v)).astype(np.int64)
    return 1 + UNIT * (counts + 1) // (total + v)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def starts_of(changed: np.ndarray) -> np.ndarray:
    """Places where runs begin; changed: whether a row differs from the one before, for all but the first."""
    return np.flatnonzero(np.concatenate([[True], changed]))


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rows whose lengths add up to about most; a longer row is a slice of its own."""
    of = np.cumsum(lengths) // most
    ends = np.concatenate([starts_of(of[1:] != of[:-1]), [len(lengths)]]) if len(lengths) else [0]
    yield from zip(ends[:-1], ends[1:], strict=True)


def counted(group: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """(term, grp, df, n): runs of the texts' terms, sorted by (group, term, document)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    words = lists.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[there]
    if not len(doc):
        return None
    terms = words.filter(pa.array(there)).dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # A document has one group: numbering documents by group sorts by (group, document) in one number.
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    keys = np.sort(code * len(group) + place[doc])
    at, here = keys // len(group), by_group[keys % len(group)]
    of = group[here]
    docs = starts_of(keys[1:] != keys[:-1])
    runs = starts_of((at[1:] != at[:-1]) | (of[1:] != of[:-1]))
    n = np.diff(np.append(runs, len(keys)))
    df = np.diff(np.append(np.searchsorted(docs, runs), len(docs)))
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(at[runs])), pa.array(of[runs].astype(np.int32)), pa.array(df), pa.array(n)], ["term", "grp", "df", "n"])


def _partial_runs(place: dict, lang_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []
        chars = 0

        def told() -> Iterator[pa.RecordBatch]:
            found = counted(np.concatenate([g for g, _ in held]), pa.concat_arrays([t for _, t in held]))
            if found is not None:
                lang = pa.array(lang_of[found.column("grp").to_numpy()])
                yield pa.RecordBatch.from_arrays([lang, *found.columns], ["lang_no", *found.schema.names])

        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.fromiter((place[x] for x in names), np.int64, batch.num_rows)
            texts = batch.column("text")
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(lengths, SORTED_CHARS):
                held.append((group[a:b], texts[a:b]))
                chars += int(lengths[a:b].sum())
                if chars >= SORTED_CHARS:
                    yield from told()
                    held, chars = [], 0
        if held:
            yield from told()

    return run


@dataclass
class _Runs:
    """Rows of (lang_no, term, grp, df, n) as columns."""

    lang: np.ndarray
    term: pa.Array
    grp: np.ndarray
    df: np.ndarray
    n: np.ndarray

    def cut(self, a: int, b: int) -> _Runs:
        return _Runs(self.lang[a:b], self.term[a:b], self.grp[a:b], self.df[a:b], self.n[a:b])

    def after(self, first: _Runs | None) -> _Runs:
        if first is None:
            return self
        join = lambda name: np.concatenate([getattr(first, name), getattr(self, name)])
        return _Runs(join("lang"), pa.concat_arrays([first.term, self.term]), join("grp"), join("df"), join("n"))

    def changes(self) -> np.ndarray:
        """Whether a row has another (language, term) than the row before."""
        same = pc.equal(self.term[1:], self.term[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        return ~same | (self.lang[1:] != self.lang[:-1])

    def summed(self) -> _Runs:
        """One row for each (language, term, source); the rows are sorted by these."""
        at = starts_of(self.changes() | (self.grp[1:] != self.grp[:-1]))
        return _Runs(self.lang[at], self.term.take(pa.array(at)), self.grp[at], np.add.reduceat(self.df, at), np.add.reduceat(self.n, at))


def _kept_runs(least_docs: int):
    """Scans rows sorted by (lang_no, term, grp); of a run that goes on in the next batch a row for each source is held."""

    def told(rows: _Runs) -> Iterator[pa.RecordBatch]:
        rows = rows.summed()
        at = starts_of(rows.changes())
        sizes = np.diff(np.append(at, len(rows.grp)))
        keep = np.add.reduceat(rows.df, at) >= least_docs
        inner = np.repeat(keep, sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32))
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.lang[at][keep]), rows.term.take(pa.array(at[keep])), pa.ListArray.from_arrays(ends, pa.array(rows.grp[inner])), pa.ListArray.from_arrays(ends, pa.array(rows.n[inner]))],
                ["lang_no", "term", "grps", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: _Runs | None = None
        for batch in batches:
            if batch.num_rows:
                column = lambda name, b=batch: b.column(name).to_numpy()
                rows = _Runs(column("lang_no"), batch.column("term"), column("grp"), column("df"), column("n")).after(open_run)
                last = int(starts_of(rows.changes())[-1])
                if last:
                    yield from told(rows.cut(0, last))
                open_run = rows.cut(last, len(rows.grp)).summed()
        if open_run is not None:
            yield from told(open_run)

    return run


@dataclass
class Groups:
    """What tasks know of the groups, numbered by (language, source): each one's language and total, each language's first
    group, number of groups, kept terms and total."""

    lang_of: np.ndarray
    total: np.ndarray
    first: np.ndarray
    size: np.ndarray
    v: np.ndarray
    lang_total: np.ndarray

    def zero(self, lang: int) -> np.ndarray:
        """What a term that none of two groups has adds to the pair's sum, for all pairs of the language's groups."""
        a, s, v = int(self.first[lang]), int(self.size[lang]), int(self.v[lang])
        p = probability(np.zeros(s, np.int64), self.total[a : a + s], v)
        return divergence(p[:, None], p[None, :])


class _Foremost:
    """Each group's TOP terms so far, by value, ties by term."""

    def __init__(self):
        self.best: dict[int, list[tuple[int, str]]] = {}

    def add(self, grp: np.ndarray, value: np.ndarray, terms: pa.Array) -> None:
        if not len(grp):
            return
        order = np.argsort(grp, kind="stable")
        at = starts_of(grp[order][1:] != grp[order][:-1])
        for a, b in zip(at, [*at[1:], len(grp)], strict=True):
            rows = order[a:b]
            if len(rows) > TOP:
                least = np.partition(value[rows], len(rows) - TOP)[len(rows) - TOP]
                rows = rows[value[rows] >= least]
            new = list(zip((-value[rows]).tolist(), terms.take(pa.array(rows)).to_pylist(), strict=True))
            g = int(grp[order[a]])
            self.best[g] = sorted(self.best.get(g, []) + new)[:TOP]


def _told_runs(groups: Groups, columns_of: np.ndarray):
    """Rows (part, grp, other, item, value): a task's sums over pairs of groups beyond zero(), and its foremost terms.

    columns_of: so many of a language's groups are a slice of the other side of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        foremost = _Foremost()

        def pairs() -> Iterator[pa.RecordBatch]:
            for (lang, piece), s in sums.items():
                g, h = np.nonzero(s)
                first = int(groups.first[lang])
                none = pa.nulls(len(g), pa.string())
                other = h + piece * int(columns_of[lang]) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["pair"] * len(g), pa.string()), pa.array((g + first).astype(np.int32)), pa.array(other.astype(np.int32)), none, pa.array(s[g, h])], ["part", "grp", "other", "item", "value"]
                )
            sums.clear()

        def add(lang: int, piece: int, rows: pa.RecordBatch) -> None:
            first, size, v = int(groups.first[lang]), int(groups.size[lang]), int(groups.v[lang])
            lists = rows.column("grps")
            t = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
            g, n = lists.flatten().to_numpy() - first, rows.column("counts").flatten().to_numpy()
            total = groups.total[first : first + size]
            counts = np.zeros((rows.num_rows, size), np.int64)
            counts[t, g] = n
            p = probability(counts, total, v)
            if piece == 0:
                whole = probability(np.array([sum(x) for x in rows.column("counts").to_pylist()], np.int64), groups.lang_total[lang : lang + 1], v)
                own = p[t, g]
                above = np.flatnonzero(own > whole[t])
                foremost.add(g[above] + first, divergence(own[above], whole[t[above]]), rows.column("term").take(pa.array(t[above])))
            a = piece * int(columns_of[lang])
            b = min(size, a + int(columns_of[lang]))
            zero = groups.zero(lang)
            if (lang, piece) not in sums:
                if sum(map(np.size, sums.values())) > CELLS:
                    out.extend(pairs())
                sums[lang, piece] = np.zeros((size, b - a), np.int64)
            s = sums[lang, piece]
            order = np.argsort(g, kind="stable")
            t, g = t[order], g[order]
            at = starts_of(g[1:] != g[:-1])
            # The group that has the term against each other; then the groups that lack it against the one that has it.
            s[g[at]] += np.add.reduceat(divergence(p[t, g][:, None], p[t, a:b]) - zero[g, a:b], at, axis=0)
            inside = (g >= a) & (g < b)
            if inside.any():
                t, g = t[inside], g[inside]
                at = starts_of(g[1:] != g[:-1])
                lacks = np.where(counts[t] == 0, divergence(p[t], p[t, g][:, None]) - zero[:, g].T, 0)
                s[:, g[at] - a] += np.add.reduceat(lacks, at, axis=0).T

        out: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("lang_no").to_numpy().astype(np.int64) * (2**31) + batch.column("piece").to_numpy()
            for key in np.unique(keys).tolist():
                lang, piece = divmod(key, 2**31)
                rows = batch.filter(pa.array(keys == key))
                step = max(1, CELLS // (4 * int(groups.size[lang]) ** 2))
                for k in range(0, rows.num_rows, step):
                    add(lang, piece, rows.slice(k, step))
                    yield from out
                    out.clear()
        yield from pairs()
        for g, best in foremost.best.items():
            k = len(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["term"] * k, pa.string()), pa.array([g] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.array([x for _, x in best], pa.string()), pa.array([-x for x, _ in best], pa.int64())], ["part", "grp", "other", "item", "value"]
            )

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(text, lang, source) -> lang, source, part, item, value, rank; see the module's and the query's contract.

    Null text, lang and source are empty; a row is a document, whatever its id, so repeated rows count twice. Groups
    without a term, and languages none of whose terms is kept, have pairs all the same. Ties of value follow the item's
    UTF-8. Texts are read whole, in pieces of some megabytes of whole texts; a longer text is a piece of its own. Other columns are ignored. An empty table gives
    no rows. Counts, totals and sums are 64-bit numbers, products beyond them Python's.

    The groups, not the terms, go to the driver and to tasks: the result has a row for each two sources of a language, so
    they are about the square root of the result's rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    names = sorted((r["lang"], r["source"]) for r in rows.select("lang", "source").distinct().collect())
    if not names:
        return spark.createDataFrame([], OUT)
    langs = sorted({n[0] for n in names})
    number = {n: k for k, n in enumerate(langs)}
    lang_of = np.array([number[n[0]] for n in names], np.int32)
    first = np.searchsorted(lang_of, np.arange(len(langs)))
    size = np.bincount(lang_of, minlength=len(langs))

    partial = rows.mapInArrow(_partial_runs({n: k for k, n in enumerate(names)}, lang_of), PARTIAL)
    by_term = partial.repartition("lang_no", "term").sortWithinPartitions("lang_no", "term", "grp")
    kept = materialize(by_term.mapInArrow(_kept_runs(least_docs), KEPT), "kept_terms")

    total, v = np.zeros(len(names), np.int64), np.zeros(len(langs), np.int64)
    for r in kept.select(F.explode(F.arrays_zip("grps", "counts")).alias("x")).groupBy("x.grps").agg(F.sum("x.counts").alias("n")).collect():
        total[r["grps"]] = r["n"]
    for r in kept.groupBy("lang_no").count().collect():
        v[r["lang_no"]] = r["count"]
    groups = Groups(lang_of, total, first, size, v, np.add.reduceat(total, first))

    # A language of very many sources is gone through in slices of the pairs' other side, so what a task holds is bounded.
    columns_of = np.minimum(size, np.maximum(1, CELLS // size))
    pieces = -(-size // columns_of)
    listed = kept.withColumn("piece", F.lit(0))
    if (pieces > 1).any():
        n_pieces = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(pieces)], "lang_no int, pieces int")
        listed = kept.join(F.broadcast(n_pieces), "lang_no").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).sortWithinPartitions("lang_no", "piece").drop("pieces")
    told = materialize(listed.mapInArrow(_told_runs(groups, columns_of), "part string, grp int, other int, item string, value long"), "partial_runs")
    release(kept)

    with_v = [(int(k), names[k][0], names[k][1], int(lang_of[k]), int(total[k]), int(v[lang_of[k]])) for k in range(len(names))]
    named = spark.createDataFrame(with_v, "grp int, lang string, source string, lang_no int, total long, v long")
    p0 = F.when(F.col("v") > 0, F.expr(f"1 + {UNIT}L div (total + v)"))
    side = named.withColumn("p0", p0)
    pairs = side.alias("g").join(side.select("grp", "lang_no", "source", "p0").alias("h"), (F.col("g.lang_no") == F.col("h.lang_no")) & (F.col("g.grp") != F.col("h.grp")))
    zeros = F.coalesce(F.expr("v * (((g.p0 - h.p0) * (g.p0 - h.p0)) div h.p0)"), F.lit(0).cast("long"))
    pairs = pairs.select("g.lang", F.col("g.source").alias("source"), F.col("g.grp").alias("grp"), F.col("h.grp").alias("other"), F.col("h.source").alias("item"), zeros.alias("zeros"))
    more = told.filter("part = 'pair'").groupBy("grp", "other").agg(F.sum("value").alias("more"))
    pairs = pairs.join(more, ["grp", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("zeros") + F.coalesce("more", F.lit(0).cast("long"))).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    terms = told.filter("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= TOP)
    terms = terms.join(F.broadcast(named), "grp").select("lang", "source", "part", "item", "value", "rank")
    return pairs.unionByName(terms)
