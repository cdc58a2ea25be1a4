"""LM scoring: a probabilistic suffix tree over words.

A context of one to four words is a candidate when it occurs LEAST_EVENTS times in training, and so is a word after it;
one is retained when its next words diverge from those after its suffix by more than the description of the
difference costs. Next-symbol distributions are discounted and smoothed by the suffix's, down to the counts of single
words. A text is scored from the longest suffix state at each of its tokens.

All runs of words that are frequent enough are counted, however many: tasks count theirs and send sorted parts of the range of
hashes, and what is shared by fewer texts than a candidate needs is known by then. Levels are joined with those below. A run's
state and event add up in logarithms along a text, so each run has one value: those of the most frequent
runs are broadcast, up to MOST_SHARED, and the others are joined with the places of the texts that a filter lets through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, forget_shuffles, materialize, release, text_or_empty, trimmed

MAX_DEPTH = 4
DISCOUNT, LEAST_EVENTS = 0.5, 3
#: What tasks hold: words of at least this share of all training tokens, and the values of so many runs of words. All others are joined.
WORD_SHARE, MOST_SHARED = 2.0**-18, 1 << 19
#: Bits of a filter for each key, and its most 64-bit words; a longer list makes it let more through, which is sorted out later.
FILTER_BITS, FILTER_WORDS = 16, 1 << 22
#: Texts are scored, and joined with what tasks don't hold, in so many slices, one after the other: all at once would take more disk.
SLICES = 3
#: Pairs that a task holds before it counts them, and the bytes of a word that is hashed by itself.
BUFFER, LONG_WORD = 1_000_000, 64

_u = np.uint64
END = xxhash.xxh3_64_intdigest(b"", seed=1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(31))) * _u(0x7FB5D329728EA185)
    x = (x ^ (x >> _u(27))) * _u(0x81DADEF4BC2DD44D)
    return x ^ (x >> _u(33))


#: ASCII white space, as booleans; the lower bytes of a 64-bit word.
_BLANKS = bytes(c in b" \t\n\v\f\r" for c in range(256))
_LOWER = np.array([(1 << 8 * n) - 1 for n in range(9)], _u)


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The texts' words, A-Z lower-cased, split at ASCII white space, each text's with its end after them; and where each text's begin and end.

    A word's hash is that of its length, then of eight bytes at a time, over all words that are so long; the longest, of which there are
    few, are hashed one by one."""
    raw = b" ".join([b"", *texts, bytes(8)]).lower()
    blank = np.frombuffer(raw.translate(_BLANKS), bool)[:-8]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = size.astype(_u) * _u(0x9E3779B97F4A7C15)
    rows, at, left = slice(None), begin, size
    for _ in range(LONG_WORD // 8):
        h[rows] = mix(h[rows] ^ (eights[at] & _LOWER[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows, at, left = more if isinstance(rows, slice) else rows[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[begin[k] : begin[k] + size[k]])
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    before = np.searchsorted(begin, bounds) + np.arange(len(texts) + 1)
    out = np.empty(len(h) + len(texts), _u)
    word = np.ones(len(out), bool)
    word[before[1:] - 1] = False
    out[word], out[~word] = h, END
    return out, before.tolist()


def token_hashes(text: int, hashes: tuple[np.ndarray, list[int]]) -> np.ndarray:
    """The words and the end of one of the texts of hashes_of()."""
    tokens, bounds = hashes
    return tokens[bounds[text] : bounds[text + 1]]


def longer(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The run of words that is context but for its last and suffix but for its first word."""
    return mix(context * _u(0x9E3779B97F4A7C15) + suffix)


class Places:
    """Finds the place of hashes in an array of distinct hashes: open addressing."""

    def __init__(self, keys: np.ndarray, room: int = 2):
        size = 1 << max(4, (room * len(keys)).bit_length())
        self.keys, self.mask = keys, _u(size - 1)
        self.slots = np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & int(self.mask)

    def find(self, q: np.ndarray) -> np.ndarray:
        """-1 where it isn't among them."""
        if not len(self.keys):
            return np.full(len(q), -1, np.int64)
        at = (q & self.mask).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != q[open_])]
        return out


class Filter:
    """Says of hashes whether they may be among the listed ones: a 64-bit word with three bits for each."""

    def __init__(self, keys: DataFrame, n: int):
        size = max(4, min(FILTER_WORDS, n * FILTER_BITS // 64)).bit_length()
        key, one = F.col(keys.columns[0]), F.lit(1).cast("long")
        bit = lambda at: F.call_function("shiftleft", one, F.shiftrightunsigned(key, at).bitwiseAND(63).cast("int"))
        bits = keys.groupBy(F.shiftrightunsigned(key, 65 - size).alias("at")).agg(F.bit_or(bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))).alias("bits"))
        t = bits.toArrow()
        self.shift, self.words = _u(65 - size), np.zeros(1 << (size - 1), _u)
        self.words[t.column("at").to_numpy()] = t.column("bits").to_numpy().view(_u)

    def has(self, q: np.ndarray) -> np.ndarray:
        bits = _u(1) << (q & _u(63)) | _u(1) << ((q >> _u(6)) & _u(63)) | _u(1) << ((q >> _u(12)) & _u(63))
        return self.words[q >> self.shift] & bits == bits


@dataclass
class Tree:
    """words: the frequent words' hashes and log10 probabilities at the root. contexts: for each length of a run of words, the most
    frequent runs' hashes, and what they add to the log10 probability of their last word and of the word after them.
    listed: whether a run may have a value. rest: (key, value) of the runs that are not among contexts, read from values."""

    words: Places
    word_log: np.ndarray
    contexts: list[tuple[Places, np.ndarray, np.ndarray]]
    listed: Filter | None
    rest: DataFrame | None
    train_tokens: int
    train_words: int
    values: DataFrame | None = None


def runs_at(tokens: np.ndarray, starts: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to longest, the run of words that ends at each token; 0 where the text begins after it would."""
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    out = [mix(tokens)]
    for k in range(1, longest):
        run = np.zeros_like(tokens)
        run[1:] = longer(out[-1][:-1], out[-1][1:])
        out.append(np.where(place >= k, run, _u(0)))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with all their tokens in one array, and where each text's begin."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            hashes = hashes_of(part.column("text").cast(pa.binary()).to_pylist())
            lists = [token_hashes(k, hashes) for k in range(part.num_rows)]
            starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
            yield part, np.concatenate(lists), starts


def _counted(keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Counts the keys of each task's texts, a buffer at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for _, tokens, starts in _texts(batches):
            held.append(keys_of(tokens, starts))
            size += len(held[-1])
            if size >= BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def count(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, n) over all texts: summed by each task before the shuffle."""
    return docs.mapInArrow(_counted(keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """keys and n, sorted by key; df is bounded by a least share."""
    t = df.select("key", "n").toArrow()
    keys, n = t.column("key").to_numpy().astype(np.int64).view(_u), t.column("n").to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


_PARTS = "length int, part int, context binary, suffix binary, n binary"
_RUNS = "length int, run long, context long, suffix long, n long"


def _summed(run: np.ndarray, *columns: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct runs in order, with their columns and how often each stands there, or the sum of n."""
    order = np.argsort(run)
    run = run[order]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(run))) if n is None else np.add.reduceat(n[order], first) if len(run) else n
    return run[first], *[c[order[first]] for c in columns], total


def _sorted_parts(lengths: list[int], filtered, parts: int) -> Callable:
    """Counts each task's runs of words, a buffer at a time, cut into parts of the range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = lengths[0] - 1
        held: dict[int, list[tuple]] = {k: [] for k in lengths}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for k in lengths:
                if held[k]:
                    runs, context, suffix, n = _summed(*map(np.concatenate, zip(*held[k], strict=True)))
                    held[k].clear()
                    cuts = np.searchsorted((runs >> _u(32)) * _u(parts) >> _u(32), np.arange(parts + 1, dtype=_u))
                    some = np.flatnonzero(np.diff(cuts))
                    binary = lambda x, some=some, cuts=cuts: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.append(cuts[some], cuts[-1]) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
                    columns = [binary(context), binary(suffix if k > 1 else np.zeros(len(suffix), "V0")), binary(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), *columns], ["length", "part", "context", "suffix", "n"])

        for _, tokens, starts in _texts(batches):
            runs = [tokens, *runs_at(tokens, starts, lengths[-1])]
            may = filtered.value.has(runs[below]) if filtered else None
            for k in lengths:
                if may is None:
                    at = np.flatnonzero(runs[k]) if k > 1 else np.arange(len(tokens))
                else:
                    may = may & np.append(False, may[:-1])  # a run is not more frequent than the shorter runs in it
                    at = np.flatnonzero(may & (runs[k] != 0))
                # A single word stands in for its context.
                held[k].append((runs[k][at], runs[k - 1][at - 1] if k > 1 else tokens[at], runs[k - 1][at] if k > 1 else tokens[at]))
                size += len(at)
            if size >= BUFFER:
                yield from out()
                size = 0
        yield from out()

    return run


def _merged(part: pa.Table) -> pa.Table:
    """One part of the range of hashes of all tasks; words of any count, longer runs that are frequent enough."""
    length = part.column("length")[0].as_py()
    context, suffix = (np.frombuffer(b"".join(part.column(c).to_pylist()), _u) for c in ("context", "suffix"))
    n = np.frombuffer(b"".join(part.column("n").to_pylist()), np.int32).astype(np.int64)
    run, context, suffix, n = _summed(*((longer(context, suffix), context, suffix) if length > 1 else (mix(context), context, context)), n=n)
    keep = n >= (LEAST_EVENTS if length > 1 else 1)
    longs = [pa.array(x[keep].view(np.int64)) for x in (run, context, suffix, n)]
    return pa.table([pa.array(np.full(int(keep.sum()), length, np.int32)), *longs], names=["length", "run", "context", "suffix", "n"])


def count_runs(docs: DataFrame, lengths: list[int], below: Filter | None = None) -> DataFrame:
    """(length, run, context, suffix, n) of all single words, and of longer runs of words with LEAST_EVENTS.

    lengths rise by one; with below, a filter of the runs one word shorter than the first of them, only what it lets through is sent."""
    spark = docs.sparkSession
    filtered = spark.sparkContext.broadcast(below) if below else None
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(trimmed(_sorted_parts(lengths, filtered, parts)), _PARTS)
    out = materialize(rows.groupBy("length", "part").applyInArrow(_merged, _RUNS), "runs")
    if filtered:
        filtered.destroy()
    forget_shuffles(spark)
    return out


def _level(events: DataFrame, below: DataFrame, total: float) -> DataFrame:
    """events, of contexts of one length, with their probability p, what they add to the logarithm of their suffix's event (own),
    that of the context's weight of its suffix's distribution (next), and whether it diverges. below: (run, n, p), one word shorter."""
    rows = events.join(below.select(F.col("run").alias("suffix"), F.col("p").alias("above")), "suffix")
    rows = rows.join(below.select(F.col("run").alias("context"), F.col("n").alias("uses")), "context")
    # Counts times the divergence of the context's next words from its suffix's; words without an event count as one.
    stats = rows.groupBy("context").agg(
        F.first("uses").alias("u"), F.count("*").alias("events"), (1 - F.sum((F.col("n") - DISCOUNT) / F.col("uses"))).alias("rest"), F.sum("n").alias("seen"),
        F.sum("above").alias("seen_above"), F.sum(F.col("n") * F.log(F.col("n") / F.col("uses") / F.col("above"))).alias("gain"),
    )
    left, left_above = F.greatest(1 - F.col("seen") / F.col("u"), F.lit(0.0)), F.greatest(1 - F.col("seen_above"), F.lit(1e-12))
    gain = F.col("gain") + F.col("u") * left * F.log(F.greatest(left, F.lit(1e-300)) / left_above)
    stats = stats.select("context", "rest", (gain > 0.5 * math.log(max(2.0, total)) * F.col("events")).alias("diverges"))
    p = (F.col("n") - DISCOUNT) / F.col("uses") + F.col("rest") * F.col("above")
    log_rest = F.log10(F.greatest("rest", F.lit(1e-300)))
    return rows.join(stats, "context").select(
        "run", "context", "suffix", "n", "uses", p.alias("p"), (F.log10(p / F.col("above")) - log_rest).alias("own"), log_rest.alias("next"), "diverges"
    )


def _values(levels: list[DataFrame]) -> DataFrame:
    """(length, key, n, own, next) of all retained contexts and their events: what such a run adds to the log10 probability of its last
    word and of the next one. levels: of contexts from one word on."""
    out, kept = [], None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        keep = level.filter("diverges").select("context")
        if kept is not None:  # the suffixes of what is retained are
            keep = keep.unionByName(level.join(kept.withColumnRenamed("context", "run"), "run").select(F.col("suffix").alias("context")))
        kept = materialize(keep.distinct(), "kept")
        states = level.join(kept, "context")
        out.append(states.select(F.lit(k + 1).alias("length"), F.col("run").alias("key"), "n", "own", F.lit(0.0).alias("next")))
        contexts = states.groupBy("context").agg(F.first("uses").alias("n"), F.first("next").alias("next"))
        out.append(contexts.select(F.lit(k).alias("length"), F.col("context").alias("key"), "n", F.lit(0.0).alias("own"), "next"))
    return reduce(DataFrame.unionByName, out).groupBy("length", "key").agg(F.max("n").alias("n"), F.sum("own").alias("own"), F.sum("next").alias("next"))


def _least_shared(values: DataFrame) -> tuple[int, int]:
    """The least n of the values that tasks hold, and how many values there are."""
    t = values.groupBy(F.least("n", F.lit(MOST_SHARED)).alias("n")).count().toArrow()
    n, many = t.column("n").to_numpy(), t.column("count").to_numpy()
    order = np.argsort(-n)
    fit = int((np.cumsum(many[order]) <= MOST_SHARED).sum())
    return (int(n[order[fit - 1]]) if fit else 1 << 62), int(many.sum())


def learn(docs: DataFrame, words: DataFrame, max_depth: int = MAX_DEPTH, runs: DataFrame | None = None) -> Tree:
    """docs: text of the training texts; words: (key, n), the counts of all their tokens; runs: count_runs() of one and two words."""
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    spark, den = docs.sparkSession, total + 0.5 * (kinds + 1)
    word_keys, word_n = _arrays(words.filter(F.col("n") >= max(LEAST_EVENTS, total * WORD_SHARE)))
    tree = Tree(Places(word_keys), np.log10((word_n + 0.5) / den), [], None, None, int(total), int(kinds))
    if not max_depth:
        return tree
    runs = count_runs(docs, [1, 2]) if runs is None else runs
    below = runs.filter((F.col("length") == 1) & (F.col("n") >= LEAST_EVENTS)).select("run", "n", ((F.col("n") + 0.5) / den).alias("p"))
    levels: list[DataFrame] = []
    # Two words are counted with single ones, and the longest two lengths together: each pass reads all texts.
    for lengths in [[2], [3], list(range(4, max_depth + 2))]:
        lengths = [k for k in lengths if k <= max_depth + 1]
        if not lengths:
            break
        if lengths[0] > 2:
            found = levels[-1].select("run")
            runs = count_runs(docs, lengths, Filter(found, found.count()))
        for k in lengths:
            levels.append(materialize(_level(runs.filter(F.col("length") == k), below, total), "level"))
            below = levels[-1].select("run", "n", "p")
        if lengths[0] > 2:
            release(runs)
        forget_shuffles(spark)
    values = materialize(_values(levels), "values")
    release(*levels)
    forget_shuffles(spark)
    least, many = _least_shared(values)
    t = values.filter(F.col("n") >= least).toArrow()
    length, key, own, after = (t.column(c).to_numpy() for c in ("length", "key", "own", "next"))
    for k in range(1, max_depth + 2):
        tree.contexts.append((Places(key[length == k].astype(np.int64).view(_u)), own[length == k], after[length == k]))
    listed = Filter(values.select("key"), many)
    forget_shuffles(spark)
    return replace(tree, listed=listed, values=values, rest=values.filter(F.col("n") < least).select("key", (F.col("own") + F.col("next")).alias("value")))


def _scores(tree) -> Callable:
    """For each text, what the frequent words and runs of words add up to, and the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for part, tokens, starts in _texts(batches):
            word = t.words.find(tokens)
            rare = word < 0
            base = np.where(rare, 0.0, t.word_log[word]) if len(t.word_log) else np.zeros(len(tokens))
            score, ends = base.copy(), np.append(starts[1:], len(tokens))
            inside = np.ones(len(tokens), bool)
            inside[ends - 1] = False
            places, keys = [np.flatnonzero(rare)], [tokens[rare]]
            has = None
            for (listed, own, after), runs in zip(t.contexts, runs_at(tokens, starts, len(t.contexts)) if t.contexts else [], strict=True):
                # A run has a value as an event of a retained context, or as a context, whose suffix is retained.
                at = np.flatnonzero(runs if has is None else (has | np.append(False, has[:-1])) & (runs != 0))
                at = at[t.listed.has(runs[at])]
                has = np.zeros(len(tokens), bool)
                has[at] = True
                state = listed.find(runs[at])
                places.append(at[state < 0])
                keys.append(runs[places[-1]])
                at, state = at[state >= 0], state[state >= 0]
                score[at] += own[state] + after[state] * inside[at]
            counts = ends - starts
            n_rare = np.add.reduceat(rare.astype(np.int64), starts)
            place, key = np.concatenate(places), np.concatenate(keys)
            order = np.argsort(place, kind="stable")
            n_keys = np.bincount(np.searchsorted(starts, place, side="right") - 1, minlength=len(starts))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(counts), pa.array(counts - n_rare), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)), pa.array(key[order].view(np.int64)))],
                ["row", "doc_id", "n_tokens", "n_frequent", "base", "score", "rare"],
            )

    return run


def score(docs: DataFrame, training: Column, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, text) -> a row each: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    The tree is learned from the rows for which training holds; all rows are scored. Null texts are empty, and an
    empty text is one token, its end. Rows that repeat are texts each; other columns are ignored. Without training
    rows each token has probability 1. Scores are log10 probabilities; base_score is that of single words alone.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"), training.alias("training"))
    learned = texts.filter("training").select("text")
    runs = count_runs(learned, [1, 2] if max_depth else [1])
    words = materialize(runs.filter("length = 1").select(F.col("context").alias("key"), "n"), "word_counts")
    tree = learn(learned, words, max_depth, runs)
    release(runs)
    shared = docs.sparkSession.sparkContext.broadcast(replace(tree, rest=None, values=None))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_frequent long, base double, score double, rare array<long>"
    # Words that training has not seen count as half a one.
    table = words.select("key", F.log10((F.col("n") + 0.5) / 0.5).alias("value"), F.lit(True).alias("word"))
    if tree.rest is not None:
        table = table.unionByName(tree.rest.withColumn("word", F.lit(False)))
    known = lambda c: F.coalesce(c, F.lit(0))
    unseen = (F.col("n_tokens") - F.col("n_frequent")) * math.log10(0.5 / (tree.train_tokens + 0.5 * (tree.train_words + 1)))
    found = []
    for k in range(SLICES):
        # A row's slice is its own, however the table is read; a slice's hashes are deleted before the next one's are written.
        part = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        rows = materialize(part.mapInArrow(trimmed(_scores(shared)), schema), "text_scores")
        rare = rows.select("row", F.explode("rare").alias("key")).join(table.hint("shuffle_hash"), "key")
        rare = rare.groupBy("row").agg(F.sum("value").alias("all"), F.sum(F.when(F.col("word"), F.col("value"))).alias("words"), F.count_if("word").alias("known"))
        sums = rows.drop("rare").join(rare, "row", "left").select(
            "doc_id", "n_tokens", (F.col("n_frequent") + known("known")).alias("n_known"), F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + unseen + known("words")).alias("base_score"), (F.col("score") + unseen + known("all")).alias("score"),
        )
        found.append(materialize(sums, "text_sums"))
        release(rows)
        forget_shuffles(docs.sparkSession)
    release(words, *([tree.values] if tree.values is not None else []))
    shared.destroy()
    return reduce(DataFrame.unionByName, found)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 1; adds held_out, whether it is."""
    side = fold(F.col("doc_id")) % 5
    return score(docs, side != 1).withColumn("held_out", side == 1)
