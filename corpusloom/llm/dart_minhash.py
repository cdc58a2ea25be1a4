"""MinHash near-dedup: DartMinHash signatures of weighted word shingles, banded joining, exact verification.

Darts are thrown by hash into each shingle's weight region, in the order of their rank; a document is hit by
those within its weight, and keeps the earliest for each coordinate. About k ln k + 2k darts fill all k
coordinates, however many shingles there are, and two documents share a coordinate with a probability equal to
their weighted Jaccard similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bloom import blocked_bloom, with_maybe
from corpusloom.llm.common import WORD, connected_components, flat, forget_shuffles, materialize, nested, release, text_or_empty, trimmed

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair has a band in common with probability 0.99997.
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Of 128 one-bit coordinates, so many may differ where the first hubs are tried: at 0.8 they differ in 12.8, with a
#: deviation of 3.4. What the first turn passes over is left to the second, which compares all, and to the exact join.
SKETCH_BITS = 34
#: Members of a bucket with which all of it are compared.
HUBS = 4
REMEMBERED, BATCH_SHINGLES, BATCH_ROWS = 60_000, 60_000, 150

_words = re.compile(WORD).findall
_u, MASK = np.uint64, (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words (a bijection)."""
    x = (x ^ (x >> _u(33))) * _u(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _u(33))) * _u(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _u(33))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, hashes: _Hashes) -> np.ndarray:
    words = _words(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), _u, len(words))


def node_of(text: str, words: np.ndarray) -> int:
    """The same for texts of the same words; texts without a word are told apart by themselves."""
    digest = xxhash.xxh3_64_intdigest(words.tobytes(), seed=1) if len(words) else xxhash.xxh3_64_intdigest(text, seed=2)
    return digest - (1 << 63)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of width words, in order; of fewer words, one of all."""
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, _u)
    for k in range(width):
        h = mix(h ^ words[k : len(words) - width + 1 + k]) if k == 0 else h * _u(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    return mix(h)


def as_set(h: np.ndarray) -> np.ndarray:
    """Sorted hashes in which the n-th occurrence of a shingle is an element of its own: set similarity of these
    is weighted similarity of the counts."""
    h = np.sort(h)
    if len(h) < 2:
        return h
    new = np.concatenate([[True], h[1:] != h[:-1]])
    if new.all():
        return h
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.sort(np.where(nth > 0, mix(h + nth.astype(_u)), h))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _u(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate, a row for each document's (distinct elements, weights > 0).

    An element's weight axis is cut into regions [0, 1), [1, 2), [2, 4), ... In a region of width v darts arrive
    along the rank axis at exponential steps of mean 1 / v, each at a uniform place of the region; they hit
    the documents whose weight reaches beyond that place. Only darts up to a rank at which about k ln k + 2k hit
    are thrown, twice as far where a coordinate stays empty.
    """
    out = np.zeros((len(docs), k), _u)
    open_docs = np.array([i for i, (e, _) in enumerate(docs) if len(e)], np.int64)
    theta = np.zeros(len(docs))
    for i in open_docs:
        theta[i] = (k * np.log(k) + 2 * k) / docs[i][1].sum()
    while len(open_docs):
        owner = np.repeat(open_docs, [len(docs[i][0]) for i in open_docs])
        element = np.concatenate([docs[i][0] for i in open_docs])
        weight = np.concatenate([docs[i][1] for i in open_docs])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        level, low, width = 0, 0.0, 1.0
        while len(owner):
            o, w, region = owner, weight, mix(element + _u(level * 0x9E3779B97F4A7C15 & MASK))
            rank, n = np.zeros(len(o)), 0
            while len(o):
                n += 1
                dart = mix(region + _u(n * 0xD1B54A32D192ED03 & MASK))
                rank = rank - np.log(_uniform(dart)) / width
                near = rank <= theta[o]
                o, w, region, rank, dart = o[near], w[near], region[near], rank[near], dart[near]
                hit = low + width * _uniform(mix(dart ^ _u(0x5851F42D4C957F2D))) < w
                found.append((o[hit], rank[hit], dart[hit]))
            low, width, level = low + width, low + width, level + 1
            further = weight > low
            owner, element, weight = owner[further], element[further], weight[further]
        o, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        # The lower bits of a dart made its rank little else; the coordinate comes from another scramble.
        place = o * k + (mix(dart + _u(1)) % _u(k)).astype(np.int64)
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        filled = np.zeros(out.size, bool)
        filled[place[first]] = True
        flat = out.reshape(-1)
        flat[place[first]] = mix(dart[first] | _u(1))
        open_docs = open_docs[~filled.reshape(out.shape)[open_docs].all(axis=1)]
        theta[open_docs] *= 2
    return out


def bands_of(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(signature), signature.shape[1] // rows), _u) + np.arange(signature.shape[1] // rows).astype(_u)
    for r in range(rows):
        h = mix(h * _u(0x9E3779B97F4A7C15) + signature[:, r::rows][:, : h.shape[1]])
    return h.view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches a few rows at a time, with their texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            yield part, part.column("text").to_pylist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for part, texts in _parts(batches):
        nodes, sets = [], []
        for text in texts:
            words = word_hashes(text, hashes)
            nodes.append(node_of(text, words))
            sets.append(shingles(words))
        at = 0
        while at < len(sets):
            size, to = 0, at
            while to < len(sets) and (to == at or size + len(sets[to]) <= BATCH_SHINGLES):
                size, to = size + len(sets[to]), to + 1
            weighed = [np.unique(s, return_counts=True) for s in sets[at:to]]
            sig = signatures([(e, n.astype(np.float64)) for e, n in weighed])
            low_bits = (sig[:, :128] >> _u(1) & _u(1)).astype(bool)
            sketch = np.packbits(low_bits, axis=1).view(np.int64)
            sizes = np.array([len(s) for s in sets[at:to]])
            bands = bands_of(sig)[sizes > 0]
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(at, to - at), pa.array(nodes[at:to], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                ["doc_id", "node", "size", "s0", "s1", "bands"],
            )
            at = to


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for _, texts in _parts(batches):
        rows = [(node_of(t, w), as_set(shingles(w)).tobytes()) for t in texts for w in [word_hashes(t, hashes)]]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["node", "elements"])


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(np.frombuffer(x, _u), np.frombuffer(y, _u)) for x, y in zip(a, b, strict=True)], dtype="float64")


def near_duplicates(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """(doc_id long, text) -> a row each: doc_id, class_id, group_size, kept.

    Documents are linked when the weighted Jaccard similarity of their counts of shingles (five lower-cased words,
    or all words of a shorter text) is at_least; a class is what links reach, class_id its smallest doc_id, and
    one row of it is kept. Texts of the same words are one node. Texts without a word, null and empty
    ones included, are linked when they are equal, null as empty. Of rows that repeat a doc_id, one may be kept.
    A null doc_id is above all others. Other columns are ignored; an empty table gives no rows.

    In each bucket of a band all members are compared with a few of them, its hubs; then, in buckets that still hold more
    than one component, with a few of the largest. What stays mixed is joined exactly, across components, on its rarest
    differences from one hub (see differences()), so no link between candidates is lost and no bucket's pairs are written
    out. Texts are never cut; a very long one takes about 200 bytes a word of its task's memory.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.mapInArrow(trimmed(_sketches), "doc_id long, node long, size long, s0 long, s1 long, bands array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # One row of each node stands for it: all of them have the same sketch.
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = materialize(rows.groupBy("node").agg(F.min(best).alias("best"), F.count("*").alias("n")), "text_nodes")
    chosen = groups.select(F.col("node").alias("g_node"), F.col("best.row").alias("g_row"))
    nodes = rows.join(chosen, (F.col("node") == F.col("g_node")) & (F.col("row") == F.col("g_row"))).select("node", "doc_id", "size", "s0", "s1", "bands")
    nodes = materialize(nodes, "sketch_nodes")
    ids = materialize(rows.select("doc_id", "node", "row"), "row_nodes")
    release(rows)

    members = nodes.select("node", "size", "s0", "s1", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(buckets.select(F.col("bucket").alias("b")), "band_buckets")
    placed = members.join(buckets, F.col("bucket") == F.col("b")).drop("b").withColumn("comp", F.col("node"))
    placed = materialize(placed, "placed_members")
    packed = elements_of(texts, nodes, placed.select("node").distinct())
    release(nodes, buckets)
    forget_shuffles(docs.sparkSession)
    comps = None

    def linked(pairs: DataFrame) -> bool:
        """Verifies pairs; whether that has changed the components."""
        nonlocal comps
        found, old = verified(packed, pairs, at_least), comps
        release(pairs)
        changed = old is None or not found.isEmpty()
        if changed:  # what was linked before is a star around each component's smallest node
            comps = connected_components(found if old is None else found.unionByName(old.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        release(found, *([old] if changed and old is not None else []))
        forget_shuffles(docs.sparkSession)
        return changed

    hubs = hubs_of(placed)
    if linked(star_pairs(placed, hubs, at_least, sketched=True)):
        placed = _still_mixed(placed, comps)
    release(hubs)
    hubs = hubs_of(placed, of_largest=True)
    if linked(star_pairs(placed, hubs, at_least, sketched=False)):
        placed = _still_mixed(placed, comps)
    rest = placed.join(hubs, F.col("bucket") == F.col("b")).select("node", "size", "comp", F.col("hubs")[0].alias("hub")).distinct()
    rest = materialize(rest, "mixed_nodes")
    release(placed, hubs)
    apart = differences(packed, rest, at_least)
    release(rest)
    if linked(across(apart, at_least, first=True)):
        before, apart = apart, materialize(_with_comp(apart, comps), "differences")
        release(before)
    linked(across(apart, at_least))
    release(packed, apart)

    classes = groups.join(comps, F.col("node") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "node"))
    classes = materialize(classes.select("node", "comp", "best", "n"), "class_nodes")
    release(groups, comps)
    wide = materialize(classes.groupBy("comp").agg(F.min("best").alias("first"), F.sum("n").alias("group_size")), "classes")
    decided = classes.select("node", "comp").join(wide, "comp").select(F.col("node").alias("d_node"), "first", "group_size")
    decided = materialize(decided, "decided_nodes")
    release(classes, wide)
    out = ids.join(decided, F.col("node") == F.col("d_node"))
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))


def _sizes_allow(a: str, b: str, at_least: float) -> Column:
    """Whether the sizes of two nodes allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(at_least - 1e-9)


def hubs_of(placed: DataFrame, of_largest: bool = False) -> DataFrame:
    """(b, hubs) of each bucket: HUBS members, maybe of its largest component, with the highest hashes, so that buckets agree."""
    highest = [F.max(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")).alias(f"m{k}") for k in range(HUBS)]
    if of_largest:
        of_comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), *highest)
        largest = F.max(F.struct("n", F.col("m0.h").alias("h"), "comp", *[f"m{k}" for k in range(HUBS)])).alias("m")
        hubs = of_comp.groupBy("bucket").agg(largest).select(F.col("bucket").alias("b"), *[F.col(f"m.m{k}").alias(f"m{k}") for k in range(HUBS)])
    else:
        hubs = placed.groupBy(F.col("bucket").alias("b")).agg(*highest)
    return materialize(hubs.select("b", F.array_distinct(F.array(*[f"m{k}.node" for k in range(HUBS)])).alias("hubs")), "bucket_hubs")


def star_pairs(placed: DataFrame, hubs: DataFrame, at_least: float, sketched: bool) -> DataFrame:
    """(a, b): members of each bucket with its hubs, unless sizes, or maybe sketches, are too unlike."""
    pairs = placed.join(hubs, F.col("bucket") == F.col("b")).select("node", "comp", "size", "s0", "s1", F.explode("hubs").alias("hub"))
    pairs = pairs.filter("node <> hub").distinct()
    ends = placed.select(F.col("node").alias("hub"), F.col("comp").alias("l_comp"), *[F.col(c).alias(f"l_{c}") for c in ("size", "s0", "s1")]).distinct()
    pairs = pairs.join(ends, "hub").filter((F.col("comp") != F.col("l_comp")) & _sizes_allow("size", "l_size", at_least))
    if sketched:
        pairs = pairs.filter(F.bit_count(F.col("s0").bitwiseXOR(F.col("l_s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("l_s1"))) <= SKETCH_BITS)
    return materialize(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "star_pairs")


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with their nodes' components."""
    rows = rows.drop("comp").join(comps, F.col("node") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "node"))
    return rows.drop("id", "component")


def _still_mixed(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, in place of placed."""
    before, placed = placed, materialize(_with_comp(placed, comps), "placed_members")
    release(before)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    mixed = materialize(mixed.select(F.col("bucket").alias("b")), "mixed_buckets")
    out = materialize(placed.join(mixed, F.col("bucket") == F.col("b")).drop("b"), "mixed_members")
    release(placed, mixed)
    return out


def elements_of(texts: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, elements) of the nodes of ids. Of the texts, only those are shuffled that a Bloom filter lets through."""
    needed = materialize(nodes.join(ids, "node").select("doc_id"), "needed_ids")
    some = with_maybe(texts, F.col("doc_id"), blocked_bloom(needed.filter("doc_id is not null"), needed.count()))
    some = some.filter("maybe or doc_id is null").drop("maybe")
    some = some.join(needed.select(F.col("doc_id").alias("i")).distinct(), F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    out = materialize(some.mapInArrow(trimmed(_packed), "node long, elements binary"), "elements")
    release(needed)
    return out


def verified(packed: DataFrame, pairs: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity is at_least."""
    a = packed.select(F.col("node").alias("a"), F.col("elements").alias("a_set"))
    b = packed.select(F.col("node").alias("b"), F.col("elements").alias("b_set"))
    exact = F.pandas_udf(_similarity, "double").asNondeterministic()  # so that the filter doesn't run it again
    both = pairs.join(a, "a").join(b, "b").select("a", "b", exact("a_set", "b_set").alias("s"))
    return materialize(both.filter(F.col("s") >= at_least).select("a", "b"), "near_links")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements in which each set differs from its hub's: those that it has and the hub lacks, and, under other
    names, those that it lacks; with how many these are, and the size of the hub."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            own, hub = ([np.frombuffer(x, _u) for x in part.column(c).to_pylist()] for c in ("elements", "h_elements"))
            apart = [np.concatenate([np.setdiff1d(a, h, assume_unique=True), mix(np.setdiff1d(h, a, assume_unique=True) + _u(1))]) for a, h in zip(own, hub, strict=True)]
            n = np.array([len(x) for x in apart])
            which = pa.array(np.repeat(np.arange(len(apart)), n))
            names = ["hub", "node", "size", "comp"]
            columns = [part.column(c).take(which) for c in names]
            columns += [pa.array(np.repeat(x, n)) for x in (n, np.array([len(h) for h in hub]))] + [pa.array(np.concatenate(apart).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "apart", "h_size", "element"])


def differences(packed: DataFrame, members: DataFrame, at_least: float) -> DataFrame:
    """Of members (node, size, comp, hub), whose similarity to their hub is known, the differences on which across() joins.

    Members as similar to their hub as that share its comp. Let a set's differences be what it has and its hub lacks, or
    the reverse. Two sets are similar when they differ in at most r * (|a| + |b|) elements, r = (1 - s) / (1 + s); they
    differ in |da| + |db| - 2 * (differences in common). So they need n = (|da| + |db| - r * (|a| + |b|)) / 2 in common, and
    n <= 0 would take both to be similar to the hub. Only differences are joined, however much all members repeat of what
    the hub says. With these from rare to frequent, similar sets have one in common after which there are enough left in both.
    """
    r = (1 - at_least) / (1 + at_least)
    sets = members.filter("node <> hub").join(packed, "node").join(packed.select(F.col("node").alias("hub"), F.col("elements").alias("h_elements")), "hub")
    rows = sets.mapInArrow(trimmed(_differences), "hub long, node long, size long, comp long, apart long, h_size long, element long")
    every = materialize(rows, "all_differences")
    key = ["hub", "element"]
    shared = materialize(every.groupBy(*key).agg(F.count("*").alias("df")).filter("df > 1"), "shared_differences")
    rows = every.join(shared, key)
    by_node = Window.partitionBy("hub", "node")
    # Differences that no other member has come first; only their number counts.
    place = F.col("apart") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("df", "element")) - 1
    # Whatever the other set, n is at least (apart - r * (size + h_size)) / 2.
    last = (F.col("apart") + F.lit(r) * (F.col("size") + F.col("h_size"))) / 2 + F.lit(1e-6)
    out = materialize(rows.withColumn("pos", place).filter(F.col("pos") <= last).drop("df", "h_size"), "differences")
    release(every, shared)
    return out


def across(rows: DataFrame, at_least: float, first: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes of unlike comp with one hub, among them all with the similarity; of differences()' rows.

    first: each difference's components are only held against one member of its largest, the nearest to the hub, so there
    are no more pairs than rows. A node similar to many of a component is found here and does not meet all of it later.
    """
    r, key = (1 - at_least) / (1 + at_least), ["hub", "element"]
    nearest = F.min(F.struct("apart", "pos", "node", "size")).alias("near")
    by_comp = rows.groupBy(*key, "comp").agg(F.count("*").alias("n"), nearest)
    largest = by_comp.groupBy(*key).agg(F.max(F.struct("n", "comp", "near")).alias("big"), F.count("*").alias("comps")).filter("comps > 1")
    largest = materialize(largest.select(*key, F.col("big.comp").alias("largest"), "big.near"), "mixed_differences")
    mixed = materialize(rows.join(largest, key), "mixed_rows")
    left = mixed.filter("comp <> largest")
    if first:
        both = left.select("*", F.col("largest").alias("o_comp"), *[F.col(f"near.{c}").alias(f"o_{c}") for c in ("apart", "pos", "node", "size")])
    else:
        right = mixed.drop("largest", "near")
        right = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
        left = left.drop("largest", "near")
        both = left.join(right, (F.col("hub") == F.col("o_hub")) & (F.col("element") == F.col("o_element")))
    need = (F.col("apart") + F.col("o_apart") - F.lit(r) * (F.col("size") + F.col("o_size"))) / 2 - F.lit(1e-6)
    enough = F.least(F.col("apart") - F.col("pos"), F.col("o_apart") - F.col("o_pos")) >= need
    pairs = both.filter((F.col("comp") != F.col("o_comp")) & enough & _sizes_allow("size", "o_size", at_least))
    out = materialize(pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct(), "cross_pairs")
    release(largest, mixed)
    return out


def dedup(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns whatever their names; see near_duplicates().

    Rows that repeat a doc_id stay together where one of them does, but for rows equal in all columns.
    """
    verdicts = near_duplicates(docs, at_least).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    dropped = materialize(verdicts.filter("not kept").select(F.col("doc_id").alias("gone")), "dropped_ids")
    rows = nested(docs, key=F.col("doc_id").cast("long"))
    bloom = blocked_bloom(dropped.filter("gone is not null"), dropped.count())
    probe = with_maybe(rows, F.col("key"), bloom).withColumn("maybe", F.col("maybe") | F.col("key").isNull())
    asked = probe.filter("maybe").join(dropped, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return flat(probe.filter("not maybe").select("row").unionByName(asked.select("row")))
