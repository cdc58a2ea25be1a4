"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Each coordinate has its own rate, and coordinates whose gradients don't add up to more than the L1 bound stay at zero: what
is broadcast are the few weights that don't. A text's features are the distinct buckets of its words, of two and three words
in a row, and of two words with one or two words between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, materialize, release, text_or_empty
from corpusloom.llm.divergence import slices

#: Hashed coordinates.
BUCKETS = 1 << 22
#: Bounds of the training sample, for each label: documents, and buckets of all of them.
SAMPLE_PER_LABEL, SAMPLE_BUCKETS = 2500, 12_000_000
#: Documents of the sample that hold a bucket which is learned.
LEAST_DOCS = 3
#: FTRL-proximal: alpha and beta of the rates; L1 of the pass that chooses coordinates, and of the one that weighs them.
ALPHA, BETA, L1_CHOICE, L1 = 1.0, 1.0, 30.0, 0.1
EPOCHS, LEAST_STEPS, SEED = 10, 12_000, 13
#: What lies between words; bytes of text whose features are made at once.
BREAKS, SLICE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 4_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    return ((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of the texts, with repeats."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), BREAKS)
    words = lists.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(bool)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[there]
    coded = words.filter(pa.array(there)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    rows, buckets = [row], [_bucket(h * _MIX[0])]

    def add(kind: int, *parts: np.ndarray, reach: int) -> None:
        mixed = np.full(len(parts[0]), kind, np.uint64) * _MIX[0]
        for p in parts:
            mixed = (mixed ^ p) * _MIX[1]
            mixed ^= mixed >> np.uint64(31)
        same = row[reach:] == row[: len(row) - reach]
        rows.append(row[reach:][same])
        buckets.append(_bucket(mixed)[same])

    if len(h) > 1:
        add(2, h[:-1], h[1:], reach=1)
    if len(h) > 2:
        add(3, h[:-2], h[1:-1], h[2:], reach=2)
        add(4, h[:-2], h[2:], reach=2)
    if len(h) > 3:
        add(5, h[:-3], h[3:], reach=3)
    return np.concatenate(rows), np.concatenate(buckets)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, bucket) once, sorted."""
    keys = np.unique(row * BUCKETS + bucket)
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class Model:
    """Buckets in rising order, their weights, all others being zero, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The logit of each text."""
        out = np.full(len(texts), self.bias)
        if len(self.bucket):
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.zeros(BUCKETS, bool)
            known[self.bucket] = True
            for a, b in slices(lengths, SLICE):
                row, bucket = features(texts[a:b])
                hit = known[bucket]
                row, bucket = distinct(row[hit], bucket[hit])
                out[a:b] += np.bincount(row, self.weight[np.searchsorted(self.bucket, bucket)], b - a)
        return out


def ftrl(bags: list[np.ndarray], labels: np.ndarray, l1: float, epochs: int, seed: int = SEED) -> Model:
    """FTRL-proximal, one step a document in shuffled order; labels are weighted to equal sums. L1 doesn't hold the bias at zero."""
    rng = np.random.default_rng(seed)
    z, n, z_bias, n_bias = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    share = len(labels) / (2 * np.bincount(labels, minlength=2))
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at = bags[i]
            zi, root = z[at], np.sqrt(n[at])
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0.0) * ALPHA / (BETA + root)
            root_bias = np.sqrt(n_bias)
            bias = -z_bias * ALPHA / (BETA + root_bias)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -500, 500))) - labels[i]) * share[labels[i]]
            n[at] += g * g
            z[at] = zi + g - (np.sqrt(n[at]) - root) / ALPHA * w
            n_bias += g * g
            z_bias += g - (np.sqrt(n_bias) - root_bias) / ALPHA * bias
    w = -np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) * ALPHA / (BETA + np.sqrt(n))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], float(-z_bias * ALPHA / (BETA + np.sqrt(n_bias))))


def train(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Distinct buckets of each document -> the model: a pass with a strong L1 bound chooses coordinates, of those in at least
    LEAST_DOCS documents, and one with a weak bound weighs what is chosen, so that the bound doesn't shrink it."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    docs = np.zeros(BUCKETS, np.int32)
    for b in bags:
        docs[b] += 1
    bags = [b[docs[b] >= LEAST_DOCS] for b in bags]
    chosen = np.zeros(BUCKETS, bool)
    chosen[ftrl(bags, labels, L1_CHOICE, max(4, -(-LEAST_STEPS // len(labels)))).bucket] = True
    return ftrl([b[chosen[b]] for b in bags], labels, L1, max(EPOCHS, -(-LEAST_STEPS // len(labels))))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_buckets: int = SAMPLE_BUCKETS) -> Model:
    """Learns labels (doc_id, toxic 0 or 1) from the texts of docs, from rows whose crc32(doc_id as text) mod 3 is not 1.

    Of each label, the per_label documents whose ids hash lowest are taken, as long as their distinct buckets together are at
    most most_buckets, which bounds what the driver holds; of rows of docs that repeat an id, one. Null or other labels
    are ignored; of contradicting labels 1 counts. Without both labels every score is a half.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 3 != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [known.filter(F.col("toxic") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    sample = materialize(sample[0].unionByName(sample[1]), "label_sample")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                at = distinct(*features(one.column("text")))[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("toxic"), pa.array([at.tobytes()], pa.binary()), pa.array([len(at)], pa.int64())], ["doc_id", "toxic", "at", "n"])

    rows = texts.mapInArrow(bags, f"doc_id {kind}, toxic int, at binary, n long").groupBy("doc_id").agg(F.min(F.struct("at", "n", "toxic")).alias("r"))
    rows = materialize(rows.select("doc_id", "r.*"), "label_features")
    # Two windows over at most per_label small rows each.
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.select("doc_id", "toxic", "n").withColumn("so_far", so_far).filter(F.col("so_far") <= most_buckets)
    found = rows.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi").select("doc_id", "toxic", "at").orderBy("doc_id").toArrow()
    release(rows, sample)
    found_bags = [np.frombuffer(x.as_buffer(), np.int32) for x in found["at"]]
    return train(found_bags, found["toxic"].to_numpy().astype(np.int64))


def scored(docs: DataFrame, model: Model, column: str = "score", text: Column | None = None) -> DataFrame:
    """docs, all columns kept, with the probability of label 1; null texts count as empty and score as the bias says.
    A column of that name is replaced. Texts are scored whole; of a text of over SLICE bytes the features are made at once,
    some 100 bytes for each of its words."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(1 / (1 + np.exp(-np.clip(share.value.margins(t), -500, 500))))

    return docs.withColumn(column, F.arrow_udf(run, "double")(text_or_empty() if text is None else F.coalesce(text, F.lit(""))))
