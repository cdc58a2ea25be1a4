"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words, and words' character n-grams are hashed to vectors, a document is the average of all of them, and a softmax
layer tells its label; vectors and layer are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents. As the layer is linear, a word or pair adds one number to a document's score;
scoring sums these numbers over the whole text on the executors. Many texts are scored together: their distinct words are
hashed by array steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, materialize, release, text_or_empty, trimmed

#: Hashed vectors, their length, and the lengths of character n-grams of a word between < and >.
BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4)
#: Hashed vectors of pairs of neighbouring words.
PAIR_BUCKETS = 1 << 16
#: Bound of the training sample: so many documents of each label.
SAMPLE_PER_LABEL = 2500
EPOCHS, RATE, SEED = 6, 1.0, 7
#: A small sample is gone through more often, until there are so many steps.
LEAST_STEPS = 15_000
#: Characters of texts that are scored together; a longer text is scored alone.
TOGETHER = 1 << 18


def piece_hashes(raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh32 of the pieces of raw, which goes on for three bytes after the last: those of one length by array steps, those from 16 bytes on one by one."""
    out, u = np.zeros(len(begin), np.uint32), np.uint32
    ones, fours = np.frombuffer(raw, np.uint8), np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    for n in np.flatnonzero(np.bincount(size)).tolist():
        rows = np.flatnonzero(size == n)
        if n >= 16:
            out[rows] = [xxhash.xxh32_intdigest(raw[k : k + n]) for k in begin[rows].tolist()]
            continue
        at, h = begin[rows], np.full(len(rows), 374761393 + n, u)
        for k in range(n // 4):
            h += fours[at + 4 * k] * u(3266489917)
            h = (h << u(17) | h >> u(15)) * u(668265263)
        for k in range(n - n % 4, n):
            h += ones[at + k] * u(374761393)
            h = (h << u(11) | h >> u(21)) * u(2654435761)
        h = (h ^ h >> u(15)) * u(2246822519)
        h = (h ^ h >> u(13)) * u(3266489917)
        out[rows] = h ^ h >> u(16)
    return out


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, buckets) of the words and of their n-grams."""
    size, place = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
    raw = b"w" + b"w".join(words) + bytes(3)
    at, found = [place], [piece_hashes(raw, np.cumsum(size + 1) - size - 1, size + 1)]
    raw = b"<" + b"><".join(words) + b">"
    begin = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)  # of the characters
    word = np.repeat(place, size + 2)[begin] if words else place
    begin, raw = np.append(begin, len(raw)), raw + bytes(3)
    for n in GRAMS:
        whole = np.flatnonzero(word[: 1 - n] == word[n - 1 :])
        at.append(word[whole])
        found.append(piece_hashes(raw, begin[whole], begin[whole + n] - begin[whole]))
    return np.concatenate(at), np.concatenate(found).astype(np.int64) % BUCKETS


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of all texts, each word's place among them, and how many words each text has. Bytes are split at ASCII white space alone."""
    words = [t.encode().split() for t in texts]
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.fromiter(map(len, words), np.int64, len(words))


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, of the words' hashes in order."""
    h = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)).astype(np.int64) % PAIR_BUCKETS + BUCKETS


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the whole text."""
    words, at, _ = distinct_words([text])
    word, found = features(words)
    counts = np.bincount(found, np.bincount(at, minlength=len(words))[word], BUCKETS + PAIR_BUCKETS) + np.bincount(pairs(word_hashes(words)[at]), minlength=BUCKETS + PAIR_BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


@dataclass
class Model:
    """Each bucket's part of the margin between label 1 and label 0, and the bias."""

    parts: np.ndarray
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Plain SGD over documents in shuffled order, the rate falling to zero; labels are weighted to equal sums."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + PAIR_BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS + PAIR_BUCKETS), 0.0)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    epochs = max(epochs, -(-LEAST_STEPS // len(labels)))
    step, steps = 0, epochs * len(labels)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, n = bags[i]
            lr = rate * (1 - step / steps) * weight[labels[i]]
            step += 1
            if not len(at):
                continue
            share = n / float(n.sum())
            hidden = share @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            vectors[at] -= lr * np.outer(share, back)
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    words, at, n_words = distinct_words(texts)
    word, found = features(words)
    part, size = np.bincount(word, model.parts[found], len(words)), np.bincount(word, minlength=len(words))
    text = np.repeat(np.arange(len(texts)), n_words)
    near = np.flatnonzero(text[1:] == text[:-1])  # the last word of a text and the first of the next are no pair
    margin = np.bincount(text, part[at], len(texts)) + np.bincount(text[near], model.parts[pairs(word_hashes(words)[at])[near]], len(texts))
    total = np.bincount(text, size[at], len(texts)) + np.maximum(n_words - 1, 0)
    return 1 / (1 + np.exp(-np.clip(model.bias + margin / np.maximum(total, 1), -500, 500)))


def score_batch(texts: list[str], model: Model) -> np.ndarray:
    """Scores so many texts at a time that they hold TOGETHER characters, one at least."""
    group = np.cumsum([0, *map(len, texts)])[:-1] // TOGETHER
    return np.concatenate([score_texts(texts[a:b], model) for a, b in pairwise([*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)])])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Learns labels (doc_id, quality 0 or 1) from the texts of docs, from rows whose crc32(doc_id) mod 5 is not 0.

    Of each label, the per_label documents whose ids hash lowest are taken, so the sample is bounded and the same
    in each run; of rows of docs that repeat an id, one. Null or other labels are ignored; of contradicting labels 0 counts. Without both labels,
    every score is a half.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = [known.filter(F.col("quality") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    sample = materialize(sample[0].unionByName(sample[1]), "label_sample")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [bag(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "quality": pdf["quality"], "at": [a.tobytes() for a, _ in found], "n": [n.tobytes() for _, n in found]})

    # One row of those that repeat an id, so that what comes to the driver is bounded like the sample.
    rows = texts.mapInPandas(trimmed(bags), "doc_id string, quality int, at binary, n binary").groupBy("doc_id").agg(F.min(F.struct("at", "n", "quality")).alias("r"))
    rows = rows.select("doc_id", "r.*").orderBy("doc_id").toArrow()
    release(sample)
    found = list(zip(_views(rows["at"], np.int32), _views(rows["n"], np.float32), strict=True))
    return train(found, rows["quality"].to_numpy().astype(np.int64))


def _views(column: pa.ChunkedArray, kind: type) -> Iterator[np.ndarray]:
    """Each binary value as an array, without copies."""
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.frombuffer(data, kind, (b - a) // 4, a)


def scored(docs: DataFrame, model: Model, column: str = "score", text: Column | None = None) -> DataFrame:
    """docs, all columns kept, with the probability of label 1; null texts count as empty and score as the bias says.
    A column of that name is replaced. Texts are scored whole, each word of those that are scored together at about 200 bytes."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(score_batch(s.tolist(), share.value) if len(s) else [], dtype="float64")

    return docs.withColumn(column, F.pandas_udf(trimmed(run), "double")(text_or_empty() if text is None else F.coalesce(text, F.lit(""))))
