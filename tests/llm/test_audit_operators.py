"""Source divergence, whitening and toxicity: against SQL, brute force and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpusloom.llm import divergence, queries, toxicity, whitening


def brute_audit(rows: list[tuple], least_docs: int = 3) -> list[tuple]:
    """(text, lang, source) by plain Python."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df: Counter = Counter()
        for (_, la, _), ts in zip(rows, terms):
            if la == lang:
                df.update(set(ts))
        kept = [t for t, n in df.items() if n >= least_docs]
        sources = sorted({s for _, la, s in rows if la == lang})
        n = {s: Counter(t for (_, la, so), ts in zip(rows, terms) if (la, so) == (lang, s) for t in ts if df[t] >= least_docs) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[s][t] + 1) // (n[s].total() + len(kept)) for t in kept} for s in sources}
        whole = sum(n.values(), Counter())
        q = {t: 1 + 10**9 * (whole[t] + 1) // (whole.total() + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            told = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[s][t] > 0 and p[s][t] > q[t])[:200]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(told, 1)]
    return sorted(out)


def audited(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [
    ("The cat the CAT, größe", "en", "a"), ("the cat the", "en", "a"), ("the the dog", "en", "b"), ("cat dog Größe größe", "en", "b"), ("dog größe", "en", None),
    (None, "en", "empty"), ("", "xx", "a"), ("1 2 3", "xx", "b"), (None, None, None), ("the cat the", "en", "a"), ("x" * 3000 + " the " * 5000, "en", "c"), ("only here here", "yy", "z"),
]


def test_divergence_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "text string, lang string, source string, term int, value string")
    assert audited(divergence.audit(docs)) == brute_audit(ODD)
    assert audited(divergence.audit(docs.repartition(7), least_docs=1)) == brute_audit(ODD, 1)


def test_divergence_of_an_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_divergence_in_small_pieces(spark, sf_dir, monkeypatch):
    """Pieces of text, slices of pairs and runs over several batches give what large ones give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    monkeypatch.setattr(divergence, "SORTED_CHARS", 20_000)
    monkeypatch.setattr(divergence, "CELLS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert audited(divergence.audit(docs)) == brute_audit(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_against_sql(spark, sf_dir, duck, same):
    same(queries.op11_source_divergence(spark, sf_dir).toPandas(), duck.sql(queries.ORACLE["op11_source_divergence"]).df())


def test_probabilities_beyond_64_bits():
    big = np.array([10**10, 5 * 10**12])
    assert divergence.probability(big, np.array([10**13, 10**13]), 7).tolist() == [1 + 10**9 * (n + 1) // (10**13 + 7) for n in big.tolist()]


def brute_white(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whitened components and shares of the trace, from whole numbers."""
    c = x - x.sum(axis=0) / len(x)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, x.shape[1])
    return (c @ axes[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_against_brute_force(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir).toPandas()
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(raw["embedding"].map(lambda v: np.floor(1024 * np.asarray(v, float)).astype(np.int64) + 100_000))
    n, sums = len(x), x.sum(axis=0)
    white, share = brute_white(x)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[raw["vec_id"]].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(white), atol=1e-9)
    sign = np.sign(wide * white)
    assert (sign == sign[0]).all()
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-9)
    assert dict(zip(got["vec_id"], got["deviation"])) == dict(zip(raw["vec_id"], ((n * x - sums) ** 2).sum(axis=1).tolist()))
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9 and (got["n"] == n).all() and len(got) == 8 * n


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 0.25]), (2, [0.25, -1.0, 0.5]), (2, [0.25, -1.0, 0.5]), (None, [1.0, 0.0, -3.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 0.0]), (7, [0.0, inf, 0.0]), (8, []), (9, [1e300, 0.0, 0.0]), (10, [1.0, 2.0]), (11, [2.0, 2.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, v int")
    got = whitening.whiten(vectors).toPandas()
    three = got[got["vec_id"].isna() | (got["vec_id"] < 10)]
    assert three["vec_id"].isna().sum() == 3 and (three["vec_id"] == 2).sum() == 6 and (three["n"] == 4).all() and len(three) == 12
    # Of four rows, of which two are equal, two directions vary; the third has none of its own.
    assert three[three["component"] == 3]["whitened"].isna().all() and three[three["component"] < 3]["whitened"].notna().all()
    two = got[got["vec_id"].isin([10, 11])].set_index(["vec_id", "component"])
    assert abs(two["whitened"][10, 1]) == pytest.approx(1.0) and two["explained"][10, 1] == 1.0 and two["whitened"].isna().sum() == 2 and (two["deviation"] == 1024**2).all()
    assert whitening.whiten(vectors.limit(0)).count() == 0
    assert whitening.whiten(vectors.filter("vec_id = 1")).filter("whitened is null and explained = 0").count() == 3


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, 0], [0, 2**41]])
    assert whitening.deviations(whitening.apart(x, 2, [2**40, 2**41])) == [None, None]
    assert whitening.deviations(whitening.apart(x // 2**20, 2, [2**20, 2**21])) == [2**40 + 2**42] * 2
    assert whitening.apart(np.array([[2**62]]), 4, [3]).tolist() == [[2**64 - 3]]


def brute_features(text: str) -> set:
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]
    grams = {(1, w) for w in words} | {(2, *g) for g in zip(words, words[1:])} | {(3, *g) for g in zip(words, words[1:], words[2:])}
    return grams | {(4, *g) for g in zip(words, words[2:])} | {(5, *g) for g in zip(words, words[3:])}


def test_features_of_a_text_are_its_own():
    texts = ["One two three, four one two THREE four", "", "one", "one two", "größe --- one", "a b c d e f g a b"]
    row, bucket = toxicity.distinct(*toxicity.features(pa.array(texts)))
    for k, t in enumerate(texts):
        alone = toxicity.distinct(*toxicity.features(pa.array([t])))[1]
        assert (bucket[row == k] == alone).all()
        assert len(alone) == len(brute_features(t))


def brute_ftrl(bags, labels, l1, epochs):
    """Coordinate by coordinate, with dictionaries."""
    rng, z, n = np.random.default_rng(toxicity.SEED), {}, {}
    share = len(labels) / (2 * np.bincount(labels, minlength=2))
    weight = lambda k: 0.0 if k != -1 and abs(z.get(k, 0.0)) <= l1 else -(z.get(k, 0.0) - (0 if k == -1 else np.sign(z[k]) * l1)) / ((toxicity.BETA + np.sqrt(n.get(k, 0.0))) / toxicity.ALPHA)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at = [*bags[i].tolist(), -1]
            w = {k: weight(k) for k in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - labels[i]) * share[labels[i]]
            for k in at:
                old = n.get(k, 0.0)
                z[k], n[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / toxicity.ALPHA * w[k], old + g * g
    return {k: weight(k) for k in z}


def test_ftrl_against_coordinates_one_by_one():
    rng = np.random.default_rng(3)
    bags, labels = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(50)], rng.integers(0, 2, 50)
    for l1 in (0.1, 1.5):
        want = brute_ftrl(bags, labels, l1, 3)
        got = toxicity.ftrl(bags, labels, l1, 3)
        found = dict(zip(got.bucket.tolist(), got.weight.tolist(), strict=True))
        assert got.bias == pytest.approx(want.pop(-1)) and found == pytest.approx({k: w for k, w in want.items() if w})
        assert 0 < len(found) < 60 or l1 < 1


def test_scores_are_sums_of_weights():
    words = ["bad", "worse", "fine"]
    hashed = toxicity.features(pa.array(words))[1]
    order = np.argsort(hashed)
    model = toxicity.Model(hashed[order], np.array([2.0, 3.0, -1.0])[order], -0.5)
    assert model.margins(pa.array(["Bad, bad!", "", "worse fine fine", "none " * 50_000 + "bad"])).tolist() == [1.5, -0.5, 1.5, 1.5]


def test_toxicity_of_held_out_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    plain, nasty = [f"w{k}" for k in range(300)], [f"nasty{k}" for k in range(8)]
    rows, labels = [], []
    for k in range(900):
        words = list(rng.choice(plain, rng.integers(5, 80)))
        toxic = k % 5 == 0
        for w in rng.choice(nasty, 3) if toxic else []:
            words.insert(int(rng.integers(0, len(words))), w)
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "nasty1 nasty2 w1 nasty3", "x"), (9002, "nasty1 w5 nasty4 nasty6 " * 20_000, "x"), (0, "w1 w2", "x")]
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame(rows, schema)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9), (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert len(model.bucket) < 60
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score"]
    scores = [(r["doc_id"], r["text"], r["score"]) for r in got.collect()]
    assert len(scores) == len(rows)
    held = [(s, k % 5 == 0) for k, _, s in scores if k and k < 900 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.98 and len(held) > 200
    empty = {s for k, _, s in scores if k in (9000, 9001)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert all(s > 0.7 for k, _, s in scores if k in (None, 9002))
    none = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_what_the_labels_are_learned_from(spark):
    """Held-out labels change nothing, and the sample keeps to its bounds."""
    rows = [(k, f"word{k % 7} other{k % 3} more words here") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    a = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(300)], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 7 == 0) ^ held(k)) for k in range(300)], "doc_id long, toxic int"))
    assert a.bucket.tolist() == b.bucket.tolist() and a.weight.tolist() == b.weight.tolist() and a.bias == b.bias
    seen = []
    old, toxicity.train = toxicity.train, lambda bags, labels: seen.append((bags, labels)) or old(bags, labels)
    try:
        toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int"), per_label=20, most_buckets=150)
    finally:
        toxicity.train = old
    bags, labels = seen[0]
    assert all(0 < sum(len(x) for x, y in zip(bags, labels) if y == k) <= 150 for k in (0, 1)) and len(bags) <= 40


def test_query_of_toxicity(spark, sf_dir):
    got = queries.op13_toxicity(spark, sf_dir).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (got["held_out"] == got["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1)).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet") if not sf_dir.startswith("viewfs") else None
    known = got.merge(labels, on="doc_id")
    assert (known[~known["held_out"]]["toxic"] == known[~known["held_out"]]["predicted"]).mean() > 0.9
