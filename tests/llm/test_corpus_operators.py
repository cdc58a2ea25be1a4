"""The corpus operators on small inputs: SQL or brute force, and odd rows. Each odd table has nulls, empty texts,
repeated rows, an empty copy, and columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import chat, common, cover_tree, curriculum, dart_minhash, digest_index, pii_crf, quality, queries, suffix_tree, url_filter

TEXTS = ["a b c d e f g", "a b c d e f g", "", None, "A  b\tc", "x", "a b c d e f g h", " \n", "+1 555 123 4567 mail me@x.org", "z" * 5000]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("s", None, "t")[i % 3], i, i, i, True, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s", 0, 0, 0, True, "x"), (None, "a b c d e f g", None, None, 1, 1, False, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, row long, size long, kept boolean, key string").repartition(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_what_sql_gives(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE[name]).df())


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Exact dedup


def test_index_over_two_batches(spark, odd):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    first = index.ingest(odd).collect()
    assert len(first) == 12 and sum(r.kept for r in first) == 8
    by_text = {(r.doc_id, r.digest): r for r in first}
    assert {r.keep_id for r in first if r.digest == hashlib.sha256(b"a b c d e f g").digest()} == {1}
    assert by_text[2, hashlib.sha256(b"").digest()].keep_id == 3
    again = index.ingest(odd.filter("doc_id < 2").withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.limit(1).withColumn("text", F.lit("new"))))
    assert Counter(r.kept for r in again.collect()) == {False: 3, True: 1}
    assert index.read().count() == 9
    # A session that starts anew finds the index at its path.
    spark.sql(f"drop table {index.table}")
    same = digest_index.DigestIndex(spark, index.path, 16)
    assert same.read().count() == 9 and same.buckets == 4


def test_two_tables_in_one_index(spark):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(7, "b"), (8, "c"), (9, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in digest_index.in_batches(one, index, [1], "one").collect()} == {(1, 1, True), (2, 2, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in digest_index.in_batches(two, index, [8], "two").collect()} == {(7, 2, False), (8, 9, False), (9, 9, True)}
    assert index.read().count() == 3


def test_a_compacted_index_says_the_same(spark, odd):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    for k in range(3):
        index.ingest(odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(f" {k % 2}"))), f"batch {k}")
    index._append(spark.createDataFrame([(b"dead", 1, 1)], "digest binary, keep_id long, n_docs long"), "no commit")
    before = sorted(map(tuple, index.read().collect()))
    index.compact()
    assert spark.table(index.table).count() == len(before)
    assert sorted(map(tuple, index.read().collect())) == before
    assert len({r[0] for r in spark.table(index.table).select(F.input_file_name()).distinct().collect()}) <= 4
    again = index.ingest(spark.createDataFrame([(50, "new one"), (51, " 1")], "doc_id long, text string"))
    assert {(r.doc_id, r.kept) for r in again.collect()} == {(50, True), (51, False)}
    index.compact()
    assert index.read().count() == len(before) + 1
    assert index.ingest(odd, "batch 1").count() == odd.count()
    fresh = digest_index.DigestIndex(spark, index.path)
    assert fresh.read().count() == len(before) + 1


def test_a_bucket_has_one_file_a_batch_however_a_key_is_dealt(spark, monkeypatch):
    frame = type(spark.range(1))
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: dealt(self, max(n, 21) if cols and isinstance(n, int) else n, *cols))
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    files = lambda: Counter(re.search(r"_(\d{5})\.", r[0])[1] for r in spark.table(index.table).select(F.input_file_name()).distinct().collect())
    assert index.ingest(docs).filter("kept").count() == 400
    assert files() == {f"{k:05}": 1 for k in range(4)}
    assert index.ingest(docs.withColumn("text", F.concat("text", F.lit("!")))).filter("kept").count() == 400
    index.compact()
    assert files() == {f"{k:05}": 1 for k in range(4)} and index.read().count() == 800


def test_a_batch_counts_once(spark, odd):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    lost = index.ingest(odd, "monday")  # its consumer fails
    again = index.ingest(odd, "monday")
    assert sorted(map(str, again.collect())) == sorted(map(str, lost.collect())) and again.filter("kept").count() == 8
    assert index.ingest(odd, "tuesday").filter("kept").count() == 0 and index.read().count() == 8


def test_a_batch_that_was_not_committed_is_not_seen(spark, odd, monkeypatch):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)

    def fails(fresh, attempt):
        append(fresh, attempt)
        raise OSError("lost")

    append = index._append
    monkeypatch.setattr(index, "_append", fails)
    with pytest.raises(OSError):
        index.ingest(odd, "monday")
    monkeypatch.undo()
    assert index.read().count() == 0
    assert index.ingest(odd, "monday").filter("kept").count() == 8 and index.read().count() == 8


def test_each_path_has_its_own_index(spark):
    paths = [common.new_path(spark, "index") + f"/{c}/" + "x" * 90 for c in "ab"]
    a, b = (digest_index.DigestIndex(spark, p, 4) for p in paths)
    a.ingest(spark.createDataFrame([(1, "t")], "doc_id long, text string"))
    assert a.table != b.table and a.read().count() == 1 and b.read().count() == 0


def test_batches_of_falling_ids(spark, odd):
    index = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4)
    got = digest_index.in_batches(odd, index, [0, 4], "odd").collect()
    want = digest_index.DigestIndex(spark, common.new_path(spark, "index"), 4).ingest(odd).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.digest) for r in got) == sorted((str(r.doc_id), r.keep_id, r.group_size, r.digest) for r in want)
    assert sum(r.kept for r in got) == 8


def test_dedup_keeps_columns_and_one_row_of_a_text(spark, odd):
    out = digest_index.dedup(odd)
    assert out.columns == odd.columns
    assert out.count() == out.select(F.coalesce("text", F.lit(""))).distinct().count() == 8
    assert digest_index.dedup(odd.limit(0)).count() == 0


# Near dedup


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    found, true = [], None
    wa, wb = rng.uniform(0.2, 9, 60), rng.uniform(0.2, 9, 60)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    for _ in range(80):
        c = rng.integers(0, 2**63, 60).astype(np.uint64)
        s = dart_minhash.signatures([(c, wa), (c, wb)])
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - true) < 0.02


def brute_classes(rows):
    hashes = dart_minhash._Hashes()
    sets = [Counter(dart_minhash.shingles(dart_minhash.word_hashes(t or "", hashes)).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (either and both / either >= 0.8) or (not either and (rows[i][1] or "") == (rows[j][1] or "")):
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(i)
    return {i: min(rows[m][0] for m in c) for c in classes.values() for i in c}


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect())
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(spark, sf_dir)).collect()}
    assert got == {rows[i][0]: c for i, c in want.items()}


def test_near_copies_of_a_template_without_a_common_hub(spark):
    """A chain of edits: neighbours are near, ends are not; and far variants of the template that link with nothing."""
    base = [f"w{k}" for k in range(200)]
    rows, now = [], list(base)
    for i in range(30):
        now = list(now)
        now[(i * 7) % 200] = f"edit{i}"
        rows.append((i, " ".join(now)))
    for i in range(30, 45):
        far = list(base)
        for k in range(0, 200, 12):
            far[k] = f"far{i}_{k}"
        rows.append((i, " ".join(far)))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: c for i, c in want.items()}


def test_prefix_filter_finds_all_links(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.integers(40)}" for w in words)) for i in range(60)]
    hashes = dart_minhash._Hashes()
    sets = {i: dart_minhash.as_set(dart_minhash.shingles(dart_minhash.word_hashes(t, hashes))) for i, t in rows}
    packed = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, elements binary")
    hub = min(sets, key=lambda i: len(sets[i]))
    comp = {i: hub if dart_minhash.similarity(s, sets[hub]) >= 0.8 else i % 3 + 1000 for i, s in sets.items()}
    members = spark.createDataFrame([(i, len(s), comp[i], hub) for i, s in sets.items()], "node long, size long, comp long, hub long")
    rows = dart_minhash.differences(packed, members, 0.8)
    pairs = {(r.a, r.b) for r in dart_minhash.across(rows, 0.8).collect()}
    assert {(r.a, r.b) for r in dart_minhash.across(rows, 0.8, first=True).collect()} < pairs
    true = {(i, j) for i in sets for j in sets if i < j and comp[i] != comp[j] and dart_minhash.similarity(sets[i], sets[j]) >= 0.8}
    assert len(true) > 20 and true <= pairs


def test_near_dedup_of_odd_rows(spark, odd):
    got = dart_minhash.near_duplicates(odd)
    assert got.count() == 12
    assert {r.doc_id: r.class_id for r in got.collect()}[3] == 2
    out = dart_minhash.dedup(odd)
    assert out.columns == odd.columns and out.filter("text like 'a b c d e f%'").select("doc_id").distinct().count() == 2
    assert dart_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(41)}}


# Embeddings


def test_cover_tree_gives_what_brute_force_gives(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = np.vstack([centres[rng.integers(8, size=150)] + rng.normal(size=(150, 16)) * rng.choice([0.02, 0.2, 0.35], (150, 1)), rng.normal(size=(100, 16))])
    x[10:14] = x[10]
    rows = [(i, [float(v) for v in x[i]], "ab"[i % 2]) for i in range(250)]
    rows += [(900, None, "a"), (901, [0.0] * 16, "a"), (902, [float("nan")] * 16, "a"), (903, [1.0] * 16, None), (904, [1.0, None], "a"), (905, [], "a"), (906, [1.0] * 3, "a"), (None, [1.0] * 16, "a"), (0, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("rep", F.lit(1))
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (units @ units.T >= 0.93) & (np.arange(250)[:, None] % 2 == np.arange(250) % 2)
    np.fill_diagonal(near, False)
    links = near.sum(axis=1) + near[:, 0] + (np.arange(250) == 0)
    component = np.arange(250)
    for _ in range(250):
        component = np.minimum(component, np.where(near, component, 999).min(axis=1))
    for block, pivots in ((2048, 64), (16, 4), (16, 0)):
        got = [r for r in cover_tree.near_duplicates(df, block=block, max_pivots=pivots).collect()]
        assert len(got) == len(rows)
        by_id = {r.vec_id: r for r in got}
        assert [by_id[i].n_links for i in range(250)] == links.tolist()
        assert [by_id[i].component_id for i in range(250)] == component.tolist()
        assert all(by_id[i].n_links == 0 and by_id[i].kept for i in range(900, 907)) and not by_id[None].kept
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


# Mixing


def test_mix_reaches_targets(spark, sf_dir):
    units, entries = curriculum.plan(documents(spark, sf_dir))
    by_source = units.groupBy("key").agg(F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("longest")).collect()
    total = sum(r["size"] for r in by_source)
    assert sum(r.target for r in by_source) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r["size"] and abs(r.taken - r.target) <= r.longest / 2 + 1 for r in by_source)
    assert units.agg(F.max("copies")).first()[0] <= 2
    assert entries.filter("position < 0 or position > 1 or position is null").isEmpty()


def test_mix_passes_by_a_document_that_is_too_long(spark):
    rows = [(0, " ".join(["a"] * 9000), "s"), *[(i, " ".join(["a"] * 100), "s") for i in range(1, 101)]]
    units, _ = curriculum.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=4000 / 19000)
    got = units.groupBy("size").agg(F.sum("copies").alias("n")).collect()
    assert {r["size"]: r.n for r in got} == {9000: 0, 100: 40}


def test_mix_follows_schedules(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    _, entries = curriculum.plan(docs)
    early = {r.key: r.share for r in entries.groupBy("key").agg(F.avg((F.col("position") < 0.5).cast("int")).alias("share")).collect()}
    want = {"=a": 0.5, "=b": 0.625, "=c": 0.125 / 0.6875}
    assert {k: pytest.approx(v, abs=0.01) for k, v in want.items()} == early
    assert curriculum.mix(docs).count() == entries.count()


def test_training_time_inverts_the_integral(spark):
    for knots in curriculum.SCHEDULES:
        t = [r[0] for r in spark.range(11).select(curriculum.training_time(F.col("id") / 10.0, knots)).collect()]
        grid = np.linspace(0, 1, 100001)
        area = np.cumsum(np.interp(grid, *zip(*knots, strict=True)))
        assert np.allclose(np.interp(t, grid, area / area[-1]), np.arange(11) / 10, atol=1e-3)


def test_mix_of_odd_rows(spark, odd):
    assert curriculum.mix(odd).columns == odd.columns
    units, _ = curriculum.plan(odd)
    assert units.agg(F.sum("size")).first()[0] == sum(len(WORD.findall(t or "")) for t in TEXTS) + 14
    assert curriculum.mix(odd.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string")
    assert curriculum.mix(few).count() in (1, 2)


# Chat


def test_windows_repeat_history_and_mask_it(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [(1, 0, "system", "be kind"), *[(1, k, ("user", "assistant")[k % 2 == 0], words(6, f"t{k}")) for k in range(1, 9)], (None, 0, "assistant", None), (None, 1, None, "\\n<|im_end|>\\"), (2, 0, "assi\nstant", "x\n\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = chat.read_windows(chat.format_windows(df, stride=30, history=12)).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.window)
    assert len(one) > 2 and all(r.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in one)
    assert [r.n_context > 1 for r in one] == [False] + [True] * (len(one) - 1)
    assert "".join(r.loss for r in one) == "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    assert [(t.role, t.text) for r in one for t in r.turns] == [(r[2], r[3]) for r in rows if r[0] == 1]
    none = next(r for r in got if r.conv_id is None)
    assert [(t.role, t.text) for t in none.turns] == [("assistant", ""), ("", "\\n<|im_end|>\\")]
    assert [(t.role, t.text) for r in got if r.conv_id == 2 for t in r.turns] == [("assi\nstant", "x\n\n")]
    assert chat.format_windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\\\|", "a\nb\\n", "<|im_end|>\\<|im_start|>", "\\|", "<<||"])
def test_escape_is_reversible(spark, text):
    r = spark.range(1).select(chat.escape(F.lit(text)).alias("a"), chat.unescape(chat.escape(F.lit(text))).alias("b"), chat.unescape(chat.escape_line(F.lit(text))).alias("c"), chat.escape_line(F.lit(text)).alias("d")).first()
    assert "<|" not in r.a and "\n" not in r.d and r.b == text == r.c


# URLs


def test_judge_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/x?q"), (4, "http://www.example.com/en/"), (5, "x://evil.org/p/#f"), (6, "x://evil.org/p//"), (7, "x://evil.org"), (8, "http://b.net/es/"), (9, "http://notexample.com/en/"), (9, "x://evil.org/p")]
    listed = spark.createDataFrame([("evil.org/p",), ("evil.org/p",), (None,)], "url string")
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, queries.URL_RULES).filter("page_id <> 9").collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/x", "example.com/en/", "block"), (4, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (5, "evil.org", "/p/", None, "block"), (6, "evil.org", "/p//", None, "block"), (7, "evil.org", "", None, "allow"), (8, "b.net", "/es/", "net/es/", "block"),
    ]
    tiny = url_filter.judge(pages, listed, queries.URL_RULES, max_filter_bytes=64)
    assert sorted(map(tuple, tiny.collect()), key=str) == sorted(map(tuple, url_filter.judge(pages, listed, queries.URL_RULES).collect()), key=str)
    assert url_filter.judge(pages.limit(0), listed.limit(0), []).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), []).collect()} == {"allow"}


# Quality


def test_classifier_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = documents(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").filter(common.fold(F.col("doc_id")) % 5 == 0).collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.9 and np.mean([r.score >= 0.3 for r in rows if r.quality]) > 0.95


def test_scores_are_those_of_averaged_vectors(spark, odd):
    """The softmax of the mean of all vectors, one for each word, n-gram and pair, kept apart by a layer of known numbers."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(quality.BUCKETS + quality.PAIR_BUCKETS, 3))
    layer, bias = rng.normal(size=(3, 2)), rng.normal(size=2)
    model = quality.Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))
    h32, h64 = (lambda s: xxhash.xxh32_intdigest(s)), (lambda s: xxhash.xxh3_64_intdigest(s))

    def pair(a, b):
        h = (h64(a) * 0x9E3779B97F4A7C15 ^ h64(b) * 0xC2B2AE3D27D4EB4F) % 2**64
        h = (h ^ (h >> 31)) * 0xD6E8FEB86659FD93 % 2**64
        return quality.BUCKETS + (h >> 40) % quality.PAIR_BUCKETS

    def score(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        at = [h32("w" + w) % quality.BUCKETS for w in words]
        at += [h32(g) % quality.BUCKETS for w in words for n in quality.GRAMS for i in range(len(w) + 3 - n) for g in [f"<{w}>"[i : i + n]]]
        at += [pair(a, b) for a, b in zip(words, words[1:])]
        z = (np.mean([vectors[k] for k in at], axis=0) if at else np.zeros(3)) @ layer + bias
        return np.exp(z[1]) / np.exp(z).sum()

    texts = ["a", "ab ab ab", "the the cat", "Ünder größe  \n und\tso", " ".join(f"w{k % 37}" for k in range(5000)), "x" * 3000, *(r.text for r in odd.select("text").collect())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.scored(rows, model).collect():
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-9)


def test_texts_scored_together_hash_their_distinct_words_by_array_steps(monkeypatch):
    """What is hashed one by one are words' hashes for pairs, and words and n-grams from 16 bytes on, once a group of texts; scores are those of each text alone."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"{'wö'[k % 2]}{k}" for k in rng.integers(0, 500, 300)) for _ in range(40)] + ["", "😀😀😀😀", "x" * 40, "a"]
    raw = "".join(texts).encode()
    begin, size = rng.integers(0, len(raw) - 30, 500), np.arange(500) % 30
    assert quality.piece_hashes(raw, begin, size).tolist() == [xxhash.xxh32_intdigest(raw[b : b + n]) for b, n in zip(begin.tolist(), size.tolist())]
    calls = Counter()
    for name in ("xxh32_intdigest", "xxh3_64_intdigest"):
        monkeypatch.setattr(quality.xxhash, name, lambda x, f=getattr(xxhash, name), name=name: calls.update([name]) or f(x))
    model = quality.Model(rng.normal(size=quality.BUCKETS + quality.PAIR_BUCKETS), 0.3)
    got = quality.score_batch(texts, model)
    assert calls["xxh32_intdigest"] < 10 and calls["xxh3_64_intdigest"] <= 503
    monkeypatch.setattr(quality, "TOGETHER", 700)
    assert got == pytest.approx(quality.score_batch(texts, model), abs=1e-12) and got == pytest.approx([quality.score_texts([t], model)[0] for t in texts], abs=1e-12)


def test_training_tells_labels_apart_and_reruns_agree():
    texts, labels = ["a b", "c d", "a b c", "c d d", "b", "d"], np.array([1, 0, 1, 0, 1, 0])
    bags = [quality.bag(t) for t in texts]
    model = quality.train(bags, labels)
    margins = [model.bias + float(model.parts[at] @ n) / float(n.sum()) for at, n in bags]
    assert all((m > 0) == (y == 1) for m, y in zip(margins, labels))
    again = quality.train(bags, labels)
    assert np.array_equal(model.parts, again.parts) and model.bias == again.bias


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (4, 1), (77, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.scored(odd, model)
    assert got.columns == [*odd.columns, "score"] and got.count() == 12 and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert {r.score for r in quality.scored(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(odd.limit(0), model).count() == 0


# Language model


def test_scores_are_those_of_brute_force_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = {r.doc_id: r for r in suffix_tree.score_held_out(docs).collect()}
    tokens = {r.doc_id: [*(w.decode() for w in (r.text or "").encode().lower().split()), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), abs=1e-6)
    assert sum(got[i].score - got[i].base_score for i in tokens if held[i]) > 0


def brute_scores(train, texts, depth=suffix_tree.MAX_DEPTH):
    """The suffix tree by dictionaries: contexts are tuples of words, the newest first. Also the retained contexts."""
    c = Counter(t for ts in train for t in ts)
    n, least = sum(c.values()), suffix_tree.LEAST_EVENTS
    root = lambda w: (c[w] + 0.5) / (n + 0.5 * (len(c) + 1))
    counts = Counter()
    for ts in train:
        for k, w in enumerate(ts):
            for d in range(1, min(depth, k) + 1):
                counts[tuple(reversed(ts[k - d : k])), w] += 1
    uses = {(w,): m for w, m in c.items() if m >= least and w is not None}
    p, rest, diverges = {}, {}, {}

    def after(context, w):
        if not context:
            return root(w)
        return p[context, w] if (context, w) in p else rest[context] * after(context[:-1], w)

    for d in range(1, depth + 1):
        level = {x: m for x, m in uses.items() if len(x) == d}
        for x, m in level.items():
            events = {w: k for (y, w), k in counts.items() if y == x and k >= least and c[w] >= least}
            above = {w: after(x[:-1], w) for w in events}
            rest[x] = 1 - sum((k - suffix_tree.DISCOUNT) / m for k in events.values())
            left, left_above = max(0.0, 1 - sum(events.values()) / m), max(1e-12, 1 - sum(above.values()))
            gain = sum(k * math.log(k / m / above[w]) for w, k in events.items()) + m * left * math.log(max(left, 1e-300) / left_above)
            diverges[x] = bool(events) and gain > 0.5 * math.log(n) * len(events)
            p |= {(x, w): (k - suffix_tree.DISCOUNT) / m + rest[x] * above[w] for w, k in events.items()}
        uses |= {(w, *x): k for x in level for w, k in ((w, counts[x, w]) for w in c) if k >= least and c[w] >= least and w is not None and (w, *x)[:-1] in level}
    kept = {x[: k + 1] for x, yes in diverges.items() if yes for k in range(len(x))}

    def log_p(ts, k):
        longest = max((d for d in range(min(depth, k) + 1) if not d or tuple(reversed(ts[k - d : k])) in kept), default=0)
        return math.log10(after(tuple(reversed(ts[k - longest : k])), ts[k]))

    return [sum(log_p(ts, k) for k in range(len(ts))) for ts in texts], kept


def test_scores_are_those_of_a_brute_force_tree(spark):
    rng = np.random.default_rng(3)
    patterns = ["a b c d e", "x b c d f", "a c c d g", "q r s t u"]
    texts = [" ".join(patterns[k] for k in rng.integers(0, 4, 6)) + (" rare%d" % i if i % 9 == 0 else "") for i in range(60)]
    docs = spark.createDataFrame([(i, t, i < 45) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, F.col("train")).collect()}
    tokens = [[*t.split(), None] for t in texts]
    want, kept = brute_scores(tokens[:45], tokens)
    assert max(map(len, kept)) >= 3
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in range(60))


@pytest.mark.parametrize("most", [0, 25])
def test_scores_do_not_depend_on_which_runs_tasks_hold(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_tree, "MOST_SHARED", most)
    test_scores_are_those_of_a_brute_force_tree(spark)


def test_contexts_of_a_small_share_are_learned(spark):
    """Three occurrences make a context and its event, in a corpus of any size."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 10_000)) for _ in range(20)]
    texts = [f"{t} {'north by northwest with six geese' if i < 3 else ''}" for i, t in enumerate(texts)] + ["north by northwest with six geese"]
    docs = spark.createDataFrame([(i, t, i < 20) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    (r,) = suffix_tree.score(docs, F.col("train")).filter("doc_id = 20").collect()
    assert r.n_known == 7 and r.train_tokens == 200_038
    # Five of its six words follow one that they alone follow, 2.5 of 3 times after the discount.
    assert r.score - r.base_score > 5 * math.log10(2.5 / 3 * 200_000 / 3.5) - 0.01


def test_words_hashed_together_are_those_of_each_text():
    rng = np.random.default_rng(7)
    odd = [b"", b" ", b"A b\ta\n\x0b\x0c\rB", b"\x1c \x1f\x85 \xc2\xa0x y\xe2\x80\x83z", b"a\x00 a a\x00\x00 \x00", b"x" * 200 + b" " + b"X" * 200 + b" " + b"x" * 199 + b"y"]
    odd += [b" ".join(b"w" * n for n in range(1, 140)), b"12345678 123456789 1234567 12345678\x00", "\u00c4 \u00e4 \u00c4".encode()]
    odd += [bytes(rng.integers(0, 256, 3000).astype(np.uint8)) for _ in range(20)]
    tokens, bounds = suffix_tree.hashes_of(odd)
    want = [[*t.lower().split(), None] for t in odd]
    assert [b - a for a, b in zip(bounds, bounds[1:], strict=False)] == list(map(len, want))
    pairs = {(w, h) for t, ts in enumerate(want) for w, h in zip(ts, suffix_tree.token_hashes(t, (tokens, bounds)).tolist(), strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert tokens[bounds[1] - 1] == suffix_tree.END


def test_next_words_of_each_state_sum_to_one(spark):
    """Scores of all one-word continuations, the end and an unknown word included, are a distribution."""
    texts = ["a b a b a b c"] * 40 + ["b b c a"] * 30 + ["c a b"] * 30
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(["a b", "a b a", "a b b", "a b c", "a b unknown"])], "doc_id long, text string, train boolean")
    s = {r.doc_id: r.score for r in suffix_tree.score(docs, F.col("train")).collect()}
    tree = suffix_tree.learn(docs.filter("train").select("text"), suffix_tree.count(docs.filter("train").select("text"), lambda t, b: t))
    assert sum(len(c[0].keys) for c in tree.contexts) >= 3
    import pyarrow as pa

    class Box:
        value = tree

    total = defaultdict(float)
    for context in ([b"a"], [b"b"], [b"c"], [b"a", b"b"], [b"b", b"a"]):
        for w in [b"a", b"b", b"c", b"zz"]:
            text, longer_text = b" ".join(context), b" ".join([*context, w])
            batch = pa.RecordBatch.from_pydict({"row": [0, 1], "doc_id": [0, 1], "text": [text, longer_text]})
            out = next(suffix_tree._scores(Box)(iter([batch]))).to_pydict()
            unknown = math.log10(0.5 / (tree.train_tokens + 0.5 * (tree.train_words + 1))) if w == b"zz" else 0
            # The score of the words alone: the text's less its end, which follows another state.
            total[tuple(context)] += 10 ** (_words_only(tree, [*context, w]) + unknown - _words_only(tree, context))
            assert out["n_tokens"] == [len(context) + 1, len(context) + 2]
        total[tuple(context)] += 10 ** (_with_end(tree, context) - _words_only(tree, context))
    assert all(v == pytest.approx(1, abs=1e-9) for v in total.values()) and s


def _tokens_score(tree, tokens):
    """The sum of a token array's scores, by the operator's own walk over one text."""
    import pyarrow as pa

    class Box:
        value = tree

    batch = pa.RecordBatch.from_pydict({"row": [0], "doc_id": [0], "text": [b" ".join(tokens)]})
    return next(suffix_tree._scores(Box)(iter([batch]))).to_pydict()["score"][0]


def _with_end(tree, tokens):
    return _tokens_score(tree, tokens)


def _words_only(tree, tokens):
    """The score without that of the end: the end's own is taken off by the difference of the two walks."""
    real = suffix_tree.token_hashes
    try:
        suffix_tree.token_hashes = lambda text, hashes: real(text, hashes)[:-1]
        return _tokens_score(tree, tokens)
    finally:
        suffix_tree.token_hashes = real


def test_scores_of_odd_rows(spark, odd):
    got = suffix_tree.score_held_out(odd.select("doc_id", "text", "n", F.lit(1).alias("key")))
    assert got.count() == 12
    assert {r.n_tokens for r in got.filter("doc_id in (2, 3, 7)").collect()} == {1}
    assert suffix_tree.score(odd, F.lit(False)).filter("score <> 0").isEmpty()
    assert suffix_tree.score_held_out(odd.limit(0)).count() == 0


def files_of_shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_shuffles_of_the_last_query_are_forgotten(spark):
    common.forget_shuffles(spark)
    before = files_of_shuffles(spark)
    rows = spark.range(20_000).selectExpr("id", "id % 100 as k").mapInArrow(common.trimmed(lambda batches: batches), "id long, k long")
    out = common.materialize(rows.groupBy("k").applyInArrow(lambda t: t.slice(0, 1), "id long, k long"), "some")
    new = files_of_shuffles(spark) - before
    common.forget_shuffles(spark)
    for _ in range(20):
        if not new & files_of_shuffles(spark):
            break
        time.sleep(0.1)
    assert new and not new & files_of_shuffles(spark) and out.count() == 100


def test_a_scored_table_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """Texts are scored a slice at a time, and what a slice wrote is deleted before the next one's."""
    written, at_once = [], []

    def watched(df, name, real=suffix_tree.materialize):
        out = real(df, name)
        written.append((name, out._written_to))
        at_once.append(sum(n == "text_scores" and common.exists(spark, p) for n, p in written))
        return out

    monkeypatch.setattr(suffix_tree, "materialize", watched)
    docs = spark.createDataFrame([(i, f"a b c a b w{i % 7}", i % 3 > 0) for i in range(90)] + [(None, "a b c", False)] * 3, "doc_id long, text string, train boolean")
    got = suffix_tree.score(docs, F.col("train"))
    assert max(at_once) == 1 and got.count() == 93 and got.filter("doc_id is null").select("score").distinct().count() == 1
    assert {n for n, p in written if common.exists(spark, p)} <= {"text_sums", "kept"}


# Personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile("[0-9]([\\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns(spark, sf_dir):
    rng = np.random.default_rng(2)
    texts = [r.text for r in documents(spark, sf_dir).collect()]
    texts += ["".join(rng.choice(list("a1@.+ -()25x_"), 60)) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.4", "+1 (826) 555-4081 190.137.223.1", "@a.b", "4111 1111 1111 1111", "x" * 9000 + "@y.z"]
    for t in texts:
        assert pii_crf.base_spans(t) == plain_spans(t), t


def test_field_carries_labels_to_repeats(spark):
    shape = [np.zeros((n, pii_crf.LABELS)) for n in pii_crf.SLOTS]
    pair = np.zeros((2, pii_crf.LABELS, pii_crf.LABELS))
    pair[1] = 4 * np.eye(pii_crf.LABELS)
    shape[0][:, 0] = 1.0
    text = "call +15551234567 now. " + "filler " * 200 + "again 15551234567, other 99887766554"
    base, spans = pii_crf.find([text], pii_crf.Field(shape, pair))[0]
    assert [text[s:e] for s, _, e in base] == ["+15551234567"]
    assert [(pii_crf.KINDS[k], text[s:e]) for s, k, e in spans] == [("phone", "+15551234567"), ("phone", "15551234567")]


def test_spans_are_those_of_exact_marginals(spark):
    """All spans of a short text against sums over every labelling of its tokens."""
    text = "call +15551234567 or 15551234567 mail me@x.org and 15551234567 at 10"
    docs = spark.createDataFrame([(i, f"tel +1555123{4000 + i} or 1555123{4000 + i} ok {i}") for i in range(40)] + [(99, text)], "doc_id long, text string")
    field = pii_crf.fit(docs)
    graph = pii_crf.graph_of([text])
    node = sum(w[graph.shapes[:, k]] for k, w in enumerate(field.shape))
    weights = np.zeros((len(graph.seen), pii_crf.LABELS))
    for labels in itertools.product(range(pii_crf.LABELS), repeat=len(graph.seen)):
        if all(s < 0 or s == x for s, x in zip(graph.seen, labels, strict=True)):
            x = math.exp(sum(node[i, v] for i, v in enumerate(labels) if graph.seen[i] < 0) + sum(field.pair[kind][labels[a], labels[b]] for a, b, kind in graph.links))
            for i, v in enumerate(labels):
                weights[i, v] += x
    exact = weights / weights.sum(axis=1, keepdims=True)
    assert np.abs(exact - pii_crf.beliefs(graph, field)).max() < 0.05
    got = pii_crf.detect(docs.filter("doc_id = 99"), field).first()
    base = {(s["kind"], s["start"], s["end"]) for s in got.base}
    spans, mine = {(s["kind"], s["start"], s["end"]) for s in got.spans}, set()
    for (start, end), p, seen in zip(graph.spans[0], exact, graph.seen, strict=True):
        if seen < 0 and p.argmax() and p.max() >= pii_crf.BELIEF:
            mine.add((pii_crf.KINDS[p.argmax() - 1], start, end))
    assert spans == base | mine and len(mine) >= 2


def test_field_reaches_a_hundred_repeats_and_no_other_document():
    shape = [np.zeros((n, pii_crf.LABELS)) for n in pii_crf.SLOTS]
    pair = np.zeros((2, pii_crf.LABELS, pii_crf.LABELS))
    pair[1] = 4 * np.eye(pii_crf.LABELS)
    shape[0][:, 0] = 1.0
    field, again = pii_crf.Field(shape, pair), "again 15551234567 said twice. " * 50
    text = again + "call +15551234567 now. " + again
    others = ["1 2 3 " * 40, "7 and then 7 and 8 and then 8", ""]
    got = pii_crf.find([text, *others], field)
    assert [text[s:e] for s, k, e in got[0][1] if pii_crf.KINDS[k] == "phone"] == ["15551234567"] * 50 + ["+15551234567"] + ["15551234567"] * 50
    alone, both = pii_crf.beliefs(pii_crf.graph_of(others[:2]), field), pii_crf.beliefs(pii_crf.graph_of([*others[:2], text]), field)
    assert np.array_equal(alone, both[: len(alone)])


def test_messages_give_the_marginals_of_a_tree():
    rng = np.random.default_rng(0)
    n = 5
    graph = pii_crf.Graph([], np.array([[int(rng.integers(s)) for s in pii_crf.SLOTS] for _ in range(n)]), np.array([-1, 3, -1, -1, -1]), np.array([[0, 1, 0], [1, 2, 0], [1, 3, 1], [3, 4, 1]]), [])
    field = pii_crf.Field([rng.normal(size=(s, 5)) for s in pii_crf.SLOTS], rng.normal(size=(2, 5, 5)))
    field.pair = (field.pair + field.pair.transpose(0, 2, 1)) / 2
    got = pii_crf.beliefs(graph, field, rounds=200)
    node = sum(w[graph.shapes[:, k]] for k, w in enumerate(field.shape))
    want = np.zeros((n, 5))
    for labels in np.ndindex(*[5] * n):
        if labels[1] == 3:
            p = math.exp(sum(node[i, x] for i, x in enumerate(labels) if i != 1) + sum(field.pair[k][labels[a], labels[b]] for a, b, k in graph.links))
            for i, x in enumerate(labels):
                want[i, x] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=2e-3)


def test_a_learned_field_carries_labels_to_repeats(spark):
    """What is planted in other texts than those that it learned from: recall of repeats in spellings that no pattern knows, and what is left alone."""
    rng = np.random.default_rng(11)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        while not pii_crf.luhn(d := "4" + digits(15)):
            pass
        return d

    def text(k: int) -> tuple[str, set[str], set[str]]:
        phone, number, other = "1" + digits(10), card(), "7" + digits(9)
        told = [f"+{phone}", f"+{phone[0]} ({phone[1:4]}) {phone[4:7]}-{phone[7:]}"][k % 2]
        said = {phone, f"{phone[0]}-{phone[1:4]}-{phone[4:7]}-{phone[7:]}", ".".join(number[i : i + 4] for i in range(0, 16, 4))}
        filler = " and some words between them here "
        body = filler.join([f"order {other} of us", f"call {told}", f"card {number}", *sorted(said), f"order {other} again", "mail a@b or k@example.org"])
        return body, said, {other, "a@b"}

    learn = spark.createDataFrame([(k, text(k)[0]) for k in range(150)], "doc_id long, text string")
    field = pii_crf.fit(learn)
    hits = wanted = 0
    for k in range(40):
        body, said, none = text(k)
        found = {body[s:e] for s, _, e in pii_crf.find([body], field)[0][1]}
        hits, wanted = hits + len(said & found), wanted + len(said)
        assert not none & found
    assert hits / wanted > 0.95


def test_whole_numbers_side_by_side_are_two(spark):
    shape = [np.zeros((n, pii_crf.LABELS)) for n in pii_crf.SLOTS]
    shape[5][1, 3] = 9.0
    found = pii_crf.find(["4465758382889437 4465758382889437"], pii_crf.Field(shape, np.zeros((2, pii_crf.LABELS, pii_crf.LABELS))))[0][1]
    assert [(s, e) for s, _, e in found] == [(0, 16), (17, 33)]


def test_pii_of_odd_rows(spark, odd):
    got = {(r.doc_id, tuple(s.kind for s in r.base)) for r in pii_crf.detect(odd, pii_crf.fit(odd)).collect()}
    assert {k for d, k in got if d == 8} == {("phone", "email")} and all(not k for d, k in got if d != 8)
    assert pii_crf.detect(odd.limit(0), pii_crf.fit(odd.limit(0))).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    kept = common.materialize(corpus_pipeline.keep_quality(spark, docs, sf_dir), "kept")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    wrong = docs.join(labels, "doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").filter("quality = 1").count()
    assert wrong <= 0.05 * labels.count()
    exact = common.materialize(corpus_pipeline.drop_copies(spark, kept, sf_dir), "exact")
    want = kept.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(r.doc_id for r in want.collect())
    near = common.materialize(corpus_pipeline.drop_near_copies(spark, exact, sf_dir), "near")
    rows = sorted((r.doc_id, r.text) for r in exact.collect())
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(brute_classes(rows).values()))
    mixed = common.materialize(corpus_pipeline.mix_sources(spark, near, sf_dir), "mixed")
    assert mixed.columns == columns
    words = lambda d: d.agg(F.sum(common.n_words(F.col("text")))).first()[0]
    assert abs(words(mixed) / words(near) - 1.5) < 0.2
    out = common.materialize(corpus_pipeline.encode_pieces(spark, mixed, sf_dir), "encoded")
    assert sorted(r.position for r in out.collect()) == list(range(mixed.count()))
    # The plan's order is that of the output.
    planned = curriculum.plan(near)[1].orderBy("position", "key", "doc_id", "copy").collect()
    assert [r.doc_id for r in out.orderBy("position").collect()] == [r.doc_id for r in planned]
    texts = {r.doc_id: r.text or "" for r in near.collect()}
    spelled = corpus_pipeline.piece_sampling.load(spark).spelled
    for r in out.collect():
        assert {corpus_pipeline.piece_sampling.decode(s.ids, spelled) for s in r.samples} == {texts[r.doc_id]}
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)


def tables_left(spark):
    return Counter(name.rsplit("-", 1)[0] for name in os.listdir(common.shared_dir(spark).removeprefix("file://")))


def test_stages_leave_little_behind(spark, sf_dir):
    """What a stage has written for itself goes, but for what its result is read from."""
    docs = documents(spark, sf_dir)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat("text", F.lit(" again"))))
    before = tables_left(spark)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    assert tables_left(spark) - before == Counter(["stage"] * 4 + ["dropped_keys", "dropped_ids", "row_nodes", "decided_nodes", "mixed_units"] + ["groups"] * 2)
    before = tables_left(spark)
    corpus_pipeline.run(spark, sf_dir)
    assert (tables_left(spark) - before)["stage"] == 1


def test_run_is_its_stages(spark, sf_dir, monkeypatch):
    """run() on a table of its own: a bad document, copies, near copies and two sources."""
    monkeypatch.setattr(corpus_pipeline, "LEAST_QUALITY", 0.5)
    good, bad = [f"fine{k} prose{k % 7} reads{k % 5} well{k % 3}" for k in range(60)], "junk junk junk junk"
    long = " ".join(f"word{k}" for k in range(100))
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(good)] + [(100 + i, bad, "a") for i in range(40)] + [(200, good[3], "a"), (300, long, "b"), (301, long + " more", "a")]
    folder = common.new_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int("junk" not in r[1])) for r in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    ids = Counter(r.doc_id for r in out)
    assert not any(100 <= i < 140 for i in ids) and 3 not in ids and 301 not in ids and max(ids.values()) <= 2
    assert sorted(r.position for r in out) == list(range(len(out)))
    assert {200, 300} <= set(ids) or len(ids) > 50


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, odd, empty):
    """Nulls, empty texts, repeated rows, working names as columns, and a map; no column is lost or written over."""
    names = "digest v_id v_digest id _id _at _block _maybe maybe _key e_key e_id _position position _copy copy _score score row whole_row turn samples _metadata".split()
    docs = odd.drop("row").withColumns({n: F.lit(f"own {n}") for n in names} | {"m": F.create_map(F.lit("a"), F.lit(1))})
    docs = docs.limit(0) if empty else docs
    folder = common.new_path(spark, "tables")
    spark.createDataFrame([(1, 1), (0, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, folder), "odd_stage")
        assert out.columns == docs.columns and out.count() <= 2 * docs.count() and (empty or out.count() > 0)
        assert out.filter(" or ".join(f"`{n}` <> 'own {n}'" for n in names)).isEmpty()
    out = corpus_pipeline.encode_pieces(spark, docs, folder)
    assert out.count() == docs.count() and out.columns == ["doc_id", "position", "samples"]
