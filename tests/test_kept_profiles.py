"""Profiles changed by adds, deletes and confirmed metadata, against profiles built anew."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import routing
from corpusloom.session import new_path
from corpusloom.sources.buckets import Conflict
from corpusloom.sources.kept_profiles import KeptProfiles, Rows

DOCS = "kb_id int, document_id long, title string, department string, doc_type string, text string"


def rows_of(docs):
    parents = docs.select("kb_id", "document_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "/")).alias("parent_index", "content"))
    return Rows(docs, parents)


@pytest.fixture(scope="module")
def kbs(spark):
    return spark.createDataFrame([(k, f"kb{k}", None if k == 2 else "about") for k in range(4)], "kb_id int, name string, description string")


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def start():
    """Knowledge base 0 holds most; some rows have nulls, empty texts or no knowledge base."""
    rows = [(0 if i % 3 else 1, i, f"t{i} Red", "ab"[i % 2], "x" if i % 5 else "", f"alpha w{i % 7}/beta w{i % 3}") for i in range(40)]
    return [*rows, (2, 100, None, None, None, None), (None, 101, "t", "a", "x", "lost"), (2, 102, "", "", "", "")]


def rebuilt(spark, kbs, rows):
    r = rows_of(frame(spark, rows))
    p = routing.profiles(kbs, r.documents.filter("kb_id is not null"), r.parents.filter("kb_id is not null"))
    return {x.kb_id: x for x in p.collect()}


def brute_keywords(spark, rows):
    fresh = KeptProfiles(spark, new_path(spark, "fresh"), buckets=4)
    fresh.build(rows_of(frame(spark, rows)))
    return sorted(fresh.keywords().collect())


def test_changes_give_what_a_rebuild_gives(spark, kbs):
    rows = start()
    kept = KeptProfiles(spark, new_path(spark, "profiles"), buckets=4)
    kept.build(rows_of(frame(spark, rows)))
    assert {x.kb_id: x for x in kept.profiles(kbs).collect()} == rebuilt(spark, kbs, rows)
    first = {r[1]: r for r in rows}
    steps = [
        ([(3, 200, "new", "c", "y", "gamma"), (0, -5, "before all", "b", "x", "delta/alpha")], []),  # a new knowledge base, and a row ahead of the first
        ([], [first[1], first[2], first[39]]),  # first rows go, and one that is not among them
        ([(*first[4][:3], "confirmed", "z", first[4][5])], [first[4]]),  # confirmed metadata
        ([], [(3, 200, "new", "c", "y", "gamma"), first[100], first[102]]),  # knowledge bases without documents
    ]
    for added, gone in steps:
        rows = [r for r in rows if r not in gone] + added
        kept.change(*(rows_of(frame(spark, x)) for x in (added, gone, rows)))
        assert {x.kb_id: x for x in kept.profiles(kbs).collect()} == rebuilt(spark, kbs, rows)
    assert sorted(kept.keywords().collect()) == brute_keywords(spark, rows)


def test_a_marked_change_counts_once_and_a_late_writer_counts_again(spark, kbs, monkeypatch):
    rows = start()
    kept = KeptProfiles(spark, new_path(spark, "profiles"), buckets=4)
    kept.build(rows_of(frame(spark, rows)), mark=("docs", 0))
    kept.build(rows_of(frame(spark, rows)), mark=("docs", 0))
    new = [(0, 300, "late", "d", "x", "alpha")]
    commit, calls = kept.store._commit, []

    def once(*args):
        calls.append(1)
        if len(calls) == 1:
            raise Conflict("another writer")
        return commit(*args)

    monkeypatch.setattr(kept.store, "_commit", once)
    kept.change(*(rows_of(frame(spark, x)) for x in (new, [], rows + new)))
    assert len(calls) == 2
    assert {x.kb_id: x for x in kept.profiles(kbs).collect()} == rebuilt(spark, kbs, rows + new)


def test_only_buckets_of_a_change_are_written(spark):
    kept = KeptProfiles(spark, new_path(spark, "profiles"), buckets=16)
    rows = start()
    kept.build(rows_of(frame(spark, rows)))
    was = kept.store.state()["tables"]["counts"]["files"]
    new = [(3, 300, "z", "", "", "")]
    kept.change(*(rows_of(frame(spark, x)) for x in (new, [], rows + new)))
    now = kept.store.state()["tables"]["counts"]["files"]
    assert 0 < sum(was.get(b) != w for b, w in now.items()) <= 3
