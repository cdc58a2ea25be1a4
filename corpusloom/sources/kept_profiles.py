"""Profiles of knowledge bases, kept up to date by what a change adds and takes away instead of being built anew.

A change is read once: it becomes numbers that are added to stored counts (documents, departments, document types, tokens of titles and
parents), and rows that may be among a knowledge base's first titles and parents. Only a knowledge base that loses one of
its first rows is read again. All of a change is one commit of the store.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.retrieval import ranked
from corpusloom.operators.routing import KEYWORDS, SAMPLE_CHARS, SAMPLES, STOP_WORDS, TITLES, assemble
from corpusloom.session import materialize
from corpusloom.sources.buckets import BucketStore

#: Parts that a knowledge base's counts are dealt to, so that a large one is many buckets' work.
PARTS = 16
#: table -> (its rows' key, how many first rows are kept).
HEADS = {"titles": (["kb_id", "document_id"], TITLES), "samples": (["kb_id", "document_id", "parent_index"], SAMPLES)}


@dataclass
class Rows:
    """documents (kb_id, document_id, title, department, doc_type) and parents (kb_id, document_id, parent_index, content)."""

    documents: DataFrame
    parents: DataFrame


def _slot(part: Column) -> Column:
    return F.concat_ws("/", F.col("kb_id").cast("string"), part.cast("string"))


def _facts(rows: Rows) -> list[DataFrame]:
    """(kb_id, kind, value) for each row that supports it; rows without a knowledge base support none."""
    docs = rows.documents.filter("kb_id is not null")
    tokens = lambda df, text: df.select("kb_id", F.lit("token").alias("kind"), F.explode(X.profile_tokens(F.coalesce(text, F.lit("")))).alias("value"))
    said = lambda name: docs.filter(F.col(name) != "").select("kb_id", F.lit(name).alias("kind"), F.col(name).alias("value"))
    return [
        docs.select("kb_id", F.lit("document").alias("kind"), F.lit("").alias("value")), said("department"), said("doc_type"),
        tokens(docs, F.col("title")), tokens(rows.parents.filter("kb_id is not null"), F.col("content")),
    ]


def _summed(*parts: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("slot", "kb_id", "kind", "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def _heads(rows: Rows) -> dict[str, DataFrame]:
    head = _slot(F.lit("head")).alias("slot")
    sample = F.substring("content", 1, SAMPLE_CHARS).alias("sample")
    return {
        "titles": rows.documents.filter("kb_id is not null").select(head, "kb_id", "document_id", "title"),
        "samples": rows.parents.filter("kb_id is not null").select(head, "kb_id", "document_id", "parent_index", sample),
    }


class KeptProfiles:
    """The profiles below a path.

    Keys of documents and parents are taken to be distinct; those of a row that changes are in both gone, as it was, and
    added, as it is. Null texts have no tokens, and null or empty departments and types aren't listed, as in profiles().
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.store = BucketStore(spark, path, key="slot", tables=("counts", *HEADS), buckets=buckets)

    def change(self, added: Rows, gone: Rows, now: Rows, mark: tuple[str, int] | None = None) -> int:
        """now: all rows as they are after the change, read only where a knowledge base loses a first row. mark as in
        BucketStore.replace(): a batch that is committed isn't counted again."""
        signed = [df.withColumn("n", F.lit(sign).cast("long")) for rows, sign in ((added, 1), (gone, -1)) for df in _facts(rows)]
        slots = [df.withColumn("slot", _slot(F.pmod(F.xxhash64("value"), F.lit(PARTS)))) for df in signed]
        delta = materialize(_summed(*slots), "profile_delta")
        new, lost, whole = _heads(added), _heads(gone), _heads(now)
        touched = [delta.select("slot"), *(h[t].select("slot") for h in (new, lost) for t in HEADS)]

        def count(old: DataFrame | None) -> DataFrame:
            return delta if old is None else _summed(old, delta)

        def first(name: str):
            keys, most = HEADS[name]
            order = [F.col(k) for k in keys[1:]]
            best = lambda rows: ranked(rows, ["kb_id"], order, "_n", most).drop("_n")

            def change(old: DataFrame | None) -> DataFrame:
                if old is None:
                    return best(new[name])
                hit = materialize(old.join(lost[name].select(*keys), keys, "left_semi").select("kb_id").distinct(), "profiles_to_refill")
                if hit.isEmpty():
                    return best(old.unionByName(new[name]))
                kept = old.unionByName(new[name]).join(hit, "kb_id", "left_anti")
                return best(kept.unionByName(whole[name].join(hit, "kb_id", "left_semi"))).select(*old.columns)

            return change

        return self.store.change(reduce(DataFrame.union, touched), {"counts": count, **{t: first(t) for t in HEADS}}, mark)

    def build(self, rows: Rows, mark: tuple[str, int] | None = None) -> int:
        """The first rows of an empty store."""
        return self.change(rows, Rows(rows.documents.limit(0), rows.parents.limit(0)), rows, mark)

    def profiles(self, kbs: DataFrame) -> DataFrame:
        """What routing.profiles() builds from all rows, from the stored counts and first rows."""
        counts = self.store.read("counts")
        listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(f"{kind}s")
        facts = counts.filter("kind <> 'token'").groupBy("kb_id").agg(
            F.sum(F.when(F.col("kind") == "document", F.col("n"))).alias("document_count"), listed("department"), listed("doc_type")
        )
        titles = self.store.read("titles").groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "title"))).alias("t"))
        samples = self.store.read("samples").groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "parent_index", F.col("sample").alias("c")))).alias("s"))
        return assemble(kbs, facts, titles, samples)

    def keywords(self, limit: int = KEYWORDS) -> DataFrame:
        """(kb_id, keyword, n, rank): the tokens of most titles and parents, then by token."""
        tokens = self.store.read("counts").filter("kind = 'token'").filter(~F.col("value").isin(*STOP_WORDS) & (F.length("value") >= 2))
        return ranked(tokens.select("kb_id", F.col("value").alias("keyword"), "n"), ["kb_id"], [F.col("n").desc(), F.col("keyword")], "rank", limit)
