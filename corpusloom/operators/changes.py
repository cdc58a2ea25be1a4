"""Incremental maintenance: what to add, update and delete, and merges by key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal contents are the same chunk when their places differ by no more.
BAND = 10


def to_add(current: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(existing.select(*keys).distinct(), keys, "left_anti")


def to_delete(current: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """All of existing if current is empty."""
    return existing.join(current.select(*keys).distinct(), keys, "left_anti")


def _pairs(old: list[tuple[int, str]], new: list[int], band: int) -> list[tuple[str, str | None, int | None]]:
    """('update', uuid, place), ('delete', uuid, None) and ('create', None, place): both lists are walked in order of
    place, pairing the foremost two when they are near, else giving up the one further ahead."""
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and abs(old[i][0] - new[j]) <= band:
            out.append(("update", old[i][1], new[j]))
            i, j = i + 1, j + 1
        elif j == len(new) or (i < len(old) and old[i][0] < new[j]):
            out.append(("delete", old[i][1], None))
            i += 1
        else:
            out.append(("create", None, new[j]))
            j += 1
    return out


def banded_diff(old: DataFrame, new: DataFrame, band: int = BAND, scope: list[str] | None = None) -> DataFrame:
    """old (uuid, index, content_hash) and new (index, content_hash) -> (action, content_hash, uuid, index).

    A content with at most one old and one new place is decided by an expression. Only those with more are walked: a
    group is one content of one scope (a document, say), so a line that recurs throughout the corpus is many groups.
    """
    scope = scope or []
    both = old.select(*scope, "content_hash", "uuid", "index", F.lit(True).alias("is_old")).unionByName(
        new.select(*scope, "content_hash", F.lit(None).cast("string").alias("uuid"), "index", F.lit(False).alias("is_old"))
    )
    keys = [*scope, "content_hash"]

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        was = sorted(zip(pdf["index"][pdf["is_old"]], pdf["uuid"][pdf["is_old"]], strict=True))
        now = sorted(pdf["index"][~pdf["is_old"]])
        out = pd.DataFrame(_pairs(was, now, band), columns=["action", "uuid", "index"]).astype({"index": "Int64"})
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out

    types = {f.name: f.dataType.simpleString() for f in old.schema}
    schema = "action string, uuid string, index long, " + ", ".join(f"{k} {types[k]}" for k in keys)
    pick = lambda c, is_old: F.max(F.when(F.col("is_old") == is_old, F.col(c)))
    groups = both.groupBy(*keys).agg(
        F.count_if("is_old").alias("n_old"), F.count_if(~F.col("is_old")).alias("n_new"), pick("uuid", True).alias("uuid"), pick("index", True).alias("was"), pick("index", False).alias("now")
    )
    plain = (F.col("n_old") <= 1) & (F.col("n_new") <= 1)
    action = lambda name, uuid, index: F.struct(F.lit(name).alias("action"), uuid.cast("string").alias("uuid"), index.cast("long").alias("index"))
    none = F.lit(None)
    near = (F.col("n_old") == 1) & (F.col("n_new") == 1) & (F.abs(F.col("was") - F.col("now")) <= band)
    gone = F.when(F.col("n_old") == 1, action("delete", F.col("uuid"), none))
    made = F.when(F.col("n_new") == 1, action("create", none, F.col("now")))
    decided = F.when(near, F.array(action("update", F.col("uuid"), F.col("now")))).otherwise(F.filter(F.array(gone, made), lambda x: x.isNotNull()))
    decided = groups.filter(plain).select(*keys, F.explode(decided).alias("d")).select("d.*", *keys)
    rest = both.join(groups.filter(~plain).select(*keys), keys, "left_semi")
    return decided.unionByName(rest.groupBy(*keys).applyInPandas(walk, schema))


def merge_by_key(existing: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """existing with changes put in; of several changes of a key the one of the largest order stays, of those that tie, and
    without an order, the one of the smallest hash of all columns."""
    hashed = F.xxhash64(F.to_json(F.struct(*changes.columns)))
    latest = Window.partitionBy(*keys).orderBy(*([F.col(order).desc()] if order else []), hashed)
    changes = changes.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_missing(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... WHERE NOT EXISTS."""
    return existing.unionByName(rows.join(existing.select(*keys), keys, "left_anti"))


def delete_in(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """DELETE ... WHERE key IN (...)."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def update_where(rows: DataFrame, condition, values: dict) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def not_yet_known(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads whose knowledge base, name and hash no document has."""
    keys = ["kb_id", "file_name", "file_hash"]
    return uploads.join(documents.select(*keys), keys, "left_anti")


def propagate(rows: DataFrame, confirmed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with what confirmed (one row per key) says in columns; empty text and null leave them as they are."""
    new = confirmed.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def replace_documents(chunks: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """chunks with those of fresh's documents replaced: what a document no longer holds goes."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
