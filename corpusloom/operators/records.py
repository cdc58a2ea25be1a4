"""Traces, snapshots, pages of lists, and joins of records for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X

SNAPSHOT_ROWS, PREVIEW_CHARS, TEXT_CHARS, LIST_ITEMS, MOST_TRACES, TURNS = 20, 240, 2000, 80, 200, 6


def snapshot(candidates: DataFrame, rank: str = "rank") -> DataFrame:
    """The first candidates of each query, their content cut to a preview."""
    return candidates.filter(F.col(rank) <= SNAPSHOT_ROWS).withColumn("preview", F.substring("content", 1, PREVIEW_CHARS)).drop("content")


def truncated(column: Column, kind: T.DataType) -> Column:
    """A value of any type cut to what a trace may hold: texts to TEXT_CHARS, lists to LIST_ITEMS, at every depth."""
    if isinstance(kind, T.StringType):
        return F.substring(column, 1, TEXT_CHARS)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(column, 1, LIST_ITEMS), lambda x: truncated(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: truncated(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[truncated(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def trace(rows: DataFrame, key: str, created_at: Column) -> DataFrame:
    """A trace record for each row: its key, the time as text, and all other columns, truncated, as JSON."""
    payload = F.struct(*[truncated(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if f.name != key])
    return rows.select(key, X.iso(created_at).alias("created_at"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def variable(rows: DataFrame, column: str, *order: Column) -> Column:
    """One value, as a session variable holds it: the column of the first row in this order, null without rows."""
    return rows.orderBy(*order).select(column).limit(1).scalar()


def first_row(rows: DataFrame, condition: Column, *order: Column) -> DataFrame:
    """The first of the rows that the condition holds for."""
    return rows.filter(condition).orderBy(*order).limit(1)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the sizes of tables, as a dashboard shows them."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def task_states(tasks: DataFrame, upload: str, status: str, done: str, failed: str) -> DataFrame:
    """For each upload, how many tasks it has, whether all of them are done and whether any failed."""
    s = F.coalesce(F.col(status), F.lit(""))
    return tasks.groupBy(upload).agg(F.count("*").alias("n_tasks"), F.bool_and(s == done).alias("all_done"), F.bool_or(s == failed).alias("any_failed"))


def page(rows: DataFrame, key: str, skip: int, size: int) -> DataFrame:
    return rows.orderBy(key).offset(skip).limit(size)


def latest(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(min(limit, MOST_TRACES))


def last_turns(messages: DataFrame, chat: str, turn: str, n: int = TURNS) -> DataFrame:
    """(chat, turns): the last n turns of each chat, in order."""
    recent = messages.withColumn("_r", F.row_number().over(Window.partitionBy(chat).orderBy(F.col(turn).desc()))).filter(F.col("_r") <= n)
    listed = F.sort_array(F.collect_list(F.struct(turn, "role", "text")))
    return recent.groupBy(chat).agg(F.transform(listed, lambda m: F.concat_ws(": ", m["role"], m["text"])).alias("turns"))


def nested(left: DataFrame, right: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """left with the sorted list of its rows of right; an empty list where there are none."""
    lists = right.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return left.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def cited_documents(citations: DataFrame, documents: DataFrame, kbs: DataFrame) -> DataFrame:
    """(kb_id, document_id) pairs as they are cited, with repeats -> each once with its document's and knowledge base's names."""
    found = citations.select("kb_id", "document_id").distinct().join(documents.select("kb_id", "document_id", "file_name"), ["kb_id", "document_id"])
    return found.join(kbs.select("kb_id", F.col("name").alias("kb_name")), "kb_id").select("kb_id", "document_id", "kb_name", "file_name")
