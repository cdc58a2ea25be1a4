"""What several operators of this subpackage share: the shared folder, prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where it is unset and the session is local does a temporary folder of this machine take its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_local_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def give_back() -> None:
    """Returns what a Python worker has freed to its machine: workers live on from task to task, and so would the room that their largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function from batches to batches, with give_back() at its end."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() has written; nothing may read them later."""
    for t in tables:
        delete(t.sparkSession, t._written_to)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay until the driver collects its garbage; those of the last query only go with a second collection, a moment after the first."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one column, row, beside the given ones, so that no working name meets a name of theirs; flat() undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def fold(col: Column) -> Column:
    """crc32 of the value as text, null as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def ascii_lower(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def prefix_sum(df: DataFrame, group: str, bucket: Column, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each (value: name) of values, the sum over all earlier rows of the group in (bucket, order).

    A group may hold most of the table: rows are summed by (group, bucket) first, the few bucket sums are
    added up per group, and each bucket runs its own short window, so no task sees a whole group. bucket must
    rise with the order. group must not be null.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(group, "_bucket").agg(*[F.sum(v).alias(f"_s_{n}") for v, n in values.items()])
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values.values()],
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in values.items()})
    rows = rows.join(sums, (F.col(group) == F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return rows.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values.values()}).drop(
        "_bucket", "_g", "_b", *[f"_o_{n}" for n in values.values()]
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (id, component), component being the smallest id reachable; isolated ids are absent.

    Alternates large-star and small-star steps: each takes a minimum per node, by tasks before the shuffle, and joins
    it back, so a node with very many links is split like any other skewed join. Each round is written to the
    shared folder; the driver only learns whether all that is left are stars. The result is read from the last round's
    table, and release() deletes that.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest_neighbours")
        linked = both.join(low.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
        if large:
            out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
            out = out.filter("a <> b").distinct()
        out = materialize(out, "links")
        release(low, e)
        return out

    # Each link runs from its larger to its smaller end.
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        now = star(star(now, True), False)
        forget_shuffles(edges.sparkSession)
        # Stars alone are left when no end has two centres and no centre is an end.
        ends = now.groupBy("a").agg(F.count("*").alias("n"))
        if ends.filter("n > 1").isEmpty() and ends.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = labels.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    labels._written_to = now._written_to
    return labels


#: Up to so many rows with one row per group are broadcast; more are joined by a salted shuffle.
SMALL_ROWS = 10_000
SALTS = 16


def join_groups(rows: DataFrame, per_group: DataFrame, key: str) -> DataFrame:
    """rows with what per_group (one row per key, which is not null) says on their key, however many rows a key has."""
    per_group = materialize(per_group, "groups")
    if per_group.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(per_group), key)
    salted = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", spread).join(salted, [key, "_salt"]).drop("_salt")
