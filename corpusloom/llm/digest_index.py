"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New documents are hashed, reduced to one row per distinct digest, and held against the index by a sort-merge
anti join that reads the index without a shuffle; what is new is appended in the same buckets. A batch counts from the
moment its name is written to the index's commits: until then neither its digests nor its verdicts are seen, and from then
on ingesting it again only reads its verdicts.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, exists, flat, materialize, nested, new_path, release, text_or_empty

#: A digest with more than one row in HOT_SHARE is hot; so at most HOT_SHARE digests are.
HOT_SHARE = 1000
BUCKETS = 64


def digest_of(text: Column | None = None) -> Column:
    """SHA-256 of the unchanged text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(text_or_empty() if text is None else text, 256))


@dataclass
class DigestIndex:
    """Digests seen so far, in a folder of any store that the cluster shares, for one writer at a time.

    The folder holds layout (the number of buckets, fixed when the index is made), digests, commits, verdicts, and places:
    which folder has the digests since when compact() wrote them anew.
    """

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        layout = f"{self.path}/layout"
        if not exists(self.spark, f"{layout}/_SUCCESS"):
            self.spark.createDataFrame([], "batch string, attempt string").write.mode("overwrite").parquet(f"{self.path}/commits")
            self.spark.createDataFrame([(self.buckets,)], "buckets int").write.mode("overwrite").parquet(layout)
        self.buckets = self.spark.read.parquet(layout).first()["buckets"]

    def _place(self) -> tuple[int, str]:
        """How often the digests were compacted, and the folder that has them."""
        if not exists(self.spark, f"{self.path}/places"):
            return 0, "digests"
        last = self.spark.read.schema("n int, folder string").parquet(f"{self.path}/places").orderBy(F.col("n").desc()).first()
        return (last["n"], last["folder"]) if last else (0, "digests")

    @property
    def table(self) -> str:
        """The name under which the session's catalogue knows the digests; each folder has its own."""
        return self._name(self._place()[1])

    def _name(self, folder: str) -> str:
        return "digest_index_" + hashlib.sha256((self.path + folder.removeprefix("digests")).encode()).hexdigest()[:32]

    def _open(self) -> str:
        """Makes the digests known to the session; their table's name."""
        folder = self._place()[1]
        name = self._name(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, n_docs BIGINT, attempt STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.buckets)} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return name

    def commits(self) -> DataFrame:
        return self.spark.read.schema("batch string, attempt string").parquet(f"{self.path}/commits")

    def _committed(self) -> DataFrame:
        name = self._open()
        # One row for each batch: far fewer than there are files.
        return self.spark.table(name).join(F.broadcast(self.commits().select("attempt")), "attempt", "left_semi")

    def read(self) -> DataFrame:
        """digest, keep_id, n_docs of all committed batches."""
        return self._committed().drop("attempt")

    def _write(self, fresh: DataFrame, folder: str) -> None:
        # By the bucket's own number: however many parts a shuffle has, a bucket gets one file and a task writes one bucket.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (
            fresh.select("digest", "keep_id", "n_docs", "attempt").repartitionById(self.buckets, bucket)
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/{folder}").saveAsTable(self._name(folder))
        )

    def _append(self, fresh: DataFrame, attempt: str) -> None:
        self._open()
        self._write(fresh.withColumn("attempt", F.lit(attempt)), self._place()[1])

    def compact(self) -> None:
        """Writes the committed digests anew, one sorted file a bucket, and drops what attempts without a commit have left.

        The new folder counts from the moment its name is among the places; the one before it stays until the next time, for those
        who read it now, and older ones go. By the index's one writer.
        """
        n, old = self._place()
        folder = f"digests-{uuid.uuid4().hex}"
        # A new column: else Spark takes the table for dealt to buckets already, leaves out the shuffle, and then reads it file by file.
        self._write(self._committed().withColumn("digest", F.unhex(F.hex("digest"))), folder)
        self.spark.createDataFrame([(n + 1, folder)], "n int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/places")
        kept = {folder, old, *(f"{r['batch']}-{r['attempt']}" for r in self.commits().collect())}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("digests")]
        verdicts = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/verdicts")
        found += [s.getPath() for s in fs.listStatus(verdicts)] if fs.exists(verdicts) else []
        for path in found:
            if path.getName() not in kept:
                fs.delete(path, True)

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Dedups docs (doc_id long, text) against themselves and the index, and appends what is new.

        Returns a row for each row of docs: doc_id, keep_id (the indexed document, else the largest doc_id among
        the equal texts), group_size (rows of docs with the text, and those counted when it was indexed), kept,
        digest. kept holds for one row of a text that the index did not have. batch names what is ingested, so that
        it may be tried again after any failure: a name that was committed changes nothing and gives the verdicts of
        then. Null texts count as empty; a null doc_id is below all others; of repeated rows with one doc_id, one is
        kept. Whole texts are hashed, however long. Other columns are ignored. An empty table gives no rows.
        """
        name = hashlib.sha256(batch.encode()).hexdigest() if batch is not None else uuid.uuid4().hex
        done = self.commits().filter(F.col("batch") == name).first()
        if done:
            return self.spark.read.parquet(f"{self.path}/verdicts/{name}-{done['attempt']}")
        rows = materialize(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest")).withColumn(
                "row", F.monotonically_increasing_id()
            ),
            "digests",
        )
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
        index = self.read().withColumnsRenamed({"digest": "i_digest", "keep_id": "i_keep", "n_docs": "i_n"}).hint("merge")
        groups = groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("n_docs"))
        fresh = groups.join(index, F.col("digest") == F.col("i_digest"), "left_anti")
        fresh = materialize(fresh, "fresh_digests")
        known = groups.join(index, F.col("digest") == F.col("i_digest")).select(
            "digest", F.col("i_keep").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), (F.col("n_docs") + F.col("i_n")).alias("n_docs")
        )
        decided = materialize(fresh.unionByName(known), "decided_digests")
        verdicts = spread(rows, decided).select(
            "doc_id", "keep_id", F.col("n_docs").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest"
        )
        attempt = uuid.uuid4().hex
        path = f"{self.path}/verdicts/{name}-{attempt}"
        verdicts.write.parquet(path)
        self._append(fresh, attempt)
        self.spark.createDataFrame([(name, attempt)], "batch string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        release(rows, fresh, decided)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        """Deletes the index and its verdicts; nothing may read them later."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)


def spread(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows with what is decided on their digest. The at most HOT_SHARE hot digests are broadcast; the others are
    joined by a shuffle in which no digest has more than one row in HOT_SHARE."""
    at_least = max(2, rows.count() // HOT_SHARE + 1)
    hot = decided.filter(F.col("n_docs") >= at_least)
    rest = decided.filter(F.col("n_docs") < at_least)
    few = F.broadcast(hot.limit(HOT_SHARE)) if not _indexed_hot(hot) else hot
    return rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(rest, "digest"))


def _indexed_hot(hot: DataFrame) -> bool:
    """Whether counts from an older index make more digests look hot than the bound allows to broadcast."""
    return hot.limit(HOT_SHARE + 1).count() > HOT_SHARE


def in_batches(docs: DataFrame, index: DigestIndex, cuts: list[int], name: str) -> DataFrame:
    """Ingests docs (doc_id long, text) in batches of falling doc_id, cut at these ids, null ids last, so that of all equal
    texts the largest doc_id stays; ingest()'s columns, group_size counted over all batches.

    name stands for this table among all that the index takes: the batches are named by it, so one that was ingested under the
    name is not judged again."""
    key, parts, above = F.col("doc_id").cast("long"), [], F.lit(True)
    for cut in sorted(set(cuts), reverse=True):
        parts.append(docs.filter(above & (key > cut)))
        above = key <= cut
    parts.append(docs.filter(above | key.isNull()))
    verdicts = [index.ingest(part.select("doc_id", "text"), f"{name}/{n} of {len(parts)}") for n, part in enumerate(parts)]
    rows = verdicts[0]
    for more in verdicts[1:]:
        rows = rows.unionByName(more)
    sizes = materialize(rows.groupBy("digest").agg(F.count("*").alias("n_docs")), "digest_sizes")
    return spread(rows.drop("group_size"), sizes).withColumnRenamed("n_docs", "group_size")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns whatever their names; without an index, docs are only compared
    with each other.

    Of rows that repeat a doc_id and a text, one stays.
    """
    spark, own = docs.sparkSession, index is None
    if own:  # as many buckets as a shuffle has parts, so that each task writes one
        index = DigestIndex(spark, new_path(spark, "digest_index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    verdicts = index.ingest(docs, batch).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    verdicts = materialize(verdicts.filter("not kept or n > 1").select(F.col("digest").alias("v_digest"), F.col("doc_id").alias("v_id"), "kept"), "dropped_keys")
    if own:
        index.drop()
    rows = nested(docs, digest=digest_of(), id=F.col("doc_id").cast("long"))
    same = (F.col("digest") == F.col("v_digest")) & F.col("id").eqNullSafe(F.col("v_id"))
    stays = rows.join(verdicts, same, "left_anti").select("row")
    again = verdicts.filter("kept")
    if again.isEmpty():
        return flat(stays)
    # The first in the order of their hashes; a map can be hashed in no other way than as text.
    hashed = F.xxhash64(F.to_json("row"))
    repeated = rows.join(again, same).groupBy("v_digest", "v_id").agg(F.min_by("row", hashed).alias("row"))
    return flat(stays.unionByName(repeated.select("row")))
