"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, encoding. Each stage is written and read again.

Every stage reads whole texts, however long, and gives no rows for an empty table. Columns beside doc_id, text and source
may be there under any name; all stages but the last keep them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import curriculum, dart_minhash, digest_index, piece_sampling, quality
from corpusloom.llm.common import flat, forget_shuffles, join_groups, materialize, nested, release

#: A document stays when its quality score is at least this.
LEAST_QUALITY = 0.3
#: Distinct segmentations of each row that the last stage emits.
SAMPLES = piece_sampling.K


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the subword-embedding classifier rejects.

    Rows are judged one by one by their texts, so rows that repeat a text stay or go together. A null text counts as
    empty; an empty one has no words and scores as the classifier's bias says. A null doc_id is judged like any other;
    rows of labels without an id or a label teach nothing.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = quality.scored(nested(docs), model, text=F.col("row.text"))
    return flat(scored.filter(F.col("score") >= LEAST_QUALITY))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the largest doc_id.

    Null and empty texts are equal. A null doc_id is below all others; of rows that repeat a doc_id and text, one stays.
    """
    return digest_index.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, keeps the one with the smallest doc_id.

    Null and empty texts are a class, and so are equal texts without a word. A null doc_id is above all others; of
    rows that tie, one stays.
    """
    return dart_minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to reach each source's target, in the curriculum's order.

    A null source is a source; null and empty texts have no words, and stand in the order without taking any. Rows
    that repeat a doc_id and source come and go together; ties of position follow source and doc_id.
    """
    return curriculum.mix(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, position): rows of files numbered from 0 on as they were written, by the files' names and their places
    in them; rows of other tables as they come."""
    try:
        at = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", at["file_name"].alias("file"), at["row_index"].alias("place"))
    except AnalysisException:  # not a table of files
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("position"))
    # One row a file goes through the window.
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = join_groups(rows, files.select("file", before.alias("before")), "file")
    return rows.select("doc_id", "text", (F.col("before") + F.col("place")).alias("position"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position and samples, an array of distinct segmentations, of each row, sorted by position.

    position numbers the rows of docs in their order. Rows that repeat a doc_id and text, null ids and texts included,
    take further segmentations of it in turn; a text that has no more begins anew. A null or empty text has one without ids.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("position")
    rows = in_order(docs).withColumn("turn", F.row_number().over(same) - 1).orderBy("position")
    return piece_sampling.encode(rows, piece_sampling.load(spark), k=SAMPLES, repeat="turn", together=True, held=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: No SQL can train the classifier or sample segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder, read as the next one's docs, and then deleted."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, before, sf_dir), "stage")
        if n:
            release(before)
        before = docs
        forget_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
