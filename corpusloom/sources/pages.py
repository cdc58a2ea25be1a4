"""Tables that are read a page at a time: sorted once into files of which a page reads only its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = 64


class PagedTable:
    """Rows sorted by columns, in files of rising ranges, with a table of where each file's rows begin."""

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path, order

    def write(self, rows: DataFrame, files: int = FILES) -> PagedTable:
        """order has to say the place of each row; rows that tie in it have no place of their own. Nulls come first."""
        rows.repartitionByRange(files, *self.order).sortWithinPartitions(*self.order).write.parquet(f"{self.path}/rows")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows")
        file = there.metadataColumn("_metadata")["file_path"]
        zones = there.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.min(F.struct(*self.order)).alias("low"))
        # A row for each file goes through the window.
        before = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
        zones.select("file", "n", F.coalesce(before, F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{self.path}/zones")
        return self

    def count(self) -> int:
        return self.spark.read.parquet(f"{self.path}/zones").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, skip: int, size: int) -> DataFrame:
        """The rows from place skip on, size of them at most: only the files that hold one are read."""
        zones = self.spark.read.parquet(f"{self.path}/zones")
        mine = zones.filter((F.col("start") < skip + size) & (F.col("start") + F.col("n") > skip)).orderBy("start").collect()
        whole = self.spark.read.parquet(f"{self.path}/rows")
        if not mine:
            return whole.limit(0)
        rows = self.spark.read.schema(whole.schema).parquet(*[r["file"] for r in mine])
        return rows.orderBy(*self.order).offset(skip - mine[0]["start"]).limit(size)
