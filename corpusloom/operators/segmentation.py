"""Parents of documents of any length: the fold of chunking.parents() as a scan over buckets of segments.

Whether a segment begins a parent hangs on the segment before, and on one number, the size of the open parent. What a bucket
does to that number is a small map: the larger the size that comes in, the earlier the bucket's first break for size, and
from that break on all is settled. So buckets are summed up side by side, their maps are applied one after the other to find
the size that comes into each, and then each bucket places its own segments. No document's text is gathered in a row,
and a row is a bucket, so that a batch holds many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.schemas import Budgets
from corpusloom.session import materialize

#: Segments of a bucket.
BUCKET = 4096

_DOC = ["kb_id", "document_id", "file_name"]


def walk(size: np.ndarray, breaks: np.ndarray, free: np.ndarray, held: int, limit: int, at: int = 0) -> tuple[int, np.ndarray]:
    """(size of the open parent after the last segment, which segments from at on begin a parent). breaks: segments that begin one in any case;
    free: those that don't for their size; held: the size that comes in."""
    begins = np.zeros(len(size), bool)
    for k in range(at, len(size)):
        if breaks[k] or (held + size[k] > limit and not free[k]):
            begins[k], held = True, 0
        held += size[k]
    return int(held), begins


def bucket_map(size: np.ndarray, breaks: np.ndarray, free: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int], int]:
    """What a bucket makes of a size that comes in: (least, out, begun, total). The last k with least[k] <= size tells the size that goes out and how many
    parents begin; out is -1 where no segment begins one, and total is added then."""
    hard = np.flatnonzero(breaks)
    end = int(hard[0]) if len(hard) else len(size)
    upto = np.concatenate([[0], np.cumsum(size)])
    # A first break for size at k: the size that comes in, with all before, leaves no room for it, but it did for those before.
    pieces: dict[int, int] = {}
    lowest = None
    for k in np.flatnonzero(~free[:end]):
        needs = int(limit - upto[k + 1] + 1)
        if lowest is None or needs < lowest:
            pieces[max(needs, 0)] = int(k)
            lowest = needs
            if needs <= 0:
                break
    least, out, begun = [], [], []
    if lowest is None or lowest > 0:  # from 0 on: no break for size before the first in any case
        if end < len(size):
            left, begins = walk(size, breaks, free, 0, limit, end)
            least, out, begun = [0], [left], [int(begins.sum())]
        else:
            least, out, begun = [0], [-1], [0]
    for needs in sorted(pieces):
        left, begins = walk(size, breaks, free, limit + 1, limit, pieces[needs])
        least.append(needs)
        out.append(left)
        begun.append(int(begins.sum()))
    return least, out, begun, int(upto[-1])


def parents(segments: DataFrame, budgets: Budgets = Budgets(), bucket: int = BUCKET) -> DataFrame:
    """The rows and ids of chunking.parents(), whatever the number of a document's segments; seg_no tells their order."""
    order = Window.partitionBy("doc").orderBy("seg_no")
    was = lambda c: F.lag(c).over(order)
    # What the scan needs of a text is told before its shuffle. One key that is never null: whatever goes by it shares a shuffle.
    rows = segments.withColumns({"size": F.length("text"), "free": X.starts_clause(F.col("text")), "doc": F.to_json(F.struct(*_DOC))}).withColumn("nth", F.row_number().over(order) - 1)
    path = F.coalesce("section_path", F.lit(""))
    apart = (was(path) != "") & (was(path) != path)
    breaks = F.coalesce((F.col("nth") == 0) | F.col("is_table") | F.col("is_heading") | was("is_table") | apart, F.lit(False))
    keys = ["doc", "bucket"]
    steps = rows.select("doc", F.floor(F.col("nth") / bucket).cast("int").alias("bucket"), "nth", "size", breaks.alias("breaks"), "free")
    # A row for each bucket, so that many buckets of many documents go through Python at once.
    shape = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", "size", "breaks", "free"))).alias("s"))
    shape = materialize(shape.select(*keys, *[F.col(f"s.{c}").alias(c) for c in ("size", "breaks", "free")]), "shapes")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = [bucket_map(np.asarray(s, np.int64), np.asarray(b, bool), np.asarray(f, bool), budgets.parent) for s, b, f in zip(pdf["size"], pdf["breaks"], pdf["free"], strict=True)]
            yield pdf[keys].assign(**{c: [m[k] for m in maps] for k, c in enumerate(("least", "out", "begun", "total"))})

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for doc, maps in pdf[["doc", "maps"]].itertuples(index=False):
                held, parent = 0, 0
                for m in maps:
                    found.append((doc, m["bucket"], held, parent))
                    k = int(np.searchsorted(m["least"], held, side="right")) - 1
                    held, parent = (held + m["total"] if m["out"][k] < 0 else int(m["out"][k])), parent + int(m["begun"][k])
            yield pd.DataFrame(found, columns=[*keys, "held", "parent"])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            numbers = []
            for s, b, f, held, parent in pdf[["size", "breaks", "free", "held", "parent"]].itertuples(index=False):
                _, begins = walk(np.asarray(s, np.int64), np.asarray(b, bool), np.asarray(f, bool), int(held), budgets.parent)
                numbers.append(int(parent) + np.cumsum(begins) - 1)
            yield pdf[keys].assign(parents=numbers)

    maps = shape.mapInPandas(summed, "doc string, bucket int, least array<long>, out array<long>, begun array<long>, total long")
    maps = maps.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("bucket", "least", "out", "begun", "total"))).alias("maps"))
    entries = maps.mapInPandas(entered, "doc string, bucket int, held long, parent long")
    at = shape.join(entries, keys).mapInPandas(placed, "doc string, bucket int, parents array<int>")
    # Four bytes a segment; the texts stay where the window has them, and so does all that follows.
    numbers = at.groupBy("doc").agg(F.flatten(F.sort_array(F.collect_list(F.struct("bucket", "parents")))["parents"]).alias("numbers"))
    whole = rows.select("doc", *_DOC, "nth", "text", path.alias("path"), "page").join(numbers, "doc").withColumn("parent", F.col("numbers")[F.col("nth")]).drop("numbers")
    grouped = whole.groupBy("doc", "parent").agg(
        *[F.first(c).alias(c) for c in _DOC], F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("texts"), F.max_by("path", "nth").alias("section_path"),
        F.min_by("page", F.when(F.col("page").isNotNull(), F.col("nth"))).alias("page"),
    )
    grouped = grouped.withColumn("content", F.array_join(F.col("texts.text"), "\n\n")).filter(X.strip(F.col("content")) != "")
    numbered = grouped.withColumn("parent_index", (F.row_number().over(Window.partitionBy("doc").orderBy("parent")) - 1).cast("int"))
    out = numbered.select(*_DOC, "parent_index", "content", F.coalesce(F.nullif("section_path", F.lit("")), F.col("file_name")).alias("section_path"), F.col("page").cast("int").alias("page"))
    return out.withColumn("parent_id", X.sha256_of(F.lit("parent"), F.col("kb_id"), F.col("document_id"), F.col("parent_index"), F.col("content")))
