"""Mixing sources to target weights along a time-varying curriculum, by DataFrame functions alone.

Each source's schedule of weights over training time is integrated; the inverse of the integral turns a
document's place in its source's stream of words into a training position, and documents are range-sorted by
position. Prefix sums run over small buckets, so one source may hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import flat, join_groups, materialize, n_words, nested, prefix_sum, release, text_or_empty

#: Sources by code point, null last, take these in turn.
WEIGHTS = (5, 2, 1)
#: For each of them (time, weight) knots; between knots the weight is linear.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.25), (0.5, 0.25), (1.0, 2.0)))
#: All sources' targets together, and the most of one source, as multiples of sizes.
SHARE, CAP = 1.5, 2.0
#: A document with at least this part of its source's words is placed before the others when a pass is filled.
LONG = 0.01
BUCKET_BITS = 10


def source_key(source: Column) -> Column:
    """Not null, and different for each source, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source, source_size) -> with class and target.

    Targets are cap * size for capped sources and level * weight for the others; sorted by cap * size / weight,
    the level at a source counts those before it as capped, and the first source below its cap fixes it. One
    row per source goes through the windows without a partition, not one per document.
    """
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    klass = F.pmod(F.col("rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (klass + 1).cast("int"))
    most = F.col("source_size") * F.lit(cap)
    by_cap = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    t = ranked.withColumns({"class": klass, "weight": weight, "most": most}).withColumn("ratio", F.col("most") / F.col("weight"))
    t = t.withColumns({
        "capped_before": F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        "wanted": F.sum("source_size").over(everything) * F.lit(share),
    })
    t = t.withColumn("level", (F.col("wanted") - F.col("capped_before")) / F.col("weight_left"))
    first_free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    t = t.withColumn("free", first_free["level"])
    target = F.coalesce(F.least(F.col("most"), F.col("free") * F.col("weight")), F.col("most"))
    return t.select("key", "source_size", F.col("class").cast("int").alias("class"), target.alias("target"))


def shuffled(doc_id: Column, salt: str) -> Column:
    """A number from 0 to 2**60 - 1 that follows from the document's id alone."""
    text = F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def training_time(share: Column, knots: tuple) -> Column:
    """The time at which the integral of the schedule has reached this share of its whole."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    at, y = F.lit(1.0), share * F.lit(area[-1])
    for (t0, w0), (t1, w1), a0, a1 in reversed(list(zip(knots, knots[1:], area, area[1:], strict=False))):
        slope, over = (w1 - w0) / (t1 - t0), y - F.lit(a0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * over, F.lit(0.0)))
        step = F.when(over > 0, F.lit(2.0) * over / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        at = F.when(y <= F.lit(a1), F.lit(t0) + step).otherwise(at)
    return at


def plan(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of docs (doc_id, text, source).

    Returns units, a row per (doc_id, source): doc_id, key, size, source_size, target, class, copies; and
    entries, a row per copy: doc_id, key, copy, position from 0 to 1. Null texts have no words, null sources are
    a source, and rows that repeat a doc_id and source are taken together. A source's last pass takes its long
    documents first, then others in shuffled order, as long as more than half of a document fits; those of which
    less than half fits from the start don't stand in line. So what it takes comes within half of one document of
    the target. An empty table gives no rows.
    """
    if not 0 <= share <= cap or cap > 2:
        raise ValueError("0 <= share <= cap <= 2 is needed")
    sized = docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), n_words(text_or_empty()).alias("size"))
    units = given = materialize(sized.groupBy("doc_id", "key").agg(F.sum("size").alias("size"), F.first("source").alias("source")), "units")
    per_source = units.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    units = join_groups(units.drop("source"), targets(per_source, weights, share, cap), "key")

    whole = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    long_one = F.col("size") >= F.greatest(F.lit(1.0), F.col("source_size") * F.lit(LONG))
    units = units.withColumns({"whole": whole, "h": shuffled(F.col("doc_id"), "take"), "first": F.when(long_one, -F.col("size")).otherwise(F.lit(0).cast("long"))})
    bucket = F.when(F.col("first") < 0, F.lit(-1)).otherwise(F.shiftright("h", 60 - BUCKET_BITS))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    units = units.withColumn("offered", F.when((left > 0) & (F.col("size") / F.lit(2.0) > left), F.lit(0).cast("long")).otherwise(F.col("size")))
    units = prefix_sum(units, "key", bucket, [F.col("first"), F.col("h"), F.col("doc_id")], {"offered": "before"})
    fits = F.col("before") + F.col("size") / F.lit(2.0) <= left
    units = units.withColumn("copies", F.col("whole") + F.when(fits, 1).otherwise(0)).drop("h", "first", "offered", "before", "whole")
    units = materialize(units, "mixed_units")
    release(given)

    taken = units.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_taken"))
    entries = units.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    entries = join_groups(entries.select("doc_id", "key", "size", "class", "copy"), taken, "key").withColumn("h", shuffled(F.col("doc_id"), "place"))
    bucket = F.shiftleft("copy", BUCKET_BITS) + F.shiftright("h", 60 - BUCKET_BITS)
    entries = prefix_sum(entries, "key", bucket, [F.col("copy"), F.col("h"), F.col("doc_id")], {"size": "before"})
    reached = F.when(F.col("source_taken") > 0, (F.col("before") + F.col("size") / F.lit(2.0)) / F.col("source_taken")).otherwise(F.lit(0.0))
    position = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        position = F.when(F.col("class") == k, training_time(reached, knots)).otherwise(position)
    return units, entries.select("doc_id", "key", "copy", position.alias("position"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs in training order, repeated as planned, with all their columns whatever their names; see plan().
    Written out, the order is that of the files' names and of the rows in each."""
    entries = plan(docs, **settings)[1].select(F.col("doc_id").alias("e_id"), F.col("key").alias("e_key"), "position", "copy")
    rows = nested(docs, id=F.col("doc_id"), key=source_key(F.col("source")))
    same = (F.col("key") == F.col("e_key")) & F.col("id").eqNullSafe(F.col("e_id"))
    return flat(rows.join(entries, same).orderBy("position", "e_key", "e_id", "copy"))
