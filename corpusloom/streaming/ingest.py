"""Incremental ingestion of arriving files, and windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import chunking
from corpusloom.operators.records import TEXT_CHARS
from corpusloom.schemas import Budgets
from corpusloom.session import materialize
from corpusloom.sources.buckets import BucketStore

# The stages of an ingestion and their progress.
STAGES = {"embedding": 20, "parsing": 30, "chunking": 45, "chunked": 65, "storing": 80, "indexed": 100}
STAGE_SCHEMA = "batch_id long, stage string, progress int, message string, at timestamp"


#: The tables of a store of chunks.
CHUNK_TABLES = ("parents", "children")


def ingest(spark: SparkSession, source: str, schema, store: BucketStore, checkpoint: str, stages: str, budgets: Budgets = Budgets(), name: str = "ingest") -> StreamingQuery:
    """Chunks document files (kb_id, document_id, file_name, text as Parquet) as they arrive and puts them into a store of
    CHUNK_TABLES by document_id; a document that comes again replaces its chunks. A batch rewrites the buckets of its
    documents, and its parents and children are seen from one commit on. name marks the commits: a batch that is repeated
    after a failure is not put in again.

    stages is a log: a row as each batch enters a stage, and one for its failure.
    """

    def enter(batch_id: int, stage: str, progress: int, message: str | None = None) -> None:
        row = spark.createDataFrame([(batch_id, stage, progress, message)], "batch_id long, stage string, progress int, message string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(stages)

    def put(batch: DataFrame, batch_id: int) -> None:
        reached = "embedding"
        try:
            for reached in ("embedding", "parsing"):
                enter(batch_id, reached, STAGES[reached])
            segments = materialize(chunking.line_segments(batch), "segments")
            reached = "chunking"
            enter(batch_id, reached, STAGES[reached])
            rows = materialize(chunking.parents(segments, budgets), "parents")
            reached = "chunked"
            enter(batch_id, reached, STAGES[reached])
            kids = chunking.children(rows, budgets)
            reached = "storing"
            enter(batch_id, reached, STAGES[reached])
            new = dict(zip(CHUNK_TABLES, (rows.dropDuplicates(["parent_id"]), kids.dropDuplicates(["chunk_id"])), strict=True))
            store.replace(new, gone=batch.select("document_id"), mark=(name, batch_id))
            enter(batch_id, "indexed", STAGES["indexed"])
        except Exception as e:
            enter(batch_id, "failed", STAGES[reached], str(e)[:TEXT_CHARS])
            raise

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(stages: DataFrame) -> DataFrame:
    """(batch_id, stage, progress, message): the last stage that each batch of the log has entered."""
    last = F.max_by(F.struct("stage", "progress", "message"), F.struct("at", "progress")).alias("s")
    return stages.groupBy("batch_id").agg(last).select("batch_id", "s.*")


#: Errors of a document that are tried again; how long a document may stay without an event.
RETRIES, PATIENCE = 2, "30 minutes"
STATE_SCHEMA = "document_id long, state string, progress int, errors int, at timestamp, message string"


def _progress(stage: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[stage], F.lit(0))


def document_states(events: DataFrame, retries: int = RETRIES, patience: str = PATIENCE, now: Column | None = None) -> DataFrame:
    """(document_id, stage, at, message, order) -> STATE_SCHEMA, a row for each document, as of now, by default the last event's time.

    stage is submitted, one of STAGES, or error. What counts is what came since the document was last submitted: it is indexed
    when it has reached that; failed after more than retries errors, or when its last event is longer ago than patience;
    retrying after an error; else in its last stage. Events of the same time follow order. Aggregates alone, so a document with very many
    events is added up by tasks first.
    """
    place = F.struct("at", "order")
    since = events.groupBy("document_id").agg(F.coalesce(F.max(F.when(F.col("stage") == "submitted", place)), F.min(place)).alias("since"))
    rows = events.join(since.withColumnRenamed("document_id", "_id"), F.col("document_id").eqNullSafe(F.col("_id"))).filter(place >= F.col("since"))
    error = F.col("stage") == "error"
    last = rows.groupBy("document_id").agg(
        F.max_by(F.struct("stage", "at"), place).alias("last"), F.count_if(error).cast("int").alias("errors"), F.count_if(F.col("stage") == "indexed").alias("indexed"),
        F.max_by("stage", F.when(~error, place)).alias("reached"), F.max_by("message", F.when(error, place)).alias("said"),
    )
    if now is None:
        last = last.crossJoin(F.broadcast(events.agg(F.max("at").alias("now"))))  # one row
    else:
        last = last.withColumn("now", now)
    stuck = F.col("last.at") < F.col("now") - F.expr(f"INTERVAL {patience}")
    state = F.when(F.col("indexed") > 0, "indexed").when((F.col("errors") > retries) | stuck, "failed").when(F.col("last.stage") == "error", "retrying").otherwise(F.col("last.stage"))
    rows = last.withColumn("state", state)
    message = F.when(F.col("state").isin("failed", "retrying"), F.when((F.col("errors") > retries) | (F.col("state") == "retrying"), F.col("said")).otherwise(F.concat(F.lit("stuck in "), "last.stage")))
    progress = F.when(F.col("state") == "indexed", STAGES["indexed"]).when(F.col("state") == "retrying", 0).otherwise(_progress(F.col("reached")))
    return rows.select("document_id", "state", progress.cast("int").alias("progress"), "errors", F.col("last.at").alias("at"), message.alias("message"))


def follow(events: DataFrame, retries: int = RETRIES, patience: str = PATIENCE, late: str = "5 minutes") -> DataFrame:
    """A stream of (document_id, stage, at, message, order) -> STATE_SCHEMA: a row whenever a document's state changes, also when it has been
    without an event for longer than patience, which a timer on event time tells. For events in order the last rows are those
    of document_states(). A document without an id is followed like others."""
    wait = pd.Timedelta(patience) // pd.Timedelta(microseconds=1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        names = ["since", "last", "stage", "reached", "errors", "indexed", "said", "told"]
        s = dict(zip(names, held.get, strict=True)) if held.exists else dict.fromkeys(names)
        if held.hasTimedOut:
            if not s["indexed"] and s["errors"] <= retries:
                yield _row(key, "failed", STAGES.get(s["reached"], 0), s, f"stuck in {s['stage']}")
                held.update(tuple({**s, "told": "failed"}[n] for n in names))
            return
        events = pd.concat(list(batches)).sort_values(["micros", "order"], kind="stable")
        for stage, now, message in zip(events["stage"], events["micros"], events["message"], strict=True):
            if s["since"] is None or (stage == "submitted" and now >= s["since"]):
                s.update(since=now, last=now, errors=0, indexed=False, said=None, reached="", stage="")
            if now < s["since"]:
                continue
            if now >= s["last"]:
                s.update(last=now, stage=stage)
            s["indexed"] = s["indexed"] or stage == "indexed"
            if stage == "error":
                s.update(errors=s["errors"] + 1, said=message)
            else:
                s["reached"] = stage
        if s["indexed"]:
            state, progress, message = "indexed", STAGES["indexed"], None
        elif s["errors"] > retries:
            state, progress, message = "failed", STAGES.get(s["reached"], 0), s["said"]
        elif s["stage"] == "error":
            state, progress, message = "retrying", 0, s["said"]
        else:
            state, progress, message = s["stage"], STAGES.get(s["reached"], 0), None
        told = f"{state}/{progress}/{s['errors']}/{s['last']}"
        if told != s["told"]:
            yield _row(key, state, progress, s, message)
        s["told"] = told
        held.update(tuple(s[n] for n in names))
        if state not in ("indexed", "failed"):
            held.setTimeoutTimestamp(max(-(-(s["last"] + wait) // 1000), held.getCurrentWatermarkMs() + 1))

    def _row(key: tuple, state: str, progress: int, s: dict, message: str | None) -> pd.DataFrame:
        return pd.DataFrame({"document_id": [key[0]], "state": [state], "progress": [progress], "errors": [s["errors"]], "at": [pd.Timestamp(s["last"], unit="us", tz="UTC")], "message": [message]})

    rows = events.withWatermark("at", late).select("document_id", "stage", "at", F.unix_micros("at").alias("micros"), "message", "order")
    kept = "since long, last long, stage string, reached string, errors int, indexed boolean, said string, told string"
    return rows.groupBy("document_id").applyInPandasWithState(step, STATE_SCHEMA, kept, "update", GroupStateTimeout.EventTimeTimeout)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """A stream with its watermark, which needs instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late and events.isStreaming else events


def latency_windows(events: DataFrame, size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(ts, event_type, value) -> count, mean and largest value of each window and type; late: the watermark of a stream."""
    out = _timed(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value", "max_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(ts, user_id) -> each user's sessions: events with no gap of that length between them."""
    out = _timed(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")
