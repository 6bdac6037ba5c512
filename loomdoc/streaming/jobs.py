"""Translation jobs as an append-only event log, and streams over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdoc import config as C
from loomdoc.functions import pages as P
from loomdoc.model import BLOCK, JOB_EVENT
from loomdoc.operators.layout import PAGE


PAYLOAD = (("page_width", "double"), ("page_height", "double"), ("blocks", f"array<{BLOCK}>"))
_COLUMNS = ("job_id", "seq", "type", "page", "done", "total", "reason", "cached", "warn_count", "skipped_count", *[c for c, _ in PAYLOAD])


def page_events(outcomes: DataFrame) -> DataFrame:
    """Events of jobs from page outcomes (job_id, order, page, error, cached, warn_count, skipped_count, and where known the page's
    page_width, page_height and blocks, which its ``page_done`` carries): ``page_done`` and
    ``progress`` for a page that worked, ``page_error`` for one that did not, ``job_done`` at the end. ``seq`` is the place in the job's log.

    Failed pages do not advance ``done``; ``total`` counts all.
    """
    along = W.partitionBy("job_id").orderBy("order")
    whole = W.partitionBy("job_id")
    good = F.col("error").isNull()
    numbered = outcomes.withColumn("done", F.count_if(good).over(along).cast("int")).withColumn("total", F.count("*").over(whole).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda kind, **v: F.struct(
        F.lit(kind).alias("type"), *[v.get(c, none(k)).cast(k).alias(c) for c, k in (("page", "int"), ("done", "int"), ("total", "int"), ("reason", "string"), ("cached", "boolean"), ("warn_count", "int"), ("skipped_count", "int"), *PAYLOAD)]
    )
    both = F.array(event("page_done", page=F.col("page"), cached=F.col("cached"), **{c: F.col(c) for c, _ in PAYLOAD if c in outcomes.columns}), event("progress", done=F.col("done"), total=F.col("total")))
    failed = F.array(event("page_error", page=F.col("page"), reason=F.col("error")))
    pages = numbered.select("job_id", "order", F.posexplode(F.when(good, both).otherwise(failed)).alias("_k", "e"))
    sums = outcomes.groupBy("job_id").agg(F.sum(F.when(good, F.col("warn_count")).otherwise(0)).alias("w"), F.sum(F.when(good, F.col("skipped_count")).otherwise(0)).alias("s"))
    ends = sums.select("job_id", F.lit(None).cast("int").alias("order"), F.lit(0).alias("_k"), event("job_done", warn_count=F.col("w"), skipped_count=F.col("s")).alias("e"))
    place = W.partitionBy("job_id").orderBy(F.col("order").asc_nulls_last(), "_k")
    rows = pages.withColumn("order", F.col("order").cast("int")).unionByName(ends)
    return rows.select("job_id", (F.row_number().over(place) - 1).cast("long").alias("seq"), "e.*").select(*_COLUMNS)


def after(events: DataFrame, last_seen: Column | int) -> DataFrame:
    """Events beyond a client's cursor."""
    return events.filter(F.col("seq") > last_seen)


def sse_lines(events: DataFrame) -> DataFrame:
    """The log as server-sent events; fields that an event lacks are left out."""
    body = F.struct(*[c for c in events.columns if c not in ("job_id", "seq")])
    return events.select("job_id", "seq", P.sse(F.col("seq"), body).alias("line"))


def unknown_job(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """One error with id -1 for each job asked for that has no log."""
    gone = jobs.join(events.select("job_id").distinct(), "job_id", "left_anti")
    return gone.select("job_id", F.lit(-1).cast("long").alias("seq"), F.lit("page_error").alias("type"), F.lit("unknown job").alias("reason"))


def counters(events: DataFrame) -> DataFrame:
    """Pages done and failed, and whether the job ended; on a stream a stateful count for update mode."""
    kind = F.col("type")
    return events.groupBy("job_id").agg(
        F.count_if(kind == "page_done").alias("done"), F.count_if(kind == "page_error").alias("failed"), F.count_if(kind == "job_done").alias("ended"),
        F.coalesce(F.max("warn_count"), F.lit(0)).alias("warn_count"), F.coalesce(F.max("skipped_count"), F.lit(0)).alias("skipped_count"),
    )


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The log's Parquet files as they arrive. The checkpoint of the query that reads it is the cursor."""
    return spark.readStream.schema(JOB_EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Pass each batch of events to ``sink`` (batch and its number), once after a restart; ends when all that is there has been read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_table(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counters of all jobs in a memory table."""
    return counters(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cancelled(pages: DataFrame, stops: DataFrame) -> DataFrame:
    """Pages of jobs that have not been cancelled; the others' logs still end with ``job_done``."""
    return pages.join(stops.select("job_id").distinct(), "job_id", "left_anti")


def bounded(pages: DataFrame, width: int = C.CONCURRENCY) -> DataFrame:
    """At most ``width`` pages at a time in the next stage: a translator's limit, not the cluster's."""
    return pages.repartition(width, *[c for c in PAGE if c in pages.columns])
