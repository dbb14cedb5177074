"""Job submission and job state as Structured Streaming queries.

* ``stream_jobs``: a stream of submitted job documents (``submissions``: a
  landing folder of JSON lines); a submission is one run, however often it is
  delivered: repeats of a job id are dropped by keyed streaming state, which
  forgets an id ``REMEMBERED`` after its first arrival. Each micro-batch is
  checked and run (G1) over the files table and overwrites its own
  ``batch_id=<n>`` folder, so a replayed batch rewrites the same files
  (exactly-once effect). The checkpoint records which batches are done: a
  restart does not redo them.
* ``stream_job_state``: ledger events -> per-job state, deduplicated on
  (job_id, seq) for ``REMEMBERED`` after an event's first arrival; state is the
  first-terminal-wins aggregate of ``job_state``, kept as a written snapshot to
  which each batch appends (see snapshot.py), so that jobs are no streaming state.

Folders default to fresh sub-folders of ``spark.checkpoint.dir``, which on a
cluster must be a shared file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..plans import workflow as W
from ..schema import JOB_SCHEMA
from ..session import scratch_dir
from ..sources.jobs import explode_jobs
from . import snapshot

REMEMBERED = "30 days"


def stream_table(spark: SparkSession, table_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table (``<dir>/<name>.parquet``) read as a file stream."""
    schema = spark.read.parquet(f"{table_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(table_dir)


def flat_results(results: DataFrame) -> DataFrame:
    return results.select("job_id", F.col("op_index").cast("bigint"), "op_name", "op_type", "success", "error",
                          "clean", "detail", "size_bytes", F.col("page_count").cast("bigint"),
                          F.length("markdown").cast("bigint").alias("md_chars"),
                          F.sha2("markdown", 256).alias("md_sha256"))


def submissions(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Job documents (JSON lines) that land in a folder; a backlog is taken some files at a time."""
    return (spark.readStream.schema(JOB_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(folder))


def new_submissions(submitted: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The documents of a stream whose job id has not arrived before, the first of each id.

    The time of arrival is the batch's own, so that no document is ever late, whatever the age of its
    file; an id leaves the state ``remembered`` after it arrived.
    """
    arrived = submitted.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remembered)
    return arrived.dropDuplicatesWithinWatermark(["job_id"]).drop("__arrived")


def stream_jobs(submitted: DataFrame, files: DataFrame, signatures: DataFrame | None, out_dir: str | None = None,
                checkpoint: str | None = None, page_chars: int = 1800, available_now: bool = True,
                allowed_buckets=None, remembered: str = REMEMBERED):
    """Run submitted job documents, each id once, over the files table; returns (query, out_dir).

    Results are in ``out_dir``, outcomes (refused jobs too) in ``out_dir`` + "-outcomes".
    Of a batch only its checked jobs are read again, from where the run wrote them.
    """
    spark = submitted.sparkSession
    out_dir = (out_dir or scratch_dir(spark, "stream-jobs-out")).rstrip("/")
    checkpoint = checkpoint or scratch_dir(spark, "stream-jobs-ckpt")

    def run_batch(batch: DataFrame, batch_id: int):
        run = W.run_jobs(explode_jobs(batch), files, signatures, page_chars=page_chars,
                         allowed_buckets=allowed_buckets)
        flat_results(run.results).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        run.outcomes.write.mode("overwrite").parquet(f"{out_dir}-outcomes/batch_id={batch_id}")

    w = new_submissions(submitted, remembered).writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(), out_dir


def dedup_ledger(ledger: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Replays of an event (same job_id, seq) are dropped; events count however late they come.

    An event leaves the state ``remembered`` after it arrived (the batch's own time, so none is late).
    """
    arrived = ledger.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remembered)
    return arrived.dropDuplicatesWithinWatermark(["job_id", "seq"]).drop("__arrived")


def stream_job_state(ledger: DataFrame, out_dir: str | None = None, checkpoint: str | None = None,
                     available_now: bool = True, remembered: str = REMEMBERED,
                     compact_every: int = snapshot.COMPACT_EVERY):
    """Per-job state kept up to date; returns (query, out_dir).

    Jobs are not held in streaming state, which has only the events that arrived within
    ``remembered``: each micro-batch appends its partial states to the written snapshot
    (``batch_id=<n>`` folders, which a replay overwrites). Events of jobs that ended long ago
    meet their state there, when it is read.
    """
    spark = ledger.sparkSession
    out_dir = out_dir or scratch_dir(spark, "stream-state-out")
    checkpoint = checkpoint or scratch_dir(spark, "stream-state-ckpt")

    def write_changes(batch: DataFrame, batch_id: int):
        snapshot.append(batch, out_dir, batch_id, compact_every)

    w = (dedup_ledger(ledger, remembered).writeStream.foreachBatch(write_changes)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(), out_dir


def read_job_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current state: the last snapshot and the changes after it."""
    return snapshot.read(spark, out_dir)
