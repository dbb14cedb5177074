"""The state of all jobs as a written table that grows by batches.

``append`` writes what a batch of ledger events adds: one row for each job in it, a
partial state (first terminal event, latest event, number of events). Partial states
merge in any order, so a batch reads nothing that was written before it and the same
batch number written again replaces itself. ``compact`` merges the last snapshot and
the changes since into a new one, a row a job, laid out by a hash of the job id.

Questions read the last snapshot and the few changes after it, never the history of
events; ``get_jobs`` takes only the asked jobs out of both before it merges. A folder
counts once Spark has marked it as done, so a reader never sees half a write. The
snapshot before the last one and the changes after it are kept: a batch that is
repeated after a failure finds all it needs.

Defined results: without any batch the state is empty; a job with a null id is one
group, as in ``job_state``; an event appended under two batch numbers counts twice in
``n_events`` and changes nothing else (``stream_job_state`` drops repeats before).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L

BUCKETS = 64
COMPACT_EVERY = 20

_SCHEMA = ("job_id string, f struct<seq:bigint,status:string,error:string>, "
           "l struct<seq:bigint,status:string>, n bigint")


def _bucket(job_id: str = "job_id"):
    return F.pmod(F.xxhash64(job_id), F.lit(BUCKETS)).cast("int")


def _changes(root: str) -> str:
    return f"{root.rstrip('/')}/batch_id="


def _snapshots(root: str) -> str:
    return f"{root.rstrip('/')}-snapshot/upto="


def _done(spark: SparkSession, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><n>`` that were written to their end, ascending."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append(events: DataFrame, root: str, batch_id: int, compact_every: int = COMPACT_EVERY) -> None:
    """Add a batch of ledger events; every ``compact_every`` batches all is merged into a snapshot."""
    L.partial_state(events).write.mode("overwrite").parquet(f"{_changes(root)}{batch_id}")
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact(events.sparkSession, root, batch_id)


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """The state after batch ``upto`` as a snapshot; what only older snapshots need is removed."""
    earlier = [n for n in _done(spark, _snapshots(root)) if n < upto]
    state = _partials(spark, root, upto, earlier[-1] if earlier else None)
    (L.merged_state(state).withColumn("bucket", _bucket()).repartition("bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{_snapshots(root)}{upto}"))
    if earlier:
        for n in earlier[:-1]:
            _remove(spark, f"{_snapshots(root)}{n}")
        for n in _done(spark, _changes(root)):
            if n <= earlier[-1]:
                _remove(spark, f"{_changes(root)}{n}")


def _partials(spark: SparkSession, root: str, upto: int | None, snapshot: int | None) -> DataFrame:
    """(bucket, job_id, f, l, n): rows of a snapshot and of the changes after it, up to a batch."""
    after = [n for n in _done(spark, _changes(root))
             if (snapshot is None or n > snapshot) and (upto is None or n <= upto)]
    out = spark.createDataFrame([], _SCHEMA).withColumn("bucket", _bucket())
    if after:
        changed = spark.read.schema(_SCHEMA).parquet(*[f"{_changes(root)}{n}" for n in after])
        out = changed.withColumn("bucket", _bucket())
    if snapshot is not None:
        path = f"{_snapshots(root)}{snapshot}"
        out = out.unionByName(spark.read.schema(_SCHEMA + ", bucket int").option("basePath", path).parquet(path))
    return out


def read(spark: SparkSession, root: str) -> DataFrame:
    """H4: the state of every job, with the columns of ``job_state``."""
    return L.resolved_state(L.merged_state(_latest(spark, root)))


def _latest(spark: SparkSession, root: str) -> DataFrame:
    snapshots = _done(spark, _snapshots(root))
    return _partials(spark, root, None, snapshots[-1] if snapshots else None)


def get_jobs(spark: SparkSession, root: str, requests: DataFrame, id_col: str = "job_id") -> DataFrame:
    """H5 over the snapshot: only the asked jobs are merged, and Spark can skip the
    buckets that nobody asks for."""
    asked = requests.select(F.col(id_col).alias("job_id")).where("job_id <> ''").distinct().withColumn("bucket", _bucket())
    some = _latest(spark, root).join(asked, ["bucket", "job_id"], "left_semi")
    return L.get_jobs(L.resolved_state(L.merged_state(some)), requests, id_col)
