import os
import tempfile

from pyspark.sql import functions as F

from sheaf.operators import ledger as L
from sheaf.plans import queries as Q
from sheaf.plans import workflow as W
from sheaf.sources.jobs import explode_jobs, parse_jobs
from sheaf.sources.tables import document_jobs_json
from sheaf.streaming import jobs as ST

from conftest import SF001


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    ra = sorted((tuple(r) for r in a.select(*cols).collect()), key=repr)
    rb = sorted((tuple(r) for r in b.select(*cols).collect()), key=repr)
    assert ra == rb


def test_stream_state_equals_batch_and_drops_replays(spark):
    events = Q.T(spark, SF001, "events")
    batch = L.job_state(L.events_as_ledger(events))
    # a landing folder holding the events twice (a replayed delivery)
    land = tempfile.mkdtemp(prefix="land-", dir=spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
    events.write.mode("append").parquet(os.path.join(land, "events.parquet"))
    events.write.mode("append").parquet(os.path.join(land, "events.parquet"))
    schema = events.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(land, "events.parquet"))
    q, out = ST.stream_job_state(L.events_as_ledger(stream))
    q.awaitTermination()
    _same(ST.read_job_state(spark, out), batch)


def test_stream_jobs_equals_batch(spark):
    """Two deliveries, one batch each, with a refused job: results and outcomes equal one batch run."""
    files, sigs = Q.doc_files(spark, SF001), Q.bench_signatures(spark, SF001)
    land = tempfile.mkdtemp(prefix="submitted-", dir=spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
    js = document_jobs_json(Q.T(spark, SF001, "documents"))
    second = F.crc32(F.col("job_json").cast("binary")) > (1 << 31)
    js.filter(~second).coalesce(1).write.mode("append").text(land)
    refused = spark.createDataFrame([('{"job_id": "idle"}',)], "job_json string")
    js.filter(second).unionByName(refused).coalesce(1).write.mode("append").text(land)
    q, out = ST.stream_jobs(ST.submissions(spark, land, 1), files, sigs, page_chars=Q.PAGE_CHARS)
    q.awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch_id").distinct().count() == 2
    run = W.run_jobs(explode_jobs(parse_jobs(js.unionByName(refused))), files, sigs, page_chars=Q.PAGE_CHARS)
    _same(streamed.drop("batch_id"), ST.flat_results(run.results))
    _same(spark.read.parquet(f"{out}-outcomes").drop("batch_id"), run.outcomes)


def test_submissions_delivered_twice_run_once(spark):
    """A landing folder that holds every job twice, in other batches and in the same one, gives the rows of once."""
    files, sigs = Q.doc_files(spark, SF001), Q.bench_signatures(spark, SF001)
    land = tempfile.mkdtemp(prefix="again-", dir=spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
    js = document_jobs_json(Q.T(spark, SF001, "documents").limit(40))
    js = spark.createDataFrame(js.collect(), "job_json string")
    for rows in (js, js, js.unionByName(js)):
        rows.coalesce(1).write.mode("append").text(land)
    q, out = ST.stream_jobs(ST.submissions(spark, land, 1), files, sigs, page_chars=Q.PAGE_CHARS)
    q.awaitTermination()
    run = W.run_jobs(explode_jobs(parse_jobs(js)), files, sigs, page_chars=Q.PAGE_CHARS)
    _same(spark.read.parquet(out).drop("batch_id"), ST.flat_results(run.results))
    _same(spark.read.parquet(f"{out}-outcomes").drop("batch_id"), run.outcomes)


def test_stream_state_across_batches_takes_latest(spark):
    """Two batches, the second moving jobs on: the state read back is the
    latest per job and equals the batch answer over all events."""
    events = Q.T(spark, SF001, "events")
    land = tempfile.mkdtemp(prefix="land2-", dir=spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
    path = os.path.join(land, "events.parquet")
    cut = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    events.filter(F.col("event_id") <= cut).write.mode("append").parquet(path)
    events.filter(F.col("event_id") > cut).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q, out = ST.stream_job_state(L.events_as_ledger(stream))
    q.awaitTermination()
    written = spark.read.parquet(out)
    assert written.select("batch_id").distinct().count() >= 2  # more than one batch wrote changes
    _same(ST.read_job_state(spark, out), L.job_state(L.events_as_ledger(events)))
