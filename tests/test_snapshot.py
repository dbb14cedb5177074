import os
import tempfile

from pyspark.sql import functions as F

from sheaf.operators import ledger as L
from sheaf.session import scratch_dir
from sheaf.streaming import jobs as ST
from sheaf.streaming import snapshot as SN

LEDGER = "job_id string, seq long, ts timestamp, step string, status string, error string"


def ledger(spark, rows):
    return spark.createDataFrame([(j, s, None, "step", st, "bad" if st == L.FAILED else None) for j, s, st in rows], LEDGER)


def same(a, b):
    key = lambda df: sorted((tuple(r) for r in df.select("job_id", "status", "error", "final_seq", "last_seq", "n_events").collect()), key=repr)
    assert key(a) == key(b)


def history(n_batches=11):
    """A job of every batch, late events of earlier ones, and one job with a third of all events."""
    statuses = [L.RUNNING, L.COMPLETED, L.RUNNING, L.FAILED]
    out, seq = [], 0
    for b in range(n_batches):
        batch = [(f"j{b}", L.PENDING), (f"j{b}", statuses[b % 4]), (f"j{b // 2}", L.FAILED), (f"j{b // 3}", L.RUNNING)]
        batch += [("busy", L.RUNNING)] * 2 + [(None, L.RUNNING)] * (b % 2)
        rows = []
        for job, status in batch:
            rows.append((job, seq, status))
            seq += 1
        out.append(rows)
    out[1], out[-2] = out[-2], out[1]  # events that come late
    return out


def test_snapshot_equals_batch_after_every_batch(spark):
    root, seen = scratch_dir(spark, "snap"), []
    for n, rows in enumerate(history()):
        seen += rows
        SN.append(ledger(spark, rows), root, n, compact_every=3)
        if n in (0, 3, 5, 10):
            same(SN.read(spark, root), L.job_state(ledger(spark, seen)))
    assert SN._done(spark, SN._snapshots(root)) == [5, 8]
    assert SN._done(spark, SN._changes(root)) == [6, 7, 8, 9, 10]  # what the last two snapshots need


def test_repeated_and_unfinished_batches(spark):
    root, batches = scratch_dir(spark, "snap"), history(6)
    for n, rows in enumerate(batches):
        SN.append(ledger(spark, rows), root, n, compact_every=2)
        SN.append(ledger(spark, rows), root, n, compact_every=2)  # the same batch once more, its snapshot too
    half = f"{SN._changes(root)}6".replace("file:", "")
    os.makedirs(half)  # a write that was not ended
    with open(f"{half}/part-0.parquet", "w") as f:
        f.write("half")
    same(SN.read(spark, root), L.job_state(ledger(spark, [r for b in batches for r in b])))


def test_empty_snapshot_and_batches(spark):
    root = scratch_dir(spark, "snap")
    assert SN.read(spark, root).count() == 0
    for n in range(3):
        SN.append(ledger(spark, []), root, n, compact_every=2)
    assert SN.read(spark, root).count() == 0
    requests = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "request_id long, job_id string")
    got = {r["request_id"]: r["error"] for r in SN.get_jobs(spark, root, requests).collect()}
    assert got == {1: L.NOT_FOUND, 2: L.JOB_ID_REQUIRED, 3: L.JOB_ID_REQUIRED}


def test_asked_jobs_are_taken_out_before_merging(spark):
    root, batches = scratch_dir(spark, "snap"), history()
    for n, rows in enumerate(batches):
        SN.append(ledger(spark, rows), root, n, compact_every=4)
    requests = spark.createDataFrame([(1, "j0"), (2, "busy"), (3, "nobody"), (4, "j9"), (5, "j0")], "request_id long, job_id string")
    got = SN.get_jobs(spark, root, requests)
    want = L.get_jobs(L.job_state(ledger(spark, [r for b in batches for r in b])), requests)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "dynamicpruning" in plan  # buckets nobody asks for are not read


def test_streaming_state_is_bounded_over_many_batches(spark):
    """Ten batches, replays in the next batch: the state read is the batch answer, and the events held
    by the stream are those of the last moments, not of the whole history."""
    land = tempfile.mkdtemp(prefix="events-", dir=spark.conf.get("spark.checkpoint.dir").replace("file:", ""))
    batches = [[(f"j{b}-{i}", b * 1000 + i, L.COMPLETED if i % 2 else L.RUNNING) for i in range(200)] for b in range(10)]
    out, checkpoint, held = scratch_dir(spark, "out"), scratch_dir(spark, "ckpt"), []
    for b, rows in enumerate(batches):
        again = batches[b - 1] if b and b % 2 == 0 else []
        ledger(spark, rows + rows[:20] + again[:5]).coalesce(1).write.mode("append").json(land)
        stream = spark.readStream.schema(LEDGER).json(land)
        q, _ = ST.stream_job_state(stream, out, checkpoint, remembered="4 seconds", compact_every=4)
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) < 2000 and held[-1] < 2000, held  # 2,000 events in all
    state = {r["job_id"]: r for r in ST.read_job_state(spark, out).collect()}
    assert len(state) == 2000
    assert all(r["status"] == (L.COMPLETED if int(j.split("-")[1]) % 2 else L.RUNNING) for j, r in state.items())
    assert sum(r["n_events"] for j, r in state.items() if j.startswith("j9-")) == 200  # repeats of one batch are dropped


def test_cancel_requests_with_one_id(spark):
    state = L.job_state(ledger(spark, [("a", 1, L.RUNNING), ("b", 2, L.COMPLETED), ("c", 3, L.PENDING)]))
    r = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (4, "c"), (4, None), (4, "x")], "request_id long, job_id string")
    got = sorted((x["job_id"] or "", x["outcome"]) for x in L.cancel_jobs(state, r).collect())
    assert got == [("", L.JOB_ID_REQUIRED), ("a", L.ALREADY_FINAL), ("a", L.ALREADY_FINAL), ("a", L.ACCEPTED),
                   ("b", L.ALREADY_FINAL), ("c", L.ACCEPTED), ("x", L.NOT_FOUND)]
    assert L.cancel_events(L.cancel_jobs(state, r), F.lit(9)).count() == 2
