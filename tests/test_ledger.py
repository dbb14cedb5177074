import datetime as dt

from pyspark.sql import functions as F

from sheaf.operators import ledger as L


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "job_id string, seq long, status string, error string")


def test_first_terminal_wins(spark):
    led = _ledger(spark, [("a", 1, "pending", None), ("a", 2, "running", None), ("a", 3, "completed", None),
                          ("a", 4, "failed", "late"),
                          ("b", 1, "pending", None), ("b", 5, "running", None),
                          ("c", 2, "failed", "boom"), ("c", 1, "pending", None), ("c", 3, "completed", None)])
    st = {r.job_id: (r.status, r.error, r.final_seq, r.last_seq) for r in L.job_state(led).collect()}
    assert st == {"a": ("completed", None, 3, 4), "b": ("running", None, None, 5), "c": ("failed", "boom", 2, 3)}


def test_get_and_cancel(spark):
    state = spark.createDataFrame([("r", "running"), ("d", "completed"), ("p", "pending")],
                                  "job_id string, status string")
    reqs = spark.createDataFrame([(1, "r"), (2, "d"), (3, "x"), (4, ""), (5, "r"), (6, "p"), (7, None)],
                                 "request_id long, job_id string")
    got = {r.request_id: (r.status, r.error) for r in L.get_jobs(state, reqs).collect()}
    assert got == {1: ("running", None), 2: ("completed", None), 3: (None, "NOT_FOUND"),
                   4: (None, "JOB_ID_REQUIRED"), 5: ("running", None), 6: ("pending", None),
                   7: (None, "JOB_ID_REQUIRED")}
    out = {r.request_id: r.outcome for r in L.cancel_jobs(state, reqs).collect()}
    assert out == {1: "CANCELLED", 2: "ALREADY_FINAL", 3: "NOT_FOUND", 4: "JOB_ID_REQUIRED",
                   5: "ALREADY_FINAL", 6: "CANCELLED", 7: "JOB_ID_REQUIRED"}
    ev = L.cancel_events(L.cancel_jobs(state, reqs), F.lit(100).cast("long"))
    assert sorted(r.job_id for r in ev.collect()) == ["p", "r"]


def test_register_and_list(spark):
    t0 = dt.datetime(2024, 1, 1)
    subs = spark.createDataFrame([
        ("1", ["x", "y"], "u1", t0), ("2", ["x"], "", t0 + dt.timedelta(days=1)),
        ("3", None, None, t0 + dt.timedelta(days=2)), ("4", ["y", "x"], "", t0 + dt.timedelta(days=1))],
        "job_id string, tags array<string>, caller_user string, created timestamp")
    reg = L.register_jobs(subs)
    tags = {r.job_id: r.tags for r in reg.collect()}
    assert tags == {"1": ["file_processing", "x", "y", "user:u1"], "2": ["file_processing", "x"],
                    "3": ["file_processing"], "4": ["file_processing", "y", "x"]}
    assert [r.job_id for r in L.list_jobs(reg, ["x"]).collect()] == ["2", "4", "1"]
    assert [r.job_id for r in L.list_jobs(reg, ["x", "y"]).collect()] == ["4", "1"]
    assert [r.job_id for r in L.list_jobs(reg, [], limit=2, offset=1).collect()] == ["2", "4"]
    assert [r.job_id for r in L.list_jobs(reg, ["nope"]).collect()] == []
