"""H1, H4-H8: an append-only job ledger and the questions asked of it.

State is derived from events; nothing is updated in place. Per-job results
are (partial) aggregates, so one very busy job is no single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OUTPUT_SCHEMA
from ..session import stored

# Job type tag, statuses, outcomes.
JOB_TYPE = "file_processing"
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
FINAL = (COMPLETED, FAILED, CANCELLED)
JOB_ID_REQUIRED = "JOB_ID_REQUIRED"
NOT_FOUND = "NOT_FOUND"
ALREADY_FINAL = "ALREADY_FINAL"
ACCEPTED = "CANCELLED"

# How the driver's `events` table reads as a ledger.
EVENT_STATUS = {"signup": PENDING, "view": RUNNING, "click": RUNNING,
                "purchase": COMPLETED, "error": FAILED}


def register_jobs(subs: DataFrame, tags_col: str = "tags", user_col: str = "caller_user") -> DataFrame:
    """H1: type and tags of new jobs: file_processing + given tags + user:<id>."""
    tags = F.coalesce(F.col(tags_col), F.array().cast("array<string>"))
    user = F.coalesce(F.col(user_col), F.lit(""))
    return (subs.withColumn("job_type", F.lit(JOB_TYPE))
            .withColumn("tags", F.concat(F.array(F.lit(JOB_TYPE)), tags,
                                         F.when(user != "", F.array(F.concat(F.lit("user:"), user)))
                                         .otherwise(F.array().cast("array<string>")))))


def events_as_ledger(events: DataFrame) -> DataFrame:
    """The driver's `events` as ledger events: job = user, seq = event id."""
    m = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"),
        F.element_at(m, F.col("event_type")).alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


def job_state(ledger: DataFrame) -> DataFrame:
    """H4: per job the first terminal event wins; before it, the latest event.

    One aggregation: min over terminal (seq, status, error), max over all.
    """
    return resolved_state(partial_state(ledger))


def partial_state(ledger: DataFrame) -> DataFrame:
    """(job_id, f, l, n): first terminal event, latest event and number of events of each job."""
    final = F.col("status").isin(*FINAL)
    return (ledger.groupBy("job_id")
            .agg(F.min(F.when(final, F.struct("seq", "status", "error"))).alias("f"),
                 F.max(F.struct("seq", "status")).alias("l"),
                 F.count(F.lit(1)).cast("bigint").alias("n")))


def merged_state(partials: DataFrame) -> DataFrame:
    """Partial states of the same jobs, from different events, as one each."""
    return partials.groupBy("job_id").agg(F.min("f").alias("f"), F.max("l").alias("l"), F.sum("n").alias("n"))


def resolved_state(partials: DataFrame) -> DataFrame:
    return partials.select("job_id",
                           F.coalesce(F.col("f.status"), F.col("l.status")).alias("status"),
                           F.col("f.error").alias("error"),
                           F.col("f.seq").alias("final_seq"),
                           F.col("l.seq").alias("last_seq"),
                           F.col("n").cast("bigint").alias("n_events"))


def get_jobs(state: DataFrame, requests: DataFrame, id_col: str = "job_id") -> DataFrame:
    """H5: state by id; empty id -> JOB_ID_REQUIRED, unknown -> NOT_FOUND."""
    s = state.select(F.col("job_id").alias("__jid"), "status")
    blank = F.col(id_col).isNull() | (F.col(id_col) == "")
    return (requests.join(s, F.col(id_col) == F.col("__jid"), "left")
            .withColumn("error", F.when(blank, F.lit(JOB_ID_REQUIRED))
                        .when(F.col("__jid").isNull(), F.lit(NOT_FOUND)))
            .withColumn("status", F.when(F.col("error").isNull(), F.col("status")))
            .drop("__jid"))


def list_jobs(jobs: DataFrame, tags: list[str] | None = None, limit: int = 0, offset: int = 0,
              created_col: str = "created") -> DataFrame:
    """H6: jobs carrying file_processing and every given tag, newest first.

    limit 0 = no limit. The order is total (created desc, job_id).
    """
    want = [JOB_TYPE] + list(tags or [])
    cond = F.lit(True)
    for t in want:
        cond = cond & F.array_contains(F.col("tags"), F.lit(t))
    out = jobs.filter(cond).orderBy(F.col(created_col).desc(), F.col("job_id"))
    if offset:
        out = out.offset(offset)
    if limit:
        out = out.limit(limit)
    return out


def cancel_jobs(state: DataFrame, requests: DataFrame, order_col: str = "request_id",
                id_col: str = "job_id") -> DataFrame:
    """H7: outcome per cancel request.

    Empty id -> JOB_ID_REQUIRED; unknown -> NOT_FOUND; final -> ALREADY_FINAL;
    otherwise the first request for the job in the batch is accepted and the
    later ones find it final. Of requests with one order value a single one is
    accepted: rows are numbered in a written copy. The first request of each job
    is an aggregate, written before it is joined back, so that AQE can split the
    join of a job that holds a large share of the requests.
    """
    numbered = stored(requests.withColumn("__row", F.monotonically_increasing_id()), "cancel-requests")
    first = (numbered.groupBy(id_col).agg(F.min(F.struct(F.col(order_col).alias("o"), F.col("__row").alias("r"))).alias("__first"))
             .select(id_col, F.col("__first.r").alias("__first")))
    first = stored(first, "cancel-first")
    s = state.select(F.col("job_id").alias("__jid"), F.col("status").alias("__st"))
    blank = F.col(id_col).isNull() | (F.col(id_col) == "")
    return (numbered.join(first, id_col, "left")
            .join(s, F.col(id_col) == F.col("__jid"), "left")
            .withColumn("outcome", F.when(blank, F.lit(JOB_ID_REQUIRED))
                        .when(F.col("__jid").isNull(), F.lit(NOT_FOUND))
                        .when(F.col("__st").isin(*FINAL), F.lit(ALREADY_FINAL))
                        .when(F.col("__row") == F.col("__first"), F.lit(ACCEPTED))
                        .otherwise(F.lit(ALREADY_FINAL)))
            .drop("__first", "__row", "__jid", "__st"))


def cancel_events(outcomes: DataFrame, seq: Column) -> DataFrame:
    """Ledger events appended for the accepted cancels."""
    return (outcomes.filter(F.col("outcome") == ACCEPTED)
            .select("job_id", seq.alias("seq"), F.current_timestamp().alias("ts"),
                    F.lit("cancel").alias("step"), F.lit(CANCELLED).alias("status"),
                    F.lit(None).cast("string").alias("error")))


def decode_results(df: DataFrame, output_col: str = "output") -> DataFrame:
    """H8: output JSON -> one row per result with all its fields; undecodable output gives none."""
    parsed = df.select("job_id", F.from_json(F.col(output_col), OUTPUT_SCHEMA).alias("o"))
    return (parsed.select("job_id", F.explode(F.col("o.results")).alias("op_name", "r"))
            .select("job_id", "op_name", "r.success", "r.error", "r.size_bytes", "r.scan.clean", "r.scan.detail",
                    F.col("r.markdown.markdown").alias("markdown"), F.col("r.markdown.html").alias("html"),
                    "r.destination", "r.thumbnail_pages"))
