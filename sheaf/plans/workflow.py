"""Run the operations of whole tables of jobs.

Jobs are data: a job is a row with its inputs and its operations, whatever they
are. The checked jobs are written once; each input meets its file in one join;
then the operations of a job are one fold inside its row (see ``fold``), and
what they give is computed from the parts of each artifact and the texts of the
row. There is one plan for any number of different operation lists, and no job
row reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.paths import page_key
from ..operators import scan as S
from ..operators import validate as V
from ..session import stored
from ..sources.files import TOO_LARGE, effective_cap
from ..sources.jobs import Jobs, op_struct
from . import fold

# Result messages.
SKIPPED = "skipped: prior scan detected a threat"
UNKNOWN_TYPE = "unknown operation type"
VIRUS_PREFIX = "virus detected: "
NOT_FOUND = "NOT_FOUND"
UNREADABLE = "UNREADABLE"
MISSING_INPUT = "MISSING_INPUT"
NO_PAGES = "NO_PAGES"
REJECTED = "rejected"  # outcome of a job that fails the pipeline checks
JOB_ID_REQUIRED = "JOB_ID_REQUIRED"

RESULT_COLS = ["job_id", "op_index", "op_name", "op_type", "success", "error", "clean", "detail",
               "size_bytes", "page_count", "markdown", "html", "thumbnail_pages"]

INPUT_REFS = "array<struct<name:string,bucket:string,key:string,content_type:string>>"


def downloads(inputs: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Each job input (a row with bucket and key) joined to its file: ``error`` NOT_FOUND / TOO_LARGE /
    UNREADABLE (no text), else ``text``. Other columns of the inputs are kept."""
    cap = effective_cap(max_bytes)
    read = files.select("bucket", "key", F.col("content_type").alias("__ct"), "size_bytes",
                        F.col("text").isNotNull().alias("__readable"),
                        F.when(F.col("size_bytes") <= cap, F.col("text")).alias("text"))
    error = (F.when(F.col("__readable").isNull(), F.lit(NOT_FOUND))
             .when(F.col("size_bytes") > cap, F.lit(TOO_LARGE))
             .when(~F.col("__readable"), F.lit(UNREADABLE)))
    return inputs.join(read, ["bucket", "key"], "left").select(
        *[c for c in inputs.columns if c != "content_type"],
        F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.col("__ct")).alias("content_type"),
        error.alias("error"), "text")


def job_outcome(dl: DataFrame) -> DataFrame:
    """Failed when an input cannot be downloaded, else completed; one aggregate over the inputs."""
    bad = F.when(F.col("error").isNotNull(), F.struct("input_index", "name", "error"))
    return (dl.groupBy("job_id").agg(F.min(bad).alias("f"))
            .select("job_id",
                    F.when(F.col("f").isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
                    F.when(F.col("f").isNotNull(),
                           F.concat(F.lit("download "), F.col("f.name"), F.lit(": "), F.col("f.error")))
                     .alias("error")))


def first_submissions(docs: DataFrame) -> DataFrame:
    """One document a job id: a submission that is repeated counts once; of different documents with
    one id the least (as JSON text) counts, for a batch has no order."""
    row = F.struct(*[c for c in docs.columns if c != "job_id"])
    once = docs.groupBy("job_id").agg(F.min_by(row, F.to_json(row)).alias("d"))
    return once.select(*["job_id" if c == "job_id" else f"d.{c}" for c in docs.columns])


def dispatch_ops(ops: DataFrame) -> DataFrame:
    """The type that runs (first set of scan, convert, merge, thumbnail,
    markdown); no type -> error result."""
    return ops.withColumn("dispatch", F.coalesce(F.col("op_type"), F.lit("error"))).withColumn(
        "dispatch_error", F.when(F.col("op_type").isNull(), F.lit(UNKNOWN_TYPE)))


@dataclass
class JobRun:
    results: DataFrame        # one row per (job, op) of jobs whose downloads succeeded
    outcomes: DataFrame       # job_id, status (completed, failed, rejected), error
    artifacts: DataFrame      # job_id, name, n_pages, size_bytes, source, file_name
    artifact_pages: DataFrame  # job_id, name, page_no, size_bytes (previews of 'all' thumbnails)
    checked: DataFrame        # job_id, inputs, ops, error: the jobs as they were checked, written once
    downloads: DataFrame      # job_id, input_index, name, error: every input of the jobs that passed the checks


def checked_jobs(jobs: Jobs, allowed_buckets=None) -> DataFrame:
    """(job_id, inputs, ops, error): every job once, with its first pipeline error (B3) or null.

    A job id that is repeated counts once (see ``first_submissions``; rows of flat tables that are
    repeated count once), a job without an id is refused with JOB_ID_REQUIRED.
    """
    if jobs.docs is not None:
        docs = first_submissions(jobs.docs)
        if isinstance(allowed_buckets, DataFrame):
            found = V.check_pipelines(jobs, allowed_buckets).select("job_id", "error")
            docs = docs.join(found, "job_id", "left")
        else:
            docs = V.check_documents(docs, allowed_buckets)
        rows = docs.select("job_id", F.col("inputs").cast(INPUT_REFS).alias("inputs"),
                           F.transform("operations", op_struct).cast(f"array<{fold.OP}>").alias("ops"), "error")
    else:
        def gathered(df, *cols):
            return df.groupBy("job_id").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias("a"))
        ins = gathered(jobs.inputs, "input_index", "name", "bucket", "key", "content_type").select(
            "job_id", F.transform("a", lambda x: x.dropFields("input_index")).cast(INPUT_REFS).alias("inputs"))
        op = F.struct("op_index", "op_name", "op_type", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"),
                      "width", "dpi", "format", "pages")
        ops = (jobs.ops.select("job_id", op.alias("o")).groupBy("job_id").agg(F.array_sort(F.collect_set("o")).alias("ops"))
               .select("job_id", F.col("ops").cast(f"array<{fold.OP}>").alias("ops")))
        rows = (V.check_pipelines(jobs, allowed_buckets).select("job_id", "error")
                .join(ins, "job_id", "left").join(ops, "job_id", "left").select("job_id", "inputs", "ops", "error"))
    return rows.withColumn("error", F.when(F.col("job_id").isNull(), F.lit(JOB_ID_REQUIRED)).otherwise(F.col("error")))


NO_SCANS = f"cast(map() AS map<int,{fold.THREAT}>)"


def _derived_scans() -> Column:
    """(op_index, parts) of scans of what is no stored file: merges and previews."""
    out = fold.operations("ops", "inputs.name", f"transform(inputs, x -> cast(null AS {fold.THREAT}))", NO_SCANS, True)
    some = F.filter(out, lambda x: (x["op"]["op_type"] == "scan") & (x["state"] == fold.RAN) & ~fold.whole(x["parts"]))
    return F.transform(some, lambda x: F.struct(x["op"]["op_index"].alias("op_index"), x["parts"].alias("parts")))


def _threats(rows: DataFrame, signatures: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, threat): the lowest signature of each text that holds any."""
    first = S.scan_hits(rows, signatures, id_col=ids).groupBy(*ids).agg(F.min("sig_id").alias("sig_id"))
    return (first.join(signatures.select("sig_id", "sig_name").dropDuplicates(["sig_id"]), "sig_id")
            .select(*ids, F.struct(F.col("sig_name").alias("name")).alias("threat")))


def run_jobs(jobs: Jobs, files: DataFrame, signatures: DataFrame | None,
             page_chars: int = 1800, max_bytes: int | None = None, allowed_buckets=None) -> JobRun:
    """G1: every operation of every valid job, in order.

    Jobs are checked first (B3) and written once under ``spark.checkpoint.dir``: a job that fails is not run,
    and its outcome is 'rejected' with the code of its first error, so every job has an outcome.

    Files that jobs read are scanned once each, however many jobs read them. The texts cross the
    network in the inputs-to-files join, and once more by job for jobs with several inputs (or
    scans of merged documents), whose texts meet in the job's row.
    """
    checked = checked_jobs(jobs, allowed_buckets)
    if signatures is None:
        derived = F.array().cast(f"array<struct<op_index:int,parts:{fold.PARTS}>>")
    else:
        derived = F.when(F.col("error").isNull(), _derived_scans())
    checked = stored(checked.withColumn("derived", derived), "checked-jobs")
    run = checked.filter(F.col("error").isNull())
    rejected = checked.filter(F.col("error").isNotNull()).select("job_id", F.lit(REJECTED).alias("status"), "error")

    alone = (F.size("inputs") == 1) & (F.size("derived") == 0)
    inputs = run.select("job_id", "ops", "derived", alone.alias("alone"), F.posexplode("inputs").alias("input_index", "f"))
    inputs = inputs.select("job_id", "ops", "derived", "alone", F.col("input_index").cast("int"), "f.*")
    no_threat = F.lit(None).cast(fold.THREAT)
    if signatures is None:
        dl = downloads(inputs, files, max_bytes).withColumn("threat", no_threat)
    else:
        scanned = files.join(inputs.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")
        threats = _threats(scanned.select("bucket", "key", "text"), signatures, ["bucket", "key"])
        dl = downloads(inputs, files, max_bytes).join(threats, ["bucket", "key"], "left")
    one = F.struct("name", "bucket", "key", "content_type", "text", "threat")
    rows = (dl.filter(F.col("alone") & F.col("error").isNull())
            .select("job_id", "ops", F.array(one).cast(fold.INPUTS).alias("ins"), F.expr(NO_SCANS).alias("found")))
    has = run.agg(F.max(~alone).alias("several"), F.max(F.size("derived") > 0).alias("derived")).first()
    if has["several"]:
        rows = rows.unionByName(_several(dl, one, signatures if has["derived"] else None, page_chars))
    rows = rows.select("job_id", "ins", fold.operations("ops", "ins.name", "ins.threat", "found", signatures is not None)
                       .alias("out"))
    read = downloads(inputs.drop("ops", "derived", "alone"), files, max_bytes).select("job_id", "input_index", "name", "error")
    outcomes = job_outcome(read).unionByName(rejected)
    return JobRun(_results(rows, page_chars, signatures is not None), outcomes, _artifacts(rows, page_chars),
                  _artifact_pages(rows, page_chars), checked.select("job_id", "inputs", "ops", "error"), read)


def _several(dl: DataFrame, one: Column, signatures: DataFrame | None, page_chars: int) -> DataFrame:
    """(job_id, ops, ins, found) of jobs whose texts meet by job; found: verdicts of their derived scans."""
    rows = (dl.filter(~F.col("alone")).groupBy("job_id")
            .agg(F.array_sort(F.collect_list(F.struct("input_index", one.alias("f")))).alias("ins"),
                 F.first("ops").alias("ops"), F.first("derived").alias("derived"), F.count("error").alias("bad"))
            .filter("bad = 0")
            .select("job_id", "ops", "derived", F.transform("ins", lambda x: x["f"]).cast(fold.INPUTS).alias("ins")))
    if signatures is None:
        return rows.select("job_id", "ops", "ins", F.expr(NO_SCANS).alias("found"))
    probe = rows.select("job_id", "ins", F.explode("derived").alias("d"))
    probe = probe.select("job_id", F.col("d.op_index").alias("op_index"),
                         fold.Parts(F.col("ins"), F.col("d.parts"), page_chars).text().alias("text"))
    found = (_threats(probe, signatures, ["job_id", "op_index"]).groupBy("job_id")
             .agg(F.map_from_entries(F.collect_list(F.struct("op_index", "threat"))).alias("found")))
    return rows.join(found, "job_id", "left").select(
        "job_id", "ops", "ins", F.coalesce("found", F.expr(NO_SCANS)).alias("found"))


def _results(rows: DataFrame, page_chars: int, scanning: bool) -> DataFrame:
    """One row per operation of the rows' jobs."""
    r = rows.select("job_id", "ins", F.explode("out").alias("r")).select(
        "job_id", "ins", "r.op.op_index", "r.op.op_name", "r.op.op_type", "r.op.pages", "r.state", "r.file", "r.parts", "r.threat")
    parts = fold.Parts(F.col("ins"), F.col("parts"), page_chars)
    source = F.get("ins", F.get("parts", F.lit(0))["i"])
    ran, kind = F.col("state") == fold.RAN, F.col("op_type")
    scan, text = ran & (kind == "scan"), ran & (kind == "extract_markdown")
    paged = ran & kind.isin("convert_to_pdf", "merge_pdfs")
    thumb = ran & (kind == "thumbnail")
    each = thumb & (F.col("pages") == "all")
    media = F.substring_index(F.coalesce(source["content_type"], F.lit("")), ";", 1)  # parameters do not matter
    is_html = text & F.col("file") & (F.lower(F.trim(media)) == "text/html")
    r = r.withColumns({"is_html": F.coalesce(is_html, F.lit(False)),
                       "source": F.when(is_html, source["text"])})
    if scanning:
        clean, found = F.col("threat").isNull(), F.concat(F.lit(VIRUS_PREFIX), F.col("threat.name"))
    else:
        clean, found = F.lit(False), F.lit(S.DISABLED_DETAIL)
    error = (F.when(F.col("state") == fold.SKIPPED, F.lit(SKIPPED)).when(F.col("state") == fold.UNKNOWN, F.lit(UNKNOWN_TYPE))
             .when(F.col("state") == fold.MISSING, F.lit(MISSING_INPUT)).when(scan & ~clean, found))
    thumbs = F.transform(parts.page_sizes(), lambda s, i: F.struct(
        (i + 1).cast("int").alias("page_number"), s.alias("size_bytes")))
    return r.select(
        "job_id", "op_index", "op_name", "op_type", (ran & ~F.coalesce(scan & ~clean, F.lit(False))).alias("success"),
        error.alias("error"), F.when(scan, clean).alias("clean"), F.when(scan, F.col("threat.name")).alias("detail"),
        F.when(paged, parts.size()).when(thumb, parts.first_size()).alias("size_bytes"),
        F.when(paged | each, parts.n_pages()).when(thumb, F.lit(1)).alias("page_count"),
        F.when(F.col("is_html"), H.to_markdown("source")).when(text, parts.text()).alias("markdown"),
        F.when(F.col("is_html"), H.clean_html("source")).alias("html"),
        F.when(each, thumbs).alias("thumbnail_pages"))


def _artifacts(rows: DataFrame, page_chars: int) -> DataFrame:
    """(job_id, name, n_pages, size_bytes, source, file_name) of inputs and of what operations made."""
    kind = "array<struct<name:string,n_pages:int,size_bytes:bigint,source:string,file_name:string>>"
    given = F.transform("ins", lambda x: F.struct(
        x["name"], F.lit(None), F.octet_length(x["text"]), F.lit("input"), x["key"])).cast(kind)

    def made(x):
        parts, op = fold.Parts(F.col("ins"), x["parts"], page_chars), x["op"]
        thumb = op["op_type"] == "thumbnail"
        return F.struct(op["op_name"], F.when(thumb & (op["pages"] == "all"), parts.n_pages()),
                        F.when(thumb, parts.first_size()).otherwise(parts.size()), F.lit("op"),
                        F.when(op["op_type"] == "convert_to_pdf", F.concat(op["op_name"], F.lit(".pdf"))))
    kept = F.filter("out", lambda x: (x["state"] == fold.RAN) & x["op"]["op_type"].isin(
        "convert_to_pdf", "merge_pdfs", "thumbnail"))
    return (rows.select("job_id", F.explode(F.concat(given, F.transform(kept, made).cast(kind))).alias("a"))
            .select("job_id", "a.*"))


def _artifact_pages(rows: DataFrame, page_chars: int) -> DataFrame:
    """(job_id, name, page_no, size_bytes) of the pages of previews of every page."""
    kept = F.filter("out", lambda x: (x["state"] == fold.RAN) & (x["op"]["op_type"] == "thumbnail")
                    & (x["op"]["pages"] == "all"))
    r = rows.select("job_id", "ins", F.explode(kept).alias("r"))
    sizes = fold.Parts(F.col("ins"), F.col("r.parts"), page_chars).page_sizes()
    return (r.select("job_id", F.col("r.op.op_name").alias("name"), F.posexplode(sizes).alias("at", "size_bytes"))
            .select("job_id", "name", (F.col("at") + 1).alias("page_no"), "size_bytes"))


def file_names(artifacts: DataFrame) -> DataFrame:
    """File name handed to the next step: an input keeps its key, a
    converted document is '<op>.pdf', merges and previews set none and the
    artifact name stands in."""
    return artifacts.withColumn("file_name", F.coalesce(F.col("file_name"), F.col("name")))


def op_status(results: DataFrame) -> DataFrame:
    """Success / error per op (already in the result rows), with counts."""
    return (results.groupBy("op_name", "op_type", "success", "error")
            .agg(F.count(F.lit(1)).alias("n_ops")))


def artifact_refs(jobs: Jobs) -> DataFrame:
    """Uses per artifact (op inputs with repeats + one per destination)
    and the last op index that uses it (NULL when only a destination does)."""
    uses = (jobs.ops.select("job_id", F.explode("inputs").alias("ref"), "op_index")
            .unionByName(jobs.dests.select("job_id", F.col("name").alias("ref"),
                                           F.lit(None).cast("int").alias("op_index"))))
    return (uses.groupBy("job_id", "ref")
            .agg(F.count(F.lit(1)).alias("n_uses"), F.max("op_index").alias("last_op_index")))


def unused_inputs(jobs: Jobs) -> DataFrame:
    """Inputs no operation or destination refers to."""
    refs = artifact_refs(jobs).select("job_id", F.col("ref").alias("name"))
    return jobs.inputs.join(refs, ["job_id", "name"], "left_anti")


def results_struct(r: Column, dest: Column) -> Column:
    """One result as the JSON output shape (empty fields dropped); ``dest``: the operation's destination, or null.

    Of a preview of several pages each page has its own destination, as in the upload plan.
    """
    thumbs = F.filter(r["thumbnail_pages"], lambda p: p.isNotNull())
    paged = F.coalesce(F.size(thumbs), F.lit(0)) > 1

    def page(p):
        key = F.when(paged, page_key(dest["key"], p["page_number"])).otherwise(dest["key"])
        return F.struct(p["page_number"].alias("page_number"),
                        F.when(dest.isNotNull(), F.struct(dest["bucket"].alias("bucket"), key.alias("key"),
                                                          dest["content_type"].alias("content_type"))).alias("destination"),
                        p["size_bytes"].alias("size_bytes"))
    is_file = r["op_type"].isin("convert_to_pdf", "merge_pdfs", "thumbnail")
    return F.struct(
        r["success"].alias("success"),
        F.nullif(r["error"], F.lit("")).alias("error"),
        F.when(r["op_type"] == "scan", F.struct(r["clean"].alias("clean"), r["detail"].alias("detail"))).alias("scan"),
        F.when((r["op_type"] == "extract_markdown") & r["success"],
               F.struct(r["markdown"].alias("markdown"), r["html"].alias("html"))).alias("markdown"),
        F.transform(thumbs, page).alias("thumbnail_pages"),
        F.when(is_file & r["success"] & ~paged, dest).alias("destination"),
        F.nullif(r["size_bytes"], F.lit(0)).alias("size_bytes"))


def assemble_results(results: DataFrame, dests: DataFrame | None = None) -> DataFrame:
    """job_id, output JSON {"results": {op_name: result}}, operations in their order.

    ``dests`` (job_id, name, bucket, key, content_type) fills the destinations of what was uploaded.
    Of operations with one name (which the checks refuse) the last counts; one without a name is left out.
    """
    fields = [c for c in RESULT_COLS if c not in ("job_id", "op_index")]
    jobs = (results.filter(F.col("op_name").isNotNull()).groupBy("job_id")
            .agg(F.collect_list(F.struct("op_index", *fields)).alias("r")))
    ref = "map<string,struct<bucket:string,key:string,content_type:string>>"
    if dests is None:
        jobs = jobs.withColumn("d", F.lit(None).cast(ref))
    else:
        named = (dests.filter(F.col("name").isNotNull()).groupBy("job_id", "name")
                 .agg(F.min(F.struct("bucket", "key", "content_type")).alias("d"))
                 .groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "d"))).alias("d")))
        jobs = jobs.join(named, "job_id", "left")
    in_order = F.array_sort("r", lambda a, b: a["op_index"] - b["op_index"])
    jobs = jobs.select("job_id", "d", in_order.alias("r"))
    names = F.transform("r", lambda x: x["op_name"])
    last = F.filter("r", lambda x, i: ~F.array_contains(
        F.slice(names, i + 2, F.size("r")), x["op_name"]))
    entries = F.transform(last, lambda x: F.struct(
        x["op_name"], results_struct(x, F.try_element_at(F.col("d"), x["op_name"]))))
    return jobs.select("job_id", F.to_json(F.struct(F.map_from_entries(entries).alias("results"))).alias("output"))


def progress_events(run: JobRun) -> DataFrame:
    """H2: (job_id, seq, step, current, total): 'downloading' 0 of n and after each input, up to the first that
    cannot be read, then every operation's name and number before it is executed; skipped ones report none."""
    inputs = run.downloads.groupBy("job_id").agg(
        F.count("*").alias("n_in"), F.min(F.when(F.col("error").isNotNull(), F.col("input_index"))).alias("bad"))
    reads = inputs.select("job_id", F.lit("downloading").alias("step"), F.col("n_in").cast("int").alias("total"),
                          F.explode(F.sequence(F.lit(0), F.coalesce("bad", F.col("n_in").cast("int")))).alias("current"))
    sizes = run.checked.select("job_id", F.size("inputs").alias("n_in"), F.size("ops").alias("n_ops"))
    ran = run.results.filter(~F.col("error").eqNullSafe(SKIPPED)).select("job_id", "op_index", "op_name").join(sizes, "job_id")
    return (reads.select("job_id", F.col("current").cast("bigint").alias("seq"), "step", "current", "total")
            .unionByName(ran.select("job_id", (F.col("n_in") + 1 + F.col("op_index")).cast("bigint").alias("seq"),
                                    F.col("op_name").alias("step"), (F.col("op_index") + 1).cast("int").alias("current"),
                                    F.col("n_ops").alias("total"))))


def progress_reports(events: DataFrame, total: int = 100) -> DataFrame:
    """H2: progress reports from ledger events (job_id, seq, step, props): the step, and how much of it is
    done (``k`` of the event's JSON properties, of ``total``). An event without a number reports none done."""
    done = F.get_json_object("props", "$.k").cast("int")
    return events.select("job_id", "seq", "step", F.least(F.greatest(F.coalesce(done, F.lit(0)), F.lit(0)), F.lit(total))
                         .alias("current"), F.lit(total).alias("total"))


def latest_progress(events: DataFrame) -> DataFrame:
    """H3: current step of each job = the event with the highest seq."""
    return (events.groupBy("job_id")
            .agg(F.max_by(F.struct("step", "current", "total"), F.col("seq")).alias("p"),
                 F.max("seq").alias("last_seq"))
            .select("job_id", "p.step", "p.current", "p.total", "last_seq"))
