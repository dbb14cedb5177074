"""Registered queries: each reads whole driver tables and returns flat columns.

Integral outputs are bigint and every computed column is aliased, so the
DuckDB statements in ``oracle.py`` can return the same names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..functions import html as H
from ..operators import extract as E
from ..operators import ledger as L
from ..operators import pages as P
from ..operators import scan as S
from ..operators import validate as V
from ..operators.backend import apply_backend
from ..plans import workflow as W
from ..session import scratch_dir
from ..sources.files import cap_sizes, files_from_documents, files_from_pages, read_files, read_table
from ..sources.jobs import explode_jobs, parse_jobs
from ..sources.objects import get_objects, list_objects, put_objects, read_lines
from ..sources.sinks import upload_plan, write_artifacts, write_structure
from ..sources.tables import document_jobs_json, order_jobs, page_jobs_json
from ..streaming import jobs as ST
from ..streaming import snapshot as SN
from .registry import query

PAGE_CHARS = 1800
SIZE_CAP = 16384  # parameter of files_sized: splits sf0.01 documents on both sides
ALLOWED = ["archive", "inbox", "src0", "src1", "src2"]


def T(spark, sf, name):
    return read_table(spark, sf, name)


def doc_files(spark, sf):
    return files_from_documents(T(spark, sf, "documents"))


def doc_pages(spark, sf) -> DataFrame:
    return P.paginate(doc_files(spark, sf), PAGE_CHARS).withColumnRenamed("file_id", "doc_id")


def orders_jobs(spark, sf):
    return order_jobs(T(spark, sf, "orders"), T(spark, sf, "lineitem"))


# ---- A: sources -------------------------------------------------------------

@query("files_sized")
def q_files_sized(spark: SparkSession, sf: str) -> DataFrame:
    f = cap_sizes(doc_files(spark, sf), SIZE_CAP)
    return f.select("file_id", "bucket", "key", "size_bytes", "error",
                    F.sha2("text", 256).alias("content_sha256"))


@query("read_files")
def q_read_files(spark, sf):
    """Documents as objects of JSON lines, read back as binary files and decoded."""
    folder = scratch_dir(spark, "objects")
    docs = T(spark, sf, "documents").select("doc_id", "text")
    docs.write.option("maxRecordsPerFile", 1000).json(folder)
    objects = read_files(spark, folder, max_bytes=(1 << 31) - 1, glob="*.json")
    lines = objects.select("error", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    row = F.from_json("line", docs.schema)
    return (lines.filter(F.col("line") != "")
            .select(row["doc_id"].alias("doc_id"), F.sha2(row["text"], 256).alias("content_sha256"), "error"))


REWRITTEN = ["src0", "src1", "src2"]


@query("write_artifacts")
def q_write_artifacts(spark, sf):
    """All documents written by bucket, then some buckets anew with their English documents alone."""
    root = scratch_dir(spark, "artifacts")
    files = doc_files(spark, sf).select("key", "text", "bucket")
    write_artifacts(files, root)
    write_artifacts(files.filter(F.col("bucket").isin(REWRITTEN) & F.col("key").startswith("en/")), root)
    return spark.read.schema(files.schema).parquet(root).select(
        "bucket", "key", F.sha2("text", 256).alias("content_sha256"))


@query("put_objects")
def q_put_objects(spark, sf):
    """Every document as an object at its bucket and key, read back by key. German ones are given a key outside
    of the bucket and Spanish ones no bytes: each is an error row, and the others are written."""
    root = scratch_dir(spark, "objects")
    files = doc_files(spark, sf).select(
        "bucket", F.when(F.col("key").startswith("de/"), F.concat(F.lit("../"), F.col("key"))).otherwise(F.col("key")).alias("key"),
        F.when(~F.col("key").startswith("es/"), F.col("text")).alias("text"))
    report = put_objects(files, root, "text")
    back = get_objects(spark, root, report.where("error is null")).select(
        "bucket", "key", F.sha2("content", 256).alias("content_sha256"))
    return report.join(back, ["bucket", "key"], "left").select("bucket", "key", "size_bytes", "content_sha256", "error")


@query("read_ranges")
def q_read_ranges(spark, sf):
    """Documents as a few objects of JSON lines, read line by line in ranges of 256 KB."""
    folder = scratch_dir(spark, "large-objects")
    docs = T(spark, sf, "documents").select("doc_id", "text")
    docs.write.json(folder)
    lines = read_lines(list_objects(spark, folder, "*.json"), 1 << 18)
    row = F.from_json("line", docs.schema)
    return lines.select(row["doc_id"].alias("doc_id"), F.sha2(row["text"], 256).alias("content_sha256"))


# ---- B: checks ----------------------------------------------------------------

@query("check_refs")
def q_check_refs(spark, sf):
    docs = doc_files(spark, sf).select(F.concat(F.lit("doc-"), F.col("file_id").cast("string")).alias("ref_id"),
                                        "bucket", "key")
    inputs = orders_jobs(spark, sf).inputs.select(
        F.concat(F.lit("in-"), F.col("job_id"), F.lit("-"), F.col("input_index").cast("string")).alias("ref_id"),
        "bucket", "key")
    return V.check_refs(docs.unionByName(inputs), allowed_buckets=ALLOWED)


# ---- C: pages -----------------------------------------------------------------

@query("paginate")
def q_paginate(spark, sf):
    return doc_pages(spark, sf).select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), "page_text",
        F.length("page_text").cast("bigint").alias("page_chars"))


def stored_pages(spark, sf):
    """Documents of mixed types, conversations as files that have pages (a turn each), and all pages:
    cut ones and those that passthrough files bring along. A PDF among the documents has none."""
    docs = T(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"), "text",
        F.when(F.col("source").endswith("7"), F.lit("application/pdf"))
         .when(F.col("source").endswith("3"), F.lit("image/png")).otherwise(F.lit("text/plain")).alias("content_type"))
    turns = T(spark, sf, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("file_id"),
        (F.col("turn") + 1).alias("page_no"), F.col("text").alias("page_text"))
    convs = turns.select("file_id").distinct().select("file_id", F.lit(None).cast("string").alias("text"),
                                                      F.lit("application/pdf").alias("content_type"))
    files = docs.unionByName(convs)
    return files, P.paginate(files, PAGE_CHARS, "file_id", existing=turns)


@query("paginate_passthrough")
def q_paginate_passthrough(spark, sf):
    return stored_pages(spark, sf)[1].select("file_id", F.col("page_no").cast("bigint").alias("page_no"), "page_text")


@query("page_count_errors")
def q_page_count_errors(spark, sf):
    files, pages = stored_pages(spark, sf)
    return P.page_counts(pages, "file_id", documents=files)


@query("page_counts")
def q_page_counts(spark, sf):
    return P.page_counts(doc_pages(spark, sf), "doc_id")


# ---- E: extraction ------------------------------------------------------------


IMG_INJECT = ('<img src="data:image/png;base64,iVBORw0KGgo=" alt="logo">'
              '<img src="/static/figure.jpg" alt="figure"><a href="/more"><img src="data:image/gif;base64,R0lGOD=="></a>'
              '</article>')


def page_markdown(spark, sf):
    return E.extract_markdown(T(spark, sf, "pages").select("page_id", "html"))


def page_blocks(spark, sf):
    return E.structure_blocks(page_markdown(spark, sf), "page_id", page_chars=PAGE_CHARS)


@query("extract_markdown")
def q_extract_markdown(spark, sf):
    return page_markdown(spark, sf).select("page_id", "markdown")


@query("extract_html")
def q_extract_html(spark, sf):
    return E.extract_html(T(spark, sf, "pages")).select("page_id", "clean_html")


@query("structure_blocks")
def q_structure_blocks(spark, sf):
    return page_blocks(spark, sf).select(
        "page_id", "pos", "label", "text", "heading", F.col("page_no").cast("bigint"))


@query("heading_paths")
def q_heading_paths(spark, sf):
    """Documents as Markdown of many levels: a sentence is a block, its length decides whether and how deep a header."""
    def block(sentence):
        level = F.length(sentence) % 8
        return F.when(level.between(1, 6), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), sentence)).otherwise(sentence)
    md = T(spark, sf, "documents").select(
        "doc_id", F.array_join(F.transform(F.split("text", "\\. "), block), "\n\n").alias("markdown"))
    return E.structure_blocks(md, "doc_id", page_chars=PAGE_CHARS).select(
        "doc_id", "pos", "label", F.array_join("headings", " > ").alias("path"), F.size("headings").cast("bigint").alias("depth"),
        "heading")


@query("structure_json")
def q_structure_json(spark, sf):
    return E.structure_json(page_blocks(spark, sf), "page_id")


@query("write_structure")
def q_write_structure(spark, sf):
    path = scratch_dir(spark, "structure")
    structured = E.structure_json(page_blocks(spark, sf), "page_id")
    write_structure(structured, path, id_col="page_id")
    return spark.read.schema(structured.schema).json(path)


@query("parse_chunks")
def q_parse_chunks(spark, sf):
    ch = E.parse_chunks(E.structure_json(page_blocks(spark, sf), "page_id"), "page_id")
    return ch.select("page_id", F.col("chunk_index").cast("bigint"), "chunk_type",
                     F.col("page_number").cast("bigint"), "heading", "chunk_text")


@query("image_modes")
def q_image_modes(spark, sf):
    base = T(spark, sf, "pages").select(
        "page_id", F.replace(F.col("html"), F.lit("</article>"), F.lit(IMG_INJECT)).alias("html"))
    outs = [E.extract_markdown(E.extract_html(base, image_mode=mode), image_mode=mode)
            .select("page_id", F.lit(mode).alias("mode"), "clean_html", "markdown") for mode in H.IMAGE_MODES]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


# ---- F: scanning --------------------------------------------------------------


def bench_signatures(spark, sf):
    return T(spark, sf, "benchmark").select(
        F.col("item_id").alias("sig_id"),
        F.concat(F.lit("Bench.Passage-"), F.col("item_id").cast("string")).alias("sig_name"),
        F.col("text").alias("pattern"))


def doc_verdicts(spark, sf):
    return S.scan_corpus(doc_files(spark, sf), bench_signatures(spark, sf))


def scanner_replies(spark, sf):
    """Reply lines a scanner daemon would print for each document.

    Verdicts come from the signature scan; the line shapes (trailing NUL,
    padding, size-limit error) are chosen by language so that every parsing
    rule sees whole-table traffic.
    """
    v = doc_verdicts(spark, sf).join(
        T(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "lang", "n_chars"), "file_id")
    base = F.when(F.col("clean"), F.lit("stream: OK")).otherwise(
        F.concat(F.lit("stream: "), F.col("detail"), F.lit(" FOUND")))
    line = (F.when(F.col("lang") == "en", F.concat(base, F.lit("\x00")))
             .when(F.col("lang") == "fr", F.concat(F.lit("  "), base, F.lit(" \n")))
             .when((F.col("lang") == "de") & (F.col("n_chars") > 20000),
                   F.lit("stream: INSTREAM size limit exceeded ERROR"))
             .otherwise(base))
    return v.select("file_id", line.alias("response"))


@query("scan_corpus")
def q_scan_corpus(spark, sf):
    return doc_verdicts(spark, sf)


@query("scan_hits")
def q_scan_hits(spark, sf):
    return S.scan_hits(doc_files(spark, sf), bench_signatures(spark, sf))


@query("scan_hashes")
def q_scan_hashes(spark, sf):
    docs = T(spark, sf, "documents")
    bad = (docs.join(T(spark, sf, "labels").filter(F.col("toxic") == 1), "doc_id")
           .select(F.col("doc_id").alias("bad_id"), F.sha2("text", 256).alias("sha256")))
    return S.scan_hashes(doc_files(spark, sf), bad)


@query("scan_disabled")
def q_scan_disabled(spark, sf):
    return S.scan_corpus(doc_files(spark, sf), None)


@query("classify_scans")
def q_classify_scans(spark, sf):
    return S.classify_scan_responses(scanner_replies(spark, sf), "response")


@query("threat_counts")
def q_threat_counts(spark, sf):
    return S.threat_counts(S.classify_scan_responses(scanner_replies(spark, sf), "response"))


@query("scan_gate")
def q_scan_gate(spark, sf):
    ev = T(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
                                       "event_type")
    return S.scan_gate(ev, "job_id", "seq", F.col("event_type") == "error")


# ---- A2 / B3 / G: jobs --------------------------------------------------------


def doc_jobs(spark, sf):
    return explode_jobs(parse_jobs(document_jobs_json(T(spark, sf, "documents"))))


def doc_run(spark, sf, max_bytes=None):
    return W.run_jobs(doc_jobs(spark, sf), doc_files(spark, sf), bench_signatures(spark, sf),
                      page_chars=PAGE_CHARS, max_bytes=max_bytes)


@query("jobs_exploded")
def q_jobs_exploded(spark, sf):
    j = doc_jobs(spark, sf)
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    ins = j.inputs.select("job_id", F.lit("input").alias("part"), F.col("input_index").cast("bigint").alias("idx"),
                          "name", none_s.alias("op_type"), none_s.alias("refs"), "bucket", "key",
                          "content_type", none_i.alias("width"), none_i.alias("dpi"),
                          none_s.alias("format"), none_s.alias("pages"))
    ops = j.ops.select("job_id", F.lit("op").alias("part"), F.col("op_index").cast("bigint").alias("idx"),
                       F.col("op_name").alias("name"), "op_type", F.array_join("inputs", ",").alias("refs"),
                       none_s.alias("bucket"), none_s.alias("key"), none_s.alias("content_type"),
                       F.col("width").cast("bigint"), F.col("dpi").cast("bigint"), "format", "pages")
    dests = j.dests.select("job_id", F.lit("dest").alias("part"), none_i.alias("idx"), "name",
                           none_s.alias("op_type"), none_s.alias("refs"), "bucket", "key", "content_type",
                           none_i.alias("width"), none_i.alias("dpi"), none_s.alias("format"), none_s.alias("pages"))
    return ins.unionByName(ops).unionByName(dests)


@query("check_jobs")
def q_check_jobs(spark, sf):
    r = V.check_pipelines(orders_jobs(spark, sf))
    return r.select("job_id", "error", F.col("stage").cast("bigint"), "item")


@query("dispatch_ops")
def q_dispatch_ops(spark, sf):
    return W.dispatch_ops(orders_jobs(spark, sf).ops).select(
        "job_id", F.col("op_index").cast("bigint"), "op_name", "dispatch", "dispatch_error")


@query("artifact_refs")
def q_artifact_refs(spark, sf):
    return W.artifact_refs(orders_jobs(spark, sf)).select(
        "job_id", "ref", F.col("n_uses").cast("bigint"), F.col("last_op_index").cast("bigint"))


@query("unused_inputs")
def q_unused_inputs(spark, sf):
    return W.unused_inputs(orders_jobs(spark, sf)).select(
        "job_id", F.col("input_index").cast("bigint"), "name", "bucket", "key")


def _flat_results(res):
    return res.select("job_id", F.col("op_index").cast("bigint"), "op_name", "op_type", "success", "error",
                      "clean", "detail", "size_bytes", F.col("page_count").cast("bigint"),
                      F.length("markdown").cast("bigint").alias("md_chars"),
                      F.sha2("markdown", 256).alias("md_sha256"))


@query("run_jobs")
def q_run_jobs(spark, sf):
    return _flat_results(doc_run(spark, sf).results)


def page_run(spark, sf):
    pages = T(spark, sf, "pages")
    return W.run_jobs(explode_jobs(parse_jobs(page_jobs_json(pages))), files_from_pages(pages),
                      bench_signatures(spark, sf), page_chars=PAGE_CHARS)


@query("run_page_jobs")
def q_run_page_jobs(spark, sf):
    return _flat_results(page_run(spark, sf).results)


@query("page_job_outcome")
def q_page_job_outcome(spark, sf):
    return page_run(spark, sf).outcomes


@query("results_json")
def q_results_json(spark, sf):
    return W.assemble_results(doc_run(spark, sf).results, doc_jobs(spark, sf).dests)


@query("job_outcome")
def q_job_outcome(spark, sf):
    return doc_run(spark, sf, max_bytes=32768).outcomes


@query("upload_plan")
def q_upload_plan(spark, sf):
    run = doc_run(spark, sf)
    plan = upload_plan(doc_jobs(spark, sf).dests, run.artifacts, run.artifact_pages)
    return plan.select("job_id", "name", F.col("page_no").cast("bigint"), "bucket", "key", "content_type",
                       "size_bytes", "source")


@query("artifact_files")
def q_artifact_files(spark, sf):
    a = W.file_names(doc_run(spark, sf).artifacts)
    return a.select("job_id", "name", "source", "file_name", "size_bytes")


def progress(spark, sf):
    """`events` as progress reports: the step is the event's type, k of 100 of it is done."""
    return W.progress_reports(T(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("step"),
        "props"))


@query("progress_events")
def q_progress_events(spark, sf):
    return W.progress_events(doc_run(spark, sf)).select(
        "job_id", "seq", "step", F.col("current").cast("bigint"), F.col("total").cast("bigint"))


@query("progress_reports")
def q_progress_reports(spark, sf):
    return progress(spark, sf).select("job_id", "seq", "step", F.col("current").cast("bigint"), F.col("total").cast("bigint"))


@query("latest_progress")
def q_latest_progress(spark, sf):
    return W.latest_progress(progress(spark, sf)).select("job_id", "step", F.col("current").cast("bigint"),
                                                         F.col("total").cast("bigint"), "last_seq")


# ---- C / D: routing, merging, previews ---------------------------------------

def conv_files(spark, sf):
    """Conversation turns as documents (member = (conv_id, turn))."""
    c = T(spark, sf, "conversations")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file_id"),
                    "conv_id", "turn", "text", F.lit("text/plain").alias("content_type"))


def routed_files(spark, sf):
    """Documents and pages as objects, content types as a client would send them."""
    d = T(spark, sf, "documents")
    ct = (F.when(F.col("source").endswith("7"), F.lit("application/pdf"))
           .when(F.col("source").endswith("3"), F.lit("image/png"))
           .when(F.col("lang") == "de", F.lit("application/vnd.oasis.opendocument.text"))
           .otherwise(F.lit("text/plain")))
    docs = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"),
                    ct.alias("content_type"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    pages = T(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("file_id"),
        F.lit("text/html").alias("content_type"), F.octet_length("html").cast("bigint").alias("size_bytes"))
    return docs.unionByName(pages)


@query("route_conversion")
def q_route_conversion(spark, sf):
    return P.route_conversion(routed_files(spark, sf)).select("file_id", "content_type", "route")


@query("route_summary")
def q_route_summary(spark, sf):
    return P.route_summary(P.route_conversion(routed_files(spark, sf)))


@query("merge_documents")
def q_merge_documents(spark, sf):
    cf = conv_files(spark, sf)
    pages = P.paginate(cf, 400, id_col="file_id")
    # very short turns list an attachment that nobody stored
    lost = cf.filter(F.length("text") < 40).select("conv_id", (F.col("turn") + 1000).alias("turn"),
                                                         F.concat("file_id", F.lit("/attachment")).alias("file_id"))
    members = cf.select("conv_id", "turn", "file_id").unionByName(lost)
    m = P.merge_documents(members, pages, "conv_id", "turn", "file_id")
    return m.select("conv_id", "turn", F.col("member_page_no").cast("bigint"), "page_no", "page_text", "error")


def preview_requests(spark, sf):
    """One preview request per document; options vary with language and source."""
    d = T(spark, sf, "documents")
    fmt = (F.when(F.col("lang") == "en", "png").when(F.col("lang") == "de", "WebP")
            .when(F.col("lang") == "fr", "").otherwise("JPEG"))
    return d.select("doc_id", fmt.alias("format"),
                    F.when(F.col("source").endswith("1"), F.lit(0)).otherwise(F.lit(300)).cast("int").alias("width"),
                    F.when(F.col("source").endswith("2"), F.lit(-1)).otherwise(F.lit(72)).cast("int").alias("dpi"),
                    F.when(F.col("n_chars") > 5000, "all").otherwise("first").alias("pages"),
                    F.concat(F.lit("thumbs/"), F.col("doc_id").cast("string"), F.lit(".img")).alias("dest_key"))


def preview_plan_df(spark, sf):
    return P.plan_previews(P.page_counts(doc_pages(spark, sf), "doc_id"), preview_requests(spark, sf))


@query("preview_plan")
def q_preview_plan(spark, sf):
    return preview_plan_df(spark, sf).select(
        "doc_id", F.col("page_no").cast("bigint"), "format", "mime", F.col("width").cast("bigint"),
        F.col("dpi").cast("bigint"), "key", "error")


def previews(spark, sf):
    return P.preview_pages(doc_pages(spark, sf), preview_plan_df(spark, sf))


@query("previews_first")
def q_previews_first(spark, sf):
    return previews(spark, sf).filter(~F.col("all_pages")).select("doc_id", "key", "preview", "size_bytes")


@query("previews_all")
def q_previews_all(spark, sf):
    return previews(spark, sf).filter(F.col("all_pages")).select(
        "doc_id", F.col("page_no").cast("bigint"), "key", "preview", "size_bytes")


@query("preview_sizes")
def q_preview_sizes(spark, sf):
    return P.preview_sizes(previews(spark, sf))


# ---- H: ledger ----------------------------------------------------------------


LIST_TAGS = ["1-URGENT", "building"]


def submissions(spark, sf):
    o = T(spark, sf, "orders")
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select(F.col("o_orderkey").cast("string").alias("job_id"),
                    F.array(F.col("o_orderpriority"), F.lower("c_mktsegment")).alias("tags"),
                    F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
                     .otherwise(F.lit("")).alias("caller_user"),
                    F.col("o_orderdate").alias("created")))


def ledger_state(spark, sf):
    return L.job_state(L.events_as_ledger(T(spark, sf, "events")))


def job_requests(spark, sf):
    """Lookups / cancels by customers, in customer order (ids may repeat or be unknown)."""
    c = T(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("request_id"),
                    F.when(F.col("c_acctbal") < 0, F.lit(""))
                     .otherwise(F.floor(F.col("c_acctbal") / 50).cast("bigint").cast("string")).alias("job_id"))


@query("register_jobs")
def q_register_jobs(spark, sf):
    r = L.register_jobs(submissions(spark, sf))
    return r.select("job_id", "job_type", F.array_join("tags", ",").alias("tags"), "created")


@query("job_status")
def q_job_status(spark, sf):
    return ledger_state(spark, sf)


@query("get_jobs")
def q_get_jobs(spark, sf):
    return L.get_jobs(ledger_state(spark, sf), job_requests(spark, sf)).select(
        "request_id", "job_id", "status", "error")


@query("list_jobs")
def q_list_jobs(spark, sf):
    reg = L.register_jobs(submissions(spark, sf))
    out = L.list_jobs(reg, LIST_TAGS, limit=25, offset=10)
    return out.select("job_id", "created", F.array_join("tags", ",").alias("tags"))


@query("cancel_jobs")
def q_cancel_jobs(spark, sf):
    return L.cancel_jobs(ledger_state(spark, sf), job_requests(spark, sf)).select(
        "request_id", "job_id", "outcome")


@query("decode_results")
def q_decode_results(spark, sf):
    d = L.decode_results(q_results_json(spark, sf))
    pages = F.transform("thumbnail_pages", lambda p: F.concat_ws(
        ":", p["page_number"], p["destination"]["key"], p["size_bytes"]))
    return d.select("job_id", "op_name", "success", "error", "size_bytes", "clean", "detail",
                    F.sha2("markdown", 256).alias("md_sha256"), "html",
                    F.col("destination.bucket").alias("dest_bucket"), F.col("destination.key").alias("dest_key"),
                    F.col("destination.content_type").alias("dest_type"), F.array_join(pages, ",").alias("thumbs"))


@query("op_status")
def q_op_status(spark, sf):
    r = W.op_status(doc_run(spark, sf).results)
    return r.select("op_name", "op_type", "success", "error", F.col("n_ops").cast("bigint"))


# ---- B: more checks -------------------------------------------------------------

@query("check_destinations")
def q_check_destinations(spark, sf):
    """Destinations of the order jobs, plus jobs without a destination."""
    j = orders_jobs(spark, sf)
    d = j.dests.select("job_id", "name", F.struct("bucket", "key", "content_type").alias("destination"))
    none = (j.tags.select("job_id").join(j.dests.select("job_id").distinct(), "job_id", "left_anti")
            .select("job_id", F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("struct<bucket:string,key:string,content_type:string>").alias("destination")))
    r = V.check_destinations(d.unionByName(none), allowed_buckets=["out"])
    return r.select("job_id", "name", "dest_error")


REQUEST_BUCKETS = ["merge-in", "out", "src0", "src1", "src2", "web"]


@query("check_requests")
def q_check_requests(spark, sf):
    def dest(bucket, key):
        return F.struct(bucket.alias("bucket"), key.alias("key"))
    d = T(spark, sf, "documents")
    out = F.concat(F.lit("pdf/"), F.col("doc_id").cast("string"))
    conv = V.check_convert_requests(d.select(
        F.col("doc_id").cast("string").alias("request_id"), F.col("source").alias("bucket"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.when(F.col("lang") == "es", F.lit("")).otherwise(F.lit("text/plain")).alias("content_type"),
        F.when(F.col("lang") != "en", dest(F.when(F.col("lang") == "fr", "private").otherwise("out"), out))
         .alias("destination")), REQUEST_BUCKETS)
    o = T(spark, sf, "orders")
    li = T(spark, sf, "lineitem")
    members = li.select(F.col("l_orderkey").cast("string").alias("request_id"),
                        F.col("l_linenumber").alias("position"),
                        F.when(F.col("l_returnflag") == "A", F.lit("old")).otherwise(F.lit("merge-in")).alias("bucket"),
                        F.concat(F.lit("parts/"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("key"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    merge = V.check_merge_requests(
        o.select(F.col("o_orderkey").cast("string").alias("request_id"),
                 F.when(urgent, dest(F.lit("out"), F.lit("a/../b.pdf"))).alias("destination")),
        members, allowed_buckets=REQUEST_BUCKETS)
    p = T(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("request_id"), F.lit("web").alias("bucket"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("key"),
        F.when(F.col("url").contains("?"), dest(F.lit(""), F.lit("x")))
         .when(F.col("url").contains("#"), dest(F.lit("out"), F.lit(""))).alias("destination"),
        F.explode(F.array(*[F.lit(k) for k in ("scan", "thumbnail", "markdown")])).alias("kind"))
    single = V.check_file_requests(p, F.col("kind"), REQUEST_BUCKETS)
    look = V.check_job_requests(job_requests(spark, sf).select(
        F.col("request_id").cast("string").alias("request_id"), "job_id"))
    return (conv.select(F.lit("convert").alias("kind"), "request_id", "error")
            .unionByName(merge.select(F.lit("merge").alias("kind"), "request_id", "error"))
            .unionByName(single.select("kind", "request_id", "error"))
            .unionByName(look.select(F.lit("job").alias("kind"), "request_id", "error")))


@query("check_urls")
def q_check_urls(spark, sf):
    """Every page's URL as it is, and in forms that break each rule."""
    u = F.col("url")
    forms = {"as_is": u, "ftp": F.regexp_replace(u, "^https?", "ftp"), "no_host": F.regexp_replace(u, "//[^/]*", "//"),
             "blank": F.regexp_replace(u, "//", "//a b"), "port": F.regexp_replace(u, "//[^/]*", "//h:port"),
             "bracket": F.regexp_replace(u, "//[^/]*", "//[::1"), "escape": F.concat(F.split(u, "[?#]")[0], F.lit("%zz")),
             "newline": F.concat(u, F.lit("\n"))}
    p = T(spark, sf, "pages").select("page_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("form"), c.alias("url")) for n, c in forms.items()])).alias("f"))
    return V.check_urls(p.select("page_id", "f.form", "f.url")).select("page_id", "form", "scheme", "host", "url_error")


@query("url_hosts")
def q_url_hosts(spark, sf):
    r = V.url_hosts(V.check_urls(T(spark, sf, "pages").select("page_id", "url")))
    return r.select("host", F.col("n_urls").cast("bigint"), F.col("n_bad").cast("bigint"),
                    F.col("n_https").cast("bigint"))


# ---- I: streaming -------------------------------------------------------------


def _streamed(spark, sf, deliveries):
    landing = scratch_dir(spark, "submissions")
    for _ in range(deliveries):
        document_jobs_json(T(spark, sf, "documents")).write.mode("append").text(landing)
    q, out = ST.stream_jobs(ST.submissions(spark, landing), doc_files(spark, sf), bench_signatures(spark, sf),
                            page_chars=PAGE_CHARS)
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("stream_jobs")
def q_stream_jobs(spark, sf):
    return _streamed(spark, sf, 1)


@query("stream_jobs_repeated")
def q_stream_jobs_repeated(spark, sf):
    """Every job is delivered twice, and runs once."""
    return _streamed(spark, sf, 2)


@query("stream_job_state")
def q_stream_job_state(spark, sf):
    ledger = L.events_as_ledger(ST.stream_table(spark, sf, "events"))
    q, out = ST.stream_job_state(ledger)
    q.awaitTermination()
    return ST.read_job_state(spark, out)


def _snapshot(spark, sf):
    """The ledger appended in five parts, the third of them twice under its number, merged after every second."""
    root = scratch_dir(spark, "job-state")
    events = T(spark, sf, "events")
    for n in (0, 1, 2, 2, 3, 4):
        part = events.filter(F.pmod(F.col("event_id"), F.lit(5)) == n)
        SN.append(L.events_as_ledger(part), root, n, compact_every=2)
    return root


@query("job_snapshot")
def q_job_snapshot(spark, sf):
    return SN.read(spark, _snapshot(spark, sf))


@query("get_jobs_snapshot")
def q_get_jobs_snapshot(spark, sf):
    return SN.get_jobs(spark, _snapshot(spark, sf), job_requests(spark, sf)).select(
        "request_id", "job_id", "status", "error")


@query("cancel_jobs_repeated")
def q_cancel_jobs_repeated(spark, sf):
    """Every cancel request comes twice with its id: one of the two is accepted, the other finds the job final."""
    r = job_requests(spark, sf)
    return L.cancel_jobs(ledger_state(spark, sf), r.unionByName(r)).select("request_id", "job_id", "outcome")


# ---- J: user backend ------------------------------------------------------------


def _line_counter():
    """A user's page/line counter: one instance per task."""
    def count(text):
        if text is None:
            raise ValueError("no content")
        return {"n_lines": text.count("\n") + 1}
    return count


@query("apply_backend")
def q_apply_backend(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "text")
    out = apply_backend(d, _line_counter, ["text"],
                        TT.StructType([TT.StructField("n_lines", TT.LongType())]))
    return out.select("doc_id", "n_lines", "backend_error")
