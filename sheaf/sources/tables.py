"""Job batches derived from the driver tables, so that their size grows with them.

* ``document_jobs``: one pipeline document per row of `documents` (written as
  JSON and decoded again, which exercises A2). Two templates: the four-step
  README pipeline (scan, pdf, first-page thumb, text) and, for German
  documents, the same with an all-pages PNG thumbnail.
* ``order_jobs``: one job per order, one operation per line item. The rules
  below give every validation code a natural share of jobs at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import Jobs, explode_jobs, parse_jobs

def _empty():
    return F.struct()


def _op(name, inputs, scan=None, convert=None, merge=None, thumb=None, markdown=None):
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("name"),
        F.array(*[F.lit(i) for i in inputs]).alias("inputs"),
        (scan if scan is not None else none).alias("scan"),
        (convert if convert is not None else none).alias("convert_to_pdf"),
        (merge if merge is not None else none).alias("merge_pdfs"),
        (thumb if thumb is not None else none).alias("thumbnail"),
        (markdown if markdown is not None else none).alias("extract_markdown"),
    )


def page_jobs_json(pages: DataFrame) -> DataFrame:
    """job_json per web page. By its URL: with a query, two inputs are merged and the merged
    document scanned; with a fragment, an input is not there; else a scan comes first."""
    p = F.col("page_id").cast("string")
    query, fragment = F.col("url").contains("?"), F.col("url").contains("#")
    small = F.struct(F.lit(200).cast("int").alias("width"), F.lit(0).cast("int").alias("dpi"),
                     F.lit("png").alias("format"), F.lit("all").alias("pages"))
    plain = F.struct(F.lit(0).cast("int").alias("width"), F.lit(0).cast("int").alias("dpi"),
                     F.lit("").alias("format"), F.lit("").alias("pages"))

    def inp(name, key):
        return F.struct(F.lit(name).alias("name"), F.lit("web").alias("bucket"), key.alias("key"),
                        F.lit("text/html; charset=utf-8").alias("content_type"))
    key = F.concat(p, F.lit(".html"))
    merged = F.array(_op("md", ["page"], markdown=_empty()), _op("pdf", ["page"], convert=_empty()),
                     _op("both", ["pdf", "again"], merge=_empty()), _op("scan", ["both"], scan=_empty()),
                     _op("thumb", ["both"], thumb=plain))
    scanned = F.array(_op("scan", ["page"], scan=_empty()), _op("pdf", ["page"], convert=_empty()),
                      _op("thumb", ["pdf"], thumb=small))
    job = F.struct(
        F.concat(F.lit("page-"), p).alias("job_id"),
        F.when(query, F.array(inp("page", key), inp("again", key)))
         .when(fragment, F.array(inp("page", F.concat(p, F.lit(".gone")))))
         .otherwise(F.array(inp("page", key))).alias("inputs"),
        F.when(query, F.to_json(merged)).otherwise(F.to_json(scanned)).alias("operations"))
    # the two lists differ in their types: put together as JSON text
    return pages.select(F.concat(F.lit('{"job_id":"'), job["job_id"], F.lit('","inputs":'), F.to_json(job["inputs"]),
                                 F.lit(',"operations":'), job["operations"], F.lit("}")).alias("job_json"))


def document_jobs_json(documents: DataFrame) -> DataFrame:
    """job_json per document (string column), as a client would submit it."""
    d = F.col("doc_id").cast("string")
    all_pages = F.col("lang") == "de"
    fmt = F.when(all_pages, "png").otherwise("jpg")
    thumb = F.struct(
        F.when(all_pages, 200).otherwise(400).cast("int").alias("width"),
        F.lit(150).cast("int").alias("dpi"),
        fmt.alias("format"),
        F.when(all_pages, "all").otherwise("first").alias("pages"),
    )
    ref = lambda key, ct: F.struct(F.lit("out").alias("bucket"), key.alias("key"), ct.alias("content_type"))
    doc = F.struct(
        F.concat(F.lit("doc-"), d).alias("job_id"),
        F.array(F.struct(
            F.lit("doc").alias("name"), F.col("source").alias("bucket"),
            F.concat(F.col("lang"), F.lit("/"), d, F.lit(".txt")).alias("key"),
            F.lit("text/plain").alias("content_type"))).alias("inputs"),
        F.array(
            _op("scan", ["doc"], scan=_empty()),
            _op("pdf", ["doc"], convert=_empty()),
            _op("thumb", ["pdf"], thumb=thumb),
            _op("text", ["pdf"], markdown=_empty()),
        ).alias("operations"),
        F.create_map(
            F.lit("pdf"), ref(F.concat(F.lit("pdf/"), d, F.lit(".pdf")), F.lit("application/pdf")),
            F.lit("thumb"), ref(F.concat(F.lit("thumb/"), d, F.lit("."), fmt),
                                F.when(all_pages, "image/png").otherwise("image/jpeg")),
            F.lit("text"), ref(F.concat(F.lit("text/"), d, F.lit(".md")), F.lit("text/markdown")),
        ).alias("destinations"),
        F.array(F.col("lang"), F.col("source")).alias("tags"),
    )
    return documents.select(F.to_json(doc).alias("job_json"))


def document_jobs(documents: DataFrame) -> Jobs:
    return explode_jobs(parse_jobs(document_jobs_json(documents)))


def order_jobs(orders: DataFrame, lineitem: DataFrame) -> Jobs:
    """Jobs at scale: job = order, operation = line item."""
    o = orders.select(F.col("o_orderkey").cast("string").alias("job_id"),
                      "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    k = F.col("o_orderkey").cast("string")
    first = o.select(
        "job_id", F.lit(0).alias("input_index"), F.lit("src").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "archive")
         .when(F.col("o_orderstatus") == "O", "inbox").otherwise("").alias("bucket"),
        F.concat(F.lit("orders/"), k, F.lit(".txt")).alias("key"),
        F.lit("text/plain").alias("content_type"))
    second = (o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
              .select("job_id", F.lit(1).alias("input_index"),
                      F.when(F.col("o_orderpriority") == "1-URGENT", "att").otherwise("src").alias("name"),
                      F.lit("inbox").alias("bucket"),
                      F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("att/../"), k))
                       .otherwise(F.concat(F.lit("att/"), k, F.lit(".bin"))).alias("key"),
                      F.lit("application/octet-stream").alias("content_type")))
    inputs = first.unionByName(second)

    n = F.col("l_linenumber")
    name = (F.when((n == 3) & (F.col("l_returnflag") == "R"), F.lit("src"))
             .when((n == 4) & (F.col("l_returnflag") == "A"), F.lit("s3"))
             .otherwise(F.concat(F.lit("s"), n.cast("string"))))
    typ = (F.when(n == 1, "scan")
            .when(F.col("l_discount") >= 0.095, F.lit(None).cast("string"))
            .when(F.col("l_returnflag") == "R", "convert_to_pdf")
            .when(F.col("l_returnflag") == "A", "thumbnail")
            .when(F.col("l_linestatus") == "O", "extract_markdown")
            .otherwise("merge_pdfs"))
    prev = F.concat(F.lit("s"), (n - 1).cast("string"))
    refs = (F.when(n == 1, F.array(F.lit("src")))
             .when(F.col("l_quantity") >= 49, F.array(F.concat(F.lit("s"), (n + 1).cast("string"))))
             .when(typ == "merge_pdfs", F.array(F.lit("src"), prev))
             .otherwise(F.array(prev)))
    thumb = typ == "thumbnail"
    ops = lineitem.select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        (n - 1).cast("int").alias("op_index"),
        name.alias("op_name"), typ.alias("op_type"), refs.alias("inputs"),
        F.when(thumb, (F.col("l_quantity") * 10).cast("int")).alias("width"),
        F.when(thumb, F.lit(150)).alias("dpi"),
        F.when(thumb, F.lit("png")).alias("format"),
        F.when(thumb, F.when(F.col("l_linestatus") == "F", "all").otherwise("first")).alias("pages"))

    dest1 = o.select("job_id", F.lit("s1").alias("name"), F.lit("out").alias("bucket"),
                     F.concat(F.lit("out/"), k, F.lit(".pdf")).alias("key"),
                     F.lit("application/pdf").alias("content_type"))
    dest2 = (o.filter(F.col("o_orderpriority") == "3-MEDIUM")
             .select("job_id", F.lit("report").alias("name"), F.lit("out").alias("bucket"),
                     F.concat(F.lit("out/"), k, F.lit(".md")).alias("key"),
                     F.lit("text/markdown").alias("content_type")))
    dests = dest1.unionByName(dest2)
    tags = o.select("job_id", F.array(F.col("o_orderpriority")).alias("tags"))
    return Jobs(inputs, ops, dests, tags)
