"""Explicit schemas of the data model; nothing is inferred."""

from pyspark.sql import types as T

FILE_REF = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("content_type", T.StringType()),
])

FILE_INPUT = T.StructType([T.StructField("name", T.StringType())] + FILE_REF.fields)

THUMBNAIL_OP = T.StructType([
    T.StructField("width", T.IntegerType()),
    T.StructField("dpi", T.IntegerType()),
    T.StructField("format", T.StringType()),
    T.StructField("pages", T.StringType()),
])

EMPTY = T.StructType([])

OPERATION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("inputs", T.ArrayType(T.StringType())),
    T.StructField("scan", EMPTY),
    T.StructField("convert_to_pdf", EMPTY),
    T.StructField("merge_pdfs", EMPTY),
    T.StructField("thumbnail", THUMBNAIL_OP),
    T.StructField("extract_markdown", EMPTY),
])

# A pipeline document (one JSON object per job).
JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("inputs", T.ArrayType(FILE_INPUT)),
    T.StructField("operations", T.ArrayType(OPERATION)),
    T.StructField("destinations", T.MapType(T.StringType(), FILE_REF)),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# Structured document: only the fields chunking needs.
STRUCTURE_SCHEMA = T.StructType([
    T.StructField("texts", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("prov", T.ArrayType(T.StructType([
            T.StructField("page_no", T.IntegerType())]))),
        T.StructField("headings", T.ArrayType(T.StringType())),
    ]))),
])

# One operation result as stored in a job's output JSON.
RESULT_SCHEMA = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("scan", T.StructType([
        T.StructField("clean", T.BooleanType()),
        T.StructField("detail", T.StringType())])),
    T.StructField("markdown", T.StructType([
        T.StructField("markdown", T.StringType()),
        T.StructField("html", T.StringType())])),
    T.StructField("thumbnail_pages", T.ArrayType(T.StructType([
        T.StructField("page_number", T.IntegerType()),
        T.StructField("destination", FILE_REF),
        T.StructField("size_bytes", T.LongType())]))),
    T.StructField("destination", FILE_REF),
    T.StructField("size_bytes", T.LongType()),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("results", T.MapType(T.StringType(), RESULT_SCHEMA)),
])

# Ledger events (append only).
JOB_EVENT_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("current", T.IntegerType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

OP_TYPES = ("scan", "convert_to_pdf", "merge_pdfs", "thumbnail", "extract_markdown")
