"""A1: files as rows, with the size cap kept as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: default download cap (256 MiB); a cap <= 0 means the default.
DEFAULT_MAX_BYTES = 256 << 20
TOO_LARGE = "TOO_LARGE"


def effective_cap(max_bytes: int | None) -> int:
    return DEFAULT_MAX_BYTES if not max_bytes or max_bytes <= 0 else int(max_bytes)


# Tables whose rows carry whole texts: per-row work on them is CPU-heavy.
SPREAD_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores.

    A file written as one row group is one scan task; text work (regex
    chains, scans) would then run on one core. At scale a scan has thousands
    of partitions and this is a no-op.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as it is
        return df
    return df.repartition(cores) if parts < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df


def files_from_documents(documents: DataFrame) -> DataFrame:
    """`documents` as objects: bucket = source, key = lang/doc_id.txt."""
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("bucket"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.lit("text/plain").alias("content_type"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("text"),
    )


def files_from_pages(pages: DataFrame) -> DataFrame:
    """`pages` as objects in bucket `web`, key page_id.html."""
    return pages.select(
        F.col("page_id").alias("file_id"),
        F.lit("web").alias("bucket"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("key"),
        F.lit("text/html").alias("content_type"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.col("html").alias("text"),
    )


def cap_sizes(files: DataFrame, max_bytes: int | None = None,
              content_col: str = "text") -> DataFrame:
    """Mark rows larger than the cap (equal is allowed) and drop their content.

    No row is removed: an oversize file keeps its row with error TOO_LARGE.
    """
    cap = effective_cap(max_bytes)
    too_big = F.col("size_bytes") > F.lit(cap)
    return (files
            .withColumn("error", F.when(too_big, F.lit(TOO_LARGE)))
            .withColumn(content_col, F.when(~too_big, F.col(content_col))))


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None,
               glob: str | None = None) -> DataFrame:
    """Binary files under ``path``; content is read only for files within the cap.

    One listing, two scans of it: the `length` predicate of each is pushed to
    the binaryFile source, so oversize files are never opened.
    """
    cap = effective_cap(max_bytes)
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listing = reader.load(path)  # one file listing, shared by both branches
    small = (listing.filter(F.col("length") <= cap)
             .select("path", F.col("length").alias("size_bytes"), "content",
                     F.lit(None).cast("string").alias("error")))
    big = (listing.filter(F.col("length") > cap)
           .select("path", F.col("length").alias("size_bytes"),
                   F.lit(None).cast("binary").alias("content"),
                   F.lit(TOO_LARGE).alias("error")))
    return small.unionByName(big)
