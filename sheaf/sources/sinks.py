"""A3-A5: writing artifacts and planning where each one goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import page_key


def write_artifacts(df: DataFrame, root: str, partition_col: str = "bucket") -> None:
    """A3: one parquet dataset partitioned by bucket.

    Dynamic partition overwrite replaces only the buckets present, so a re-run
    (or a retried task) gives the same files.
    """
    (df.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(root))


def write_structure(df: DataFrame, path: str, json_col: str = "structure_json", id_col: str | None = None) -> None:
    """A5: one structured document per line; with ``id_col``, a JSON object of its id and the document."""
    if id_col is None:
        df.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)
    else:
        df.select(id_col, json_col).write.mode("overwrite").json(path)


def upload_plan(dests: DataFrame, artifacts: DataFrame, artifact_pages: DataFrame) -> DataFrame:
    """A4: which artifact goes to which key.

    ``dests``: job_id, name, bucket, key, content_type.
    ``artifacts``: job_id, name, n_pages (pages of a multi-page preview, else
    NULL), size_bytes, source ('input' or 'op').
    ``artifact_pages``: job_id, name, page_no, size_bytes for multi-page previews.
    A destination without an artifact (scan, Markdown, failed or skipped op) is
    skipped; more than one page -> one key per page ``base_NNN.ext``.
    """
    d = dests.join(artifacts, ["job_id", "name"], "inner")
    multi = F.coalesce(F.col("n_pages"), F.lit(0)) > 1
    single = (d.filter(~multi)
              .select("job_id", "name", F.lit(None).cast("int").alias("page_no"), "bucket", "key",
                      "content_type", "size_bytes", "source"))
    paged = (d.filter(multi).drop("size_bytes")
             .join(artifact_pages, ["job_id", "name"], "inner")
             .select("job_id", "name", F.col("page_no").cast("int"), "bucket",
                     page_key(F.col("key"), F.col("page_no")).alias("key"),
                     "content_type", "size_bytes", "source"))
    return single.unionByName(paged)
