"""A2: pipeline documents -> flat job tables (inputs, operations, destinations)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOB_SCHEMA


@dataclass
class Jobs:
    """The three flat tables of a batch of pipeline documents (+ tags)."""
    inputs: DataFrame   # job_id, input_index, name, bucket, key, content_type
    ops: DataFrame      # job_id, op_index, op_name, op_type, inputs, width, dpi, format, pages
    dests: DataFrame    # job_id, name, bucket, key, content_type
    tags: DataFrame     # job_id, tags
    docs: DataFrame | None = None  # the nested documents, when the jobs came from them


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Pipeline documents (JSON lines) with the explicit job schema."""
    return spark.read.schema(JOB_SCHEMA).json(path)


def parse_jobs(df: DataFrame, json_col: str = "job_json") -> DataFrame:
    """Decode a JSON string column into job structs (same schema as read_jobs)."""
    return df.select(F.from_json(F.col(json_col), JOB_SCHEMA).alias("j")).select("j.*")


def op_type(op: Column) -> Column:
    """First set type in this order: scan, convert, merge, thumbnail, markdown."""
    return F.coalesce(
        F.when(op["scan"].isNotNull(), F.lit("scan")),
        F.when(op["convert_to_pdf"].isNotNull(), F.lit("convert_to_pdf")),
        F.when(op["merge_pdfs"].isNotNull(), F.lit("merge_pdfs")),
        F.when(op["thumbnail"].isNotNull(), F.lit("thumbnail")),
        F.when(op["extract_markdown"].isNotNull(), F.lit("extract_markdown")),
    )


def explode_jobs(jobs: DataFrame) -> Jobs:
    """Nested job documents -> flat tables. Positions come from posexplode."""
    inputs = (jobs.select("job_id", F.posexplode("inputs").alias("input_index", "i"))
              .select("job_id", F.col("input_index").cast("int"),
                      "i.name", "i.bucket", "i.key", "i.content_type"))
    ops = (jobs.select("job_id", F.posexplode("operations").alias("op_index", "o"))
           .select("job_id", F.col("op_index").cast("int"),
                   F.col("o.name").alias("op_name"),
                   op_type(F.col("o")).alias("op_type"),
                   F.coalesce(F.col("o.inputs"), F.array().cast("array<string>")).alias("inputs"),
                   F.col("o.thumbnail.width").alias("width"),
                   F.col("o.thumbnail.dpi").alias("dpi"),
                   F.col("o.thumbnail.format").alias("format"),
                   F.col("o.thumbnail.pages").alias("pages")))
    dests = (jobs.select("job_id", F.explode("destinations").alias("name", "d"))
             .select("job_id", "name", "d.bucket", "d.key", "d.content_type"))
    tags = jobs.select("job_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return Jobs(inputs, ops, dests, tags, jobs)


def op_struct(o: Column, i: Column) -> Column:
    """Flat description of one operation (as in the ops table)."""
    return F.named_struct(
        F.lit("op_index"), i.cast("int"), F.lit("op_name"), o["name"],
        F.lit("op_type"), op_type(o),
        F.lit("inputs"), F.coalesce(o["inputs"], F.array().cast("array<string>")),
        F.lit("width"), o["thumbnail"]["width"], F.lit("dpi"), o["thumbnail"]["dpi"],
        F.lit("format"), o["thumbnail"]["format"], F.lit("pages"), o["thumbnail"]["pages"])
