"""Markdown, clean HTML, structure, image modes and chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.windows import running_values
from ..schema import STRUCTURE_SCHEMA

DEFAULT_PAGE_CHARS = 1800
BLOCK_SEP = "\n\n"
HEADER_RE = r"^#{1,6} "
ITEM_RE = r"^- "
LEVELS = range(1, 7)
MAX_LENGTH = (1 << 31) - 1
INVALID_JSON = "INVALID_JSON"


def extract_markdown(df: DataFrame, html_col: str = "html", out: str = "markdown",
                     image_mode: str | None = None) -> DataFrame:
    """HTML -> Markdown by the ordered rewrite chain; links keep their targets."""
    return df.withColumn(out, H.to_markdown(html_col, image_mode))


def extract_html(df: DataFrame, html_col: str = "html", out: str = "clean_html",
                 image_mode: str | None = None) -> DataFrame:
    """HTML without comments, head, scripts, styles, navigation, footer, ads."""
    return df.withColumn(out, H.clean_html(html_col, image_mode))


def apply_image_mode(df: DataFrame, html_col: str = "html", mode: str | None = None,
                     out: str | None = None) -> DataFrame:
    """Placeholder (default), embedded (as is) or referenced images."""
    return df.withColumn(out or html_col, H.apply_image_mode(html_col, mode))


def structure_blocks(df: DataFrame, id_col: str, md_col: str = "markdown",
                     page_chars: int = DEFAULT_PAGE_CHARS) -> DataFrame:
    """Markdown -> ordered blocks with label, heading, path of headings and page number.

    Blocks are split on blank lines. Label: '#'.. header -> section_header,
    '- ' -> list_item, else text (marker removed). Headings = the open headers at
    the block, outermost first: a header closes all of its own and of deeper
    levels. Heading = the innermost one, itself for a header; null, and an empty
    path, before the first. Page = block start offset // page_chars + 1. The path
    is made of the last header of each level, a running value like the offset;
    both are computed in bounded blocks (one huge document is no problem).
    """
    blocks = (df.select(id_col, F.posexplode(F.split(F.col(md_col), BLOCK_SEP, -1)).alias("pos", "raw"))
              .withColumn("pos", F.col("pos").cast("bigint")))
    is_h = F.col("raw").rlike(HEADER_RE)
    is_li = F.col("raw").rlike(ITEM_RE)
    label = F.when(is_h, "section_header").when(is_li, "list_item").otherwise("text")
    text = (F.when(is_h, F.regexp_replace("raw", HEADER_RE, "")).when(is_li, F.regexp_replace("raw", ITEM_RE, ""))
            .otherwise(F.col("raw")))
    header = {f"__l{k}": F.when(F.col("raw").startswith("#" * k + " "), F.struct("pos", F.substring("raw", k + 2, MAX_LENGTH).alias("text")))
              for k in LEVELS}
    blocks = running_values(blocks, id_col, "pos", sums={"start": (F.length("raw") + len(BLOCK_SEP)).cast("bigint")}, lasts=header)
    blocks = blocks.withColumns({"label": label, "text": text})
    return blocks.select(id_col, "pos", "label", "text", _open_headings().alias("headings"),
                         F.try_element_at(_open_headings(), F.lit(-1)).alias("heading"),
                         (F.floor(F.col("start") / page_chars) + 1).cast("int").alias("page_no"))


def _open_headings():
    """The texts of the last headers of all levels, without those that a header of a lower level followed."""
    path = []
    for k in LEVELS:
        closed = [F.coalesce(F.col(f"__l{j}.pos") > F.col(f"__l{k}.pos"), F.lit(False)) for j in range(1, k)]
        path.append(F.when(~reduce(lambda a, b: a | b, closed, F.lit(False)), F.col(f"__l{k}.text")))
    return F.array_compact(F.array(*path))


def structure_json(blocks: DataFrame, id_col: str, out: str = "structure_json") -> DataFrame:
    """One JSON document per id, items in block order.

    This is the one place a document's blocks meet in one row: the output is
    one JSON value per document by definition.
    """
    item = F.struct(
        F.col("pos"),
        F.struct(F.col("text"), F.col("label"),
                 F.array(F.struct(F.col("page_no").alias("page_no"))).alias("prov"),
                 F.col("headings")).alias("item"))
    return (blocks.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(item)).alias("__items"))
            .select(id_col, F.to_json(F.struct(
                F.transform("__items", lambda x: x["item"]).alias("texts"))).alias(out)))


def _parse_structure(j):
    """One permissive parse: the document, a stored service reply wrapping it
    under document.json_content, and the raw text when it does not decode
    (malformed, or the wrong shape, as a strict decoder would refuse)."""
    from pyspark.sql import types as T
    schema = T.StructType(STRUCTURE_SCHEMA.fields + [
        T.StructField("document", T.StructType([T.StructField("json_content", STRUCTURE_SCHEMA)])),
        T.StructField("_corrupt_record", T.StringType())])
    return F.from_json(j, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def _empty_payload(j):
    t = F.trim(j)
    return j.isNull() | (t == "") | (t == "{}") | (t == "null")


def parse_chunks(df: DataFrame, id_col: str, json_col: str = "structure_json") -> DataFrame:
    """E5: structured JSON -> chunk rows (see ``chunk_errors`` for bad payloads).

    Empty, '{}' or 'null' -> no chunks. A stored service reply with the
    document under document.json_content is unwrapped. Items with empty text
    are dropped but keep their original index. Page = first prov's page (else
    0); heading = last of the list (else '').
    """
    j = F.col(json_col)
    d = (df.select(id_col, _empty_payload(j).alias("__empty"), _parse_structure(j).alias("__p"))
         .filter(~F.col("__empty") & F.col("__p._corrupt_record").isNull()))
    texts = F.coalesce(F.col("__p.document.json_content.texts"), F.col("__p.texts"))
    items = d.select(id_col, F.posexplode(texts).alias("chunk_index", "t"))
    return (items.filter(F.col("t.text").isNotNull() & (F.col("t.text") != ""))
            .select(id_col,
                    F.col("chunk_index").cast("int").alias("chunk_index"),
                    F.col("t.label").alias("chunk_type"),
                    F.coalesce(F.try_element_at(F.col("t.prov"), F.lit(1))["page_no"], F.lit(0))
                     .cast("int").alias("page_number"),
                    F.coalesce(F.try_element_at(F.col("t.headings"), F.lit(-1)), F.lit("")).alias("heading"),
                    F.col("t.text").alias("chunk_text")))


def chunk_errors(df: DataFrame, id_col: str, json_col: str = "structure_json") -> DataFrame:
    """Documents whose payload does not decode (the rows that give no chunks)."""
    j = F.col(json_col)
    return (df.select(id_col, _empty_payload(j).alias("__empty"), _parse_structure(j).alias("__p"))
            .filter(~F.col("__empty") & F.col("__p._corrupt_record").isNotNull())
            .select(id_col, F.lit(INVALID_JSON).alias("chunk_error")))
