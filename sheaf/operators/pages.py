"""Documents as ordered page tables, merging and previews.

A converted document is a table of pages (doc_id, page_no, page_text): pages
can be counted, merged in a listed order, selected and previewed without
gathering a document into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import page_key
from ..functions.rules import conversion_route, image_mime
from ..functions.text import chunks
from ..functions.windows import running_sum

DEFAULT_PAGE_CHARS = 1800

# Preview defaults (format, width, dpi).
DEFAULT_FORMAT = "jpg"
DEFAULT_WIDTH = 400
DEFAULT_DPI = 150
NO_PAGES = "NO_PAGES"
MEMBER_MISSING = "MEMBER_MISSING"
NO_MEMBERS = "NO_MEMBERS"


def route_conversion(files: DataFrame, type_col: str = "content_type") -> DataFrame:
    """image/* -> image, application/pdf -> passthrough, rest -> office."""
    return files.withColumn("route", conversion_route(F.col(type_col)))


def route_summary(routed: DataFrame) -> DataFrame:
    return (routed.groupBy("route")
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.sum("size_bytes").cast("bigint").alias("total_bytes")))


def paginate(files: DataFrame, page_chars: int = DEFAULT_PAGE_CHARS,
             id_col: str = "file_id", text_col: str = "text",
             type_col: str | None = "content_type", existing: DataFrame | None = None) -> DataFrame:
    """Every readable file becomes >= 1 pages of ``page_chars`` characters.

    An image is one page. The pages of a file concatenate to its text.
    Rows without content (NULL text, e.g. over the size cap) give no pages.

    With ``existing`` (id, page_no, page_text; numbers from 1) files of the route
    passthrough are never cut: they keep the pages they have there, text or not,
    and one without any has no pages (an error row of ``page_counts``). Pages of
    files of another route, or of no file, are ignored.
    """
    if existing is not None:
        if type_col is None:
            raise ValueError("existing pages are kept by content type")
        through = conversion_route(F.col(type_col)) == "passthrough"
        kept = (existing.join(files.filter(through).select(id_col), id_col, "left_semi")
                .select(id_col, F.col("page_no").cast("int").alias("page_no"), "page_text"))
        return paginate(files.filter(~through), page_chars, id_col, text_col, type_col).unionByName(kept)
    img = (conversion_route(F.col(type_col)) == "image") if type_col is not None else F.lit(False)
    pages = F.when(img, F.array(F.col(text_col))).otherwise(chunks(F.col(text_col), page_chars))
    return (files.filter(F.col(text_col).isNotNull())
            .select(F.col(id_col), F.posexplode(pages).alias("pos", "page_text"))
            .select(id_col, (F.col("pos") + 1).cast("int").alias("page_no"), "page_text"))


def page_counts(page_table: DataFrame, id_col: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """C4: pages and bytes per document (partial aggregation, skew-safe).

    With ``documents`` (a table with the id) each of its rows is answered: a document whose
    pages cannot be counted, for it has none, is a row with error NO_PAGES and null numbers.
    """
    if documents is not None:
        counts = page_counts(page_table, id_col)
        return (documents.select(id_col).join(counts, id_col, "left")
                .withColumn("error", F.when(F.col("n_pages").isNull(), F.lit(NO_PAGES))))
    return (page_table.groupBy(id_col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_pages"),
                 F.sum(F.octet_length("page_text")).cast("bigint").alias("size_bytes")))


def merge_documents(members: DataFrame, page_table: DataFrame, group_col: str,
                    pos_col: str, member_col: str, page_id_col: str | None = None,
                    groups: DataFrame | None = None) -> DataFrame:
    """Concatenate member documents of each group in the listed order.

    ``members`` has (group, pos, member); ``page_table`` has (member, page_no,
    page_text). Merged page number = pages of earlier members + own page_no.
    The offsets are a running sum over member page counts, computed in blocks
    so that one enormous group is not a single window task; page text is never
    gathered. One member -> its pages unchanged.

    A member without pages fails its group: the group has no pages, only a row
    with error MEMBER_MISSING for each such member. With ``groups`` (a table with
    the group column) a group without members has a row with error NO_MEMBERS.
    """
    pid = page_id_col or member_col
    counts = page_counts(page_table.withColumnRenamed(pid, "__m"), "__m")
    m = (members.select(group_col, pos_col, F.col(member_col).alias("__m"))
         .join(counts.select("__m", "n_pages"), "__m", "left"))
    failed = m.filter(F.col("n_pages").isNull())
    whole = m.join(failed.select(group_col).distinct(), group_col, "left_anti")
    whole = running_sum(whole, group_col, pos_col, "n_pages", "page_offset")
    pages = page_table.withColumnRenamed(pid, "__m")
    none_i, none_l, none_s = (F.lit(None).cast(t) for t in ("int", "bigint", "string"))

    def error_rows(df, pos, member, code):
        return df.select(group_col, pos.alias(pos_col), member.alias(member_col), none_i.alias("member_page_no"),
                         none_l.alias("page_no"), none_s.alias("page_text"), F.lit(code).alias("error"))
    out = (whole.join(pages, "__m", "inner")
           .select(group_col, pos_col, F.col("__m").alias(member_col),
                   F.col("page_no").cast("int").alias("member_page_no"),
                   (F.col("page_offset") + F.col("page_no")).cast("bigint").alias("page_no"),
                   "page_text", none_s.alias("error"))
           .unionByName(error_rows(failed, F.col(pos_col), F.col("__m"), MEMBER_MISSING)))
    if groups is not None:
        empty = groups.select(group_col).distinct().join(members.select(group_col), group_col, "left_anti")
        out = out.unionByName(error_rows(empty, F.lit(None).cast(members.schema[pos_col].dataType),
                                         F.lit(None).cast(members.schema[member_col].dataType), NO_MEMBERS))
    return out


def plan_previews(counts: DataFrame, requests: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Which pages to preview, with defaults, MIME type and page keys.

    ``requests``: id, format, width, dpi, pages ('all' or anything else = first),
    dest_key (nullable). ``counts``: id, n_pages. 'all' explodes 1..n and keys
    each page ``base_NNN.ext``; otherwise page 1 with the plain key. A document
    without pages keeps one row with error NO_PAGES.
    """
    fmt = F.when(F.coalesce(F.col("format"), F.lit("")) == "", F.lit(DEFAULT_FORMAT)).otherwise(F.col("format"))
    width = F.when(F.coalesce(F.col("width"), F.lit(0)) <= 0, F.lit(DEFAULT_WIDTH)).otherwise(F.col("width"))
    dpi = F.when(F.coalesce(F.col("dpi"), F.lit(0)) <= 0, F.lit(DEFAULT_DPI)).otherwise(F.col("dpi"))
    all_pages = F.coalesce(F.col("pages"), F.lit("")) == "all"
    n = F.coalesce(F.col("n_pages"), F.lit(0))
    sel = (F.when(n <= 0, F.array(F.lit(None).cast("int")))
            .when(all_pages, F.sequence(F.lit(1), n.cast("int")))
            .otherwise(F.array(F.lit(1))))
    planned = (requests.join(counts.select(id_col, "n_pages"), id_col, "left")
               .select(id_col, fmt.alias("format"), image_mime(fmt).alias("mime"),
                       width.cast("int").alias("width"), dpi.cast("int").alias("dpi"),
                       all_pages.alias("all_pages"), "dest_key", n.alias("n_pages"),
                       F.explode(sel).alias("page_no")))
    return (planned
            .withColumn("key", F.when(F.col("all_pages"), page_key(F.col("dest_key"), F.col("page_no")))
                        .otherwise(F.col("dest_key")))
            .withColumn("error", F.when(F.col("page_no").isNull(), F.lit(NO_PAGES))))


def preview_pages(page_table: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Preview of each planned page = its first ``width`` characters."""
    pages = page_table.select(id_col, "page_no", "page_text")
    return (plan.join(pages, [id_col, "page_no"], "left")
            .withColumn("preview", F.substring("page_text", 1, F.col("width")))
            .withColumn("size_bytes", F.octet_length("preview").cast("bigint"))
            .drop("page_text"))


def preview_sizes(previews: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: previews made, size of page 1 (the document's size), total."""
    return (previews.groupBy(id_col)
            .agg(F.count("preview").cast("bigint").alias("n_previews"),
                 F.sum(F.when(F.col("page_no") == 1, F.col("size_bytes"))).cast("bigint").alias("first_size"),
                 F.sum("size_bytes").cast("bigint").alias("total_size")))
