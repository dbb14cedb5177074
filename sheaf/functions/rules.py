"""Row-level rules as column expressions: errors are data (NULL = fine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes of the reference checks, in the order they are tested.
BUCKET_REQUIRED = "BUCKET_REQUIRED"
BUCKET_NOT_ALLOWED = "BUCKET_NOT_ALLOWED"
KEY_REQUIRED = "KEY_REQUIRED"
KEY_TRAVERSAL = "KEY_TRAVERSAL"


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def ref_error(bucket: Column, key: Column, allowed: Column | None = None) -> Column:
    """First failing rule of a bucket/key pair.

    ``allowed`` is a boolean column telling whether the bucket is on the
    allow-list; None means no list (every bucket allowed).
    """
    ladder = [F.when(blank(bucket), F.lit(BUCKET_REQUIRED))]
    if allowed is not None:
        ladder.append(F.when(~F.coalesce(allowed, F.lit(False)), F.lit(BUCKET_NOT_ALLOWED)))
    ladder += [
        F.when(blank(key), F.lit(KEY_REQUIRED)),
        F.when(key.contains(".."), F.lit(KEY_TRAVERSAL)),
    ]
    return F.coalesce(*ladder)


def image_mime(fmt: Column) -> Column:
    """MIME type of a preview format, case-insensitive, unknown -> jpeg."""
    f = F.lower(F.coalesce(fmt, F.lit("")))
    # Format -> MIME type.
    return (F.when(f == "png", "image/png")
             .when(f == "webp", "image/webp")
             .otherwise("image/jpeg"))


def conversion_route(content_type: Column) -> Column:
    """image/* -> image, exactly application/pdf -> passthrough, else office."""
    ct = F.coalesce(content_type, F.lit(""))
    return (F.when(ct.startswith("image/"), "image")
             .when(ct == "application/pdf", "passthrough")
             .otherwise("office"))
