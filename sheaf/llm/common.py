"""Helpers the training-data operators share: task code shipping, scratch tables, batches."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sheaf
from sheaf.session import checkpoint_root

PIECE_BYTES = 4 << 20  # text handled at once inside a task


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per session (as --py-files would)."""
    sc = spark.sparkContext
    if getattr(sc, "_sheaf_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(sheaf.__file__)))
    folder = tempfile.mkdtemp(prefix="sheaf-code-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "sheaf"), "zip", root, "sheaf"))
    sc._sheaf_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (whatever other columns there are); a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later plans start there, so the
    shuffle files of the write are dropped as soon as it is done."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def mod_of_crc(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str)
                              else doc_id.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = PIECE_BYTES, size: str | None = None) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about ``limit`` bytes of text each (one row at least).

    size: a column with each row's bytes, where the text itself is packed.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        each = batch.column(size) if size else pa.compute.binary_length(batch.column(column)).fill_null(0)
        sizes = np.cumsum(np.asarray(each, dtype=np.int64))
        at = 0
        while at < n:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as ``z``, compressed on its own, and its bytes as ``n``: what waits on disk for a join is smaller."""
    codec = pa.Codec("zstd")
    for batch in pieces(batches):
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array([len(r) for r in raw], pa.int64()),
             pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], [*names, "n", "z"])


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, with the text again (as bytes) for n and z."""
    codec = pa.Codec("zstd")
    for batch in pieces(batches, limit=limit, size="n"):
        raw = [codec.decompress(z, n, asbytes=True) if n else b""
               for z, n in zip(batch.column("z").to_pylist(), batch.column("n").to_pylist())]
        names = [c for c in batch.schema.names if c not in ("n", "z")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(raw, pa.large_binary())],
                                         [*names, "text"])


def row_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole rows (struct ``row``) with the row's text, or '', as column ``text`` beside
    the others: made inside the task, so that texts do not travel twice."""
    for batch in batches:
        text = batch.column("row").field("text").fill_null("")
        yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit hash per pair (order counts)."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(salt) + (a >> np.uint64(29)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def windows(a: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive values of a (len(a) - n + 1 of them), by doubling."""
    if len(a) < n:
        return np.zeros(0, np.uint64)
    out, width, level, size = None, 0, a, 1
    rest = n
    while rest:
        if rest & 1:
            keep = len(a) - width - size + 1
            out = level[:keep] if out is None else mix(out[:keep], level[width:width + keep], salt + size)
            width += size
        rest >>= 1
        if rest:
            level = mix(level[:-size], level[size:], salt + size)
            size *= 2
    return out


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    size = 1
    while size * 2 <= n:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:len(a) - (n - size)], a[n - size:]) if n > size else a
