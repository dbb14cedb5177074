"""A1, A3: objects by bucket and key, written one by one and read in ranges.

``put_objects`` writes each row's bytes as the object ``<root>/<bucket>/<key>`` through the
``objects`` data source. A task writes an object beside its place and moves it there whole, so
a reader never sees half of one, and a task that runs again writes the same objects again. What
became of each row goes into a report, whose parts count only once the whole write is committed:
a row that cannot be written (no bytes, a bad key, an error of the file system) is an error row
there and harms no other row.

``read_ranges`` lists objects and reads them by (path, offset, length): no task holds more than a
range of an object, however large it is. ``read_lines`` gives the lines of text objects, each with
the range it starts in.

Files are reached through pyarrow's file systems (local, hdfs, s3, gcs), inside tasks only.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import scratch_dir, ship, stored
from .files import DEFAULT_MAX_BYTES

NO_CONTENT = "NO_CONTENT"
BAD_KEY = "BAD_KEY"
DUPLICATE_KEY = "DUPLICATE_KEY"
WRITE_FAILED = "WRITE_FAILED"

OBJECT_SCHEMA = "bucket string, key string, content binary"
REPORT_SCHEMA = "bucket string, key string, size_bytes bigint, error string"
RANGE_BYTES = 64 << 20
LOOK_AHEAD = 1 << 16  # bytes read at once behind a range, for the end of its last line

_REPORT = pa.schema([("bucket", pa.string()), ("key", pa.string()), ("size_bytes", pa.int64()), ("error", pa.string())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    fs, top = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return fs, posixpath.join(top or "/", path)


def _bad(name: str | None) -> bool:
    parts = (name or "").split("/")
    return "" in parts or "." in parts or ".." in parts or "\0" in (name or "")


class _Written(WriterCommitMessage):
    def __init__(self, part: str | None):
        self.part = part


class _ObjectWriter(DataSourceArrowWriter):
    """One report part a task; the parts move to their place when the whole write is committed."""

    def __init__(self, root: str, report: str):
        self.root, self.report = root, report

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.root)
        report_fs, report = file_system(self.report)
        part = f"{report}/_pending/{uuid.uuid4().hex}.parquet"
        report_fs.create_dir(posixpath.dirname(part), recursive=True)
        with pq.ParquetWriter(part, _REPORT, filesystem=report_fs) as out:
            for batch in iterator:
                rows = [batch.column(c) for c in ("bucket", "key", "content")]
                done = [self._put(fs, root, *[column[i].as_py() for column in rows]) for i in range(batch.num_rows)]
                out.write_batch(pa.RecordBatch.from_pylist(done, schema=_REPORT))
        return _Written(part)

    def _put(self, fs: pafs.FileSystem, root: str, bucket: str | None, key: str | None, content: bytes | None) -> dict:
        row = {"bucket": bucket, "key": key, "size_bytes": None, "error": None}
        if _bad(key) or _bad(bucket) or "/" in bucket:
            return {**row, "error": BAD_KEY}
        if content is None:
            return {**row, "error": NO_CONTENT}
        place = f"{root}/{bucket}/{key}"
        beside = f"{root}/_writing/{uuid.uuid4().hex}"
        try:
            fs.create_dir(posixpath.dirname(beside), recursive=True)
            with fs.open_output_stream(beside) as f:
                f.write(content)
            fs.create_dir(posixpath.dirname(place), recursive=True)
            fs.move(beside, place)
        except OSError:
            if fs.get_file_info(beside).type == pafs.FileType.File:
                fs.delete_file(beside)
            return {**row, "error": WRITE_FAILED}
        return {**row, "size_bytes": len(content)}

    def commit(self, messages: list[_Written | None]) -> None:
        fs, report = file_system(self.report)
        for m in messages:
            if m is not None and m.part:
                fs.move(m.part, f"{report}/{posixpath.basename(m.part)}")
        with fs.open_output_stream(f"{report}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = file_system(self.report)
        for m in messages:
            if m is not None and m.part and fs.get_file_info(m.part).type == pafs.FileType.File:
                fs.delete_file(m.part)


class ObjectDataSource(DataSource):
    """``df.write.format("objects").option("root", ...).option("report", ...)``: columns of OBJECT_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return OBJECT_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ObjectWriter(self.options["root"].rstrip("/"), self.options["report"].rstrip("/"))


def put_objects(df: DataFrame, root: str, content_col: str = "content") -> DataFrame:
    """A3: each row's bytes (or text, as UTF-8) at bucket/key; returns (bucket, key, size_bytes, error), a row each.

    An object that is there already is replaced. Of rows with one key and different bytes the one with
    the greatest SHA-256 is written and the others are errors DUPLICATE_KEY; equal rows are written alike.
    Null bytes are an error NO_CONTENT; a null or empty bucket or key, and one with an empty, ``.`` or
    ``..`` part, BAD_KEY; what the file system refuses, WRITE_FAILED. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(ObjectDataSource)
    content = F.col(content_col).cast("binary")
    rows = df.select("bucket", "key", content.alias("content"))
    # the greatest hash of the few keys that have several; bytes themselves are not aggregated
    several = (rows.where("content is not null").select("bucket", "key", F.sha2("content", 256).alias("hash"))
               .groupBy("bucket", "key").agg(F.max("hash").alias("most"), F.min("hash").alias("least"))
               .where("most <> least").drop("least"))
    several = stored(several, "several")
    marked = rows.join(several, ["bucket", "key"], "left")
    later = F.col("most").isNotNull() & (F.sha2("content", 256) != F.col("most"))
    report = scratch_dir(spark, "report")
    (marked.where(~F.coalesce(later, F.lit(False))).select("bucket", "key", "content")
     .write.format("objects").option("root", root).option("report", report).mode("append").save())
    lost = marked.where(later).select("bucket", "key", F.lit(None).cast("bigint").alias("size_bytes"),
                                      F.lit(DUPLICATE_KEY).alias("error"))
    return spark.read.schema(REPORT_SCHEMA).parquet(report).unionByName(lost)


def list_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size_bytes) of all files under a folder; nothing is opened. Spark's listing leaves out empty files
    and names that begin with ``_`` or ``.``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size_bytes"))


def get_objects(spark: SparkSession, root: str, keys: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """(bucket, key, size_bytes, content, error) of the asked objects, each row of ``keys`` answered: NOT_FOUND
    where there is none, TOO_LARGE (without its bytes) over the cap."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root.rstrip("/"))
        for batch in batches:
            for bucket, key in zip(batch.column("bucket").to_pylist(), batch.column("key").to_pylist()):
                size, content, error = None, None, "NOT_FOUND"
                if not _bad(key) and not _bad(bucket):
                    info = fs.get_file_info(f"{top}/{bucket}/{key}")
                    if info.type == pafs.FileType.File:
                        size, error = info.size, None
                        if size > max_bytes:
                            error = "TOO_LARGE"
                        else:
                            with fs.open_input_stream(info.path) as f:
                                content = f.read()
                yield pa.RecordBatch.from_arrays(  # a batch each: one object is held at a time
                    [pa.array([bucket], pa.string()), pa.array([key], pa.string()), pa.array([size], pa.int64()),
                     pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    ["bucket", "key", "size_bytes", "content", "error"])

    return keys.select("bucket", "key").mapInArrow(run, "bucket string, key string, size_bytes bigint, content binary, error string")


def ranges(objects: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size_bytes, offset, length): the ranges of listed objects."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size_bytes") - 1, F.lit(range_bytes).cast("bigint"))
    cut = objects.where("size_bytes > 0").select("path", "size_bytes", F.explode(starts).alias("offset"))
    return (cut.withColumn("length", F.least(F.lit(range_bytes).cast("bigint"), F.col("size_bytes") - F.col("offset")))
            .repartition("path", "offset"))  # the ranges of one object go to many tasks


def read_ranges(objects: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A1: (path, offset, content): listed objects (``list_objects``) in ranges of at most ``range_bytes``."""
    ship(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, offset, length, _ in _each(batches):
            with _open(path) as f:
                f.seek(offset)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offset], pa.int64()), pa.array([f.read(length)], pa.binary())],
                                                 ["path", "offset", "content"])

    return ranges(objects, range_bytes).mapInArrow(run, "path string, offset bigint, content binary")


def read_lines(objects: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, line): the lines of listed UTF-8 text objects, with the place of their first byte.

    A line belongs to the range it starts in and is read to its end there. The end of the last line needs no
    line break; an empty line is a row; bytes that are no UTF-8 are replaced.
    """
    ship(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, offset, length, size in _each(batches):
            with _open(path) as f:
                f.seek(max(0, offset - 1))
                data = f.read(length + (offset > 0))
                # with the byte before the range, a line that starts at its first byte is seen to start there
                begin = 0 if offset == 0 else data.find(b"\n") + 1
                if offset and not begin:
                    continue  # the range is inside one line
                end = offset + length
                tail = []
                while end < size and not (tail[-1] if tail else data).endswith(b"\n"):
                    more = f.read(LOOK_AHEAD)
                    stop = more.find(b"\n")
                    tail.append(more if stop < 0 else more[:stop + 1])
                    end += len(tail[-1])
                lines = (data[begin:] + b"".join(tail)).split(b"\n")
            if lines[-1] == b"":
                lines.pop()  # behind the last line break no line starts in this range
            if lines:
                at, starts = max(0, offset - 1) + begin, []
                for line in lines:
                    starts.append(at)
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(lines)), pa.array(starts, pa.int64()),
                     pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())], ["path", "offset", "line"])

    return ranges(objects, range_bytes).mapInArrow(run, "path string, offset bigint, line string")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int]]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length", "size_bytes")])


def _open(path: str) -> pa.NativeFile:
    fs, place = file_system(path)
    return fs.open_input_file(place)
