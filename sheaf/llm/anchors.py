"""What the two operators on repeated passages share: content-defined anchors.

Every window of w symbols has its anchor, the least hash among the short grams
inside it. Equal windows have equal anchors, so rows grouped by anchor meet
all their equals, and a run of neighbouring windows with one anchor travels as
one row. An anchor that more than a quarter of a mean partition's rows share
is hot (counted over all documents; it only decides the route, never the
result): hot runs are taken apart into windows, which Spark counts with
partial aggregation. There are hardly more than four hot anchors a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLED = 1  # one document in so many is counted: all
PIECE = 1 << 20  # bytes of text handled at once
LEAST = 64  # rows that a hot anchor has at least
TOGETHER = 1 << 18  # anchors counted at once
NO_ID = -(1 << 63)  # stands for a null doc_id


def keyed(docs: DataFrame, wide: bool = True) -> DataFrame:
    """(id, h, text): the id with null as the least, a checksum of the text, the text or ''.

    Rows with one id and different texts stay apart by h, of 32 bits or (``wide``) of 64; equal rows
    get equal results.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(text) if wide else F.crc32(text.cast("binary"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), h.alias("h"), text.alias("text"))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether an id (or null) occurs in more than one row: ids alone are read and counted."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def runs(least: np.ndarray, doc: np.ndarray, last_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every maximal run of neighbouring windows with one anchor.

    least: each window's anchor; doc, last_doc: document of its first and last symbol.
    """
    inside = doc == last_doc
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    edge |= ~inside
    edge[1:] |= ~inside[:-1]
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, len(least)))
    keep = inside[starts]
    return starts[keep], lengths[keep]


class Frequent:
    """The most frequent values with their counts, in bounded memory (Misra-Gries over sorted slices).

    A count is short by at most ``lost``, which is at most the number of all over ``entries``; what
    is missing occurred no more than ``lost`` times.
    """

    def __init__(self, entries: int):
        self.entries, self.rows, self.lost = entries, 0, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size >= max(TOGETHER, self.entries):
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        values = np.concatenate([self.values, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        self.rows += self.size
        self.waiting, self.size = [], 0
        by = np.argsort(values)
        values = values[by]
        head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.values, self.counts = values[head], np.add.reduceat(counts[by], head)
        if len(head) > self.entries:
            cut = np.partition(self.counts, -self.entries - 1)[-self.entries - 1]
            kept = self.counts > cut
            self.values, self.counts = self.values[kept], self.counts[kept] - cut
            self.lost += int(cut)


def hot(docs: DataFrame, anchors_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The hot anchors, sorted. ``anchors_of`` gives the anchor of every run of a batch.

    A task counts all its runs and passes on the most frequent anchors alone, so that no anchor is
    shuffled once a run. No hot anchor is missed: what the tasks' counts may lack, a sixteenth of the
    bound together, is taken off the bound.
    """
    spark = docs.sparkSession
    common.ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = 64 * max(64, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(entries)
        for batch in common.pieces(batches, limit=PIECE):
            frequent.add(anchors_of(batch))
        frequent.settle()
        a, n = frequent.values.view(np.int64), frequent.counts
        if len(a):  # the null anchor counts all rows
            yield pa.record_batch([pa.array(np.append(a, 0), mask=np.arange(len(a) + 1) == len(a)),
                                   pa.array(np.append(n, frequent.rows)),
                                   pa.array(np.append(np.zeros(len(a), np.int64), frequent.lost))], ["a", "n", "lost"])

    some = docs.where(F.pmod(F.xxhash64("id", "h"), F.lit(SAMPLED)) == 0) if SAMPLED > 1 else docs
    counts = some.mapInArrow(run, "a long, n long, lost long").groupBy("a").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    counts = common.stored(counts, "anchors")
    total, lost = counts.where("a is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "lost")]).first()
    least = max(LEAST, total // (4 * partitions)) - lost
    rows = counts.where(F.col("a").isNotNull() & (F.col("n") >= least)).select("a").collect()
    return np.sort(np.array([r["a"] for r in rows], np.int64).view(np.uint64))


def is_in(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``those``."""
    if not len(those):
        return np.zeros(len(values), bool)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def spans_of(flags: np.ndarray, run_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch of set flags inside one run."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (run_of[at[1:]] != run_of[at[:-1]]))
    return at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)]


def with_spans(docs: DataFrame, spans: DataFrame, wide: bool = True) -> DataFrame:
    """(doc_id, text, spans) of every document; ``spans`` (id, h, first, end) are collected per document,
    once for all rows that are repeated."""
    of = spans.groupBy("id", "h").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    joined = keyed(docs, wide).join(of, ["id", "h"], "left")
    kind = docs.schema["doc_id"].dataType
    return joined.select(F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias("doc_id"), "text", "spans")


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n symbols lie in a span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, [s["first"] for s in spans], 1)
    np.add.at(depth, [s["end"] for s in spans], -1)
    return np.cumsum(depth[:-1]) > 0
