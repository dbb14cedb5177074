"""Operator 1: token ids as Parquet list columns, in ascending document order.

Rows are range-partitioned and sorted by document id, encoded with the
tokenizers library and written by Spark's Parquet writer: one file a
partition, ids dictionary-encoded, ids of documents and starts delta-encoded,
bounded row groups, small pages with page indexes. A filter on ``doc_id`` or
a selection of metadata columns thus reads few pages and no ids.

File columns: doc_id, part (the partition), part_start (ids before the row
inside its part), n_tokens, ids array<int>, and ``meta`` (a struct of the
metadata columns asked for, so their names clash with nothing). ``read_starts``
adds up the parts: their number is the number of partitions.

Defined results: null text is empty and becomes the end id alone; equal
doc_ids are ordered by the text's crc32, then by text, however many partitions
there are; a null doc_id comes first; an empty table gives
no rows.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 500
PIECE_ENTRIES = 300_000  # strings remembered by a task; beyond it, the half most used and those of the texts at hand
LONG = 64  # bytes of the longest string remembered
PIECE = 2 << 20  # bytes of text handled at once

# Classes of a text's bytes. VAGUE: perhaps white space; OTHER: signs beyond ASCII that are not, perhaps letters.
VAGUE, LETTER, DIGIT, SIGN, QUOTE, OTHER, BREAK, SPACE = range(8)
KINDS = np.full(256, VAGUE, np.uint8)
KINDS[33:127] = SIGN
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58], KINDS[39], KINDS[9:14], KINDS[32], KINDS[128:] = DIGIT, QUOTE, BREAK, SPACE, OTHER
# By class before and after: 1, a piece of the byte-level pattern always ends there; 2, it does if the byte before is
# the only white space there. A quote may go on with letters ('s), a space goes to what follows.
CUTS = np.zeros((8, 8), np.uint8)
CUTS[LETTER:OTHER + 1, BREAK:] = 1
CUTS[LETTER, DIGIT:OTHER] = CUTS[DIGIT, [LETTER, SIGN, QUOTE]] = 1
CUTS[SIGN, LETTER:SIGN] = CUTS[QUOTE, DIGIT] = 1
CUTS[BREAK, LETTER:OTHER + 1] = 2
# Where no piece ends for sure; a string between two cuts that has nothing else inside is one piece.
JOINS = np.zeros((8, 8), bool)
JOINS[SPACE, LETTER:OTHER] = JOINS[LETTER, LETTER] = JOINS[DIGIT, DIGIT] = JOINS[SIGN:OTHER, SIGN:OTHER] = True


def kinds(data: np.ndarray) -> np.ndarray:
    """Class of every byte of whole UTF-8 texts; the bytes of a character share theirs."""
    out = KINDS[data]
    if len(data) and data.max() > 127:
        at = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # two bytes, U+00C0 to U+017F
        at = at[(data[at] != 0xC3) | (data[at + 1] & 0xDF != 0x97)]  # but the signs of times and division
        out[at] = out[at + 1] = LETTER
        at = np.flatnonzero(data == 0xC2)
        at = at[(data[at + 1] == 0x85) | (data[at + 1] == 0xA0)]
        out[at] = out[at + 1] = VAGUE
        at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
        a, b, c = data[at], data[at + 1], data[at + 2]
        at = at[((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80))
                | ((a == 0xE2) & ((b == 0x81) | (b == 0x80) & ((c < 0x90) | (c >= 0xA8) & (c <= 0xAF))))]
        out[at] = out[at + 1] = out[at + 2] = VAGUE
    return out


def pairs(kind: np.ndarray) -> np.ndarray:
    """Places in the tables for every two bytes in a row."""
    return kind[:-1] << 3 | kind[1:]


class WordEncoder:
    """The library's ids of whole texts, with strings between sure borders remembered.

    Texts are cut where the byte-level pattern ends a piece whatever stands around (``CUTS``), so a string between two
    cuts encodes alike everywhere. Arrow numbers the different strings of a slice of texts together with the
    remembered ones, and a text's ids are gathered from its strings'. A new string of one piece goes to the library's
    model at once, others are cut by the library's pre-tokenizer first. Long ones of several pieces, texts with special
    tokens, and all texts if the vocabulary has another pre-tokenizer, are encoded whole. The empty string closes every text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads hold memory
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.cutter = self.tok.model, self.tok.pre_tokenizer
        self.cuts = (isinstance(self.cutter, pre_tokenizers.ByteLevel) and not self.cutter.add_prefix_space
                     and self.cutter.use_regex and self.tok.normalizer is None and isinstance(self.model, models.BPE))
        letters = byte_letters()
        letters[255] = " "  # no byte of UTF-8
        self.letters = "".join(letters)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, self.special)).encode() if self.cuts else b"")
        self.forget()

    def forget(self) -> None:
        self.memo = pa.array([b""], pa.binary())
        self.ids, self.sizes, self.used = np.zeros(1, np.uint32), np.ones(1, np.int32), np.zeros(1, np.int32)

    def _keep(self, some: np.ndarray) -> None:
        """Remember these of the remembered strings (in ascending order) alone."""
        starts, sizes = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, self.sizes[some]
        begins = np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(starts[some] - begins, sizes)]
        self.memo, self.sizes, self.used = self.memo.take(pa.array(some)), sizes, self.used[some]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _cut(self, string: bytes) -> list[int]:
        """The ids of a string of several pieces."""
        return [i for piece, _ in self.cutter.pre_tokenize_str(string.decode()) for i in self._piece(piece)]

    def _learn(self, strings: pa.Array, special: bool) -> None:
        """Put the ids of these new strings behind those of the remembered ones."""
        if len(strings) == 0:
            return
        new = strings.to_pylist()
        sizes = pa.compute.binary_length(strings).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        kind = kinds(np.frombuffer(b"".join(new), np.uint8))
        other = np.append(~JOINS.ravel()[pairs(kind)], False)  # by the first byte of the two
        other[ends - 1] = False
        several = np.add.reduceat(other, ends - sizes, dtype=np.int64) > 0
        if special:
            several |= np.fromiter((self.whole.search(s) is not None for s in new), bool, len(new))
        text = codecs.charmap_decode(b"\xff".join(itertools.compress(new, (~several).tolist())), "strict", self.letters)[0]
        lists = list(map(self._piece, text.split(" "))) if not several.all() else []
        if several.any():
            whole = [i for i in np.flatnonzero(several).tolist()
                     if sizes[i] > LONG or special and self.whole.search(new[i])]
            ids = dict(zip(whole, self._plain([new[i].decode() for i in whole])))
            one = iter(lists)
            lists = [(ids[i] if i in ids else self._cut(s)) if is_several else next(one)
                     for i, (s, is_several) in enumerate(zip(new, several.tolist()))]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        more = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        self.ids, self.sizes = np.concatenate([self.ids, more]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each closed by ``end_id`` if given, and the number of each."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, at = common.joined(texts)
        slow = np.full(len(texts), not self.cuts)
        for s in self.special:
            slow |= pa.compute.match_substring(texts, s).to_numpy(zero_copy_only=False)
        kind = kinds(data)
        cut = CUTS.ravel()[pairs(kind)]  # before the byte after
        single = np.flatnonzero(cut == 2)
        before = kind[single - 1]  # of the first byte: the last one's class, which may only spare a cut
        cut[single] = (before >= LETTER) & (before <= OTHER)
        cut = np.concatenate([[0], cut]) if len(data) else cut
        for i in np.flatnonzero(slow).tolist():
            cut[at[i]:at[i + 1]] = 0
        cut[at[:-1][at[:-1] < len(data)]] = 0
        inner = np.flatnonzero(cut)
        # every text ends its last string and an empty one
        closing = np.where(np.diff(at) > 0, 2, 1)
        offsets = np.concatenate([[0], np.sort(np.concatenate([inner, np.repeat(at[1:], closing)]), kind="stable")])
        strings = pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        last = np.diff(np.searchsorted(inner, at)) + closing
        last = np.cumsum(last) - 1

        if len(self.memo) > PIECE_ENTRIES:
            self._keep(np.sort(np.append(1 + np.argsort(-self.used[1:], kind="stable")[:PIECE_ENTRIES // 2], 0)))
            self.used //= 2
        known = len(self.memo)
        numbered = pa.chunked_array([self.memo, strings]).dictionary_encode().chunk(1)
        entry = numbered.indices.to_numpy()
        self._learn(numbered.dictionary.slice(known), bool(slow.any()))
        self.memo = numbered.dictionary
        starts, sizes = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, self.sizes.copy()
        self.ids[0], sizes[0] = end_id or 0, end_id is not None
        each = sizes[entry]
        ends = np.cumsum(each, dtype=np.int64)
        places = np.repeat(starts[entry] - (ends - each), each)
        places += np.arange(len(places))
        ids, counts = self.ids[places], np.diff(ends[last], prepend=0)
        self.used = np.concatenate([self.used, np.zeros(len(self.memo) - known, np.int32)])
        self.used += np.bincount(entry, minlength=len(self.memo)) > 0
        short = pa.compute.binary_length(self.memo).to_numpy() <= LONG
        if not short.all():
            self._keep(np.flatnonzero(short))
        return ids, counts


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int,
                      meta: Sequence[str] = ()) -> None:
    """Write the ids of every text, each document closed by ``end_id``, in ascending doc_id order."""
    common.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       (F.struct(*meta) if meta else F.lit(None).cast("int")).alias("meta"))
    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]  # rows of one id are dealt out too
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in common.pieces(batches, limit=PIECE):
            ids, n = enc.encode(batch.column("text"), end_id)
            ends = np.cumsum(n)
            values = pa.array(ids.view(np.int32))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n),
                pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values),
                batch.column("meta")], ["doc_id", "part", "part_start", "n_tokens", "ids", "meta"])
            start += int(ends[-1])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"doc_id {types['doc_id']}, part int, part_start long, n_tokens long, "
                               f"ids array<int>, meta {types['meta']}")
    writer = (out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
              .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
              .option("parquet.page.row.count.limit", PAGE_ROWS)
              .option("parquet.enable.dictionary#doc_id", "false")
              .option("parquet.enable.dictionary#part_start", "false")
              .option("parquet.enable.dictionary#ids.list.element", "true"))
    writer.parquet(path)


def read_starts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before each."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (files.join(F.broadcast(base), "part")
            .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), *columns))


def checked(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with count and crc32 taken from the ids themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)),
                pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
