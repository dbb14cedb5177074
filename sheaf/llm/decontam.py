"""Operator 8: benchmark decontamination with a generalised suffix automaton.

The normalised test items go into one suffix automaton over words. A
document's words run through it once; at each word the automaton knows the
longest run of words, ending there, that stands in some item. A run of at
least ``window`` words is a hit of its last ``window`` words; an item of fewer
words hits when all of it stands there.

The items are read in blocks of a bounded size (``BLOCK_BYTES`` of text); the
driver and the tasks hold one block at a time. With a single block the documents
are scanned without a shuffle; with several they are scanned for each block in
turn, and the hits are joined by row number.

Defined results: null texts (of documents or items) have no words; items
without words never hit; repeated items all count; rows keep their other
columns, whatever their names, as nothing is added beside them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import Automaton

BLOCK_BYTES = 8 << 20

# Bytes of words: digits, letters in lower case and everything beyond ASCII; the rest separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
                    for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SPANS = "array<struct<first:int,last:int>>"
FOUND = f"struct<n_words:bigint,covered:{SPANS},spans:{SPANS},items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class ItemAutomaton:
    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids = window, {}
        as_ids: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            w = tuple(self.ids.setdefault(x, len(self.ids)) for x in words_of(text))
            if w:
                as_ids.setdefault(w, set()).add(item_id)
        strings = sorted(as_ids)
        self.a = a = Automaton({s: i for i, s in enumerate(strings)})
        # state of the last `window` words of what a state stands for; 0: it is shorter
        self.last = [0] * len(a.next)
        for v in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            u = a.link[v]
            self.last[v] = self.last[u] or (v if a.length[v] >= window else 0)
        self.long: dict[int, set[str]] = {}  # state of a window: items with it
        short: dict[int, set[str]] = {}  # state of a whole short item: its ids
        for s in strings:
            v = 0
            for n, w in enumerate(s, 1):
                v = a.next[v][w]
                if n >= window:
                    self.long.setdefault(self.last[v], set()).update(as_ids[s])
            if len(s) < window:
                short[v] = as_ids[s]
        self.short = short
        self.has_short = [0] * len(a.next)  # the state itself or its first suffix that is a short item
        for v in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.has_short[v] = v if v in short else self.has_short[a.link[v]]

    def scan(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Which words are hit (None: none), and the items that hit."""
        nxt, link, length = self.a.next, self.a.link, self.a.length
        window, last, long, short, has_short = self.window, self.last, self.long, self.short, self.has_short
        hit, items, v, n = None, set(), 0, 0
        for i, w in enumerate(map(self.ids.get, words), 1):
            if w is None:
                v = n = 0
                continue
            step = nxt[v].get(w)
            while step is None and v:
                v = link[v]
                n = length[v]
                step = nxt[v].get(w)
            if step is None:
                continue
            v = step
            n += 1
            if n >= window:
                hit = hit or bytearray(len(words))
                hit[i - window:i] = b"\1" * window
                items |= long[last[v]]
            u = has_short[v if n == length[v] else link[v]]
            while u:
                hit = hit or bytearray(len(words))
                hit[i - length[u]:i] = b"\1" * length[u]
                items |= short[u]
                u = has_short[link[u]]
        return hit, items


def runs(hit: bytearray | None) -> np.ndarray:
    """First and one past the last of every run of hit words."""
    if hit is None:
        return np.zeros((0, 2), np.int32)
    flags = np.frombuffer(b"\0" + hit + b"\0", np.int8)
    return np.flatnonzero(np.diff(flags)).astype(np.int32).reshape(-1, 2)


def item_blocks(items: DataFrame) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """In how many blocks of about BLOCK_BYTES of text the items come, and what fetches one block:
    its (id, text), nulls left out."""
    rows = items.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(size // BLOCK_BYTES) + 1
    return n, lambda k: sorted(map(tuple, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()))


def pairs(runs: list) -> list[dict]:
    return [{"first": f, "last": e} for f, e in runs]


_PAIRS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("covered", _PAIRS), ("spans", _PAIRS), ("items", pa.list_(pa.string()))])


def found_in(text: str, n_words: int, hit: bytearray | None, items: set[str]) -> dict:
    covered = runs(hit).tolist()
    return {"n_words": n_words, "items": sorted(items), "covered": pairs(covered), "spans": pairs(in_characters(text, covered))}


def scan(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with ``found``: its number of words, the covered
    runs of word numbers (first, one past the last), the same in characters, and the ids of the
    items that hit."""
    common.ship(docs.sparkSession)
    n, block = item_blocks(items)
    rows = docs.select(F.struct("*").alias("row"))
    if n > 1:
        return scan_blocks(rows, n, block, window)
    shared = docs.sparkSession.sparkContext.broadcast(block(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ItemAutomaton(shared.value, window)
        for batch in common.pieces(common.row_texts(batches)):
            found = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found.append(found_in(text, len(words), *a.scan(words)))
            yield pa.record_batch([batch.column("row"), pa.array(found, _FOUND)], ["row", "found"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, found {FOUND}")


def scan_blocks(rows: DataFrame, n: int, block: Callable[[int], list[tuple[str, str]]], window: int) -> DataFrame:
    """The same for items in several blocks: each is fetched, scanned for and dropped before the
    next; the hits, kept by row number, meet at the end."""
    spark = rows.sparkSession
    rows = common.stored(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    parts = []
    for k in range(n):
        shared = spark.sparkContext.broadcast(block(k))

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = ItemAutomaton(shared.value, window)
            for batch in common.pieces(common.row_texts(batches)):
                out = []
                for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist()):
                    hit, ids = a.scan(words_of(text))
                    if hit is not None:
                        out.append((number, pairs(runs(hit).tolist()), sorted(ids)))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _PAIRS),
                                       pa.array([x[2] for x in out], pa.list_(pa.string()))], ["number", "covered", "items"])

        parts.append(common.stored(rows.mapInArrow(hits, f"number long, covered {SPANS}, items array<string>"), "hits"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy("number").agg(
        F.flatten(F.collect_list("covered")).alias("covered"), F.flatten(F.collect_list("items")).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(common.row_texts(batches)):
            found = []
            for text, covered, ids in zip(*[batch.column(c).to_pylist() for c in ("text", "covered", "items")]):
                words, hit = words_of(text), None
                for s in covered or []:
                    hit = hit or bytearray(len(words))
                    hit[s["first"]:s["last"]] = b"\1" * (s["last"] - s["first"])
                found.append(found_in(text, len(words), hit, set(ids or [])))
            yield pa.record_batch([batch.column("row"), pa.array(found, _FOUND)], ["row", "found"])

    kind = rows.schema["row"].dataType.simpleString()
    return (rows.join(merged, "number", "left").select("row", "covered", "items")
            .mapInArrow(merge, f"row {kind}, found {FOUND}"))


def n_hit(found="found"):
    return F.aggregate(f"{found}.covered", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))


def digests(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return (scan(docs.select("doc_id", "text"), items, window)
            .select("row.doc_id", "found.n_words", n_hit().alias("n_hit"),
                    F.size("found.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def in_characters(text: str, covered: list[list[int]]) -> list[tuple[int, int]]:
    """Runs of words as places of characters, with what stands between their words."""
    at = [m.span() for m in _WORD.finditer(text)] if covered else []
    return [(at[first][0], at[last - 1][1]) for first, last in covered]


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text`` (``n_chars``, if there, follows); documents
    with more than ``max_coverage`` of their words hit go. Untouched documents stay as they are."""
    found = scan(docs, items, window).where(n_hit() <= F.lit(max_coverage) * F.col("found.n_words"))
    hit, spans = F.size("found.spans") > 0, F.col("found.spans")
    begin = lambda i: F.coalesce(F.get(spans, i - 1)["last"], F.lit(0))
    end = lambda i: F.coalesce(F.get(spans, i)["first"], F.length("row.text"))
    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)),
                                    lambda i: F.substring(F.col("row.text"), begin(i) + 1, end(i) - begin(i))), "")
    rows = found.select("row", hit.alias("hit"), F.when(hit, left).alias("left"))
    return rows.select([
        F.when(F.col("hit"), F.col("left")).otherwise(F.col("row.text")).alias("text") if c == "text" else
        F.when(F.col("hit"), F.length("left")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])
