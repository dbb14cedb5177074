"""Operator 6: SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit set where more than half of its word
shingles' 64-bit hashes have it. Two fingerprints within ``k`` differing bits
agree on one of k + 1 blocks of bits, so the distinct fingerprints are grouped
once by each block. Inside a group the sorted fingerprints are a binary trie:
pairs of nodes are walked down together, bit by bit, with the differing bits
added up, and a pair is dropped as soon as it has more than ``k``.

A group of more than ``GROUP`` distinct fingerprints is grouped again by k + 1
blocks of its remaining bits, up to ``LEVELS`` times, after which few bits are
left and so few distinct fingerprints; a hot block thus never meets in one
task. Groups give a spanning forest of their links (never all pairs), and the
components come from alternating large and small stars over the fingerprints.

Defined results: null and empty texts have fingerprint zero, linked like any
other; equal fingerprints are always linked; a table without rows gives none;
a null doc_id is a document like any other (nulls come before all ids only if
a component has no other id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
GROUP = 2000
SLICE = 4096  # rows whose tries are walked together
LEVELS = 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        some = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp long) of every document; h is a checksum of its text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    t = common.texts(docs).withColumn("h", F.xxhash64("text"))
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def trie_links(fp: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with k or fewer differing bits inside each range from starts to ends,
    whose fingerprints are sorted and distinct.

    Each range is the root of a trie, and a node of it a part of the range. The frontier holds
    pairs of nodes of equal depth, of all tries together.
    """
    some = ends - starts > 1
    a = starts[some], ends[some], starts[some], ends[some], np.zeros(int(some.sum()), np.int64)
    for bit in range(63, -1, -1):
        lo1, hi1, lo2, hi2, diff = a
        zeros = np.concatenate([[0], np.cumsum(((fp >> np.uint64(bit)) & np.uint64(1)) == 0)])
        mid1, mid2 = lo1 + zeros[hi1] - zeros[lo1], lo2 + zeros[hi2] - zeros[lo2]
        same = lo1 == lo2
        parts = [(lo1, mid1, lo2, mid2, diff, None), (mid1, hi1, mid2, hi2, diff, None),
                 (lo1, mid1, mid2, hi2, diff + 1, None), (mid1, hi1, lo2, mid2, diff + 1, ~same)]
        kept = []
        for b1, e1, b2, e2, d, ok in parts:
            keep = (e1 > b1) & (e2 > b2) & (d <= k) & ~((b1 == b2) & (e1 - b1 == 1))
            keep = keep if ok is None else keep & ok
            kept.append([x[keep] for x in (b1, e1, b2, e2, d)])
        a = [np.concatenate(x) for x in zip(*kept)]
    return a[0], a[2]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_masks(mask: int, k: int) -> list[int]:
    """k + 1 masks, each with one block of the bits not yet in ``mask`` added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (k + 1) for i in range(k + 2)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links_of_groups(rows: DataFrame, k: int) -> DataFrame:
    """(a, b): spanning forests of the links inside groups of equal (mask, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy() for c in ("mask", "bits", "fp")])
            held = new if held is None else np.concatenate([held, new], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (held[:2, 1:] != held[:2, :-1]).any(0)]))
            yield from links(held[:, :starts[-1]], starts[:-1])
            held = held[:, starts[-1]:]  # the last group may go on
        if held is not None and held.shape[1]:
            yield from links(held, np.array([0]))

    def links(part: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, end = 0, part.shape[1]
        while at < len(starts):  # some whole groups at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
            yield links_of(part[:, starts[at]:starts[to] if to < len(starts) else end])
            at = to

    def links_of(part: np.ndarray) -> pa.RecordBatch:
        fp = part[2].astype(np.int64).view(np.uint64)
        group = np.cumsum(np.concatenate([[0], (part[:2, 1:] != part[:2, :-1]).any(0)]))
        order = np.lexsort((fp, group))
        fp, group = fp[order], group[order]
        new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (group[1:] != group[:-1])])
        fp, group = fp[new], group[new]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        root = forest(len(fp), *trie_links(fp, k, starts, np.append(starts[1:], len(fp))))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.record_batch([pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return (rows.repartition(n, "mask", "bits").sortWithinPartitions("mask", "bits")
            .select("mask", "bits", "fp").mapInArrow(run, "a long, b long"))


def links(fps: DataFrame, k: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within k differing bits."""
    masks, found = [0], None
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    for level in range(LEVELS):
        below = {m: [_signed(x) for x in block_masks(m % (1 << 64), k)] for m in masks}
        pick = F.lit(None).cast("array<bigint>")
        for m, subs in below.items():
            pick = F.when(F.col("mask") == m, F.array(*[F.lit(x).cast("long") for x in subs])).otherwise(pick)
        rows = (rows.select(F.explode(pick).alias("mask"), "fp")
                .withColumn("bits", F.col("mask").bitwiseAND(F.col("fp"))))
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
        grouped = common.stored(rows.join(sizes, ["mask", "bits"]), "groups")
        last = level == LEVELS - 1
        some = _links_of_groups(grouped if last else grouped.where(F.col("n") <= GROUP), k)
        found = some if found is None else found.unionByName(some)
        rows = grouped.where(F.col("n") > GROUP).select("mask", "fp")
        if last or rows.isEmpty():
            return found
        masks = sorted({x for subs in below.values() for x in subs})
    return found


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that is not the smallest of its component, with the smallest.

    Alternating large and small stars; each round is written to the shared folder.
    """
    def summary(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = common.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a != b").distinct(), "edges")
    before = summary(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = common.stored(small, "stars")
        now = summary(e)
        if now == before:
            break
        before = now
    return e


def groups(docs: DataFrame, shingle: int = 3, k: int = 2) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of every document; root: the component's own key, its least fingerprint."""
    fp = common.stored(fingerprints(docs, shingle), "fingerprints")
    distinct = common.stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    star = components(links(distinct, k)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(star, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return fp.join(of_fp, "fp").select("doc_id", "h", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, k: int = 2) -> DataFrame:
    """One row of ``docs`` for each component, as it is: that of the smallest doc_id.

    Of different texts under that id (or under none, where no id is known) the one with the least hash
    stays, of rows with one id and text the one whose columns (maps aside) have the least hash.
    """
    mine = groups(docs, shingle, k).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = (mine.groupBy("root").agg(F.first("doc_id").alias("id"), F.min("h").alias("sum"))
             .select("id", "sum").distinct())
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.xxhash64(*plain).alias("tie"))
    kept = rows.join(first, F.col("of").eqNullSafe(F.col("id")) & (F.col("h") == F.col("sum")), "left_semi")
    return kept.groupBy("of", "h").agg(F.min_by("row", "tie").alias("row")).select("row.*")


def hexadecimal(fp="fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
