"""Operator 7: repeated word windows by compaction of a de Bruijn graph.

Nodes are runs of K - 1 words, edges are windows of K words: an edge leads from
its first K - 1 words to its last. Only repeated edges matter. A node belongs
to the bucket of its anchor (see anchors), and a bucket holds every edge that
touches its nodes, so that it counts edges and the degrees of its nodes in full:

1. Inside a bucket repeated edges are compacted: two edges become one path where
   the node between them has one edge in and one out. Where an anchor is hot
   every node is a bucket of its own, counted with partial aggregation.
2. Paths that end in another bucket are joined there by their common edge, and
   chains of paths are compacted by joins that double the steps taken. Every
   repeated edge then has one place on one nonbranching path; a cycle is opened
   at its least path.
3. Occurrences keep source coordinates (document and first word). Their words are
   read there, in blocks of GRID edges of a path, and compared word by word with
   those of all other occurrences of the block. Blocks whose words differ (equal
   hashes of different words) are decided window by window, on the words.

Defined results: null text has no words; a document of fewer than K words keeps
them all; rows that are repeated repeat each other's windows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

K, GRAM = 35, 8
GRID = 128  # edges of a path whose words are compared together
PIECE = 1 << 20  # bytes of text handled at once
LEFT, RIGHT = 1, 2  # ends of a path that lie in another bucket
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _scrambled(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random odd numbers."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return common.mix(x, x >> np.uint64(7), salt) | np.uint64(1)


_BYTE = _scrambled(256, 11)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a string column."""
    data, offsets = common.joined(column)
    text = ~_SPACE[data]
    opens = text.copy()
    opens[1:] &= ~text[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] |= text[first]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text)
    word = np.cumsum(opens)[at] - 1
    place = at - starts[word]
    size = np.bincount(word)
    values = _BYTE[data[at]] * _scrambled(int(size.max()), 23)[place]
    h = np.add.reduceat(values, np.concatenate([[0], np.cumsum(size)[:-1]]))
    return common.mix(h, size.astype(np.uint64), 5), np.searchsorted(offsets, starts, "right") - 1


def paths(batch: pa.RecordBatch, k: int, gram: int, bits: int = 64):
    """Node hashes (of ``bits`` bits), and per run of nodes with one anchor: the anchor, first node, number of
    nodes, row, word of the row it starts at, whether a node comes before, and after."""
    h, doc = word_hashes(batch.column("text"))
    width = k - 1
    nodes = common.windows(h, width, 2) >> np.uint64(64 - bits)
    n = len(nodes)
    least = common.sliding_min(common.windows(h, gram, 1), width - gram + 1) if n else h[:0]
    starts, sizes = anchors.runs(least, doc[:n], doc[len(doc) - n:])
    first_word = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))[:-1]])
    row, ends = doc[starts], starts + sizes
    before = (starts > 0) & (doc[np.maximum(starts - 1, 0)] == row) if n else np.zeros(0, bool)
    after = (ends < n) & (doc[np.minimum(ends + width - 1, len(doc) - 1)] == row) if n else np.zeros(0, bool)
    return nodes, least[starts], starts, sizes, row, starts - first_word[row], before, after


def _taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def path_rows(docs: DataFrame, hot: np.ndarray, k: int, gram: int, bits: int) -> DataFrame:
    """(anchor, id, h, first, open, nodes): runs without a hot anchor, with the nodes before and after them."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            nodes, anchor, starts, sizes, row, first, before, after = paths(batch, k, gram, bits)
            starts, sizes, first = starts - before, sizes + before + after, first - before
            some = ~anchors.is_in(anchor, shared.value) & (sizes > 1)
            starts, sizes, row = starts[some], sizes[some], pa.array(row[some])
            values = pa.array(_taken(nodes, starts, sizes).view(np.int64))
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            opens = (before * LEFT + after * RIGHT)[some].astype(np.int8)
            yield pa.record_batch([
                pa.array(anchor[some].view(np.int64)), batch.column("id").take(row), batch.column("h").take(row),
                pa.array(first[some].astype(np.int32)), pa.array(opens), pa.ListArray.from_arrays(pa.array(at), values)],
                ["anchor", "id", "h", "first", "open", "nodes"])

    return docs.mapInArrow(run, "anchor long, id long, h long, first int, open byte, nodes array<long>")


def chains(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head of each element's chain and its steps from there; ``following``: the next element or -1, each
    following one at most. A cycle is opened at its least element."""
    n = len(following)
    up, steps = np.arange(n), np.zeros(n, np.int64)
    has = np.flatnonzero(following >= 0)
    up[following[has]] = has
    before = np.where(up == np.arange(n), -1, up)
    loop = following == np.arange(n)
    steps[before >= 0] = 1
    least, at = np.arange(n), np.zeros(n, np.int64)
    for _ in range(max(n, 1).bit_length() + 1):
        if (up[up] == up).all():
            break
        lower = least[up] < least
        least, at = np.where(lower, least[up], least), np.where(lower, steps + at[up], at)
        steps, up = steps + steps[up], up[up]
    cyclic = (before[up] >= 0) & ~loop[up]
    return np.where(cyclic, least, up), np.where(cyclic, at, steps)


def compacted(t: pa.Table) -> pa.RecordBatch:
    """Paths (kind 1) and occurrences of repeated edges on them (kind 0) of whole buckets."""
    t = t.combine_chunks()
    lists, opens = t.column("nodes").chunk(0), t.column("open").to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    nodes = lists.flatten().to_numpy().view(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets) - 1  # edges of a run
    run = np.repeat(np.arange(t.num_rows), sizes)
    tail = _taken(np.arange(len(nodes)), offsets[:-1], sizes)
    anchor = t.column("anchor").to_numpy().view(np.uint64)[run]
    edge = common.mix(nodes[tail], nodes[tail + 1], 3)
    _, at, inverse, count = np.unique(common.mix(edge, anchor, 4), return_index=True, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    some = at[count > 1]  # one occurrence of every repeated edge
    a, b = common.mix(nodes[tail[some]], anchor[some], 6), common.mix(nodes[tail[some] + 1], anchor[some], 6)
    outside_a = (tail[some] == offsets[run[some]]) & (opens[run[some]] & LEFT > 0)
    outside_b = (tail[some] + 2 == offsets[run[some] + 1]) & (opens[run[some]] & RIGHT > 0)
    by_a, ends = np.argsort(a, kind="stable"), np.sort(b)
    low = np.searchsorted(a[by_a], b)
    out = np.searchsorted(a[by_a], b, "right") - low
    into = np.searchsorted(ends, b, "right") - np.searchsorted(ends, b)
    following = np.full(len(some), -1)
    through = (out == 1) & (into == 1) & ~outside_b
    following[through] = by_a[low[through]]
    head, place = chains(following)
    name = common.mix(edge[some], anchor[some], 9).view(np.int64)

    top, rank = np.unique(head, return_inverse=True)
    length = np.bincount(rank, minlength=len(top))
    last = np.zeros(len(top), np.int64)
    last[rank[place == length[rank] - 1]] = np.flatnonzero(place == length[rank] - 1)
    sides = outside_a[top] * LEFT + outside_b[last] * RIGHT

    seen = np.flatnonzero((count > 1)[inverse])
    which = number[inverse[seen]]
    path, on = head[which], place[which]
    cut = np.ones(len(seen), bool)
    cut[1:] = (np.diff(seen) != 1) | (run[seen][1:] != run[seen][:-1]) | (path[1:] != path[:-1]) | (np.diff(on) != 1)
    begin = np.flatnonzero(cut)
    n = np.diff(np.append(begin, len(seen)))
    r = run[seen[begin]]
    first = t.column("first").to_numpy()[r] + tail[seen[begin]] - offsets[r]

    def both(x, y, kind):
        return pa.array(np.concatenate([np.asarray(x), np.asarray(y)]).astype(kind))
    code = edge[some].view(np.int64)
    return pa.record_batch([
        both(np.zeros(len(begin)), np.ones(len(top)), np.int8), both(name[path[begin]], name[top], np.int64),
        both(t.column("id").to_numpy()[r], code[top], np.int64), both(t.column("h").to_numpy()[r], code[last], np.int64),
        both(first, sides, np.int32), both(n, length, np.int32), both(on[begin], np.zeros(len(top)), np.int32)],
        ["kind", "path", "a", "b", "first", "n", "place"])


LOCAL = "kind byte, path long, a long, b long, first int, n int, place int"


def in_buckets(rows: DataFrame) -> DataFrame:
    """The paths and occurrences of all buckets. An occurrence (kind 0) has its id and h as a and b; a path
    (kind 1) has its first and last edge there and its open sides as ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            anchor = held.column("anchor").to_numpy()
            done = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            if done:
                yield compacted(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield compacted(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, LOCAL)


def in_hot_buckets(docs: DataFrame, hot: np.ndarray, k: int, gram: int, bits: int) -> DataFrame:
    """The same for nodes with hot anchors, a bucket each: edges are counted with partial aggregation and joined
    back on stored tables, where Spark splits skewed partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            nodes, anchor, starts, sizes, row, first, before, after = paths(batch, k, gram, bits)
            some = anchors.is_in(anchor, shared.value)
            starts, sizes, ends = starts[some], sizes[some], (starts + sizes)[some] - 1
            at = _taken(np.arange(len(nodes)), starts, sizes)
            of, place = np.repeat(row[some], sizes), at - np.repeat(starts - first[some], sizes)
            into, out = np.ones(len(at), bool), np.ones(len(at), bool)
            into[np.cumsum(sizes) - sizes], out[np.cumsum(sizes) - 1] = before[some], after[some]
            for side, has, step in ((0, into, -1), (1, out, 1)):
                here, there = at[has], at[has] + step
                a, b = (there, here) if side == 0 else (here, there)
                rows = pa.array(of[has])
                yield pa.record_batch([
                    pa.array(nodes[here].view(np.int64)), pa.array(np.full(len(here), side, np.int8)),
                    pa.array(common.mix(nodes[a], nodes[b], 3).view(np.int64)), pa.array(nodes[a] == nodes[b]),
                    batch.column("id").take(rows), batch.column("h").take(rows),
                    pa.array((place[has] - (side == 0)).astype(np.int32))],
                    ["node", "side", "edge", "turns", "id", "h", "first"])

    ends = common.stored(docs.mapInArrow(
        run, "node long, side byte, edge long, turns boolean, id long, h long, first int"), "hot-edges")
    twice = ends.groupBy("node", "side", "edge", "turns").count().where("count > 1").drop("count")
    twice = common.stored(twice, "hot-repeated")
    incoming, edge = F.col("side") == 0, F.col("edge")
    degrees = twice.groupBy("node").agg(
        F.count_if(incoming).alias("n_in"), F.count_if(~incoming).alias("n_out"),
        F.max(F.when(incoming, edge)).alias("e_in"), F.max(F.when(~incoming, edge)).alias("e_out"))
    degrees = common.stored(degrees, "hot-degrees")
    one = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("e_in") != F.col("e_out"))
    known = twice.join(degrees, "node").select("*", F.coalesce(one, F.lit(False)).alias("through"))
    through, turns = F.col("through"), F.col("turns")
    known = common.stored(known.select(
        "*", F.xxhash64(F.when(through, F.col("e_in")).otherwise(edge), "node").alias("path")), "hot-paths")
    sides = F.when(through, LEFT + RIGHT).when(turns, 0).when(incoming, LEFT).otherwise(RIGHT)
    local = known.where(incoming | ~(through | turns)).select(
        F.lit(1).cast("byte").alias("kind"), "path",
        F.when(through, F.col("e_in")).otherwise(edge).alias("a"), F.when(through, F.col("e_out")).otherwise(edge).alias("b"),
        sides.cast("int").alias("first"), F.when(through, 2).otherwise(1).cast("int").alias("n"), F.lit(0).alias("place"))
    places = known.select("node", "side", "edge", "path", (through & ~incoming).cast("int").alias("place"))
    occurrences = ends.join(places, ["node", "side", "edge"]).select(
        F.lit(0).cast("byte").alias("kind"), "path", F.col("id").alias("a"), F.col("h").alias("b"), "first", F.lit(1).alias("n"), "place")
    return common.stored(local.unionByName(occurrences), "hot-local")


def joined_paths(local: DataFrame) -> DataFrame:
    """(path, root, off): for every path of a bucket the whole path it is part of, and its place there."""
    part = local.where("kind = 1").dropDuplicates(["path"])
    part = common.stored(part.select("path", "a", "b", "n", F.col("first").alias("open")), "paths")
    ends = part.where(F.col("open").bitwiseAND(RIGHT) > 0).select(
        F.col("b").alias("a"), F.col("path").alias("up"), (F.col("n") - 1).cast("long").alias("dist"))
    begins = part.where(F.col("open").bitwiseAND(LEFT) > 0).select("a", "path")
    links = begins.join(ends, "a").groupBy("path").agg(F.min_by(F.struct("up", "dist"), "up").alias("link"))
    at = part.join(links, "path", "left").select(
        "path", F.coalesce("link.up", "path").alias("up"), F.coalesce("link.dist", F.lit(0)).alias("dist"),
        F.col("link").isNull().alias("top"), F.struct(F.col("path").alias("path"), F.lit(0).cast("long").alias("dist")).alias("least"))
    at = common.stored(at, "chains")
    count, reach = at.count(), 1
    while reach <= 2 * count and at.where("not top").limit(1).count():  # whatever is left then is a cycle
        then = at.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"),
                         F.col("top").alias("top2"), F.col("least").alias("least2"))
        lower = F.col("least2.path") < F.col("least.path")
        moved = at.where("not top").join(then, "up").select(  # rows not at a root yet have different ``up``
            "path", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("top2").alias("top"),
            F.when(lower, F.struct(F.col("least2.path").alias("path"), (F.col("dist") + F.col("least2.dist")).alias("dist")))
            .otherwise(F.col("least")).alias("least"))
        at = common.stored(at.where("top").unionByName(moved), "chains")
        reach *= 2
    return at.select("path", F.when(F.col("top"), F.col("up")).otherwise(F.col("least.path")).alias("root"),
                     F.when(F.col("top"), F.col("dist")).otherwise(F.col("least.dist")).alias("off"))


def stretches(docs: DataFrame, k: int, gram: int, bits: int) -> DataFrame:
    """(id, h, first, n, root, off): n repeated edges from word ``first`` on, which lie on path ``root`` from ``off``
    on. ``docs`` as ``anchors.keyed`` gives them."""
    hot = anchors.hot(docs, lambda batch: paths(batch, k, gram)[1])
    local = common.stored(in_buckets(path_rows(docs, hot, k, gram, bits)), "local")
    if len(hot):
        local = local.unionByName(in_hot_buckets(docs, hot, k, gram, bits))
    whole = common.stored(joined_paths(local), "whole")
    return local.where("kind = 0").join(whole, "path").select(
        F.col("a").alias("id"), F.col("b").alias("h"), "first", "n", "root", (F.col("off") + F.col("place")).alias("off"))


def merged(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, first, n, root, off of the stretches of every row, those that go on along their path made one."""
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    flat = column.flatten()
    first, n, root, off = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "n", "root", "off"))
    row = np.repeat(np.arange(len(column)), sizes)
    order = np.lexsort((first, off - first, root, row))
    row, first, n, root, off = (x[order] for x in (row, first, n, root, off))
    if not len(row):
        return row, first, n, root, off
    group = np.cumsum(np.concatenate([[0], (np.diff(row) != 0) | (np.diff(root) != 0) | (np.diff(off - first) != 0)]))
    shift = group * (int((first + n).max()) + 1)
    reach = np.maximum.accumulate(first + n + shift)
    begin = np.flatnonzero(np.concatenate([[True], (first + shift)[1:] > reach[:-1]]))
    end = (reach - shift)[np.append(begin[1:], len(row)) - 1]
    return row[begin], first[begin], end - first[begin], root[begin], off[begin]


def blocks(first: int, n: int, off: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, first, n, place in the block) of the blocks of GRID edges that n edges from ``off`` on lie in."""
    while n:
        block, place = divmod(off, GRID)
        size = min(n, GRID - place)
        yield block, first, size, place
        first, n, off = first + size, n - size, off + size


def differing(held: DataFrame, k: int) -> DataFrame:
    """(root, block): the blocks of paths whose occurrences have different words at one place."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            out, words, of = [], [], -1
            for row, first, n, root, off in zip(*(x.tolist() for x in merged(batch.column("stretches")))):
                if row != of:
                    words, of = batch.column("text")[row].as_py().encode().split(), row
                out += [(root, block, place, b" ".join(words[f:f + size + k - 1])) for block, f, size, place in blocks(first, n, off)]
            if out:
                yield pa.record_batch([pa.array([x[c] for x in out], kind) for c, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["root", "block", "place", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, bad = None, {}, False
        for batch in batches:
            out = []
            for root, block, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, block) != now:
                    now, slots, bad = (root, block), {}, False
                if bad:
                    continue
                for slot, word in enumerate(text.split(), place):
                    if slots.setdefault(slot, word) != word:
                        bad = True
                        out.append(now)
                        break
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())],
                                  ["root", "block"])

    kind = "root long, block long, place int, words binary"
    texts = held.where("stretches is not null").select("text", "stretches").mapInArrow(cut, kind).distinct()
    return (texts.repartition("root", "block").sortWithinPartitions("root", "block")
            .mapInArrow(compare, "root long, block long"))


def decided(held: DataFrame, failed: DataFrame, k: int) -> DataFrame:
    """(id, h, first, end): the spans where blocks ``failed`` are decided window by window, on their words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            out = [(row, root, block, f, size) for row, first, n, root, off in
                   zip(*(x.tolist() for x in merged(batch.column("stretches")))) for block, f, size, _ in blocks(first, n, off)]
            row = pa.array([x[0] for x in out], pa.int64())
            yield pa.record_batch([batch.column("id").take(row), batch.column("h").take(row), *[
                pa.array([x[c] for x in out], kind) for c, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]],
                ["id", "h", "root", "block", "first", "n"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            out = []
            for i, h, text, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "text", "parts"))):
                words = text.encode().split()
                out += [(i, h, p, b" ".join(words[p:p + k])) for s in parts for p in range(s["first"], s["first"] + s["n"])]
            yield pa.record_batch([pa.array([x[c] for x in out], kind) for c, kind in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["id", "h", "first", "words"])

    parts = common.stored(held.where("stretches is not null").select("id", "h", "text", "stretches").mapInArrow(
        cut, "id long, h long, root long, block long, first int, n int"), "parts")
    sure = parts.join(failed, ["root", "block"], "left_anti").select(
        "id", "h", "first", (F.col("first") + F.col("n") + (k - 1)).cast("int").alias("end"))
    of = parts.join(failed, ["root", "block"]).groupBy("id", "h").agg(F.collect_set(F.struct("first", "n")).alias("parts"))
    each = held.select("id", "h", "text").join(of, ["id", "h"]).mapInArrow(
        single, "id long, h long, first int, words binary")
    each = common.stored(each.select("id", "h", "first", F.sha2("words", 256).alias("words")), "single")
    twice = common.stored(each.groupBy("words").count().where("count > 1").select("words"), "single-repeated")
    return sure.unionByName(each.join(twice, "words").select("id", "h", "first", (F.col("first") + k).alias("end")))


def held_stretches(docs: DataFrame, k: int, gram: int, bits: int) -> DataFrame:
    """(doc_id, id, h, text, stretches) of every row, written once."""
    d = anchors.keyed(docs)
    of = stretches(d, k, gram, bits).groupBy("id", "h").agg(F.collect_set(F.struct("first", "n", "root", "off")).alias("stretches"))
    return common.stored(d.join(of, ["id", "h"], "left"), "held")


def repeated_spans(docs: DataFrame, k: int = K, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """(id, h, first, end): words of ``docs`` covered by a window of k words that occurs again."""
    held = held_stretches(docs, k, gram, bits)
    return common.stored(decided(held, common.stored(differing(held, k), "failed"), k), "spans")


def digests(docs: DataFrame, k: int = K, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return without_repeats(docs, k, gram, bits).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, k: int = K, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space."""
    held = held_stretches(docs, k, gram, bits)
    failed = common.stored(differing(held, k), "failed")
    kind = docs.schema["doc_id"].dataType
    if failed.limit(1).count():
        rows = anchors.with_spans(docs, common.stored(decided(held, failed, k), "spans"))
    else:
        span = F.transform("stretches", lambda s: F.struct(s["first"].alias("first"), (s["first"] + s["n"] + (k - 1)).alias("end")))
        rows = held.select(F.when(F.col("id") != anchors.NO_ID, F.col("id")).cast(kind).alias("doc_id"), "text", span.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                gone = anchors.covered(len(words), spans) if spans else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()),
                                   pa.array([x[1] for x in out], pa.int64()),
                                   pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
                                  ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept string")
