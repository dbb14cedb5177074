"""Operator 9: repeated byte strings by suffix sorting, deep-shallow.

Only suffixes that can repeat are sorted. Every window of ``LENGTH`` bytes has
its anchor (see anchors); an anchor that stands in two documents or more makes
the runs of windows around it candidates, and their bytes go, grouped by
anchor, to the sorter. There equal runs are taken together with their least
document; the suffixes that start in them are sorted by multikey sorting of
eight bytes at a time to the depth ``SHALLOW``; groups still equal there are
finished by blind tries over their distinct rests. Neighbours in the order with
a common prefix of LENGTH bytes are one class; a window goes where its class
has a smaller document.

Windows are compared by their bytes, not by hashes. Runs with hot anchors are
taken apart into windows and joined with each window's least document instead.

Defined results: null text is empty; a null doc_id is below every id; rows of
one doc_id do not remove each other's bytes; texts under LENGTH bytes stay; an
empty table gives no rows; other columns are ignored. ``kept`` may cut inside a
character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common
from .debruijn import _taken

LENGTH, GRAM = 50, 16
SHALLOW = 40
PIECE = 1 << 20


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, first byte highest (zeros past the end)."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        x = (x[:-n] << np.uint64(8 * n)) | x[n:]
    return x


def runs_of(batch: pa.RecordBatch, length: int, gram: int):
    """The bytes, and per run of windows its anchor, start, number of windows, row and start in its text."""
    data, offsets = common.joined(batch.column("text"))
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return data, none.view(np.uint64), none, none, none, none
    e = eights(data)
    g = common.mix(e[:len(data) - gram + 1], e[gram - 8:len(data) - 7], 3) if gram > 8 else e[:len(data) - gram + 1]
    least = common.sliding_min(g, length - gram + 1)
    doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(offsets))
    starts, sizes = anchors.runs(least, doc[:n], doc[length - 1:])
    row = doc[starts]
    return data, least[starts], starts, sizes, row, starts - offsets[row]


class BlindTrie:
    """Distinct byte strings of one length, ordered by a trie that keeps only branching places."""

    def __init__(self):
        self.root = None  # a string, or [place, {byte: node}]

    def add(self, s: bytes) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while not isinstance(node, bytes):  # blindly down to some leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node == s:
            return
        differ = next(i for i, (a, b) in enumerate(zip(node, s)) if a != b)
        other, parent, byte, at = node, None, None, self.root
        while not isinstance(at, bytes) and at[0] < differ:
            parent, byte = at, s[at[0]]
            at = at[1][byte]
        if not isinstance(at, bytes) and at[0] == differ:
            at[1][s[differ]] = s
            return
        new = [differ, {other[differ]: at, s[differ]: s}]
        if parent is None:
            self.root = new
        else:
            parent[1][byte] = new

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def classes(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``length`` bytes at ``starts``, and for each place in the order
    the number of its class of equal strings."""
    e = eights(data)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)  # groups are numbered in order
    shallow = min(shallow, length // 8 * 8)
    for depth in range(0, shallow, 8):
        size = np.bincount(group)
        some = np.flatnonzero(size[group] > 1)
        key = e[starts[order[some]] + depth]
        by = np.argsort(key)
        if depth:  # back into the groups: two plain sorts take less time than one by two keys
            rank = np.empty(len(some), np.int64)
            rank[by] = np.cumsum(np.concatenate([[0], key[by[1:]] != key[by[:-1]]])) if len(some) else 0
            by = np.argsort(group[some] << 32 | rank)
        order[some] = order[some][by]
        key = key[by]
        split = np.zeros(len(order), np.int64)
        split[some[1:]] = key[1:] != key[:-1]
        group = np.cumsum(split | np.concatenate([[0], group[1:] != group[:-1]]).astype(np.int64))
    if shallow == length or not len(starts):
        return order, group
    # deep: what is equal to the rest's end needs no order; other groups get a blind trie
    at = starts[order]
    rest = length - shallow
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group]
    differs = np.zeros(len(order), bool)
    for depth in [*range(shallow, length - 7, 8), length - 8] if rest >= 8 else []:
        key = e[at + depth]
        differs |= key != key[head]
    if rest < 8:
        for depth in range(shallow, length):
            differs |= data[at + depth] != data[at[head] + depth]
    mixed = np.unique(group[differs])
    raw = data.tobytes()
    number = np.zeros(len(order), np.int64)  # inside its group
    begin, end = np.searchsorted(group, mixed), np.searchsorted(group, mixed, "right")
    for b, n in zip(begin.tolist(), end.tolist()):
        rests = [raw[s + shallow:s + length] for s in at[b:n].tolist()]
        trie = BlindTrie()
        for r in set(rests):
            trie.add(r)
        rank = {r: i for i, r in enumerate(trie.ordered())}
        own = np.array([rank[r] for r in rests])
        by = np.argsort(own, kind="stable")
        order[b:n] = order[b:n][by]
        number[b:n] = own[by]
    new = np.concatenate([[False], (group[1:] != group[:-1]) | (number[1:] != number[:-1])])
    return order, np.cumsum(new)


def candidate_runs(docs: DataFrame, hot: np.ndarray, length: int, gram: int, wide: bool) -> DataFrame:
    """(id, h, first): starts of the runs whose anchor stands in another document too. With an h of 32 bits
    (not ``wide``) h and the start travel as one number."""
    names = ["anchor", "id", "h", "first"] if wide else ["anchor", "id", "place"]
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            _, anchor, _, _, row, first = runs_of(batch, length, gram)
            cold = ~anchors.is_in(anchor, shared.value)
            row, first = row[cold], first[cold]
            h = batch.column("h").to_numpy()[row]
            place = [pa.array(h), pa.array(first.astype(np.int64))] if wide else [pa.array((h << 32) | first)]
            yield pa.record_batch([pa.array(anchor[cold].view(np.int64)), batch.column("id").take(pa.array(row)), *place], names)

    def shared_by_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor; of each anchor only rows of its first id wait for another id."""
        held = np.zeros((len(names), 0), np.int64)
        passed = None  # an anchor whose rows all pass by now
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
            if not rows.shape[1]:
                continue
            head = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, rows.shape[1])))
            more = np.minimum.reduceat(rows[1], head) != np.maximum.reduceat(rows[1], head)
            if passed is not None and rows[0, 0] == passed:
                more[0] = True
            ok = more[group]
            wait = ~ok & (group == len(head) - 1)
            passed = rows[0, -1] if more[-1] else None
            yield pa.record_batch([pa.array(r[ok]) for r in rows[1:]], names[1:])
            held = rows[:, wait]

    kinds = [f"{c} long" for c in names]
    rows = (docs.mapInArrow(emit, ", ".join(kinds)).repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(shared_by_documents, ", ".join(kinds[1:])))
    if wide:
        return rows.select("id", "h", F.col("first").cast("int").alias("first"))
    return rows.select("id", F.shiftrightunsigned("place", 32).alias("h"),
                       F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("first"))


def run_rows(docs: DataFrame, starts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, id, h, first, bytes) of all candidate runs."""
    listed = starts.groupBy("id", "h").agg(F.collect_set("first").alias("starts"))
    long_enough = (docs.where(F.octet_length("text") >= length).select("id", "h", "text")
                   .mapInArrow(common.packed, "id long, h long, n long, z binary"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.unpacked(batches, PIECE):
            data, anchor, begin, sizes, row, first = runs_of(batch, length, gram)
            lists = batch.column("starts")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            wanted = np.unique(owner << 32 | lists.flatten().to_numpy())
            some = anchors.is_in(row.astype(np.int64) << 32 | first, wanted)
            begin, sizes, row = begin[some], sizes[some] + length - 1, pa.array(row[some])
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(_taken(data, begin, sizes))])
            yield pa.record_batch([pa.array(anchor[some].view(np.int64)), batch.column("id").take(row), batch.column("h").take(row),
                                   pa.array(first[some].astype(np.int32)), raw], ["anchor", "id", "h", "first", "bytes"])

    return long_enough.join(listed, ["id", "h"]).select("id", "h", "n", "z", "starts").mapInArrow(
        emit, "anchor long, id long, h long, first int, bytes binary")


def repeated_in_runs(rows: DataFrame, length: int) -> DataFrame:
    """(id, h, first, end) in bytes: the stretches whose windows also stand in a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchor = held.column("anchor").to_numpy()
            done = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            if done:
                yield spans(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield spans(held)

    def spans(t: pa.Table) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(b, len(number)) for b in t.column("bytes").to_pylist()])
        doc = t.column("id").to_numpy()
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        strings = list(number)
        sizes = np.array([len(s) - length + 1 for s in strings])
        begin = np.concatenate([[0], np.cumsum(sizes + length - 1)[:-1]])
        data = np.frombuffer(b"".join(strings), np.uint8)
        owner = np.repeat(np.arange(len(strings)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, cls = classes(data, begin[owner] + inner, length)
        smallest = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, cls, least[owner[order]])
        of_window = np.empty(len(order), np.int64)
        of_window[order] = smallest[cls]
        first = t.column("first").to_numpy()
        n_windows = sizes[kind]
        # a copy of a run in a smaller document covers all; the first copies are seen window by window
        whole = np.flatnonzero(doc > least[kind])
        own = np.flatnonzero(doc == least[kind])
        run_of = np.repeat(own, n_windows[own])
        window0 = (np.cumsum(sizes) - sizes)[kind]
        values = _taken(of_window, window0[own], n_windows[own])
        a, b = anchors.spans_of(values < doc[run_of], run_of)
        base = np.cumsum(n_windows[own]) - n_windows[own]
        place = np.searchsorted(base, a, "right") - 1 if len(base) else a
        row = np.concatenate([whole, own[place]])
        begins = np.concatenate([first[whole], first[own[place]] + a - base[place]])
        ends = np.concatenate([first[whole] + n_windows[whole] - 1, first[own[place]] + b - base[place]]) + length
        return pa.record_batch([pa.array(doc[row]), t.column("h").take(pa.array(row)).combine_chunks(),
                                pa.array(begins.astype(np.int32)), pa.array(ends.astype(np.int32))], ["id", "h", "first", "end"])

    return (rows.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, "id long, h long, first int, end int"))


def repeated_hot(docs: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """The same for runs with hot anchors, window by window in Spark's own aggregation and join."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            data, anchor, begin, sizes, row, first = runs_of(batch, length, gram)
            some = anchors.is_in(anchor, shared.value)
            begin, sizes, row, first = begin[some], sizes[some], row[some], first[some]
            at = _taken(np.arange(len(data)), begin, sizes)
            place = at - np.repeat(begin - first, sizes)
            raw = _taken(data, at, np.full(len(at), length))
            offsets = (np.arange(len(at) + 1) * length).astype(np.int32)
            row = pa.array(np.repeat(row, sizes))
            yield pa.record_batch([
                pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]),
                batch.column("id").take(row), batch.column("h").take(row), pa.array(place.astype(np.int32))],
                ["bytes", "id", "h", "first"])

    rows = common.stored(docs.mapInArrow(emit, "bytes binary, id long, h long, first int"), "hot-windows")
    least = rows.groupBy("bytes").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").drop("most")
    least = common.stored(least, "hot-least")  # a join with an aggregate in the same stage cannot be split
    return rows.join(least, "bytes").where("id > least").select("id", "h", "first", (F.col("first") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: bool = True) -> DataFrame:
    """(id, h, first, end): bytes covered by a string of ``length`` bytes that also starts in a smaller document.

    wide: rows of one id are told apart by 64 bits of their text; 32 do only where no id occurs twice.
    """
    d = anchors.keyed(docs, wide)
    hot = anchors.hot(d, lambda batch: runs_of(batch, length, gram)[1])
    starts = common.stored(candidate_runs(d, hot, length, gram, wide), "candidates")
    spans = repeated_in_runs(run_rows(d, starts, length, gram), length)
    if len(hot):
        spans = spans.unionByName(common.stored(repeated_hot(d, hot, length, gram), "hot-spans"))  # own plan: skew can be split
    return common.stored(spans, "spans")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document."""
    wide = anchors.ids_repeat(docs)
    rows = anchors.with_spans(docs, repeated_spans(docs, length, gram, wide), wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode()
                if not spans:
                    out.append((len(raw), 0, 0, raw))
                    continue
                gone = anchors.covered(len(raw), spans)
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), n_spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array([x[i] for x in out], pa.int64()) for i in range(3)],
                                   pa.array([x[3] for x in out], pa.binary())],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return without_repeats(docs, length, gram).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
