"""Operator 11: alignment of two tokenizers' tokens, and how often each pair of ids is linked.

Both tokenizers read a space and the text. Byte offsets where tokens of both
end are cuts, found by divide and conquer: a common end near the middle of an
interval is looked up by bisection in the other side's ends, both halves go on
alike, and an interval without a cut is a group. Every token of A in a group is
linked with every token of B in it.

A single space between two other characters starts a new token on both sides
(checked on the pieces of B), so the stretch that it opens encodes alike
everywhere: a task aligns each different stretch once and adds documents up
from that. New stretches are encoded together and aligned as one text, and all
bytes are compared.

The count of an id pair is the number of documents that hold it linked, over
the whole corpus. Documents give each of their pairs once; these are counted
with partial aggregation. The most frequent pairs (at most ``SHARE``, so of
bounded size) go to every task; all others are joined on their ids, where none
is frequent enough to be hot.

Defined results: texts that are null or empty, or that a tokenizer changes (as
U+2581, which B reads as a space), have no tokens: counts of zero and an empty
``groups``. Repeated rows count again. Strings of special tokens are plain
text. A long text is one row in a task; its pairs are counted by id. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters

SHARE = 1 << 20  # pairs that every task gets
MEMO_ENTRIES, MEMO_BYTES = 150_000, 64 << 20  # stretches that a task remembers, and the size of what it keeps for them
TOGETHER = 20_000  # stretches encoded as one text
NEAR = 8  # ends tried on both sides of the middle for all intervals together
LARGE = 4096  # links of a group whose pairs are counted by id
PIECE = 2 << 20  # bytes of text handled at once
B_BITS, PAIR_BITS = 18, 36  # a pair is a << B_BITS | b
_CUT = re.compile(r"(?<=\S) (?=\S)")


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and tokens of B up to each offset where both sides end, in order.

    Both arrays ascend and have one last value. All intervals of a depth are halved together: the
    end of A nearest to the middle that B has too is the cut; intervals without one are leaves.
    """
    a0, a1 = np.zeros(1, np.int64), np.array([len(ends_a)])
    b1 = np.array([len(ends_b)])
    leaves = []
    while len(a0):
        last = a1 - 1  # ends with the interval on both sides
        middle = (a0 + last) // 2
        cut, to = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
        left = np.flatnonzero(last > a0)
        for step in range(NEAR):
            for at in (middle[left] - step, middle[left] + step)[:1 + (step > 0)]:
                ok = (at >= a0[left]) & (at < last[left]) & (cut[left] < 0)
                at, some = at[ok], left[ok]
                place = np.searchsorted(ends_b, ends_a[at])
                hit = ends_b[place] == ends_a[at]
                cut[some[hit]], to[some[hit]] = at[hit], place[hit]
            left = left[(cut[left] < 0) & ((middle[left] - step > a0[left]) | (middle[left] + step < last[left] - 1))]
            if not len(left):
                break
        for i in left.tolist():  # few: the cut is farther off
            cut[i], to[i] = _farther(ends_a, ends_b, int(a0[i]), int(last[i]), int(middle[i]))
        none = cut < 0
        leaves.append((a1[none], b1[none]))
        cut, to, a0, a1, b1 = cut[~none], to[~none], a0[~none], a1[~none], b1[~none]
        a0, a1, b1 = np.append(a0, cut + 1), np.append(cut + 1, a1), np.append(to + 1, b1)
    up_to_a, up_to_b = (np.sort(np.concatenate(x)) for x in zip(*leaves))
    return up_to_a, up_to_b


def _farther(ends_a: np.ndarray, ends_b: np.ndarray, first: int, last: int, middle: int) -> tuple[int, int]:
    """The cut nearest to the middle beyond NEAR tokens, looked up in doubling stretches; (-1, 0) without one."""
    low, high, width = middle - NEAR + 1, middle + NEAR - 1, NEAR
    while low > first or high < last - 1:
        at = np.concatenate([np.arange(max(first, low - width), max(first, low)),
                             np.arange(min(last, high + 1), min(last, high + 1 + width))])
        place = np.searchsorted(ends_b, ends_a[at])
        hit = np.flatnonzero(ends_b[place] == ends_a[at])
        if len(hit):
            best = hit[np.argmin(np.abs(at[hit] - middle))]
            return int(at[best]), int(place[best])
        low, high, width = low - width, high + width, 2 * width
    return -1, 0


class Aligner:
    """Groups of stretches, remembered: numbers, text of the groups and linked pairs of each."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)  # ids as written inside a group and at the end of its half
        self.written = [b"%d%s" % (i, mark) for size, marks in ((n, b",|"), (m, b",;")) for mark in (marks[:1], marks[1:])
                        for i in range(size)]
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)  # no piece goes on over a space
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}  # stretches without white space at an edge: alike wherever a single space opens them
        self.edged: dict[str, int] = {}  # the others, at the edge of a text
        self.texts: list[bytes] = []  # each group closed by ;
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; A of -1: not kept
        self.pairs = self.times = np.zeros(0, np.int64)  # of all stretches in turn
        self.ends = np.zeros(1, np.int64)  # where each stretch's pairs end
        self.size = 0

    def cut(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuttable else [text]

    @staticmethod
    def _free(s: str) -> bool:
        return bool(s) and not s[0].isspace() and not s[-1].isspace()

    def learn(self, stretches: Iterable[str]) -> None:
        alone, together = [], []
        for s in stretches:
            (together if self.cuttable and "▁" not in s and self._free(s) else alone).append(s)
        todo = [together[at:at + TOGETHER] for at in range(0, len(together), TOGETHER)] + [[s] for s in alone]
        while todo:
            some = todo.pop()
            if self._add(some):
                continue
            if len(some) == 1:
                none = np.zeros(0, np.int64)
                self._keep(some, [b""], np.array([[-1, 0, 0, 0]]), none, none, np.zeros(1, np.int64))
            else:
                todo += [some[:len(some) // 2], some[len(some) // 2:]]

    def _add(self, some: list[str]) -> bool:
        """Align stretches joined by spaces; False where a tokenizer changes them or they do not part."""
        text = " ".join(some)
        raw = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        to_a, to_b = common_cuts(ends_a, ends_b)
        ends = np.cumsum(np.array([len(s.encode()) + 1 for s in some]))
        close = np.searchsorted(ends_a[to_a - 1], ends)  # each stretch's last group
        if (close >= len(to_a)).any() or (ends_a[to_a - 1][close] != ends).any():
            return False
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        n_a, n_b = to_a - from_a, to_b - from_b
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[to_a - 1], last_b[to_b - 1] = True, True
        n, m = len(self.a_bytes), len(self.b_bytes)
        code = np.empty(len(a) + len(b), np.int64)  # in the order of the groups, A before B
        code[np.arange(len(a)) + from_b[group_a]] = a + n * last_a
        code[np.arange(len(b)) + to_a[group_b]] = b + 2 * n + m * last_b
        written = list(map(self.written.__getitem__, code.tolist()))
        stop = (to_a + to_b)[close]
        texts = [b"".join(written[x:y]) for x, y in zip([0, *stop[:-1].tolist()], stop.tolist())]
        pairs, times, owner = self._linked(a, b, from_a, from_b, n_a, n_b, group_a)
        first = np.append(0, close[:-1] + 1)
        sums = [np.add.reduceat(x, first) for x in (n_a, n_b, np.ones(len(n_a), np.int64), n_a * n_b)]
        self._keep(some, texts, np.stack(sums, axis=1), pairs, times, np.searchsorted(owner, close, "right"))
        return True

    @staticmethod
    def _linked(a, b, from_a, from_b, n_a, n_b, group_a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, times and group of all links; in a large group each pair of ids once."""
        large = n_a * n_b > LARGE
        token = np.flatnonzero(~large[group_a])
        each = n_b[group_a[token]]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        owner = np.repeat(group_a[token], each)
        pairs = np.repeat(a[token], each) << B_BITS | b[from_b[owner] + at]
        times = np.ones(len(pairs), np.int64)
        for g in np.flatnonzero(large).tolist():
            x, i = np.unique(a[from_a[g]:from_a[g] + n_a[g]], return_counts=True)
            y, j = np.unique(b[from_b[g]:from_b[g] + n_b[g]], return_counts=True)
            place = int(np.searchsorted(owner, g))
            pairs = np.insert(pairs, place, (x[:, None] << B_BITS | y).ravel())
            times = np.insert(times, place, (i[:, None] * j).ravel())
            owner = np.insert(owner, place, np.full(len(x) * len(y), g))
        return pairs, times, owner

    def _keep(self, some: list[str], groups: list[bytes], numbers: np.ndarray, pairs: np.ndarray, times: np.ndarray,
              ends: np.ndarray) -> None:
        start = len(self.texts)
        if len(some) == 1 and not self._free(some[0]):
            self.edged[some[0]] = start
        else:
            self.at.update(zip(some, range(start, start + len(some))))
        self.texts += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.size += sum(map(len, some)) + sum(map(len, groups)) + 16 * len(pairs)

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (n_a, n_b, n_groups, n_links) and groups of each text, and its pairs: row ends, ids, times."""
        if len(self.texts) > MEMO_ENTRIES or self.size > MEMO_BYTES:
            self.forget()
        parts = [t.split(" ") if self.cuttable else [t] for t in texts]
        new = set().union(*parts).difference(self.at)
        self.learn(filter(self._free, new))
        get, rows, slow = self.at.get, [], []
        for i, p in enumerate(parts):
            found = list(map(get, p))
            rows.append(found)
            if None in found:
                slow.append(i)
        if slow:  # texts with other white space: cut only where a single space stands between other characters
            for i in slow:
                parts[i] = self.cut(texts[i])
            self.learn(set().union(*[parts[i] for i in slow]).difference(self.at, self.edged))
            for i in slow:
                rows[i] = [self.at[s] if s in self.at else self.edged[s] for s in parts[i]]
        n = len(texts)
        sizes = np.fromiter(map(len, rows), np.int64, n)
        which = np.fromiter((w for r in rows for w in r), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(n), sizes)
        numbers = self.numbers
        bad = np.zeros(n, bool)
        bad[doc[numbers[which, 0] < 0]] = True
        bad |= np.fromiter((not t for t in texts), bool, n)
        keep = ~bad[doc]
        doc, which = doc[keep], which[keep]
        ends = np.searchsorted(doc, np.arange(n), "right")
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(numbers[which], axis=0)])
        totals = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        joined = [None if b else b"".join(map(self.texts.__getitem__, r))[:-1] for b, r in zip(bad.tolist(), rows)]
        return totals, joined, *self._pairs(doc, which, n)

    def _pairs(self, doc: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of each row with their times: ends of rows, pairs, times."""
        key, count = np.unique(doc << 32 | which, return_counts=True)
        doc, which = key >> 32, key & 0xFFFFFFFF
        start = self.ends[which]
        each = self.ends[which + 1] - start
        at = np.arange(each.sum()) + np.repeat(start - (np.cumsum(each) - each), each)
        pairs, times = self.pairs[at], self.times[at] * np.repeat(count, each)
        full = np.repeat(doc, each) << PAIR_BITS | pairs
        order = np.argsort(full, kind="stable")
        full, times = full[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else order
        times = np.add.reduceat(times, first) if len(first) else times
        full = full[first]
        return np.searchsorted(full >> PAIR_BITS, np.arange(n), "right"), full & ((1 << PAIR_BITS) - 1), times


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def alignments(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) of every document.

    groups: the ids of each group as ``a1,a2|b1;a3|b2,b3``; groups_sha256 its SHA-256 ('' without
    tokens); pairs: the different linked ids as a << B_BITS | b, times: links of each.
    """
    common.ship(docs.sparkSession)
    d = common.texts(docs)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, limit=PIECE):
            totals, groups, ends, pairs, times = aligner(a_path, b_path).align(batch.column("text").to_pylist())
            digests = ["" if g is None else hashlib.sha256(g).hexdigest() for g in groups]
            columns = [batch.column("doc_id"), *[pa.array(totals[:, k]) for k in range(4)],
                       pa.array(digests, pa.string()), _lists(ends, pairs), _lists(ends, times)]
            if with_groups:
                columns.append(pa.array([g or b"" for g in groups], pa.binary()).cast(pa.string()))
            yield pa.record_batch(columns, names)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                             "pairs array<long>, times array<long>" + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether none of its A id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size > 4 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.stored(counts, "pair-counts")
    a = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select(  # one row an id of A: a vocabulary at most
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def least_count(counts: DataFrame) -> int:
    """The least power of two that at most SHARE pairs reach with their counts."""
    power = F.length(F.bin("n")) - 1
    sizes = {r["power"]: r["k"] for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("k")).collect()}
    least = max(sizes, default=0) + 1
    while least > 0 and sum(k for p, k in sizes.items() if p >= least - 1) <= SHARE:
        least -= 1
    return 1 << least


def link_counts(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """The columns of ``alignments`` but pairs and times, with n_best and count_sum over each document's links."""
    spark = docs.sparkSession
    aligned = common.stored(alignments(docs, a_path, b_path, with_groups)
                            .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = common.stored(pair_counts(aligned), "pairs")
    frequent = F.col("n") >= least_count(counts)
    head = counts.where(frequent).toArrow().combine_chunks().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(  # at most SHARE pairs
        head.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            offsets = batch.column("pairs").offsets.to_numpy()
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = at[hit]
            sums = np.zeros((2, len(pairs) + 1), np.int64)
            for k, values in enumerate((n[at], best[at].astype(np.int64))):
                sums[k, 1:][hit] = values * times[hit]
            sums = np.cumsum(sums, axis=1)[:, offsets]
            ends = np.concatenate([[0], np.cumsum(~hit)])[offsets]
            rare = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v[~hit])) for v in (pairs, times)]
            yield pa.record_batch([*[batch.column(c) for c in kept], *[pa.array(np.diff(s)) for s in sums], *rare],
                                  [*kept, "head_sum", "head_best", "rare", "rare_times"])

    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    rows = common.stored(aligned.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + (
        ", head_sum long, head_best long, rare array<long>, rare_times array<long>")), "linked")
    rare = (rows.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("p"))
            .select("row", F.col("p.rare").alias("pair"), "p.rare_times")
            .join(counts.where(~frequent), "pair"))
    rest = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.col("rare_times")).alias("rare_sum"),
        F.sum(F.when(F.col("best"), F.col("rare_times")).otherwise(0)).alias("rare_best"))
    zero = F.lit(0).cast("long")
    return rows.join(rest, "row", "left").select(
        *[c for c in kept if c != "row"], (F.col("head_best") + F.coalesce("rare_best", zero)).alias("n_best"),
        (F.col("head_sum") + F.coalesce("rare_sum", zero)).alias("count_sum"))
