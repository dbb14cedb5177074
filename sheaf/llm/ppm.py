"""Operator 4: language-model scores by prediction by partial matching.

A trie of byte contexts up to ``ORDER`` bytes holds how often each byte follows
each context in the training documents. A byte is coded in the longest known
context; where it never followed, an escape (method C: as many escape counts
as distinct followers) goes to the context one byte shorter, in which the
bytes already ruled out are excluded, down to an even choice among all bytes
left. A text starts after a start mark and closes with an end mark; its score
is the log10 probability of its bytes and end mark. A-Z count as lower case.

Every training count is kept. Tables by byte string, one for each context
length, hold the counts of all strings that stand in any document; from the
empty context up, each takes the log probabilities of the strings one byte
shorter and the totals and followers of its contexts, so that at ``ORDER`` every
string of the corpus has its exact log probability. The most frequent strings
over all documents, ``SHARE`` at most, go to every task; all others are joined
on the string. Words alike: those that are at least one in ``HEAD`` of all words
(HEAD words at most, and none longer than ``HEAD_BYTES``) go to every task, all
others are joined on the word. Nothing that is joined can be hot, since it is
rarer than that.

Defined results: null text is empty, an empty text has its end alone; without
training documents every byte is an even choice; a null doc_id counts as empty
text in the held-out rule; repeated rows count repeatedly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
SHARE = 1 << 20
HEAD, HEAD_BYTES = 1 << 21, 32
SYMBOLS = 257  # bytes and the end mark
START, END = 255, 254  # no byte of UTF-8 text
FLUSH_GRAMS, FLUSH_WORDS = 2_000_000, 300_000
DOCS_KEY = 7 << 56  # counts training documents
EMPTY = np.uint64(2 ** 64 - 1)  # no string
INSERTED = 1 << 18  # strings that a lookup takes in at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.tobytes()


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end mark the ORDER + 1 bytes that end there, as one
    number, and where each text begins among them."""
    data, offsets = common.joined(column)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    line = np.full(len(data) + n * (ORDER + 1), START, np.uint8)
    line[np.arange(len(data)) + doc * (ORDER + 1) + ORDER] = _LOWER[data]
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1)
    line[offsets[1:] + np.arange(n) * (ORDER + 1) + ORDER] = END
    key = np.zeros(len(line) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        key = (key << np.uint64(8)) | line[i:len(line) - ORDER + i]
    keep = np.ones(len(key), bool)
    inner = starts[1:]
    keep[(inner[:, None] - np.arange(1, ORDER + 1)).ravel()] = False  # those that reach into the next text
    return key[keep], offsets[:-1] + np.arange(n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.diff(np.append(at, len(keys)))


def counts(docs: DataFrame) -> DataFrame:
    """(gram, word, n, n_all): training counts of strings of ORDER + 1 bytes and of words, and
    their counts over all documents; summed over the corpus."""
    common.ship(docs.sparkSession)
    names = ["gram", "word", "n", "n_all"]

    def gram_rows(keys, n):
        """keys: the gram and one bit, whether it stands in a held-out document."""
        train = np.where(keys & np.uint64(1), 0, n)
        yield pa.record_batch([pa.array((keys >> np.uint64(1)).view(np.int64)), pa.nulls(len(keys), pa.binary()),
                               pa.array(train.astype(np.int64)), pa.array(n.astype(np.int64))], names)

    def word_rows(train, rest):
        words = list(train.keys() | rest.keys())
        t = np.fromiter(map(train.__getitem__, words), np.int64, len(words))
        r = np.fromiter(map(rest.__getitem__, words), np.int64, len(words))
        yield pa.record_batch([pa.nulls(len(words), pa.int64()), pa.array(words, pa.binary()), pa.array(t), pa.array(t + r)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest, n_docs = Counter(), Counter(), 0
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in common.pieces(batches):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n_docs += int((~held).sum())
            for text, h in zip(batch.column("text").to_pylist(), held.tolist()):
                (rest if h else train).update(text.encode().translate(_LOWER_BYTES).split())
            gram, starts = grams(batch.column("text"))
            each = np.diff(np.append(starts, len(gram)))
            k, c = _distinct(gram << np.uint64(1) | np.repeat(held, each).astype(np.uint64))
            keys, n = _summed(np.concatenate([keys, k]), np.concatenate([n, c]))
            if len(keys) > FLUSH_GRAMS:
                yield from gram_rows(keys, n)
                keys, n = keys[:0], n[:0]
            if len(train) + len(rest) > FLUSH_WORDS:
                yield from word_rows(train, rest)
                train, rest = Counter(), Counter()
        yield from gram_rows(keys, n)
        yield from word_rows(train, rest)
        yield pa.record_batch([pa.array([DOCS_KEY]), pa.nulls(1, pa.binary()), pa.array([n_docs], pa.int64()),
                               pa.nulls(1, pa.int64())], names)

    parts = docs.select("text", "held_out").mapInArrow(run, "gram long, word binary, n long, n_all long")
    return parts.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


class Lookup:
    """Values of 64-bit keys by open addressing; NaN where a key is unknown."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.full(1 << self.bits, np.nan)
        for at in range(0, len(keys), INSERTED):
            self._insert(keys[at:at + INSERTED], values[at:at + INSERTED])

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = keys[todo[free]]  # of several, the last stays
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = (keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], np.nan)
        todo = np.flatnonzero((got != keys) & (got != EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (got != EMPTY)
            todo, slot = todo[more], slot[more]
        return out


def model(byte_counts: DataFrame) -> DataFrame:
    """(gram, n_all, p) of every string of ORDER + 1 bytes of all documents: p is the log10
    probability of its last byte after the others.

    For each context length j, from the empty context: total and followers of the context, w (the
    log probability of the byte after an escape from the context, its followers excluded) and p
    (that of the byte in the longest known of the contexts up to j). A string has at most 256
    strings that are one byte longer, and a context 257 that follow: no join or window here has a hot key.
    """
    log = lambda x: F.log10(F.greatest(x, F.lit(1)).cast("double"))
    at = {ORDER: byte_counts.select("gram", "n", "n_all")}
    for j in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        at[j] = common.stored(at[j + 1].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n")), f"counts-{j}")
    seen = F.col("n") > 0
    below = None
    for j in range(ORDER + 1):
        rows = at[j].withColumn("context", F.shiftright("gram", 8))
        here = Window.partitionBy("context")
        if below is None:
            total, followers = F.sum("n").over(here), F.count_if(seen).over(here)
            rows = rows.withColumns({"total": total, "followers": followers})
            w = -F.log10((SYMBOLS - F.col("followers")).cast("double"))
            unknown = w
        else:
            rows = (rows.withColumn("less", F.col("gram").bitwiseAND(F.lit((1 << 8 * j) - 1)))
                    .join(below, "less"))
            rows = rows.withColumns({
                "total": F.sum("n").over(here), "followers": F.count_if(seen).over(here),
                "rest": F.col("total_less") - F.sum(F.when(seen, F.col("n_less")).otherwise(0)).over(here)})
            new = F.col("followers_less") - F.col("followers")
            mass = log(F.col("rest") + new)
            w = (F.when(F.col("n_less") > 0, log(F.col("n_less")) - mass)
                 .when(new > 0, log(new) - mass + F.col("w_less")).otherwise(F.col("w_less")))
            unknown = F.col("p_less")
        alone = log(F.col("total") + F.col("followers"))
        p = (F.when(seen, log(F.col("n")) - alone)
             .when(F.col("followers") > 0, log(F.col("followers")) - alone + F.col("w")).otherwise(unknown))
        rows = rows.withColumn("w", w).withColumn("p", p)
        if j < ORDER:
            below = common.stored(rows.select(F.col("gram").alias("less"), *[
                F.col(c).alias(f"{c}_less") for c in ("n", "total", "followers", "w", "p")]), f"order-{j}")
    return rows.select("gram", "n_all", "p")


def least_count(model: DataFrame) -> int:
    """The least power of two that at most SHARE strings reach with their counts over all documents."""
    power = F.length(F.bin("n_all")) - 1
    sizes = {r["power"]: r["n"] for r in model.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least = max(sizes, default=0) + 1
    while least > 0 and sum(n for k, n in sizes.items() if k >= least - 1) <= SHARE:
        least -= 1
    return 1 << least


def score(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    all_counts = common.stored(counts(d), "counts")
    words, byte_counts = all_counts.where("word is not null"), all_counts.where(F.col("gram") < DOCS_KEY)
    w = words.agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.count_if(F.col("n") > 0).alias("v")).first()
    docs_row = all_counts.where(F.col("gram") == DOCS_KEY).agg(F.sum("n").alias("docs")).first()
    n_docs = int(docs_row["docs"] or 0)
    train_tokens, distinct = int(w["n"] or 0) + n_docs, int(w["v"] or 0) + (n_docs > 0)
    log_all = math.log10(train_tokens + 0.1 * (distinct + 1))
    grams_p = common.stored(model(byte_counts), "model")
    frequent = F.col("n_all") >= least_count(grams_p)
    often = (F.col("n_all") >= max(1, -(-int(w["n_all"] or 0) // HEAD))) & (F.octet_length("word") <= HEAD_BYTES)
    head_words = spark.sparkContext.broadcast(words.where(often).select("word", "n").toArrow())
    kept = grams_p.where(frequent).select("gram", "p").toArrow()
    head_grams = spark.sparkContext.broadcast(Lookup(kept.column("gram").to_numpy().view(np.uint64), kept.column("p").to_numpy()))
    del kept
    tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_grams, value = head_grams.value, {}
        unseen = math.log10(0.1) - log_all
        for part in head_words.value.to_batches(max_chunksize=100_000):
            logs = np.log10(part.column("n").to_numpy() + 0.1) - log_all
            value.update(zip(part.column("word").to_pylist(), np.where(part.column("n").to_numpy() > 0, logs, unseen).tolist()))
        end = math.log10(n_docs + 0.1) - log_all
        for batch in common.pieces(batches):
            tokens, known, base, rare = [], [], [], []
            for text in batch.column("text").to_pylist():
                each = text.encode().translate(_LOWER_BYTES).split()
                got = list(map(value.get, each))
                miss = [x for x, v in zip(each, got) if v is None]
                tokens.append(len(each) + 1)
                known.append(len(each) - len(miss) - got.count(unseen) + (n_docs > 0))
                base.append(math.fsum(v for v in got if v is not None) + end)
                rare.append([{"word": x, "n": c} for x, c in Counter(miss).items()])
            key, starts = grams(batch.column("text"))
            logs = known_grams(key)
            others = np.isnan(logs)
            sums = np.add.reduceat(np.where(others, 0.0, logs), starts)
            ends = np.cumsum(np.add.reduceat(others, starts, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                             pa.array(key[others].view(np.int64)))
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base, pa.float64()), pa.array(sums), pa.array(rare, tail), lists],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "rare", "grams"])

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, "
                             "head_score double, rare array<struct<word:binary,n:bigint>>, grams array<bigint>")
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    c = words.where(~often & (F.col("n") > 0)).select("word", F.col("n").alias("c"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(c, "word", "left")
    rest = rare.groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - log_all)).alias("base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"))
    others = rows.select("row", F.explode("grams").alias("gram")).join(
        grams_p.where(~frequent).select("gram", "p"), "gram").groupBy("row").agg(F.sum("p").alias("p"))
    return rows.drop("rare", "grams").join(rest, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.coalesce("p", F.lit(0.0))).alias("score"))
