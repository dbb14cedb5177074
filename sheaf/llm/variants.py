"""Operator 12: spelling variants by permuterm rotations.

The vocabulary is counted over all documents. Every word closed by a terminator
has one rotation for each of its letters and the terminator. A rotation without
its last letter, the edited one, is a prefix: words that differ there alone
share it, and the word that lacks the letter has it as a whole rotation. So
rotations are shuffled by that prefix and sorted in it, and one scan of each
group gives every member the number of its neighbours and the best of them.
No pair of a group is made: a member needs the first of the group's order (or
the second, if it is the first itself). A prefix has one whole rotation and as
many others as the alphabet has letters at most, so no group is hot.

Inserting a letter beside an equal one gives one word by several edits; only
the first letter of such a stretch stands for them, and a neighbour counts once.

Words are nearest to spellings that occur often: a word's form is its most
frequent neighbour, if that one occurs ``RATIO`` times as often at least. Forms
are followed to the last by doubling steps; their counts double at each step,
so there are few rounds.

Defined results: null and empty texts have no words; a null doc_id is written
as the empty text; repeated rows count again; ties go to the least word in
code-point order; a long text is read in slices; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT = 5, 3
EVERY = 97  # one occurrence in so many loses a letter
RATIO = 2
END = "$"  # terminator: no letter
SLICE = 1 << 20  # characters of a long text read at once
_RUN, _LETTER = re.compile("[a-zÀ-ÿ]+"), re.compile("[a-zÀ-ÿ]")


def _counted(text: str) -> Counter:
    """Runs of letters of a lower-cased text."""
    if len(text) <= 2 * SLICE:
        return Counter(_RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        cut = min(len(text), at + SLICE)
        begin = cut
        while at < begin < len(text) and _LETTER.match(text, begin - 1):  # a run that goes on is read whole
            begin -= 1
        found.update(_RUN.findall(text, at, begin))
        run = _RUN.match(text, begin) if begin < cut else None
        if run:
            found[run.group()] += 1
        at = run.end() if run else cut
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters that occur LEAST_COUNT times or more over all documents."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.col("text").cast("binary").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, least, every = zlib.crc32, LEAST_LENGTH, EVERY
        for batch in common.pieces(batches):
            total: dict[str, int] = {}
            get = total.get
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = crc(f"{doc_id}:".encode())
                for word, n in _counted(text.lower().decode("utf-8", "replace")).items():  # bytes: A-Z alone
                    h = crc(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least:
                        total[word] = get(word, 0) + n
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                  ["word", "n"])

    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return common.stored(counts.where(F.col("n") >= LEAST_COUNT), "words")


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, n, word): every rotation as a whole, and without its last letter.

    first: the edited letter does not follow an equal one, so that it stands for its stretch.
    """
    whole = F.expr(f"transform(sequence(0, length(word)), i -> named_struct("
                   f"'key', concat(substr(word, i + 1), '{END}', substr(word, 1, i)), 'whole', true, 'first', true))")
    edited = F.expr(f"transform(sequence(1, length(word)), i -> named_struct("
                    f"'key', concat(substr(word, i + 1), '{END}', substr(word, 1, i - 1)), 'whole', false, "
                    f"'first', i = 1 or substr(word, i - 1, 1) != substr(word, i, 1)))")
    return words.select(F.explode(F.concat(whole, edited)).alias("r"), "n", "word").select("r.*", "n", "word")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<less, word>): neighbours of each word that has any; less is minus the best one's count."""
    group = Window.partitionBy("key")
    order = group.orderBy("whole", F.desc("n"), "word")
    up_to_all = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    edited, first = ~F.col("whole"), F.col("first")
    rows = rotations(words).withColumn("me", me).select(
        "word", "whole", "first", F.row_number().over(order).alias("rank"),
        F.count_if(edited).over(up_to_all).alias("n_edited"),
        F.count_if(edited & first).over(up_to_all).alias("n_first"),
        F.min(F.when(F.col("whole"), F.col("me"))).over(up_to_all).alias("lacking"),
        F.min(F.when(edited & first, F.col("me"))).over(up_to_all).alias("best_first"),
        F.first(F.when(edited, F.col("me"))).over(up_to_all).alias("top"),
        F.lead(F.when(edited, F.col("me"))).over(order).alias("next"))
    shorter = F.when(F.col("first"), F.col("lacking"))
    n = F.when(F.col("whole"), F.col("n_first")).otherwise(
        F.col("n_edited") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(F.col("whole"), F.col("best_first")).otherwise(
        F.least(F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top")), shorter))
    return (rows.select("word", n.alias("n"), best.alias("best")).where("n > 0")
            .groupBy("word").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): the last form that is reached.

    ``forms`` has no cycles (counts grow). Each round doubles the steps taken; a form without a
    form of its own ends its chain.
    """
    at = common.stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(then, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = common.stored(step, "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = vocabulary(docs)
    near = words.join(neighbours(words), "word", "left")
    is_form = -F.col("best")["less"] >= RATIO * F.col("n")
    near = common.stored(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")["word"]).alias("form"),
        F.when(is_form, -F.col("best")["less"]).alias("form_n")), "near")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
