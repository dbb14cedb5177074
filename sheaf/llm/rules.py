"""Operator 3: quality rules that vote or abstain, weighed by expectation-maximisation.

Seven rules look at statistics of the whole text. Each votes good (1), bad
(-1) or abstains (0). Documents with equal votes are counted together (three
to the power of seven rows at most), and expectation-maximisation over these
counts estimates, without labels, the share of good documents and for each
rule how often it votes right on good and on bad documents. The posterior
probability of "good" replaces the rule that all must pass.

Everything is DataFrame expressions: the statistics are computed inside the
row, the only shuffle is the count of vote patterns, and each round of the
estimation is one step of a fold over that small table.

Defined results: null and empty texts have no words and fail the base rule;
with no documents the prior stays; windows of words are compared by 64-bit
hashes within one document; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS = 25
PRIOR_GOOD = 0.85
# Prior of a vote being right on a good and on a bad document, worth PRIOR_SHARE of all documents.
RIGHT_ON_GOOD, RIGHT_ON_BAD, PRIOR_SHARE = 0.97, 0.35, 0.02


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the rules use)."""
    d = common.texts(docs).select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"),
                                  F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    shift = 1
    while shift < WINDOW:  # hashes of 2, 4, 8 words
        kept = F.greatest(F.size("h") - shift, F.lit(0))
        d = d.withColumn("h", F.zip_with(F.slice("h", 1, kept), F.slice("h", 1 + shift, kept),
                                         lambda a, b: F.xxhash64(a, b)))
        shift *= 2
    at = F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    d = d.withColumn("order", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(at)))
    again = F.filter("order", lambda s, k: F.coalesce(F.get("order", k - 1)["x"] == s["x"], F.lit(False))
                     | F.coalesce(F.get("order", k + 1)["x"] == s["x"], F.lit(False)))
    d = d.withColumn("again", F.sort_array(F.transform(again, lambda s: s["i"])))
    covered = F.aggregate("again", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("end")),
                          lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i - s["end"])).alias("sum"), i.alias("end")),
                          lambda s: s["sum"])
    count = lambda cls: F.regexp_count("text", F.lit(cls)).cast("long")
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"),
                    F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                    count(r"[#*$%&|<>]").alias("n_symbols"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
                    F.size("lines").cast("long").alias("n_lines"), count(r"\p{Lu}").alias("n_upper"),
                    count("!").alias("n_exclaim"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    c = lambda n: F.col(n).cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    mean = chars / words
    return {
        "v_symbols": _vote(c("n_symbols") < 0.005 * chars, c("n_symbols") > 0.03 * chars),
        "v_lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") > 0.3 * c("n_lines")),
        "v_repeats": _vote(c("n_repeat_words") < 0.05 * words, c("n_repeat_words") > 0.2 * words),
        "v_upper": _vote(c("n_upper") < 0.1 * chars, c("n_upper") > 0.3 * chars),
        "v_exclaim": _vote(c("n_exclaim") < 0.02 * words, c("n_exclaim") > 0.2 * words),
        "v_word_size": _vote((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 20)),
        "v_distinct": _vote(c("n_distinct") > 0.4 * words, (c("n_words") >= 50) & (c("n_distinct") < 0.2 * words)),
    }


def posterior(model: dict) -> Column:
    """Probability that a document with the vote columns is good."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for v, (on_good, on_bad) in model["right"].items():
        odds = odds + F.when(F.col(v) == 1, math.log(on_good / (1 - on_bad))) \
            .when(F.col(v) == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _let(value: Column, body) -> Column:
    """``body`` of the value, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def estimate(patterns: DataFrame, names: list[str]) -> dict:
    """Expectation-maximisation over vote patterns (columns ``names`` and their count ``n``).

    The patterns (three to the power of the rules at most) are one sorted array; the rounds are a
    fold over it, so all of it is one job however many rounds there are.
    """
    rules = F.sequence(F.lit(0), F.lit(len(names) - 1))
    each = lambda of: F.transform(rules, of)
    start = F.struct(F.lit(PRIOR_GOOD).alias("good"), each(lambda j: F.lit(RIGHT_ON_GOOD)).alias("on_good"),
                     each(lambda j: F.lit(RIGHT_ON_BAD)).alias("on_bad"))
    total = F.col("total").cast("double")
    extra = PRIOR_SHARE * total

    def gain(m, p):  # log odds of "good" that each rule's vote adds
        def of(j):
            v, g, b = F.get(p["v"], j), F.get(m["on_good"], j), F.get(m["on_bad"], j)
            return F.when(v == 1, F.log(g / (1 - b))).when(v == -1, F.log((1 - g) / b)).otherwise(0.0)
        return F.aggregate(each(of), F.log(m["good"] / (1 - m["good"])), lambda s, x: s + x)

    def one_round(m, _):
        soft = F.transform("patterns", lambda p: F.struct(
            p["v"].alias("v"), (p["n"] / (1 + F.exp(-gain(m, p)))).alias("g"), p["n"].cast("double").alias("n")))
        of_good, of_bad = (lambda p: p["g"]), (lambda p: p["n"] - p["g"])

        def updated(soft):
            share = lambda of, j, right, prior: (
                (F.aggregate(soft, F.lit(0.0), lambda s, p: s + F.when(F.get(p["v"], j) == right, of(p)).otherwise(0.0)) + prior * extra)
                / (F.aggregate(soft, F.lit(0.0), lambda s, p: s + F.when(F.get(p["v"], j) != 0, of(p)).otherwise(0.0)) + extra))
            good = F.aggregate(soft, F.lit(0.0), lambda s, p: s + of_good(p))
            return F.struct(((good + PRIOR_GOOD * extra) / (total + extra)).alias("good"),
                            each(lambda j: share(of_good, j, 1, RIGHT_ON_GOOD)).alias("on_good"),
                            each(lambda j: share(of_bad, j, -1, RIGHT_ON_BAD)).alias("on_bad"))

        return _let(soft, updated)

    listed = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), "n"))).alias("patterns"),
                          F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    m = listed.select(F.when(F.col("total") > 0, fitted).otherwise(start).alias("m")).first()["m"]
    return {"good": m["good"], "right": {v: pair for v, pair in zip(names, zip(m["on_good"], m["on_bad"]))}}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, ``quality`` (posterior), ``base_failed`` and ``kept`` of every document."""
    rules = votes()
    rows = common.stored(statistics(docs).select("*", *[v.alias(k) for k, v in rules.items()]), "votes")
    model = estimate(rows.groupBy(*rules).agg(F.count("*").alias("n")), list(rules))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (rows.withColumn("quality", posterior(model)).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
