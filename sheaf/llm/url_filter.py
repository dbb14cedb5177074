"""Operator 13: URL verdicts from rules and a list of canonical URLs behind a blocked Bloom filter.

A rule (action, host, path) fits URLs of its host and its subdomains whose path
starts with the rule's path; the longest fitting rule (host and path together,
then the longer host, then block) decides. URLs that no rule fits are blocked
when their canonical form is on the list.

The list may be of any size. Its canonical URLs are hashed into blocks of eight
64-bit words, one bit a word, by one aggregate (``bit_or`` per block). The
blocks are what is broadcast: at most ``MAX_BLOCKS`` rows, however long the list
is. URLs whose eight bits are all set are possible hits; only they go to the
join on the canonical text, which removes the false positives. A list too
long for the blocks makes more false positives, never other verdicts.

Canonical form: host in lower case (A-Z) without a leading ``www.`` and without
port 80 or 443, path without slashes at its end, query parameters in order
without those that only track; scheme and fragment do not count.

Defined results: a null URL or one without ``://`` has an empty host and path
and no canonical form, so that no rule with a host and no list entry meets it:
allow. List entries without a canonical form are ignored, repeated ones count
once. Repeated rows give repeated verdicts. An empty table gives no rows; an
empty list blocks nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ALLOW, BLOCK = "allow", "block"
WORDS = 8  # 64-bit words of a block; one bit is set in each
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 18  # 16 MB of bits: the bound of what is broadcast
MAX_RULES = 1000  # rules are settings, compiled into one expression
TRACKING = r"^(utm_[A-Za-z]+|ref|gclid|fbclid)(=|\z)"
_SEEDS = (1042, 2042)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.get(F.split(url, "://", 2), F.lit(1))


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form of a URL; null where there is none."""
    rest = _rest(url)
    name = F.regexp_replace(F.regexp_replace(host(url), "^www[.]", ""), r":(80|443)\z", "")
    query = F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(rest.isNotNull(), F.concat(
        name, F.rtrim(path(url), F.lit("/")),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule; both null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: give the URLs as a list")
    rule = action = None
    ranked = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != BLOCK))
    for verdict, h, p in ranked:
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(verdict)) if action is None else action.when(fits, F.lit(verdict))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of the canonical URLs, one row per block in use."""
    rows = listed.select(_block("canonical", n_blocks).alias("block"), *_bits("canonical"))
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def _block(column: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(_SEEDS[0]), column), F.lit(n_blocks))


def _bits(column: str) -> list[Column]:
    """One word with a single set bit for each word of a block."""
    h = f"xxhash64({_SEEDS[1]}, {column})"
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * k}) & 63 as int))").alias(f"w{k}")
            for k in range(WORDS)]


def possible(rows: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` with ``maybe``: false where the canonical URL is certainly not in ``listed`` (distinct)."""
    n = listed.count()
    n_blocks = max(1, min(max_blocks, -(-n * BITS_PER_URL // (64 * WORDS))))
    blocks = bloom_blocks(listed, n_blocks).select("block", F.struct(*[f"w{k}" for k in range(WORDS)]).alias("bits"))
    hit = F.lit(True)
    for k, bit in enumerate(_bits("canonical")):
        hit = hit & (F.col("bits")[f"w{k}"].bitwiseAND(bit) != 0)
    keyed = rows.withColumn("block", F.when(F.col("rule").isNull(), _block("canonical", n_blocks)))
    return (keyed.join(F.broadcast(blocks), "block", "left")  # at most max_blocks rows
            .withColumn("maybe", F.coalesce(F.col("canonical").isNotNull() & F.col("rule").isNull() & hit, F.lit(False)))
            .drop("block", "bits"))


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, canonical, rule, verdict) of every URL; ``listed`` has a column ``url``."""
    entries = (listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct())
    entries = common.stored(entries, "listed-urls")  # its size is known, and skewed joins with it can be split
    u = F.col(url_col)
    parsed = urls.select(F.col(id_col), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = possible(parsed.select("*", rule.alias("rule"), action.alias("action")), entries)
    exact = (rows.where("maybe").join(entries.withColumn("found", F.lit(True)), "canonical", "left")
             .withColumn("verdict", F.when(F.col("found"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))))
    others = rows.where("not maybe").withColumn("verdict", F.coalesce("action", F.lit(ALLOW)))
    cols = [id_col, "host", "path", "canonical", "rule", "verdict"]
    return exact.select(cols).unionByName(others.select(cols))
