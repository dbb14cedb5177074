"""The operators' queries over the driver tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, bpe, common, debruijn, decontam, ppm, qda, rules, secret_scan, simhash, suffixes, tokens,
               url_filter, variants)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_files(spark, sf_dir):
    path = common.scratch_path(spark, "token-files")
    tokens.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY), end_id=2)
    return tokens.checked(tokens.read_starts(spark, path, ["ids"]))


@query
def op2_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


@query
def op3_quality_rules(spark, sf_dir):
    return rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op5_quality_classifier(spark, sf_dir):
    return qda.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"),
                        held_out=common.mod_of_crc("doc_id", 4) == 2)


@query
def op6_simhash(spark, sf_dir):
    return simhash.groups(documents(spark, sf_dir), shingle=3, k=2).select(
        "doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark, sf_dir):
    return decontam.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


@query
def op4_lm_scores(spark, sf_dir):
    return ppm.score(documents(spark, sf_dir), held_out=common.mod_of_crc("doc_id", 10) == 0)


@query
def op10_secrets(spark, sf_dir):
    return secret_scan.digests(documents(spark, sf_dir))


@query
def op7_substring_dedup(spark, sf_dir):
    return debruijn.digests(documents(spark, sf_dir), k=35)


@query
def op9_suffix_array(spark, sf_dir):
    return suffixes.digests(documents(spark, sf_dir), length=50)


@query
def op11_alignment(spark, sf_dir):
    return alignment.link_counts(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY),
                                 public_tokenizers.path(PIECES))


@query
def op12_variants(spark, sf_dir):
    return variants.variants(documents(spark, sf_dir))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op13_url_filter(spark, sf_dir):
    """The list: URLs of the pages whose id the labels mark toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    listed = pages.join(toxic.distinct(), "page_id", "left_semi").select("url")
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


SQL["op13_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[A-Za-z]+|ref|gclid|fbclid)(=|\z)'))) AS params
  FROM parts),
urls AS (
  SELECT page_id, host, path,
         CASE WHEN rest IS NOT NULL THEN
           regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)\z', '') || rtrim(path, '/')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM split),
listed AS (
  SELECT DISTINCT canonical FROM urls
  WHERE canonical IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, arg_max({'rule': rule_host || rule_path, 'action': action}, length(rule_host || rule_path)) AS r
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.r.rule AS rule,
       coalesce(f.r.action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id LEFT JOIN listed l ON l.canonical = u.canonical
"""
