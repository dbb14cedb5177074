"""Operators 11 to 13 against brute force: alignment of tokenizers, spelling variants, URL verdicts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_operators import awkward, frame, got
from tokenizers import Tokenizer

from sheaf.llm import alignment, common, debruijn, queries, secret_scan, simhash, suffixes, tokens, url_filter, variants

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- 11 -------------------------------------------------------------------------


def brute_links(rows):
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(alignment.byte_letters())}
    name = {i: s for s, i in tok.get_vocab().items()}
    each = []
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        a = tok.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab = [bytes(byte[c] for c in name[i]) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
              for i in b]
        if not text or b"".join(ab) != raw or b"".join(bb) != raw:
            each.append((0, 0, [], Counter()))
            continue
        ends = [[sum(map(len, t[:k + 1])) for k in range(len(t))] for t in (ab, bb)] if len(raw) < 3000 else [
            list(accumulated(ab)), list(accumulated(bb))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [defaultdict(list), defaultdict(list)]
        for side, ids in ((0, a), (1, b)):
            k = 0
            for i, e in zip(ids, ends[side]):
                while e > cuts[k]:
                    k += 1
                at[side][k].append(i)
        groups = [(at[0][k], at[1][k]) for k in range(len(cuts))]
        each.append((len(a), len(b), groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    n = Counter(p for *_, links in each for p in links)
    most = {}
    for (x, _), c in n.items():
        most[x] = max(most.get(x, 0), c)
    out = []
    for (doc_id, _), (na, nb, groups, links) in zip(rows, each):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, na, nb, len(groups), sum(links.values()),
                    sum(c for p, c in links.items() if n[p] == most[p[0]]), sum(c * n[p] for p, c in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def accumulated(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60),
       st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_cuts(a, b, near):
    total = max(sum(a), sum(b)) + 1
    a, b = np.append(np.cumsum(a), total), np.append(np.cumsum(b), total)
    before, alignment.NEAR = alignment.NEAR, near
    try:
        got_a, got_b = alignment.common_cuts(a, b)
    finally:
        alignment.NEAR = before
    both = np.intersect1d(a, b)
    assert got_a.tolist() == (np.searchsorted(a, both) + 1).tolist()
    assert got_b.tolist() == (np.searchsorted(b, both) + 1).tolist()


def test_cuts_far_from_the_middle():
    a = np.append(np.arange(1, 5000) * 2, 10_000)  # even ends against odd ones: a single cut near the start
    b = np.concatenate([[1, 3, 4], np.arange(2, 4999) * 2 + 1, [10_000]])
    assert [x.tolist() for x in alignment.common_cuts(a, b)] == [[2, len(a)], [3, len(b)]]


def tricky():
    more = ["a" * 3000, "═" * 200 + " x", "▁ under", "two  spaces", "tail ", "\tlead", " lead", "\u3000wide", "日本語 日本語",
            "<s> </s> <0x41> <|endoftext|>", "a\nb", "line \n line", "x\x85y \x1c z", "🙂🙂 👩‍👩‍👧", "don't  'tis", "\x00 nul"]
    return awkward() + [(100 + i, t) for i, t in enumerate(more)]


def test_alignment(spark, monkeypatch):
    rows = tricky()
    docs = frame(spark, rows).repartition(3)
    want = brute_links(rows)
    assert got(alignment.link_counts(docs, A, B), *COLS) == want
    monkeypatch.setattr(alignment, "SHARE", 20)  # nearly all pairs are joined
    al = alignment.Aligner(A, B)
    usual = al.align([t or "" for _, t in rows])
    monkeypatch.setattr(alignment, "LARGE", 3)  # pairs of most groups are counted by id
    al.forget()
    for x, y in zip(usual, al.align([t or "" for _, t in rows])):
        assert np.array_equal(x, y) if isinstance(x, np.ndarray) else x == y
    assert got(alignment.link_counts(docs, A, B), *COLS) == want


def test_alignment_of_a_table_and_its_groups(spark):
    df = common.documents(spark, SF)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert got(alignment.link_counts(df, A, B), *COLS) == brute_links(rows)
    for r in alignment.alignments(df, A, B).select("groups", "groups_sha256", "n_groups").collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or not r["n_groups"]
        assert r["n_groups"] == (r["groups"].count(";") + 1 if r["groups"] else 0)


def test_aligner_forgets_alike():
    al = alignment.Aligner(A, B)
    texts = [t for _, t in tricky() if t]
    first = al.align(texts)
    alone = [al.align([t]) for t in texts]  # stretches are known from other texts
    assert first[1] == [x[1][0] for x in alone]
    al.forget()
    alone = [al.align([t]) for t in texts]
    assert first[1] == [x[1][0] for x in alone]
    assert first[0].tolist() == [x[0][0].tolist() for x in alone]


def test_a_long_text_is_aligned_in_time(spark):
    r = random.Random(3)
    text = "".join(r.choice("ab ═é\n") for _ in range(1_000_000)) + "a" * 500_000
    row = alignment.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, False).first()
    assert row["n_groups"] > 100_000 and row["n_links"] >= row["n_a"]


# ---- 12 -------------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    form, count = {}, {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) <= 1 and near(v, w)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variant_rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def spelled():
    """Documents of words that differ by an edit, with chains of forms, stretches of equal letters and ties."""
    r = random.Random(8)
    base = ["spelling", "aaaaaa", "réseau", "ÿÿÿÿÿ", "banana", "ababab", "letters"]
    words = []
    for w in base:
        for k in range(14):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2])):
                i, what = r.randrange(len(v)), r.randrange(3)
                v[i:i + 1] = [[], [r.choice("abé")], [v[i], v[i]]][what]
            words += ["".join(v)] * r.choice([1, 2, 3, 3, 6, 12, 25])
    words += ["chain"] * 3 + ["chaina"] * 6 + ["chainab"] * 12 + ["chainabb"] * 24 + ["chainabba"] * 48 + ["xchainabba"] * 100
    r.shuffle(words)
    words = [w.upper() if r.random() < 0.2 and w.isascii() else w for w in words]
    return [(i, r.choice([" ", ", ", "-", "\n"]).join(words[i::40])) for i in range(40)]


def test_variants(spark, monkeypatch):
    rows = awkward() + spelled()
    n = brute_words(rows)
    assert len(n) > 50
    want = brute_variants(n)
    assert any(w != r and f != r for w, f, r, *_ in want)  # a chain of forms
    docs = frame(spark, rows).repartition(3)
    assert variant_rows(variants.variants(docs)) == want
    df = common.documents(spark, SF)
    some = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert variant_rows(variants.variants(df)) == brute_variants(brute_words(some))


def test_changed_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "EVERY", 1)  # every run loses a letter; the mark below is fixed at 97
    rows = spark.createDataFrame([(None, "alphas " * 3), (4, "x " * 9 + "gammas " * 5)], "doc_id long, text string")
    words = {r["word"]: r["n"] for r in variants.vocabulary(rows).collect()}
    want = {}
    for doc_id, run, n in (("", "alphas", 3), ("4", "gammas", 5)):
        at = zlib.crc32(f"{doc_id}:{run}".encode()) % 6
        want[run[:at] + run[at + 1:]] = n
    assert words == want


def test_long_texts_are_counted_in_slices(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice(["abc", "é", " ", "1", "a" * 40]) for _ in range(400))
    whole = variants._counted(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(variants, "SLICE", size)
        assert variants._counted(text) == whole


# ---- 13 -------------------------------------------------------------------------


URLS = [None, "", "no scheme", "http://", "https:///path", "http://EXAMPLE.org", "http://example.org/", "http://a.example.org/es/x",
        "http://example.org/en/123", "http://notexample.org/es/", "http://org/x", "http://x.com/fr/1", "ftp://x.com/de/1?q",
        "http://X.com/other#://", "x://y.net/p?b=2&a=1", "x://www.y.net/p/?a=1&&b=2&utm_source=z#f", "x://y.net:80/p//?ref=1&b=2&a=1",
        "x://y.net/q", "x://y.net/p?b=2", "x://comfr/", "x://.com/fr/", "x://Ünï.net/a b\n", "x://y.net/%zz?x=1://2",
        "HTTP://Y.NET/p?refx=1", "x://y.net:8080/p?a=1&b=2", "x://y.net/p?b=2&a=1"]
LISTED = ["http://y.net/p?a=1&b=2", None, "nothing", "x://y.net/q#here", "x://y.net/q", "x://x.com/fr/1"]


def brute_verdict(url, listed):
    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        if rest is None:
            return "", "", None
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        query = re.match(r"[^?#]*(?:\?([^#]*))?", rest, re.S).group(1) or ""
        kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[A-Za-z]+|ref|gclid|fbclid)(=|\Z)", p))
        name = re.sub(r":(80|443)\Z", "", host[4:] if host.startswith("www.") else host)
        return host, path, name + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")
    host, path, canon = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, max(fits)[1], max(fits)[2])
    on = {parts(u)[2] for u in listed} - {None}
    return host, path, None, "block" if canon in on else "allow"


def test_url_verdicts(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[14])], "page_id long, url string")
    pages = pages.select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "block", "canonical", "maybe", "w0")])
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    want = sorted(((i, *brute_verdict(u, LISTED)) for i, u in [*enumerate(URLS), (3, URLS[14])]), key=repr)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}

    def rows(df):
        return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in df.collect()), key=repr)
    assert rows(url_filter.judge(pages, queries.URL_RULES, listed)) == want
    assert rows(url_filter.judge(pages.limit(0), queries.URL_RULES, listed)) == []
    empty = url_filter.judge(pages, [], listed.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in empty] == [(None, "allow")]
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 0)  # one full block: every URL is a possible hit or nearly so
    assert rows(url_filter.judge(pages, queries.URL_RULES, listed)) == want


def test_bloom_filter_misses_nothing_and_stays_bounded(spark):
    urls = spark.range(40_000).select(F.concat(F.lit("h.net/"), "id").alias("canonical"), F.lit(None).cast("string").alias("rule"))
    listed = urls.where("canonical rlike '[05]$'").select("canonical")
    for blocks in (url_filter.MAX_BLOCKS, 16):
        seen = url_filter.possible(urls, listed, max_blocks=blocks)
        c = seen.groupBy(F.col("canonical").rlike("[05]$").alias("on"), "maybe").count().collect()
        c = {(r["on"], r["maybe"]): r["count"] for r in c}
        assert c[True, True] == 8000 and (True, False) not in c
        if blocks > 16:
            assert c[False, True] < 0.02 * 32_000
    assert url_filter.bloom_blocks(listed, 16).count() == 16


def test_url_query_is_its_statement(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL['op13_url_filter']})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.op13_url_filter(spark, SF).select(cols).collect()), key=repr) == want


# ---- empty tables ------------------------------------------------------------------


@pytest.mark.parametrize("of", [lambda d: alignment.link_counts(d, A, B), variants.variants])
def test_empty_table(spark, of):
    assert of(frame(spark, awkward()).limit(0)).collect() == []


# ---- rows that ids do not tell apart --------------------------------------------------


def test_one_representative_a_component(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [(None, text, 1), (None, text.upper(), 2), (3, "another text with other words in it", 3),
            (3, "Another text with other words in it", 4), (3, "another text with other words in it", 5), (None, "", 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = [tuple(r) for r in simhash.representatives(docs).collect()]
    assert len(kept) == 3 and {r[0] for r in kept} == {None, 3, 9}
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in simhash.representatives(docs.repartition(5)).collect())


def test_texts_with_one_crc32_keep_their_own_spans(spark):
    """Two texts without an id and with one crc32: the one that repeats nothing keeps all."""
    alone, twice = (" ".join(f"a{i}x{k}" for k in range(40)) for i in (14895, 204006))
    assert zlib.crc32(alone.encode()) == zlib.crc32(twice.encode())
    docs = spark.createDataFrame([(None, alone), (None, twice), (5, twice)], "doc_id long, text string")
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in debruijn.digests(docs).collect())
    assert removed == [(0, 0), (0, 40), (5, 40)]


@pytest.mark.parametrize("least", [64, 1])  # with 1, windows take the route of hot anchors
def test_bytes_of_texts_with_one_id_and_crc32_keep_their_own_spans(spark, monkeypatch, least):
    monkeypatch.setattr(suffixes.anchors, "LEAST", least)
    alone, twice = (" ".join(f"a{i}x{k}" for k in range(40)) for i in (14895, 204006))
    rows = [(9, alone), (9, twice), (5, twice), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.digests(docs).collect())
    assert removed == [(0, 0), (5, 0), (9, 0), (9, len(twice))]


def test_starts_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(7, f"text {i % 9} " * 40) for i in range(60)], "doc_id long, text string")
    got = []
    for n in (1, 4):
        path = common.scratch_path(spark, "starts")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            tokens.write_token_files(docs.repartition(n), path, A, end_id=2)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        got.append(sorted((r["start"], tuple(r["ids"])) for r in tokens.read_starts(spark, path, ["ids"]).collect()))
    assert got[0] == got[1]


# ---- secret scans ---------------------------------------------------------------------


def test_candidates_short_values_and_long_runs():
    text = "pwd=Abc12345 and key: 'zz9plural' passwd=hunter22 " + "Q" * 20 + " name:abc " + "k=" + "w" * 30
    found = {text[s:e]: known for s, e, known, _ in secret_scan.candidates(text, secret_scan.base_spans(text))}
    assert found == {"Abc12345": False, "zz9plural": False, "hunter22": True, "passwd=hunter22"[7:]: True, "Q" * 20: False, "k=" + "w" * 30: False}
    windows = secret_scan.candidates("x" * 5000, [])[0][3]
    seen = windows[0][secret_scan.BEFORE:] + "".join(w[secret_scan.BEFORE + secret_scan.INSIDE - secret_scan.STRIDE:] for w in windows[1:])
    assert len(windows) > 100 and len(seen) == 5000  # to the end, nothing left out


def finding_rows():
    """900 documents, a third with a key assignment; some others hold the same kind of value after a plain name."""
    r = random.Random(3)
    value = lambda: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))
    plain = lambda: "-".join(r.choice(["ordinary", "words", "joined", "here", "with", "hyphens"]) for _ in range(4))
    return [(i, f"see {plain()} and config {'api_key' if i % 3 == 0 else 'note'}: {value() if i % 3 == 0 else plain()} end"
             + (f" credential: {value()}" if i % 30 == 1 else "")) for i in range(900)]


def test_network_reaches_held_out_findings_and_the_spans_are_its_verdicts(spark):
    docs = spark.createDataFrame(finding_rows(), "doc_id long, text string")
    r = secret_scan.recall(docs).first()
    assert r["n_findings"] > 60 and r["n_reached"] >= 0.9 * r["n_findings"]
    net = secret_scan.fit(common.stored(secret_scan.findings(docs), "found"))
    rows = {x["doc_id"]: x for x in secret_scan.scan(docs).collect()}
    n_model = 0
    for i, text in finding_rows():
        base = secret_scan.base_spans(text)
        more = [(3, s, e) for s, e, known, w in secret_scan.candidates(text, base) if not known
                and max(net.probability(net.logits(secret_scan.codes([x]))[0]) for x in w) >= net.threshold]
        assert [tuple(x) for x in rows[i]["spans"]] == sorted(base + more, key=lambda s: (s[1], s[0]))
        n_model += len(more)
    assert n_model < 200


def test_secrets_of_empty_tables_and_of_one_class(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert secret_scan.digests(empty).count() == secret_scan.masked(empty).count() == secret_scan.recall(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, ""), (1, "password=hunter2hunter2")], "doc_id long, text string")
    assert sorted(r["spans"] for r in secret_scan.digests(nothing).collect()) == ["", "", "assign:0:23"]
    assert {r["text"] for r in secret_scan.masked(nothing).collect()} == {None, "", "[secret]"}


def test_every_labelled_candidate_trains_and_calibrates(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i % 3 == 0, i, 0, "".join(r.choice("abcdef0123456789") if i % 3 == 0 else r.choice("-words here")
                                       for _ in range(64))) for i in range(5000)]  # more than 750 of a class
    seen = spark.sparkContext.accumulator(0)

    class Counted(secret_scan.Network):
        def train(self, x, *more):
            seen.add(len(x))
            super().train(x, *more)
    monkeypatch.setattr(secret_scan, "Network", Counted)
    monkeypatch.setattr(secret_scan, "SHARE", 1000)
    monkeypatch.setattr(secret_scan, "FEW", 50)
    windows = spark.createDataFrame(rows, "known boolean, h long, at int, window string")
    net = secret_scan.trained(windows)
    assert seen.value == 5000 * secret_scan.ROUNDS
    z = net.logits(secret_scan.codes([w for *_, w in rows]))
    assert min(z[::3]) > np.median(z[1::3])
    z = np.array([r.gauss(1 if k else -1, 1.5) for k, *_ in rows])  # classes that overlap
    logits = [(k, float(v)) for (k, *_), v in zip(rows, z)]
    assert secret_scan.calibrated(net, spark.createDataFrame(logits, "known boolean, logit double"))
    positive = sorted(v for k, v in logits if k)
    alone = secret_scan.Network()
    alone.calibrate(z, np.array([float(k) for k, *_ in rows]))
    assert abs(net.scale - alone.scale) < 1e-3 and abs(net.offset - alone.offset) < 1e-3
    assert net.threshold == net.probability(np.array(positive[int((1 - secret_scan.RECALL) * len(positive))]))


def test_kth_of_many_equal_and_far_values(spark):
    r = random.Random(6)
    values = [r.choice([0.0, 1.0, 1e9, r.random(), -r.random() * 1e-9]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 17, 4500, 8999):
        assert secret_scan.kth(df, k) == sorted(values)[k]
