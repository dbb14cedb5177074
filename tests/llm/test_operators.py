"""The operators against brute force, over a fixture of awkward texts and over sf0.001."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import bpe, common, decontam, debruijn, ppm, qda, rules, secret_scan, simhash, suffixes, tokens

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def awkward():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "Été", "中文", "x1", "don't", "the", "of", "##", "a" * 90, "be"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long_ = text(60), text(400)
    texts = [None, "", " ", "\n\n", "one", "  spaced \t out\v\f ", passage, passage, passage.upper(), text(30) + " " + passage,
             passage + "\n" + text(30), long_, long_.replace("alpha", "Alpha", 1), "be " * 300, "be " * 301 + "end",
             "same line here\n" * 6, "password = 'hunter2hunter2' token:abc", "AKIA" + "Q" * 16 + " " + "0f" * 15,
             "<|endoftext|> mid<|endoftext|>", "a b　c\x1cd\x85e", "İKELVIN paſſword=abcdefgh", "ὠ0" * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, passage), (6, passage), (6, text(50)), (11, long_)]


def frame(spark, rows):
    """Rows with columns whose names clash with what the operators make."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(
        ("row", "found", "words", "h", "fp", "id", "score", "part", "start", "ids", "spans", "n_tokens", "held_out"))])


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def some(spark):
    df = common.documents(spark, SF)
    return df, [tuple(r) for r in df.select("doc_id", "text").collect()]


def got(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def want(rows, values):
    return sorted(((d, *(v if isinstance(v, (tuple, list)) else (v,))) for (d, _), v in zip(rows, values)), key=repr)


def both(docs, rows, some):
    return [(docs, rows), some]


def test_bpe_is_the_librarys(docs, rows, some):
    t = Tokenizer.from_file(VOCAB)
    for df, pairs in both(docs, rows, some):
        each = []
        for _, text in pairs:
            ids = t.encode(text or "", add_special_tokens=False).ids
            each.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got(bpe.digests(df, VOCAB), "n_tokens", "ids_sha256", "decoded_sha256") == want(pairs, each)
    out = bpe.encode_documents(docs, VOCAB).collect()
    assert all(r["exact"] and len(r["ids"]) == r["n_tokens"] for r in out)


def test_token_files(spark, docs, rows, some):
    t = Tokenizer.from_file(VOCAB)
    for df, pairs in both(docs, rows, some):
        path = common.scratch_path(spark, "tokens")
        tokens.write_token_files(df, path, VOCAB, end_id=2, meta=["score"] if "score" in df.columns else ["lang"])
        expected, start = [], 0
        for d, text in sorted(pairs, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()), x[1] or "")):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        out = tokens.checked(tokens.read_starts(spark, path, ["ids"]))
        key = lambda x: (x[0] is not None, x[0] or 0)
        have = sorted((tuple(r) for r in out.collect()), key=lambda x: x[1])
        assert [key(x) for x in have] == [key(x) for x in expected]
        assert [x[1] for x in have] == list(np.cumsum([0, *[x[2] for x in have[:-1]]]))
        assert sorted((x[2:] for x in have)) == sorted(x[2:] for x in expected)
        if df is not docs:
            assert have == expected
        plan = spark.read.parquet(path).where("doc_id > 5").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
        assert "GreaterThan(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_rules_statistics_and_estimate(spark, docs, rows, some):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, pairs in both(docs, rows, some):
        assert got(rules.judge(df), *cols) == want(pairs, [brute.op3(t) for _, t in pairs])
    r = random.Random(2)
    truth = [r.random() < 0.8 for _ in range(4000)]
    names = list(rules.votes())
    data = []
    for good in truth:
        right = {n: r.random() < (0.97 if good else 0.5) for n in names}
        data.append(tuple((1 if right[n] else -1) if good else (-1 if right[n] else 1) for n in names))
    pat = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names)).groupBy(*names).agg(F.count("*").alias("n"))
    model = rules.estimate(pat, names)
    assert abs(model["good"] - np.mean(truth)) < 0.04
    assert all(abs(g - 0.97) < 0.03 and abs(b - 0.5) < 0.1 for g, b in model["right"].values())
    empty = rules.judge(frame(spark, []))
    assert empty.count() == 0


def test_language_model(docs, rows, some):
    for df, pairs in both(docs, rows, some):
        held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in pairs]
        out = ppm.score(df, common.mod_of_crc("doc_id", 10) == 0)
        base = brute.op4_base(pairs, held)
        picked = range(len(pairs)) if df is docs else [i for i, h in enumerate(held) if h][:8]
        scores = dict(zip(picked, brute.ppm([t for (_, t), h in zip(pairs, held) if not h], [pairs[i][1] for i in picked], ppm.ORDER)))
        have = sorted((tuple(r) for r in out.collect()), key=lambda x: (repr(x[0]), x[2], x[5]))
        expected = sorted(((d, h, *b, i) for i, ((d, _), h, b) in enumerate(zip(pairs, held, base))), key=lambda x: (repr(x[0]), x[2], x[5]))
        assert len(have) == len(expected)
        for a, b in zip(have, expected):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
            if b[6] in scores:
                assert a[6] == pytest.approx(scores[b[6]], abs=1e-6)


def test_language_model_keeps_every_count(docs, rows, monkeypatch):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    texts = [t for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    for share in (0, 40, ppm.SHARE):  # none, few or all of the strings go to every task
        monkeypatch.setattr(ppm, "SHARE", share)
        out = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in ppm.score(docs, common.mod_of_crc("doc_id", 10) == 0).collect())
        base = brute.op4_base(rows, held)
        expected = sorted((repr(d), b[0], p) for (d, _), b, p in zip(rows, base, brute.ppm(train, texts, ppm.ORDER)))
        assert [x[:2] for x in out] == [x[:2] for x in expected]
        assert [x[2] for x in out] == pytest.approx([x[2] for x in expected], abs=1e-6)


def test_classifier_on_held_out_rows(spark, docs, rows):
    df = common.documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = qda.classify(df, labels, common.mod_of_crc("doc_id", 4) == 2)
    right = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95 and out.where("score between 0 and 1").count() == df.count()
    none = qda.classify(docs, spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int"), F.lit(False))
    assert {r["score"] for r in none.collect()} == {0.5} and none.count() == len(rows)
    assert qda.accepted(docs, labels, F.lit(False), threshold=0.0).select(docs.columns).exceptAll(docs).count() == 0


def test_simhash(docs, rows, some):
    for df, pairs in [some]:
        fp, comp = brute.op6(pairs, 3, 2)
        out = simhash.groups(df).select("doc_id", simhash.hexadecimal().alias("f"), "component_id")
        assert got(out, "f", "component_id") == want(pairs, [(f"{a:016x}", b) for a, b in zip(fp, comp)])
        kept = simhash.representatives(df)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp)) and kept.columns == df.columns
    fp, _ = brute.op6([(0, t) for _, t in rows], 3, 2)
    ids = [(1 << 40 if d is None else d) for d, _ in rows]
    comp = [None if c == 1 << 40 else c for c in brute.linked(ids, fp, 2)]
    assert got(simhash.groups(docs), "component_id") == want(rows, comp)


def test_hot_blocks_split_alike(spark, monkeypatch):
    r = np.random.default_rng(3)
    fps = set()
    for centre in [0x1234567890ABCDEF] * 30 + [int(x) for x in r.integers(0, 1 << 62, 20)]:
        for _ in range(8):
            fps.add(centre ^ sum(1 << int(b) for b in set(r.integers(0, 64, r.integers(0, 4)))))
    fps = sorted(fps)
    expected = brute.linked(fps, fps, 2)
    monkeypatch.setattr(simhash, "GROUP", 20)
    common.ship(spark)
    links = simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    root = {a: b for a, b in simhash.components(links).collect()}
    mine = [root.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


def test_repeated_words(spark, docs, rows, some, monkeypatch):
    for df, pairs in both(docs, rows, some):
        assert got(debruijn.digests(df, 35), "n_words", "n_removed", "kept_sha256") == want(pairs, brute.op7(pairs, 35))
    monkeypatch.setattr(debruijn.anchors, "LEAST", 1)  # every frequent anchor is hot
    monkeypatch.setattr(debruijn.anchors, "SAMPLED", 1)
    assert got(debruijn.digests(docs, 12, 4), "n_words", "n_removed", "kept_sha256") == want(rows, brute.op7(rows, 12))
    assert debruijn.digests(frame(spark, [])).count() == 0


def test_repeated_bytes(spark, docs, rows, some, monkeypatch):
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for df, pairs in both(docs, rows, some):
        assert got(suffixes.digests(df), *cols) == want(pairs, brute.op9(pairs, 50))
    monkeypatch.setattr(suffixes.anchors, "LEAST", 1)
    monkeypatch.setattr(suffixes.anchors, "SAMPLED", 1)
    assert got(suffixes.digests(docs), *cols) == want(rows, brute.op9(rows, 50))
    assert suffixes.digests(frame(spark, [])).count() == 0


def test_repeated_rows_are_hot_and_carry_their_spans_once(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(20)) + " " + text
    for i in (1, 2, 3, 5, 8):  # whichever id the repeated rows have
        pairs = [(i, text)] * 200 + [(0, other)]
        docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
        hot = suffixes.anchors.hot(suffixes.anchors.keyed(docs), lambda b: debruijn.paths(b, 35, 8)[1])
        assert len(hot)
    spans = debruijn.repeated_spans(docs, 35)
    rows = suffixes.anchors.with_spans(docs, spans.unionByName(spans)).collect()
    assert len(rows) == 201 and all(len(r["spans"]) == len(set(r["spans"])) for r in rows)
    assert got(debruijn.digests(docs, 35), "n_words", "n_removed", "kept_sha256") == want(pairs, brute.op7(pairs, 35))
    assert got(suffixes.digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(pairs, brute.op9(pairs, 50))


def test_deep_shallow_order():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(4000)) + bytes(300) + b"abc" * 100
    arr = np.frombuffer(data, np.uint8)
    for length, shallow in ((50, 32), (50, 8), (20, 16), (16, 16), (12, 8)):
        starts = np.arange(len(data) - length + 1)
        order, cls = suffixes.classes(arr, starts, length, shallow)
        strings = [data[s:s + length] for s in order]
        assert [strings[i] == strings[i + 1] for i in range(len(strings) - 1)] == [cls[i] == cls[i + 1] for i in range(len(cls) - 1)]
        if shallow >= length // 8 * 8 and length % 8 == 0:
            assert strings == sorted(strings)


def test_decontamination(spark, docs, rows, some, monkeypatch):
    passage = rows[6][1]
    items = [(1, " ".join(passage.split()[20:45])), (2, "one"), (3, None), (4, "!!"), (5, "same line here"), (5, "same line here"),
             (6, "be be be be be be be be be be be be")]
    table = spark.createDataFrame(items, "item_id long, text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (decontam.BLOCK_BYTES, 100):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        assert got(decontam.digests(docs, table), *cols) == want(rows, brute.op8(rows, items, 10))
    monkeypatch.undo()
    assert got(decontam.digests(some[0], bench), *cols) == want(some[1], brute.op8(some[1], [tuple(r) for r in bench.select("item_id", "text").collect()], 10))
    cleaned = decontam.clean(docs, table)
    assert cleaned.columns == docs.columns and decontam.digests(cleaned, table.where("item_id = 1")).where("contaminated").count() == 0
    clean_ids = {d for (d, _), b in zip(rows, brute.op8(rows, items, 10)) if not b[4]}
    assert clean_ids <= {r["doc_id"] for r in cleaned.collect()}


def test_items_are_fetched_a_block_at_a_time(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    items = [(i, " ".join(rows[6][1].split()[i:i + 12])) for i in range(0, 40, 4)]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.digests(docs, table)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # not one worker a block in each task
    assert got(out, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(rows, brute.op8(rows, items, 10))


def test_secrets(spark, docs, rows, some):
    for df, pairs in both(docs, rows, some):
        assert got(secret_scan.digests(df), "n_assign", "n_access", "n_hex", "base_sha256") == want(pairs, [brute.op10(t) for _, t in pairs])
    out = secret_scan.masked(some[0])
    assert out.columns == some[0].columns and out.count() == some[0].count()
    for r in out.collect():
        assert not secret_scan._ACCESS.search(r["text"] or "") and len(r["text"]) == r["n_chars"]
    net = secret_scan.Network()
    x = secret_scan.codes([("k%d: " % i).rjust(20) + ("".join(random.Random(i).choice("0123456789abcdef") for _ in range(20)) if i % 2 else "ordinary-words-here") for i in range(200)])
    y = np.arange(200) % 2 * 1.0
    net.train(x[:120], y[:120])
    net.calibrate(net.logits(x[120:160]), y[120:160])
    p = net.probability(net.logits(x[160:]))
    assert ((p >= net.threshold) == (y[160:] == 1)).mean() > 0.9


def test_words_of_base_rules_are_ascii_only():
    assert secret_scan.base_spans("toKen=abcdefgh") == [] and re.search("(?i)token", "toKen")


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.documents(spark, SF)
    columns, ids = docs.columns, None
    for name, stage in p.STAGES:
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = common.stored(stage(spark, docs, SF), name)
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= before
        assert docs.columns == columns or name == p.STAGES[-1][0]
    assert docs.where("exact").count() == docs.count() > 100


def test_pipeline_rows_of_every_stage(spark):
    import corpus_pipeline as p

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    t, out, docs = Tokenizer.from_file(VOCAB), {}, common.documents(spark, SF)
    for name, stage in p.STAGES:
        before, have = docs, texts(docs)
        pairs = list(have.items())
        docs = common.stored(stage(spark, docs, SF), name)
        if name == "quality":
            judged = qda.classify(before, labels, common.mod_of_crc("doc_id", 4) == 2).collect()
            expected = {r["doc_id"]: have[r["doc_id"]] for r in judged if r["predicted"] == 1}
        elif name == "near_duplicates":
            expected = {d: have[d] for d in set(brute.op6(pairs, 3, 2)[1])}
        elif name == "decontamination":
            expected = {d: cut_items(x or "", items, 10) if b[4] else x for (d, x), b in zip(pairs, brute.op8(pairs, items, 10))
                        if b[1] <= 0.8 * b[0]}
        elif name == "secrets":
            expected = {}
            for r in secret_scan.scan(before).collect():
                x = have[r["doc_id"]]
                assert [tuple(s) for s in r["base"]] == secret_scan.base_spans(x or "") and set(r["base"]) <= set(r["spans"])
                gone = {i for s in r["spans"] for i in range(s["first"], s["last"])}
                starts = [s["first"] for s in r["spans"] if s["first"] == 0 or not any(
                    o["first"] < s["first"] < o["last"] for o in r["spans"])]
                expected[r["doc_id"]] = x if not gone else "".join(
                    ("[secret]" if i in starts else "") + ("" if i in gone else c) for i, c in enumerate(x))
        else:
            out = {r["doc_id"]: list(r["ids"]) for r in docs.collect()}
            assert out == {d: t.encode(x or "", add_special_tokens=False).ids for d, x in pairs}
            continue
        assert texts(docs) == expected
        assert len(expected) > 0 and docs.count() == len(expected)
    assert {r["doc_id"]: list(r["ids"]) for r in p.run(spark, SF).collect()} == out


def cut_items(text, items, window):
    """The text without the characters from the first to the last word of every run of hit words."""
    words = [(m.start(), m.end()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
    hit = set()
    low = [brute.lower(text[a:b].encode()) for a, b in words]
    for _, item in items:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower((item or "").encode()))
        n = min(window, len(w))
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(low) - n + 1 if wins else 0):
            if tuple(low[i:i + n]) in wins:
                hit.update(range(i, i + n))
    gone = set()
    for i in hit:
        gone.update(range(words[i][0], words[i + 1][0] if i + 1 in hit else words[i][1]))
    return "".join(c for i, c in enumerate(text) if i not in gone)


def test_frequent_values_are_counted_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(suffixes.anchors, "TOGETHER", 1_000)
    rng = np.random.default_rng(4)
    values = np.concatenate([np.repeat(np.arange(5, dtype=np.uint64), 4_000), rng.integers(5, 1 << 40, 60_000).astype(np.uint64)])
    rng.shuffle(values)
    frequent = suffixes.anchors.Frequent(64)
    for part in np.array_split(values, 97):
        frequent.add(part)
        assert len(frequent.values) <= 64 and frequent.size < 2_000
    frequent.settle()
    assert frequent.rows == len(values) and 0 < frequent.lost <= len(values) // 64
    held = dict(zip(frequent.values.tolist(), frequent.counts.tolist()))
    assert all(4_000 - frequent.lost <= held[v] <= 4_000 for v in range(5))
    exact = suffixes.anchors.Frequent(64)
    exact.add(np.repeat(np.arange(64, dtype=np.uint64), 3))
    exact.settle()
    assert exact.lost == 0 and exact.counts.tolist() == [3] * 64


def test_candidates_need_no_order_of_ids(spark, rows):
    """Runs of one anchor come in any order of ids and in batches of two rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        many = rows + [(i, rows[6][1]) for i in range(90, 40, -7)]
        cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got(suffixes.digests(frame(spark, many).repartition(4)), *cols) == want(many, brute.op9(many, 50))
    finally:
        spark.conf.set(key, before)


def new_words(n):
    """Texts full of words that occur once, with awkward signs among them."""
    r = random.Random(9)
    signs = "abcdefghijklmnopqrstuvwxyzABCé" * 3 + "ßſĠİ中०1234.,'\n-́‍😀"
    word = lambda: "".join(r.choice(signs) for _ in range(r.randint(1, 14))) + r.choice(["", "", "'s", "ing", ".\nNext"])
    return [" ".join(word() for _ in range(n)) for _ in range(5)] + ["a" * 300 + " " + "be" * 400, "", " ", "ab" * 20]


def test_new_words_are_encoded_beside_each_other(monkeypatch):
    texts = new_words(900)
    codec = bpe.Codec(VOCAB)
    one = [np.array(codec.piece(p.encode()), "<u4").tobytes() for t in texts for p in codec.pattern.findall(t)]
    assert codec.pieces([p.encode() for t in texts for p in codec.pattern.findall(t)]) == one
    for bits, entries in ((bpe.PAIR_BITS, bpe.MEMO_ENTRIES), (4, 500)):  # pair tests and words are forgotten too
        monkeypatch.setattr(bpe, "PAIR_BITS", bits)
        codec.forget()
        codec.word_memo.entries = codec.piece_memo.entries = entries
        alone, piece = [], codec.piece
        monkeypatch.setattr(codec, "piece", lambda data: alone.append(data) or piece(data))
        for part in (texts[:2], texts):
            codec.learn(part)
        slow = len(alone)
        assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts] == [
            e.ids for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
        assert slow < 20
        monkeypatch.setattr(codec, "piece", piece)


def test_new_words_go_to_the_librarys_model(monkeypatch):
    texts = [" ".join(w.strip() or "x" for w in t.split(" ")) for t in new_words(900)]
    enc = tokens.WordEncoder(VOCAB)
    plain, seen = enc._plain, []
    monkeypatch.setattr(enc, "_plain", lambda some: seen.extend(some) or plain(some))
    monkeypatch.setattr(tokens, "PIECE_ENTRIES", 50)
    ids, counts = enc.encode(tokens.pa.array(texts), 2)
    want_ids = [[*e.ids, 2] for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want_ids for i in x] and counts.tolist() == list(map(len, want_ids))
    assert sum(map(len, seen)) < 0.2 * sum(map(len, texts))  # a text's first word alone


def test_a_word_goes_to_the_model_once_whatever_sign_follows(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(8)) for _ in range(200)]
    texts = ["x " + " ".join(w + sign for w in words) for sign in ("", ",", ".", " 7", "###", "\nx")]
    enc = tokens.WordEncoder(VOCAB)
    piece, seen = enc._piece, []
    monkeypatch.setattr(enc, "_piece", lambda p: seen.append(p) or piece(p))
    ids, _ = enc.encode(tokens.pa.array(texts))
    assert ids.tolist() == [i for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert len(seen) == len(set(seen)) < 220


def test_texts_are_cut_where_the_library_cuts_them(monkeypatch):
    r = random.Random(4)
    signs = [*"abZé'.,0  \n\ts<|", *"\u0085\x1c　᠎ ’​ ×÷ßſĠİ中०́😀\x0b\x00\x7fªŉя", "'s", "'re", " 'll", "\r\n", "  ", "the ", "###"]
    lib, enc = Tokenizer.from_file(VOCAB), tokens.WordEncoder(VOCAB)
    monkeypatch.setattr(tokens, "PIECE_ENTRIES", 300)
    for k, end in ((0, 2), (0, None), (6, 2), (0, 7)):  # some with special tokens
        some = signs + ["<|endoftext|>"] * k
        texts = ["".join(r.choice(some) for _ in range(r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(300)]
        ids, counts = enc.encode(tokens.pa.array(["before", *texts]).slice(1), end)
        want_ids = [e.ids + [end] * (end is not None) for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want_ids for i in x] and counts.tolist() == list(map(len, want_ids))
        assert max(map(len, enc.memo.to_pylist())) <= tokens.LONG
    assert [x.tolist() for x in enc.encode(tokens.pa.array(["", ""]), 2)] == [[2, 2], [1, 1]]
    assert [x.tolist() for x in enc.encode(tokens.pa.array([], "string"), 2)] == [[], []]


def test_other_pre_tokenizers_encode_texts_whole(tmp_path):
    from tokenizers import pre_tokenizers
    lib = Tokenizer.from_file(VOCAB)
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    lib.save(str(tmp_path / "other.json"))
    texts = ["one, two", "", "three\n\nfour's <|endoftext|>x"]
    ids, _ = tokens.WordEncoder(str(tmp_path / "other.json")).encode(tokens.pa.array(texts))
    assert ids.tolist() == [i for e in lib.encode_batch(texts, add_special_tokens=False) for i in e.ids]
