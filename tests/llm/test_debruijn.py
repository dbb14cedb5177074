"""Operator 7 by parts: chains, cycles, branches, colliding hashes, hot buckets."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import anchors, debruijn


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)


def got(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def want(texts, k):
    return sorted((i, *row) for i, row in enumerate(brute.op7(list(enumerate(texts)), k)))


def hard_texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    a, b, c = draw(150), draw(90), draw(40)
    ring = draw(61)
    out = [a, draw(30) + a[20:120] + draw(10), a[:70] + b, b + a[60:], c * 9, ring * 5, ring[30:] + ring * 2, ["x"] * 80, ["x"] * 50 + c,
           ["x", "y"] * 60, a + a, draw(11), draw(12), [], b[10:22], b[10:21]]
    for _ in range(25):  # one passage in many surroundings: branches at both of its ends
        out.append(draw(15) + c[5:30] + draw(15))
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("hot", [False, True])
def test_cycles_and_branches(spark, monkeypatch, hot):
    texts = hard_texts()
    if hot:
        monkeypatch.setattr(anchors, "LEAST", 1)
    docs = table(spark, texts)
    assert got(debruijn.digests(docs, 12, 4)) == want(texts, 12)


@pytest.mark.parametrize("bits", [5, 9])
def test_colliding_hashes_are_told_apart_by_their_words(spark, bits):
    """Nodes of few bits collide everywhere: results are those of the words all the same."""
    texts = hard_texts()
    docs = table(spark, texts)
    held = debruijn.held_stretches(docs, 12, 4, bits)
    assert debruijn.differing(held, 12).count() > 0
    assert got(debruijn.digests(docs, 12, 4, bits)) == want(texts, 12)


def test_passage_is_one_path(spark, monkeypatch):
    """A passage that two documents share is one path over many buckets, hot or not; a branch ends it."""
    r = random.Random(8)
    draw = lambda n: [f"u{r.randrange(10 ** 9)}" for _ in range(n)]
    passage = draw(500)
    texts = [" ".join(draw(9) + passage + draw(9)), " ".join(draw(4) + passage)]
    for least in (anchors.LEAST, 1):
        monkeypatch.setattr(anchors, "LEAST", least)
        held = debruijn.held_stretches(table(spark, texts), 35, 8, 64)
        parts = {}
        for row in held.collect():
            found = debruijn.merged(pa.array([[x.asDict() for x in row["stretches"]]]))
            assert len(found[0]) == 1
            parts[row["id"]] = tuple(int(x[0]) for x in found[1:])
        assert parts[0][:2] == (9, 466) and parts[1][:2] == (4, 466)
        assert parts[0][2:] == parts[1][2:] and parts[0][3] == 0  # same path, from its start
    branch = texts + [" ".join(passage[100:200] + draw(50) + passage[300:])]
    held = debruijn.held_stretches(table(spark, branch), 35, 8, 64)
    roots = held.select(F.explode("stretches.root").alias("root")).distinct().count()
    assert roots == 1  # what leaves the passage is not repeated, so that it is no branch
    twice = branch + [" ".join(passage[100:200] + branch[2].split()[100:150])]
    held = debruijn.held_stretches(table(spark, twice), 35, 8, 64)
    assert held.select(F.explode("stretches.root").alias("root")).distinct().count() == 3


def test_chains():
    following = np.array([1, 2, -1, 4, 5, 3, 6, -1, 7, 10, 9])
    head, place = debruijn.chains(following)
    assert head.tolist() == [0, 0, 0, 3, 3, 3, 6, 8, 8, 9, 9]
    assert place.tolist() == [0, 1, 2, 0, 1, 2, 0, 1, 0, 0, 1]
    long_ = np.append(np.arange(1, 1000), -1)
    head, place = debruijn.chains(long_)
    assert (head == 0).all() and (place == np.arange(1000)).all()
    assert len(debruijn.chains(np.zeros(0, np.int64))[0]) == 0


def test_rows_told_apart_with_colliding_checksums(spark):
    """Documents without ids: each loses what it repeats itself."""
    r = random.Random(2)
    draw = lambda n: " ".join(f"q{r.randrange(10 ** 9)}" for _ in range(n))
    shared = draw(60)
    rows = [(None, shared), (None, draw(61)), (None, shared + " " + draw(3)), (7, draw(60)), (7, shared), (7, shared), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((x["doc_id"] or 0, x["n_words"], x["n_removed"]) for x in debruijn.digests(docs).collect())
    assert out == [(0, 0, 0), (0, 60, 60), (0, 61, 0), (0, 63, 60), (7, 60, 0), (7, 60, 60), (7, 60, 60)]


def test_very_long_document(spark):
    """20 MB with a long period: one cycle over many buckets."""
    r = random.Random(4)
    period = [f"p{r.randrange(10 ** 9)}" for _ in range(5000)]
    text = " ".join(period * 400)
    row = debruijn.digests(spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string"))
    out = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in row.collect()}
    assert out == {1: (2_000_000, 2_000_000), 2: (2, 0)}
