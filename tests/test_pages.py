import random

from pyspark.sql import functions as F

from sheaf.functions.paths import page_key
from sheaf.functions.rules import conversion_route, image_mime
from sheaf.operators import pages as P
from sheaf.sources.files import cap_sizes, effective_cap


def test_image_routing(spark):
    cases = [("image/png", True), ("image/jpeg", True), ("image/webp", True), ("image/svg+xml", True),
             ("application/pdf", False), ("text/plain", False), ("", False)]
    df = spark.createDataFrame(cases, "ct string, want boolean")
    for r in df.select("ct", "want", conversion_route(F.col("ct")).alias("route")).collect():
        assert (r.route == "image") == r.want
    got = {r.ct: r.route for r in df.select("ct", conversion_route(F.col("ct")).alias("route")).collect()}
    assert got["application/pdf"] == "passthrough" and got["text/plain"] == "office"


def test_format_to_mime(spark):
    cases = [("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("webp", "image/webp"),
             ("", "image/jpeg"), ("unknown", "image/jpeg"), ("PNG", "image/png"), (None, "image/jpeg")]
    df = spark.createDataFrame(cases, "f string, want string")
    for r in df.select("want", image_mime(F.col("f")).alias("m")).collect():
        assert r.m == r.want


def test_page_keys(spark):
    cases = [("a/b.c/thumb.jpg", "a/b.c/thumb_007.jpg"), ("a.b/thumb", "a.b/thumb_007"),
             (".bashrc", "_007.bashrc"), ("t.tar.gz", "t.tar_007.gz"), ("thumb.", "thumb_007.")]
    df = spark.createDataFrame(cases, "k string, want string")
    for r in df.select("want", page_key(F.col("k"), F.lit(7)).alias("got")).collect():
        assert r.got == r.want


def test_size_cap(spark):
    df = spark.createDataFrame([(1, 10, "x" * 10), (2, 11, "y" * 11)], "file_id int, size_bytes bigint, text string")
    got = {r.file_id: (r.error, r.text) for r in cap_sizes(df, 10).collect()}
    assert got == {1: (None, "x" * 10), 2: ("TOO_LARGE", None)}
    assert effective_cap(0) == 256 << 20 and effective_cap(-5) == 256 << 20


def test_paginate_concatenates_to_text(spark):
    rnd = random.Random(7)
    texts = ["", "a", "é" * 5] + ["".join(rnd.choice("abcé\n ") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "text/plain") for i, t in enumerate(texts)] + [(99, "img", "image/png")],
                               "file_id int, text string, content_type string")
    pages = P.paginate(df, 7)
    got = {}
    for r in pages.collect():
        got.setdefault(r.file_id, []).append((r.page_no, r.page_text))
    for i, t in enumerate(texts):
        ps = sorted(got[i])
        assert [p for p, _ in ps] == list(range(1, len(ps) + 1))
        assert "".join(x for _, x in ps) == t
        assert len(ps) == max(1, -(-len(t) // 7))
    assert got[99] == [(1, "img")]


def test_merge_documents_in_listed_order(spark):
    # group g: members listed c, a, b (positions 0, 1, 2); a has 3 pages, b 1, c 2
    members = spark.createDataFrame([("g", 0, "c"), ("g", 1, "a"), ("g", 2, "b"), ("h", 0, "a")],
                                    "g string, pos bigint, m string")
    pages = spark.createDataFrame([("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1"),
                                   ("c", 1, "c1"), ("c", 2, "c2")], "m string, page_no int, page_text string")
    out = P.merge_documents(members, pages, "g", "pos", "m")
    g = sorted((r.page_no, r.page_text) for r in out.filter("g = 'g'").collect())
    assert g == [(1, "c1"), (2, "c2"), (3, "a1"), (4, "a2"), (5, "a3"), (6, "b1")]
    h = sorted((r.page_no, r.page_text) for r in out.filter("g = 'h'").collect())
    assert h == [(1, "a1"), (2, "a2"), (3, "a3")]  # one member: unchanged


def test_merge_reports_what_is_missing(spark):
    members = spark.createDataFrame([("g", 0, "a"), ("g", 1, "lost"), ("g", 2, "b"), ("h", 0, "b")],
                                    "g string, pos bigint, m string")
    pages = spark.createDataFrame([("a", 1, "a1"), ("b", 1, "b1")], "m string, page_no int, page_text string")
    groups = spark.createDataFrame([("g",), ("h",), ("none",)], "g string")
    out = P.merge_documents(members, pages, "g", "pos", "m", groups=groups)
    assert sorted(map(str, ((r.g, r.pos, r.m, r.page_no, r.error) for r in out.collect()))) == sorted(map(str, [
        ("g", 1, "lost", None, "MEMBER_MISSING"), ("h", 0, "b", 1, None), ("none", None, None, None, "NO_MEMBERS")]))


def test_merge_offsets_cross_blocks(spark):
    """Offsets stay exact when a group spans many running-sum blocks."""
    from sheaf.functions.windows import running_sum
    n = 50
    df = spark.createDataFrame([("g", i, i % 3 + 1) for i in range(n)], "g string, pos bigint, v bigint")
    got = {r.pos: r.off for r in running_sum(df, "g", "pos", "v", "off", block=4).collect()}
    acc = 0
    for i in range(n):
        assert got[i] == acc
        acc += i % 3 + 1


def test_preview_defaults_and_all_pages(spark):
    counts = spark.createDataFrame([(1, 5), (2, 5), (3, 0), (4, 1)], "doc_id int, n_pages bigint")
    req = spark.createDataFrame([
        (1, "", 0, 0, "", "t/1.jpg"),          # all defaults: jpg, 400, 150, page 1
        (2, "png", 800, 300, "all", "t/2.png"),  # custom, every page
        (3, None, None, None, "all", "t/3.jpg"),  # no pages
        (4, "webp", 10, 10, "all", "t/4.webp")],  # all pages of a one-page document
        "doc_id int, format string, width int, dpi int, pages string, dest_key string")
    plan = P.plan_previews(counts, req).collect()
    one = [r for r in plan if r.doc_id == 1]
    assert [(r.page_no, r.format, r.mime, r.width, r.dpi, r.key) for r in one] == \
        [(1, "jpg", "image/jpeg", 400, 150, "t/1.jpg")]
    two = sorted((r.page_no, r.key, r.mime, r.width, r.dpi) for r in plan if r.doc_id == 2)
    assert [p for p, *_ in two] == [1, 2, 3, 4, 5]
    assert two[0][1:] == ("t/2_001.png", "image/png", 800, 300)
    three = [r for r in plan if r.doc_id == 3]
    assert len(three) == 1 and three[0].error == "NO_PAGES"
    four = [(r.page_no, r.key, r.mime) for r in plan if r.doc_id == 4]
    assert four == [(1, "t/4_001.webp", "image/webp")]  # the single-call path always numbers pages


def test_preview_pages_sizes(spark):
    pages = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "gh")], "doc_id int, page_no int, page_text string")
    plan = P.plan_previews(P.page_counts(pages, "doc_id"),
                           spark.createDataFrame([(1, "", 3, 0, "all", "k.jpg")],
                                                 "doc_id int, format string, width int, dpi int, pages string, dest_key string"))
    pv = P.preview_pages(pages, plan)
    got = sorted((r.page_no, r.preview, r.size_bytes) for r in pv.collect())
    assert got == [(1, "abc", 3), (2, "gh", 2)]
    s = P.preview_sizes(pv).collect()[0]
    assert (s.n_previews, s.first_size, s.total_size) == (2, 3, 5)


def test_carry_last_cross_blocks(spark):
    """Carry-forward stays exact when headings sit in earlier blocks."""
    from sheaf.functions.windows import carry_last, running_values
    rows = [("g", i, (f"h{i}" if i in (0, 5, 17) else None)) for i in range(30)] + [("k", 3, None), ("k", 9, "x")]
    df = spark.createDataFrame(rows, "g string, pos bigint, h string")
    got = {(r.g, r.pos): r.last for r in carry_last(df, "g", "pos", "h", "last", block=4).collect()}
    cur = None
    for i in range(30):
        cur = f"h{i}" if i in (0, 5, 17) else cur
        assert got[("g", i)] == cur
    assert got[("k", 3)] is None and got[("k", 9)] == "x"
    both = running_values(df.withColumn("one", F.lit(1)), "g", "pos", sums={"n": "one"}, lasts={"l": "h"}, block=3)
    assert {(r.g, r.pos): (r.n, r.l) for r in both.collect()}[("g", 20)] == (20, "h17")


def test_existing_pages_pass_through_and_uncounted_documents_are_error_rows(spark):
    files = spark.createDataFrame(
        [("pdf", None, "application/pdf"), ("lost", "text of a pdf", "application/pdf"), ("txt", "abcdefg", "text/plain"),
         ("none", None, "text/plain"), ("img", "abcdefg", "image/png"), ("empty", "", None)],
        "file_id string, text string, content_type string")
    existing = spark.createDataFrame([("pdf", 2, "two two"), ("pdf", 1, ""), ("txt", 1, "ignored"), ("nobody", 1, "x")],
                                     "file_id string, page_no int, page_text string")
    pages = P.paginate(files, 4, existing=existing)
    assert sorted(tuple(r) for r in pages.collect()) == [
        ("empty", 1, ""), ("img", 1, "abcdefg"), ("pdf", 1, ""), ("pdf", 2, "two two"), ("txt", 1, "abcd"), ("txt", 2, "efg")]
    counts = P.page_counts(pages, "file_id", documents=files)
    assert sorted(tuple(r) for r in counts.select("file_id", "n_pages", "size_bytes", "error").collect()) == [
        ("empty", 1, 0, None), ("img", 1, 7, None), ("lost", None, None, P.NO_PAGES), ("none", None, None, P.NO_PAGES),
        ("pdf", 2, 7, None), ("txt", 2, 7, None)]
    assert P.paginate(files.limit(0), 4, existing=existing).count() == 0
