import json
import time

from pyspark.sql import functions as F


from sheaf.functions.windows import running_values
from sheaf.operators import extract as E

HTML = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">x</a></nav>'
        '<!-- c --><div class="ad">buy</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>'
        '<br>next &quot;q&quot;</p><ul><li>i1</li><li>i2</li></ul><h2>Sub</h2><p>Two</p>'
        '<script>var x="</p>";</script></article><footer>&copy; f</footer></body></html>')


def test_markdown_chain(spark):
    df = spark.createDataFrame([(1, HTML)], "id int, html string")
    md = E.extract_markdown(df).collect()[0].markdown
    assert md == '# Title & more\n\nOne **bold**\nnext "q"\n\n- i1\n- i2\n\n## Sub\n\nTwo'
    clean = E.extract_html(df).collect()[0].clean_html
    assert "<nav" not in clean and "<script" not in clean and "buy" not in clean and "<h1>" in clean


def test_structure_blocks_and_round_trip(spark):
    md = "# A\n\nx1\n\n- item\n\n## B\n\nyy\n\n\n\nzz"
    df = spark.createDataFrame([(1, md)], "id int, markdown string")
    blocks = E.structure_blocks(df, "id", page_chars=10)
    got = [(r.pos, r.label, r.text, r.heading, r.page_no) for r in blocks.orderBy("pos").collect()]
    assert got == [(0, "section_header", "A", "A", 1), (1, "text", "x1", "A", 1),
                   (2, "list_item", "item", "A", 1), (3, "section_header", "B", "B", 2),
                   (4, "text", "yy", "B", 3), (5, "text", "", "B", 3), (6, "text", "zz", "B", 3)]
    js = E.structure_json(blocks, "id")
    chunks = E.parse_chunks(js, "id")
    back = [(r.chunk_index, r.chunk_type, r.chunk_text, r.heading, r.page_number)
            for r in chunks.orderBy("chunk_index").collect()]
    # empty text dropped, original index kept
    assert back == [(i, lab, t, h, p) for i, lab, t, h, p in got if t != ""]


def test_heading_paths(spark, monkeypatch):
    """A header closes its own and deeper levels; the same in blocks of any size."""
    md = ["t", "### deep", "a", "# A", "## B", "b", "#### D", "d", "### C", "c", "## B2", "e", "# A2", "f", "####### no", "#### D2", "# "]
    want = [[], ["deep"], ["deep"], ["A"], ["A", "B"], ["A", "B"], ["A", "B", "D"], ["A", "B", "D"], ["A", "B", "C"],
            ["A", "B", "C"], ["A", "B2"], ["A", "B2"], ["A2"], ["A2"], ["A2"], ["A2", "D2"], [""]]
    df = spark.createDataFrame([(1, "\n\n".join(md)), (2, "## x\n\ny"), (3, None), (4, "")], "id int, markdown string")
    for block in (1, 3, 4096):
        monkeypatch.setattr(E, "running_values", lambda *a, **k: running_values(*a, **k, block=block))
        rows = E.structure_blocks(df, "id").collect()
        got = [r["headings"] for r in sorted(rows, key=lambda r: r["pos"]) if r["id"] == 1]
        assert got == want
        assert all(r["heading"] == (r["headings"][-1] if r["headings"] else None) for r in rows)
        assert sorted((r["id"], r["headings"]) for r in rows if r["id"] != 1) == [(2, ["x"]), (2, ["x"]), (4, [])]
    js = E.structure_json(E.structure_blocks(df, "id"), "id")
    texts = json.loads(js.where("id = 1").first()["structure_json"])["texts"]
    assert [t["headings"] for t in texts] == want
    chunks = {r["chunk_index"]: r["heading"] for r in E.parse_chunks(js, "id").where("id = 1").collect()}
    assert chunks == {i: (p[-1] if p else "") for i, p in enumerate(want) if i != 16}


def test_parse_chunks_rules(spark):
    def doc(texts):
        return json.dumps({"texts": texts})
    cases = [
        ("empty", ""), ("obj", "{}"), ("null", "null"), ("bad", "{bad"), ("none", None),
        ("gap", doc([{"text": "a", "label": "text"}, {"text": "", "label": "text"},
                     {"text": "c", "label": "title", "prov": [{"page_no": 4}, {"page_no": 5}],
                      "headings": ["h1", "h2"]}])),
        ("noprov", doc([{"text": "x", "label": "text", "prov": []}])),
        ("wrapped", json.dumps({"document": {"json_content": {"texts": [{"text": "w", "label": "text"}]}},
                                "status": "success"})),
        ("wrongtype", '{"texts": 5}'), ("array", "[1, 2]"),
    ]
    df = spark.createDataFrame(cases, "id string, structure_json string")
    ch = E.parse_chunks(df, "id")
    got = sorted((r.id, r.chunk_index, r.chunk_type, r.page_number, r.heading, r.chunk_text) for r in ch.collect())
    assert got == [("gap", 0, "text", 0, "", "a"), ("gap", 2, "title", 4, "h2", "c"),
                   ("noprov", 0, "text", 0, "", "x"), ("wrapped", 0, "text", 0, "", "w")]
    errs = {r.id: r.chunk_error for r in E.chunk_errors(df, "id").collect()}
    assert errs == {"bad": "INVALID_JSON", "wrongtype": "INVALID_JSON", "array": "INVALID_JSON"}


def test_image_modes(spark):
    html = '<p>a<img src="data:image/png;base64,AAAA" alt="x">b<img src="/f.jpg"></p>'
    df = spark.createDataFrame([(1, html)], "id int, html string")
    ph = E.apply_image_mode(df, "html", None, "o").collect()[0].o
    assert ph == "<p>a<!-- image -->b<!-- image --></p>"
    emb = E.apply_image_mode(df, "html", "embedded", "o").collect()[0].o
    assert emb == html
    ref = E.apply_image_mode(df, "html", "referenced", "o").collect()[0].o
    assert ref == '<p>a<img src="image_1" alt="x">b<img src="/f.jpg"></p>'


def test_images_through_extraction(spark):
    html = ('<nav>menu<article><p>a<img src="data:image/png;base64,AAAA" alt="x">b<img src="/f.jpg">'
            '<a class="k" href="/to"><b>c</b><img src="data:image/gif;base64,BB"></a></p></article>')
    df = spark.createDataFrame([(1, html)], "id int, html string")

    def md(mode):
        return E.extract_markdown(df, image_mode=mode).collect()[0].markdown
    assert md(None) == "menu\n\na<!-- image -->b<!-- image -->[**c**<!-- image -->](/to)"
    assert md("embedded") == ("menu\n\na![image](data:image/png;base64,AAAA)b![image](/f.jpg)"
                              "[**c**![image](data:image/gif;base64,BB)](/to)")
    assert md("referenced") == "menu\n\na![image](image_1)b![image](/f.jpg)[**c**![image](image_2)](/to)"
    twice = E.extract_markdown(E.apply_image_mode(df)).collect()[0].markdown
    assert twice == md(None)


def test_unclosed_parts(spark):
    """Raw text runs to the end; other sections and comments lose only their tag."""
    df = spark.createDataFrame([
        (1, "<p>keep</p><script>var a=1;<p>gone"),
        (2, "<p>keep</p><nav>menu<p>body" + "<nav>x" * 3),
        (3, "<head><title>t</title><p>body text</p>"),
        (4, "<nav><ul><li>m</li></ul><article><p>BODY TEXT</p></article>"),
        (5, "<p>a</p><!-- open <p>b</p>"),
        (6, '<div class="ad">x</div><div>y</div><div class="ad">z'),
        (7, None),
    ], "id int, html string")
    got = {r.id: r.markdown for r in E.extract_markdown(df).collect()}
    assert got == {1: "keep", 2: "keepmenu\n\nbodyxxx", 3: "t\n\nbody text", 4: "- m\n\nBODY TEXT",
                   5: "a open\n\nb", 6: "yz", 7: None}


def test_hostile_pages_take_linear_time(spark):
    n = 1 << 20
    for piece in (" ", "<", "<head>", "<nav>", "<!--", "<a href=", '<a href="x">', "</div>", "<h1 ", " \n", "<!-- image -->"):
        df = spark.createDataFrame([(1, piece * (n // len(piece)))], "id int, html string")
        began = time.perf_counter()
        E.extract_html(E.extract_markdown(df)).collect()
        assert time.perf_counter() - began < 6, piece


def test_markdown_is_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def made(i):
        calls.add(1)
        return f"# T{i}\n\ntext\n\n## U\n\n- item"
    docs = spark.range(40).select(F.col("id").alias("doc"), F.udf(made)("id").alias("markdown"))
    rows = E.structure_json(E.structure_blocks(docs, "doc"), "doc").collect()
    assert len(rows) == 40 and calls.value == 40
