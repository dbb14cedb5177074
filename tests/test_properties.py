"""Property checks over generated inputs (fixed seed, evaluated in one Spark job each)."""

import random

import duckdb

from sheaf.functions import html as H
from sheaf.operators import pages as P
from sheaf.operators import scan as S
from sheaf.plans.oracle import html_sql, markdown_sql

TAGS = ["p", "b", "br", "h1", "h2", "li", "ul", "div", "span", "strong", "script", "style", "nav", "footer",
        "head", "a", "img"]
WORDS = ["alpha", "beta", "é", "ü", "&amp;", "&middot;", "&quot;", "&lt;", "&copy;", "x y", "\n", "  ", "\t"]


def _html(rnd):
    out = []
    for _ in range(rnd.randint(0, 30)):
        r = rnd.random()
        t = rnd.choice(TAGS)
        if r < 0.3:
            out.append(f"<{t}>")
        elif r < 0.5:
            out.append(f"</{t}>")
        elif r < 0.55:
            out.append(f'<{t} class="c">')
        elif r < 0.6:
            out.append("<!-- c -->")
        elif r < 0.63:
            out.append('<div class="ad">ad</div>')
        else:
            out.append(rnd.choice(WORDS))
    return "".join(out)


def test_rewrite_chain_equals_the_hand_written_statement(spark):
    """Spark's steps and the DuckDB statement, which shares none of them, give
    identical Markdown and clean HTML on random pages."""
    rnd = random.Random(11)
    rows = [(i, _html(rnd)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, html string")
    got = {r.id: (r.md, r.ch) for r in df.select("id", H.to_markdown("html").alias("md"),
                                                   H.clean_html("html").alias("ch")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INTEGER, html VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {i: (md, ch) for i, md, ch in con.execute(
        f"SELECT id, {markdown_sql('html')}, {html_sql('html')} FROM t").fetchall()}
    assert got == want


def test_kgram_equals_brute_force(spark):
    rnd = random.Random(5)
    alphabet = "ab é\n"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    pats = []
    for j in range(40):
        t = rnd.choice(texts)
        if len(t) > 40 and rnd.random() < 0.7:
            a = rnd.randint(0, len(t) - 35)
            pats.append((j, t[a:a + rnd.randint(31, 35)]))
        else:
            pats.append((j, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(31, 40)))))
    sigs = spark.createDataFrame(pats, "sig_id int, pattern string")
    got = {tuple(r) for r in S.scan_hits(files, sigs).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, p in pats if p in t}
    assert got == want and len(want) > 10


def test_chunked_pages_property(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aé\n𝄞 ") for _ in range(rnd.randint(0, 50))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "text/plain") for i, t in enumerate(texts)],
                               "file_id int, text string, content_type string")
    for size in (1, 4, 9):
        pages = {}
        for r in P.paginate(df, size).collect():
            pages.setdefault(r.file_id, []).append((r.page_no, r.page_text))
        for i, t in enumerate(texts):
            ps = sorted(pages[i])
            assert "".join(x for _, x in ps) == t
            assert all(len(x) == size for _, x in ps[:-1]) and 0 <= len(ps[-1][1]) <= size
            assert [p for p, _ in ps] == list(range(1, max(1, -(-len(t) // size)) + 1))


def _first_error(doc, allowed=None):
    """The checks walked in reading order for one job (brute force)."""
    def ref(bucket, key):
        if not bucket:
            return "BUCKET_REQUIRED"
        if allowed is not None and bucket not in allowed:
            return "BUCKET_NOT_ALLOWED"
        if not key:
            return "KEY_REQUIRED"
        if ".." in key:
            return "KEY_TRAVERSAL"
        return None
    ins, ops, dests = doc["inputs"], doc["operations"], doc["destinations"]
    if not ins:
        return "NO_INPUTS"
    if not ops:
        return "NO_OPERATIONS"
    seen = set()
    for i in ins:
        if not i["name"]:
            return "INPUT_NAME_REQUIRED"
        if i["name"] in seen:
            return "DUPLICATE_INPUT"
        seen.add(i["name"])
        e = ref(i["bucket"], i["key"])
        if e:
            return e
    known = set(seen)
    for o in ops:
        if not o["name"]:
            return "OP_NAME_REQUIRED"
        if o["name"] in seen:
            return "OP_NAME_IS_INPUT"
        if o["name"] in known:
            return "DUPLICATE_OP"
        if not any(t in o for t in ("scan", "convert_to_pdf", "merge_pdfs", "thumbnail", "extract_markdown")):
            return "OP_TYPE_MISSING"
        if any(r not in known for r in o["inputs"]):
            return "UNKNOWN_REF"
        if not o["inputs"]:
            return "OP_INPUTS_REQUIRED"
        known.add(o["name"])
    for name in sorted(dests):
        if name not in known:
            return "UNKNOWN_DEST"
        e = ref(dests[name]["bucket"], dests[name]["key"])
        if e:
            return e
    return None


def test_check_pipelines_equals_brute_force(spark):
    import json
    from sheaf.operators import validate as V
    from sheaf.sources.jobs import explode_jobs, parse_jobs
    rnd = random.Random(21)
    names = ["a", "b", "c", "d", ""]
    types = ["scan", "convert_to_pdf", "merge_pdfs", "thumbnail", "extract_markdown", None]
    buckets = ["x", "y", ""]
    keys = ["k", "", "a/../b", "k2"]
    docs = []
    for j in range(300):
        ins = [{"name": rnd.choice(names[:4] if rnd.random() < 0.9 else names), "bucket": rnd.choice(buckets),
                "key": rnd.choice(keys), "content_type": ""} for _ in range(rnd.randint(0, 3))]
        ops = []
        for _ in range(rnd.randint(0, 4)):
            o = {"name": rnd.choice(["s", "t", "u", "a", ""]),
                 "inputs": [rnd.choice(["a", "b", "s", "t", "u", "zz"]) for _ in range(rnd.randint(0, 2))]}
            t = rnd.choice(types)
            if t:
                o[t] = {}
            ops.append(o)
        dests = {rnd.choice(["a", "s", "t", "zz"]): {"bucket": rnd.choice(buckets), "key": rnd.choice(keys)}
                 for _ in range(rnd.randint(0, 2))}
        docs.append({"job_id": f"j{j}", "inputs": ins, "operations": ops, "destinations": dests})
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "job_json string")
    got = {r.job_id: r.error for r in V.check_pipelines(explode_jobs(parse_jobs(df)), ["x"]).collect()}
    want = {d["job_id"]: _first_error(d, {"x"}) for d in docs}
    assert got == want
    assert len(set(want.values())) >= 10


def test_ledger_equals_brute_force(spark):
    from sheaf.operators import ledger as L
    rnd = random.Random(8)
    statuses = ["pending", "running", "running", "completed", "failed", "cancelled"]
    events = []
    for seq in range(600):
        events.append((f"j{rnd.randint(0, 40)}", seq, rnd.choice(statuses), rnd.choice([None, "e1", "e2"])))
    rnd.shuffle(events)
    led = spark.createDataFrame(events, "job_id string, seq long, status string, error string")
    got = {r.job_id: (r.status, r.error, r.final_seq, r.last_seq, r.n_events) for r in L.job_state(led).collect()}
    want = {}
    for job in {e[0] for e in events}:
        evs = sorted((e for e in events if e[0] == job), key=lambda e: e[1])
        final = [e for e in evs if e[2] in ("completed", "failed", "cancelled")]
        if final:
            want[job] = (final[0][2], final[0][3], final[0][1], evs[-1][1], len(evs))
        else:
            want[job] = (evs[-1][2], None, None, evs[-1][1], len(evs))
    assert got == want
    reqs = [(i, rnd.choice(["", "nope"] + [f"j{k}" for k in range(45)])) for i in range(200)]
    out = {r.request_id: r.outcome for r in L.cancel_jobs(L.job_state(led), spark.createDataFrame(
        reqs, "request_id long, job_id string")).collect()}
    seen = set()
    for rid, jid in reqs:
        if jid == "":
            exp = "JOB_ID_REQUIRED"
        elif jid not in want:
            exp = "NOT_FOUND"
        elif want[jid][0] in ("completed", "failed", "cancelled") or jid in seen:
            exp = "ALREADY_FINAL"
        else:
            exp = "CANCELLED"
        if jid:
            seen.add(jid)
        assert out[rid] == exp, (rid, jid)
