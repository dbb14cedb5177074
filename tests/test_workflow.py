import json
import random

from pyspark.sql import functions as F

from sheaf.operators import validate as V
from sheaf.operators.ledger import decode_results
from sheaf.plans import workflow as W
from sheaf.sources.jobs import Jobs, explode_jobs, parse_jobs
from sheaf.sources.sinks import upload_plan


def _jobs(spark, docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "job_json string")
    return explode_jobs(parse_jobs(df))


def _inp(name, key):
    return {"name": name, "bucket": "b", "key": key, "content_type": ""}


FILES = [("b", "a.txt", "text/plain", "0123456789abcdef"), ("b", "evil.txt", "text/plain", "xx EVIL xx"),
         ("b", "p.html", "text/html", "<html><body><h1>T</h1><p>x</p></body></html>"),
         ("b", "z.txt", "text/plain", "zz")]


def _files(spark):
    df = spark.createDataFrame(FILES, "bucket string, key string, content_type string, text string")
    return df.withColumn("size_bytes", F.octet_length("text").cast("bigint"))


def _sigs(spark):
    return spark.createDataFrame([(1, "Evil.Sig", "EVIL")], "sig_id long, sig_name string, pattern string")


def _results(run):
    return {(r.job_id, r.op_name): r for r in run.results.collect()}


def test_gate_and_results(spark):
    ops = [{"name": "scan", "inputs": ["doc"], "scan": {}},
           {"name": "pdf", "inputs": ["doc"], "convert_to_pdf": {}},
           {"name": "thumb", "inputs": ["pdf"], "thumbnail": {"width": 3, "pages": "all"}},
           {"name": "text", "inputs": ["pdf"], "extract_markdown": {}}]
    docs = [{"job_id": "clean", "inputs": [_inp("doc", "a.txt")], "operations": ops,
             "destinations": {"thumb": {"bucket": "o", "key": "t/x.jpg"}, "pdf": {"bucket": "o", "key": "p.pdf"},
                              "text": {"bucket": "o", "key": "t.md"}}},
            {"job_id": "infected", "inputs": [_inp("doc", "evil.txt")], "operations": ops,
             "destinations": {"pdf": {"bucket": "o", "key": "p.pdf"}}}]
    jobs = _jobs(spark, docs)
    run = W.run_jobs(jobs, _files(spark), _sigs(spark), page_chars=5)
    r = _results(run)
    assert r[("clean", "scan")].success and r[("clean", "scan")].clean
    assert r[("clean", "pdf")].size_bytes == 16 and r[("clean", "pdf")].page_count == 4
    assert r[("clean", "thumb")].size_bytes == 3 and r[("clean", "thumb")].page_count == 4
    assert r[("clean", "text")].markdown == "0123456789abcdef"
    s = r[("infected", "scan")]
    assert (s.success, s.clean, s.detail, s.error) == (False, False, "Evil.Sig", "virus detected: Evil.Sig")
    for op in ("pdf", "thumb", "text"):
        x = r[("infected", op)]
        assert (x.success, x.error, x.size_bytes) == (False, "skipped: prior scan detected a threat", None)
    plan = upload_plan(jobs.dests, run.artifacts, run.artifact_pages)
    got = sorted((p.job_id, p.name, p.page_no, p.key, p.size_bytes) for p in plan.collect())
    assert got == [("clean", "pdf", None, "p.pdf", 16),
                   ("clean", "thumb", 1, "t/x_001.jpg", 3), ("clean", "thumb", 2, "t/x_002.jpg", 3),
                   ("clean", "thumb", 3, "t/x_003.jpg", 3), ("clean", "thumb", 4, "t/x_004.jpg", 1)]


def test_merge_positional_and_missing_inputs(spark):
    docs = [{"job_id": "m", "inputs": [_inp("a", "a.txt"), _inp("z", "z.txt")], "operations": [
        {"name": "pa", "inputs": ["a"], "convert_to_pdf": {}},
        {"name": "merged", "inputs": ["z", "pa"], "merge_pdfs": {}},
        {"name": "md", "inputs": ["merged"], "extract_markdown": {}},
        {"name": "bad", "inputs": ["md"], "convert_to_pdf": {}},
    ]}]
    run = W.run_jobs(_jobs(spark, docs), _files(spark), None, page_chars=5)
    r = _results(run)
    assert r[("m", "merged")].page_count == 1 + 4 and r[("m", "merged")].size_bytes == 18
    assert r[("m", "md")].markdown == "zz0123456789abcdef"
    assert r[("m", "bad")].error == "MISSING_INPUT" and not r[("m", "bad")].success
    names = {a.name: a.file_name for a in W.file_names(run.artifacts).collect()}
    assert names == {"a": "a.txt", "z": "z.txt", "pa": "pa.pdf", "merged": "merged"}


def test_scan_disabled_gates_and_html_markdown(spark):
    docs = [{"job_id": "h", "inputs": [_inp("page", "p.html")], "operations": [
        {"name": "md", "inputs": ["page"], "extract_markdown": {}},
        {"name": "scan", "inputs": ["page"], "scan": {}},
        {"name": "pdf", "inputs": ["page"], "convert_to_pdf": {}}]}]
    run = W.run_jobs(_jobs(spark, docs), _files(spark), None)
    r = _results(run)
    assert r[("h", "md")].markdown == "# T\n\nx" and r[("h", "md")].success
    assert r[("h", "scan")].error == "scanning disabled: no antivirus configured"
    assert r[("h", "pdf")].error == "skipped: prior scan detected a threat"


def test_outcome_failed_download(spark):
    docs = [{"job_id": "missing", "inputs": [_inp("a", "a.txt"), _inp("b", "nope.txt")],
             "operations": [{"name": "s", "inputs": ["a"], "convert_to_pdf": {}}]},
            {"job_id": "big", "inputs": [_inp("a", "a.txt")],
             "operations": [{"name": "s", "inputs": ["a"], "convert_to_pdf": {}}]},
            {"job_id": "fine", "inputs": [_inp("a", "z.txt")],
             "operations": [{"name": "s", "inputs": ["a"], "convert_to_pdf": {}}]}]
    run = W.run_jobs(_jobs(spark, docs), _files(spark), None, max_bytes=10)
    out = {o.job_id: (o.status, o.error) for o in run.outcomes.collect()}
    assert out == {"missing": ("failed", "download a: TOO_LARGE"), "big": ("failed", "download a: TOO_LARGE"),
                   "fine": ("completed", None)}
    assert {r.job_id for r in run.results.collect()} == {"fine"}
    run2 = W.run_jobs(_jobs(spark, docs), _files(spark), None)
    out2 = {o.job_id: o.error for o in run2.outcomes.collect()}
    assert out2["missing"] == "download b: NOT_FOUND" and out2["big"] is None


def test_jobs_are_checked_before_they_run(spark):
    """Every job has an outcome; a refused job is not run and harms no other."""
    op = {"name": "p", "inputs": ["a"], "convert_to_pdf": {}}
    a = _inp("a", "a.txt")
    docs = [{"job_id": "fine", "inputs": [a], "operations": [op]},
            {"job_id": "twice", "inputs": [a, a], "operations": [op]},
            {"job_id": "same", "inputs": [a], "operations": [op, op]},
            {"job_id": "none", "inputs": [], "operations": [op]},
            {"job_id": "null", "operations": [op]},
            {"job_id": "idle", "inputs": [a]},
            {"job_id": "untyped", "inputs": [a], "operations": [{"name": "p", "inputs": ["a"]}]},
            {"job_id": "lost", "inputs": [a], "operations": [{**op, "inputs": ["x"]}]},
            {"job_id": "far", "inputs": [a], "operations": [op], "destinations": {"q": {"bucket": "o", "key": "k"}}},
            {"job_id": "empty", "inputs": [_inp("a", "null.txt")], "operations": [op]}]
    files = _files(spark).unionByName(spark.createDataFrame(
        [("b", "null.txt", "text/plain", None, 3)],
        "bucket string, key string, content_type string, text string, size_bytes long"))
    jobs = _jobs(spark, docs)
    want = {"fine": ("completed", None), "twice": ("rejected", "DUPLICATE_INPUT"), "same": ("rejected", "DUPLICATE_OP"),
            "none": ("rejected", "NO_INPUTS"), "null": ("rejected", "NO_INPUTS"), "idle": ("rejected", "NO_OPERATIONS"),
            "untyped": ("rejected", "OP_TYPE_MISSING"), "lost": ("rejected", "UNKNOWN_REF"),
            "far": ("rejected", "UNKNOWN_DEST"), "empty": ("failed", "download a: UNREADABLE")}
    for j in (jobs, Jobs(jobs.inputs, jobs.ops, jobs.dests, jobs.tags)):
        run = W.run_jobs(j, files, None)
        assert {o.job_id: (o.status, o.error) for o in run.outcomes.collect()} == want
        assert [(r.job_id, r.op_name) for r in run.results.collect()] == [("fine", "p")]


def test_documents_checked_in_the_row_as_in_tables(spark):
    rnd = random.Random(3)
    names = ["a", "b", "c", "", None]

    def doc(i):
        ops = [{"name": rnd.choice(names + ["d", "e"]), "inputs": rnd.choice([["a"], ["b", "c"], ["d"], [], None]),
                rnd.choice(["scan", "merge_pdfs", "other"]): {}} for _ in range(rnd.randint(0, 3))]
        return {"job_id": str(i), "operations": ops,
                "inputs": [{"name": rnd.choice(names), "bucket": rnd.choice(["b", "b", ""]),
                            "key": rnd.choice(["k", "k", "x/../y", None])} for _ in range(rnd.randint(0, 3))],
                "destinations": {n: {"bucket": "o", "key": "k"} for n in rnd.sample(["a", "d", "z"], rnd.randint(0, 2))}}
    jobs = _jobs(spark, [doc(i) for i in range(300)])
    for allowed in (None, ["b", "o"], ["o"]):
        rows = [sorted(tuple(map(str, r)) for r in df.select("job_id", "error", "stage", "item").collect())
                for df in (V.check_documents(jobs.docs, allowed), V.check_pipelines(jobs, allowed))]
        assert rows[0] == rows[1]


def test_full_results(spark):
    docs = [{"job_id": "j", "inputs": [_inp("doc", "a.txt")], "operations": [
        {"name": "z", "inputs": ["doc"], "convert_to_pdf": {}},
        {"name": "a", "inputs": ["z"], "thumbnail": {"width": 3, "pages": "all"}},
        {"name": "one", "inputs": ["z"], "thumbnail": {"width": 3}}],
        "destinations": {"z": {"bucket": "o", "key": "p.pdf", "content_type": "application/pdf"},
                         "a": {"bucket": "o", "key": "t.png", "content_type": "image/png"}}}]
    jobs = _jobs(spark, docs)
    run = W.run_jobs(jobs, _files(spark), None, page_chars=10)
    js = W.assemble_results(run.results, jobs.dests)
    out = json.loads(js.collect()[0].output)["results"]
    assert list(out) == ["z", "a", "one"]

    def at(key, kind):
        return {"bucket": "o", "key": key, "content_type": kind}
    assert out["z"] == {"success": True, "destination": at("p.pdf", "application/pdf"), "size_bytes": 16}
    assert out["a"]["thumbnail_pages"] == [
        {"page_number": n, "destination": at(f"t_00{n}.png", "image/png"), "size_bytes": 3} for n in (1, 2)]
    assert "destination" not in out["a"] and "destination" not in out["one"]
    row = {d.op_name: d for d in decode_results(js).collect()}
    assert row["a"].thumbnail_pages[1].destination.key == "t_002.png" and row["z"].destination.bucket == "o"
    twice = W.assemble_results(run.results.unionByName(run.results.withColumn("op_index", F.col("op_index") + 9)
                                                       .withColumn("success", F.lit(False))))
    assert not json.loads(twice.collect()[0].output)["results"]["z"]["success"]


def test_results_json_round_trip(spark):
    docs = [{"job_id": "j", "inputs": [_inp("doc", "a.txt")], "operations": [
        {"name": "scan", "inputs": ["doc"], "scan": {}}, {"name": "pdf", "inputs": ["doc"], "convert_to_pdf": {}}]}]
    run = W.run_jobs(_jobs(spark, docs), _files(spark), _sigs(spark))
    js = W.assemble_results(run.results)
    out = json.loads(js.collect()[0].output)
    assert out == {"results": {"scan": {"success": True, "scan": {"clean": True}},
                               "pdf": {"success": True, "size_bytes": 16}}}
    bad = spark.createDataFrame([("x", "{not json"), ("y", None)], "job_id string, output string")
    dec = decode_results(js.unionByName(bad))
    assert sorted((d.job_id, d.op_name, d.success) for d in dec.collect()) == [("j", "pdf", True), ("j", "scan", True)]


def test_artifact_refs_and_unused(spark):
    docs = [{"job_id": "r", "inputs": [_inp("a", "a.txt"), _inp("u", "z.txt")], "operations": [
        {"name": "p", "inputs": ["a"], "convert_to_pdf": {}},
        {"name": "m", "inputs": ["p", "p", "a"], "merge_pdfs": {}}],
        "destinations": {"m": {"bucket": "o", "key": "m.pdf"}}}]
    jobs = _jobs(spark, docs)
    refs = {(x.ref): (x.n_uses, x.last_op_index) for x in W.artifact_refs(jobs).collect()}
    assert refs == {"a": (2, 1), "p": (2, 1), "m": (1, None)}
    assert [u.name for u in W.unused_inputs(jobs).collect()] == ["u"]


def _brute(doc, files, sigs, n):
    """One job's results in plain Python: (name, success, error, clean, detail, size, pages, markdown, thumbs)."""
    files = {(b, k): (ct, t) for b, k, ct, t in files}
    arts, out, gate = {}, [], False
    for i in doc["inputs"]:
        ct, text = files[i["bucket"], i["key"]]
        pages = [text] if ct.startswith("image/") else [text[x:x + n] for x in range(0, len(text), n)] or [""]
        arts[i["name"]] = ("file", pages)
    for op in doc["operations"]:
        kind = next(k for k in ("scan", "convert_to_pdf", "merge_pdfs", "thumbnail", "extract_markdown") if k in op)
        src = [arts.get(r) for r in op["inputs"]]
        row = [op["name"], False, None, None, None, None, None, None, None]
        if gate:
            row[2] = W.SKIPPED
        elif None in src:
            row[2], gate = W.MISSING_INPUT, gate or kind == "scan"
        else:
            row[1] = True
            pages = src[0][1]
            if kind == "scan":
                hit = next((name for _, name, p in sorted(sigs) if p in "".join(pages)), None)
                row[1], row[3], row[4] = hit is None, hit is None, hit
                row[2], gate = (W.VIRUS_PREFIX + hit, True) if hit else (None, gate)
            elif kind in ("convert_to_pdf", "merge_pdfs"):
                pages = pages if kind == "convert_to_pdf" else [p for s in src for p in s[1]]
                arts[op["name"]] = ("paged", pages)
                row[5], row[6] = sum(len(p.encode()) for p in pages), len(pages)
            elif kind == "thumbnail":
                width = op[kind].get("width") or 400
                every = op[kind].get("pages") == "all"
                cut = [p[:width] for p in (pages if every else pages[:1])]
                arts[op["name"]] = ("image", cut)
                row[5], row[6] = len(cut[0].encode()), len(cut)
                row[8] = [(i + 1, len(p.encode())) for i, p in enumerate(cut)] if every else None
            else:
                row[7] = "".join(pages)
        out.append(tuple(row))
    return out


def test_every_job_with_its_own_operations(spark):
    """Hundreds of different operation lists in one plan, with merges of merges, previews of previews
    and scans of both, against plain Python."""
    rnd = random.Random(11)
    files = [("b", "a.txt", "text/plain", "0123456789abcdef"), ("b", "e.txt", "text/plain", "xx EVIL xx"), ("b", "z.txt", "", "zz"),
             ("b", "u.txt", "text/plain", "éé𝄞ßEV"), ("b", "v.txt", "text/plain", "IL..."), ("b", "i.png", "image/png", "imagebytes" * 3),
             ("b", "empty.txt", "text/plain", "")]
    sigs = [(1, "Evil.Sig", "EVIL"), (2, "Two.Sig", "zz0"), (3, "Cut.Sig", "01234")]

    def doc(i):
        names = [f"in{k}" for k in range(rnd.choice([1, 1, 2, 3]))]
        inputs = [_inp(x, rnd.choice(files)[1]) for x in names]
        ops = []
        for k in range(rnd.randint(1, 6)):
            kind = rnd.choice(["scan", "convert_to_pdf", "merge_pdfs", "merge_pdfs", "thumbnail", "extract_markdown"])
            refs = [rnd.choice(names) for _ in range(rnd.choice([2, 3]) if kind == "merge_pdfs" else 1)]
            what = {"width": rnd.choice([0, 3, 5]), "pages": rnd.choice(["all", "first"])} if kind == "thumbnail" else {}
            ops.append({"name": f"op{k}", "inputs": refs, kind: what})
            names.append(f"op{k}")
        return {"job_id": str(i), "inputs": inputs, "operations": ops}
    docs = [doc(i) for i in range(400)]
    table = spark.createDataFrame(files, "bucket string, key string, content_type string, text string")
    table = table.withColumn("size_bytes", F.octet_length("text").cast("bigint"))
    sig = spark.createDataFrame(sigs, "sig_id long, sig_name string, pattern string")
    jobs = _jobs(spark, docs)
    want = sorted(((d["job_id"], *r) for d in docs for r in _brute(d, files, sigs, 5)), key=repr)
    assert sum(r[4] is False for r in want) > 20
    for j in (jobs, Jobs(jobs.inputs, jobs.ops, jobs.dests, jobs.tags)):
        run = W.run_jobs(j, table, sig, page_chars=5)
        got = sorted(((r.job_id, r.op_name, r.success, r.error, r.clean, r.detail, r.size_bytes, r.page_count, r.markdown,
                       None if r.thumbnail_pages is None else [tuple(p) for p in r.thumbnail_pages])
                      for r in run.results.collect()), key=repr)
        assert got == want
    pages = {(r.job_id, r.name, r.page_no, r.size_bytes) for r in run.artifact_pages.collect()}
    assert pages == {(w[0], w[1], *p) for w in want for p in w[9] or ()}


def test_plan_does_not_grow_with_operation_lists(spark):
    def plan(n):
        docs = [{"job_id": str(i), "inputs": [_inp("a", "a.txt")],
                 "operations": [{"name": f"p{i}-{k}", "inputs": ["a"], "convert_to_pdf": {}} for k in range(i % 7 + 1)]}
                for i in range(n)]
        run = W.run_jobs(_jobs(spark, docs), _files(spark), _sigs(spark))
        assert run.results.count() == sum(i % 7 + 1 for i in range(n))
        return len(run.results._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(3) - plan(2000)) < 200


def test_repeated_submissions_run_once(spark):
    op = {"name": "p", "inputs": ["a", "b"], "merge_pdfs": {}}
    docs = [{"job_id": str(i), "inputs": [_inp("a", "a.txt"), _inp("b", "z.txt")], "operations": [op]} for i in range(3)]
    once, twice = _jobs(spark, docs), _jobs(spark, docs * 2 + [{"operations": [op]}])
    flat = Jobs(*[x.unionByName(x) for x in (once.inputs, once.ops, once.dests, once.tags)])
    want = sorted(map(tuple, W.run_jobs(once, _files(spark), _sigs(spark)).results.collect()), key=repr)
    assert len(want) == 3
    for jobs in (twice, flat):
        run = W.run_jobs(jobs, _files(spark), _sigs(spark))
        assert sorted(map(tuple, run.results.collect()), key=repr) == want
        out = sorted(((o.job_id, o.status, o.error) for o in run.outcomes.collect()), key=repr)
        assert out[:3] == [(str(i), "completed", None) for i in range(3)]
        assert out[3:] == ([(None, "rejected", "JOB_ID_REQUIRED")] if jobs is twice else [])
    other = [{**docs[0], "operations": [{**op, "name": n}]} for n in ("z", "p")]
    run = W.run_jobs(_jobs(spark, other + other[::-1]), _files(spark), None)  # one id, two documents: the least counts
    assert [r.op_name for r in run.results.collect()] == ["p"]


def test_progress(spark):
    ev = spark.createDataFrame([("a", 1, "x", '{"k": 7}'), ("a", 5, "y", '{"k": 700}'), ("b", 2, "z", "no json"), ("b", 1, "w", None)],
                               "job_id string, seq long, step string, props string")
    reports = W.progress_reports(ev)
    assert sorted((r.job_id, r.seq, r.current, r.total) for r in reports.collect()) == [
        ("a", 1, 7, 100), ("a", 5, 100, 100), ("b", 1, 0, 100), ("b", 2, 0, 100)]
    assert sorted((r.job_id, r.step, r.last_seq) for r in W.latest_progress(reports).collect()) == [("a", "y", 5), ("b", "z", 2)]


def test_progress_of_the_jobs_themselves(spark):
    scan, pdf = {"name": "scan", "inputs": ["a"], "scan": {}}, {"name": "pdf", "inputs": ["a"], "convert_to_pdf": {}}
    docs = [{"job_id": "both", "inputs": [_inp("a", "a.txt"), _inp("z", "z.txt")], "operations": [scan, pdf]},
            {"job_id": "gated", "inputs": [_inp("a", "evil.txt")], "operations": [scan, pdf]},
            {"job_id": "lost", "inputs": [_inp("a", "a.txt"), _inp("z", "gone.txt")], "operations": [scan]},
            {"job_id": "bad", "inputs": [], "operations": [pdf]}]
    events = W.progress_events(W.run_jobs(_jobs(spark, docs), _files(spark), _sigs(spark)))
    assert sorted(tuple(e) for e in events.select("job_id", "seq", "step", "current", "total").collect()) == [
        ("both", 0, "downloading", 0, 2), ("both", 1, "downloading", 1, 2), ("both", 2, "downloading", 2, 2),
        ("both", 3, "scan", 1, 2), ("both", 4, "pdf", 2, 2),
        ("gated", 0, "downloading", 0, 1), ("gated", 1, "downloading", 1, 1), ("gated", 2, "scan", 1, 2),
        ("lost", 0, "downloading", 0, 2), ("lost", 1, "downloading", 1, 2)]
