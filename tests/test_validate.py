
from pyspark.sql import functions as F

from sheaf.operators import validate as V
from sheaf.sources.jobs import explode_jobs, parse_jobs


def test_check_refs_rules_in_order(spark):
    df = spark.createDataFrame([
        ("a", "", "k"), ("b", "x", ""), ("c", "x", "a/../b"), ("d", "x", "ok.txt"),
        ("e", "nope", "ok.txt"), ("f", "", ""), ("g", None, None), ("h", "nope", "a..b")],
        "id string, bucket string, key string")
    got = dict((r.id, r.ref_error) for r in V.check_refs(df, allowed_buckets=["x"]).collect())
    assert got == {"a": "BUCKET_REQUIRED", "b": "KEY_REQUIRED", "c": "KEY_TRAVERSAL", "d": None,
                   "e": "BUCKET_NOT_ALLOWED", "f": "BUCKET_REQUIRED", "g": "BUCKET_REQUIRED",
                   "h": "BUCKET_NOT_ALLOWED"}
    # No list (or an empty one) allows every bucket.
    got = dict((r.id, r.ref_error) for r in V.check_refs(df, allowed_buckets=[]).collect())
    assert got["e"] is None and got["h"] == "KEY_TRAVERSAL"
    # An allow-list given as a table is joined.
    allowed = spark.createDataFrame([("x",)], "b string")
    got = dict((r.id, r.ref_error) for r in V.check_refs(df, allowed_buckets=allowed).collect())
    assert got["e"] == "BUCKET_NOT_ALLOWED" and got["d"] is None


def test_check_destinations_missing_is_fine(spark):
    df = spark.createDataFrame([("a", None), ("b", ("", "k", None)), ("c", ("o", "..", None)),
                                ("d", ("o", "k", "t"))],
                               "id string, destination struct<bucket:string,key:string,content_type:string>")
    got = dict((r.id, r.dest_error) for r in V.check_destinations(df).collect())
    assert got == {"a": None, "b": "BUCKET_REQUIRED", "c": "KEY_TRAVERSAL", "d": None}


def _job(job_id, inputs, ops, dests=None):
    import json
    return json.dumps({"job_id": job_id, "inputs": inputs, "operations": ops,
                       "destinations": dests or {}})


def _inp(name, bucket="b", key="k.txt"):
    return {"name": name, "bucket": bucket, "key": key, "content_type": "text/plain"}


def _op(name, inputs, typ="scan", **thumb):
    o = {"name": name, "inputs": inputs}
    o[typ] = thumb if typ == "thumbnail" else {}
    return o


def _check(spark, docs):
    df = spark.createDataFrame([(d,) for d in docs], "job_json string")
    return {r.job_id: r.error for r in V.check_pipelines(explode_jobs(parse_jobs(df))).collect()}


def test_check_pipelines_each_rule(spark):
    docs = [
        _job("ok", [_inp("a")], [_op("s", ["a"]), _op("c", ["s"], "convert_to_pdf")], {"c": {"bucket": "o", "key": "x"}}),
        _job("no_inputs", [], [_op("s", ["a"])]),
        _job("no_ops", [_inp("a")], []),
        _job("input_name", [_inp("")], [_op("s", [""])]),
        _job("dup_input", [_inp("a"), _inp("a")], [_op("s", ["a"])]),
        _job("traversal", [_inp("a", key="x/../y")], [_op("s", ["a"])]),
        _job("op_name", [_inp("a")], [_op("", ["a"])]),
        _job("op_is_input", [_inp("a")], [_op("a", ["a"])]),
        _job("dup_op", [_inp("a")], [_op("s", ["a"]), _op("s", ["a"])]),
        _job("no_type", [_inp("a")], [{"name": "s", "inputs": ["a"]}]),
        _job("self_ref", [_inp("a")], [_op("s", ["s"])]),
        _job("forward_ref", [_inp("a")], [_op("s", ["t"]), _op("t", ["a"])]),
        _job("empty_refs", [_inp("a")], [_op("s", [])]),
        _job("unknown_dest", [_inp("a")], [_op("s", ["a"])], {"zz": {"bucket": "o", "key": "x"}}),
        _job("dest_key", [_inp("a")], [_op("s", ["a"])], {"s": {"bucket": "o", "key": ""}}),
        _job("dest_input", [_inp("a")], [_op("s", ["a"])], {"a": {"bucket": "o", "key": "copy"}}),
    ]
    assert _check(spark, docs) == {
        "ok": None, "no_inputs": "NO_INPUTS", "no_ops": "NO_OPERATIONS",
        "input_name": "INPUT_NAME_REQUIRED", "dup_input": "DUPLICATE_INPUT", "traversal": "KEY_TRAVERSAL",
        "op_name": "OP_NAME_REQUIRED", "op_is_input": "OP_NAME_IS_INPUT", "dup_op": "DUPLICATE_OP",
        "no_type": "OP_TYPE_MISSING", "self_ref": "UNKNOWN_REF", "forward_ref": "UNKNOWN_REF",
        "empty_refs": "OP_INPUTS_REQUIRED", "unknown_dest": "UNKNOWN_DEST", "dest_key": "KEY_REQUIRED",
        "dest_input": None}


def test_check_pipelines_first_error_wins(spark):
    docs = [
        # input stage before op stage
        _job("p1", [_inp("a", bucket="")], [_op("", ["a"])]),
        # earlier input before later input
        _job("p2", [_inp("a", key=""), _inp("a")], [_op("s", ["a"])]),
        # op 0 error before op 1 error
        _job("p3", [_inp("a")], [{"name": "s", "inputs": ["a"]}, _op("s", ["a"])]),
        # within one op: name conflict before missing type
        _job("p4", [_inp("a")], [{"name": "a", "inputs": ["zz"]}]),
        # ops before destinations; destinations by name
        _job("p5", [_inp("a")], [_op("s", ["q"])], {"zz": {"bucket": "", "key": ""}}),
        _job("p6", [_inp("a")], [_op("s", ["a"])], {"b": {"bucket": "", "key": "k"}, "a": {"bucket": "o", "key": ".."}}),
        # empty inputs before empty operations
        _job("p7", [], []),
    ]
    assert _check(spark, docs) == {
        "p1": "BUCKET_REQUIRED", "p2": "KEY_REQUIRED", "p3": "OP_TYPE_MISSING", "p4": "OP_NAME_IS_INPUT",
        "p5": "UNKNOWN_REF", "p6": "KEY_TRAVERSAL", "p7": "NO_INPUTS"}


def test_check_requests(spark):
    conv = spark.createDataFrame([("1", "b", "k", ""), ("2", "b", "k", "text/plain"), ("3", "", "k", "")],
                                 "request_id string, bucket string, key string, content_type string")
    got = {r.request_id: r.error for r in V.check_convert_requests(conv).collect()}
    assert got == {"1": "CONTENT_TYPE_REQUIRED", "2": None, "3": "BUCKET_REQUIRED"}
    reqs = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "request_id string")
    members = spark.createDataFrame([("m1", 1, "b", "x"), ("m3", 2, "b", "..."), ("m3", 1, "b", "ok")],
                                    "request_id string, position int, bucket string, key string")
    got = {r.request_id: (r.error, r.n_files) for r in V.check_merge_requests(reqs, members).collect()}
    assert got == {"m1": (None, 1), "m2": ("FILES_REQUIRED", 0), "m3": ("KEY_TRAVERSAL", 2)}
    jobs = spark.createDataFrame([("1", ""), ("2", "j"), ("3", None)], "request_id string, job_id string")
    got = {r.request_id: r.error for r in V.check_job_requests(jobs).collect()}
    assert got == {"1": "JOB_ID_REQUIRED", "2": None, "3": "JOB_ID_REQUIRED"}


def test_check_urls(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/x"), (2, "HTTPS://b.example.com:8443/"),
                                (3, "ftp://c.example.com"), (4, "http:///path"), (5, "not a url"),
                                (6, "https://user:pw@d.example.com?q=1")], "id int, url string")
    got = {r.id: (r.scheme, r.host, r.url_error) for r in V.check_urls(df).collect()}
    assert got == {1: ("http", "a.example.com", None), 2: ("https", "b.example.com:8443", None),
                   3: ("ftp", "c.example.com", "URL_SCHEME"), 4: ("http", "", "URL_HOST"),
                   5: ("", "", "URL_SCHEME"), 6: ("https", "d.example.com", None)}
    hosts = {r.host: (r.n_urls, r.n_bad) for r in V.url_hosts(V.check_urls(df)).collect()}
    assert hosts["a.example.com"] == (1, 0) and hosts[""] == (2, 2)
    bad = ["http://exa mple.com/", "http://[::1", "http://h:port/x", "http://h/%zz", "http://h/a%4", "http://h/\n",
           ":x", "1a:b", "http://a]b/"]
    good = ["http://[::1]:80/", "http://h:/x", "http://h/a b", "http://h/?q=%zz", "https://ü.example/%C3%BC"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.url_error for r in V.check_urls(df).collect()}
    assert got == {**dict.fromkeys(bad, "URL_INVALID"), **dict.fromkeys(good)}


def test_requests_of_every_kind(spark):
    rows = [(k, b, ("o", key) if key is not None else None) for k in ("scan", "convert", "thumbnail", "markdown")
            for b, key in (("b", None), ("b", "k"), ("b", ""), ("x", "k"))]
    df = spark.createDataFrame([(k, b, "k", "t", d) for k, b, d in rows],
                               "kind string, bucket string, key string, content_type string, "
                               "destination struct<bucket:string,key:string>")
    got = [r.error for r in V.check_file_requests(df, F.col("kind"), ["b", "o"]).collect()]
    assert got[:4] == [None, None, None, "BUCKET_NOT_ALLOWED"]
    assert got[4:] == [None, None, "KEY_REQUIRED", "BUCKET_NOT_ALLOWED"] * 3
    reqs = spark.createDataFrame([("1", ("o", "k")), ("2", ("p", "k")), ("3", ("p", "k"))],
                                 "request_id string, destination struct<bucket:string,key:string>")
    members = spark.createDataFrame([("1", 0, "b", "x"), ("2", 0, "b", "x"), ("3", 0, "q", "x")],
                                    "request_id string, position int, bucket string, key string")
    got = {r.request_id: r.error for r in V.check_merge_requests(reqs, members, allowed_buckets=["b", "o"]).collect()}
    assert got == {"1": None, "2": "BUCKET_NOT_ALLOWED", "3": "BUCKET_NOT_ALLOWED"}


def test_empty_allow_list_table_allows_all(spark):
    df = spark.createDataFrame([("b", "k")], "bucket string, key string")
    none = spark.createDataFrame([], "b string")
    assert [r.ref_error for r in V.check_refs(df, allowed_buckets=none).collect()] == [
        r.ref_error for r in V.check_refs(df, allowed_buckets=[]).collect()]
