import json
import os


from sheaf.sources.files import read_files
from sheaf.sources.jobs import explode_jobs, read_jobs
from sheaf.sources.sinks import write_artifacts, write_structure


def test_read_files_cap_keeps_rows(spark, tmp_path):
    d = tmp_path / "objs"
    d.mkdir()
    (d / "ten.bin").write_bytes(b"x" * 10)
    (d / "eleven.bin").write_bytes(b"y" * 11)
    df = read_files(spark, str(d), max_bytes=10)
    got = {os.path.basename(r.path): (r.size_bytes, r.error, r.content) for r in df.collect()}
    assert got == {"ten.bin": (10, None, bytearray(b"x" * 10)), "eleven.bin": (11, "TOO_LARGE", None)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and "PushedFilters" in plan


def test_read_jobs_set_vs_missing(spark, tmp_path):
    p = tmp_path / "jobs.json"
    docs = [{"job_id": "a", "inputs": [{"name": "in", "bucket": "b", "key": "k"}],
             "operations": [{"name": "s", "inputs": ["in"], "scan": {}},
                            {"name": "t", "inputs": ["in"], "thumbnail": {"width": 10, "pages": "all"}},
                            {"name": "x", "inputs": ["in"]},
                            {"name": "both", "inputs": ["in"], "extract_markdown": {}, "convert_to_pdf": {}}],
             "destinations": {"t": {"bucket": "o", "key": "t.png"}}, "tags": ["q"]}]
    p.write_text("\n".join(json.dumps(d) for d in docs))
    jobs = explode_jobs(read_jobs(spark, str(p)))
    ops = {r.op_name: (r.op_type, r.width, r.pages) for r in jobs.ops.collect()}
    # a set empty struct counts, a missing one does not; first type in order wins
    assert ops == {"s": ("scan", None, None), "t": ("thumbnail", 10, "all"), "x": (None, None, None),
                   "both": ("convert_to_pdf", None, None)}
    assert [(r.name, r.key) for r in jobs.dests.collect()] == [("t", "t.png")]
    assert [r.tags for r in jobs.tags.collect()] == [["q"]]


def test_write_artifacts_rerun_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "out")
    a = spark.createDataFrame([("b1", "k1", "x"), ("b2", "k2", "y")], "bucket string, key string, text string")
    write_artifacts(a, root)
    write_artifacts(a, root)  # a retried job writes the same files
    got = sorted(tuple(r) for r in spark.read.parquet(root).select("bucket", "key", "text").collect())
    assert got == [("b1", "k1", "x"), ("b2", "k2", "y")]
    # only the buckets present are replaced
    write_artifacts(spark.createDataFrame([("b1", "k9", "z")], "bucket string, key string, text string"), root)
    got = sorted(tuple(r) for r in spark.read.parquet(root).select("bucket", "key", "text").collect())
    assert got == [("b1", "k9", "z"), ("b2", "k2", "y")]


def test_write_structure(spark, tmp_path):
    p = str(tmp_path / "structure")
    df = spark.createDataFrame([(1, '{"texts":[]}'), (2, '{"texts":[{"text":"a"}]}')],
                               "id int, structure_json string")
    write_structure(df, p)
    assert sorted(r.value for r in spark.read.text(p).collect()) == ['{"texts":[]}', '{"texts":[{"text":"a"}]}']
    write_structure(df, p, id_col="id")
    got = spark.read.schema("id int, structure_json string").json(p).collect()
    assert sorted(tuple(r) for r in got) == [(1, '{"texts":[]}'), (2, '{"texts":[{"text":"a"}]}')]
