import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.session import scratch_dir
from sheaf.sources import objects as O


def local(path):
    return path.replace("file:", "")


def report(df):
    return sorted((tuple(r) for r in df.select("bucket", "key", "size_bytes", "error").collect()), key=repr)


def test_objects_lie_at_bucket_and_key_and_a_bad_one_fails_alone(spark):
    root = scratch_dir(spark, "objects")
    rows = [("b", "x/y.txt", "one"), ("b", "z é.txt", "zwei"), ("c", "x/y.txt", ""), ("b", "n", None), ("b", "../up", "q"),
            ("b", "", "q"), (None, "k", "q"), ("b", None, "q"), ("b/c", "k", "q"), ("b", "x//y", "q"),
            ("d", "same", "s"), ("d", "same", "s"), ("d", "two", "t1"), ("d", "two", "t2"), ("d", "two", None)]
    df = spark.createDataFrame(rows, "bucket string, key string, content string").withColumn("size_bytes", F.lit("clash"))
    got = report(O.put_objects(df.repartition(3), root))
    bad = [("b", "n", None, O.NO_CONTENT), ("d", "two", None, O.NO_CONTENT), ("d", "two", None, O.DUPLICATE_KEY)]
    bad += [(b, k, None, O.BAD_KEY) for b, k, _ in rows[4:10]]
    good = [("b", "x/y.txt", 3, None), ("b", "z é.txt", 4, None), ("c", "x/y.txt", 0, None), ("d", "same", 1, None),
            ("d", "same", 1, None), ("d", "two", 2, None)]
    assert got == sorted(good + bad, key=repr)
    with open(f"{local(root)}/b/z é.txt", encoding="utf-8") as f:
        assert f.read() == "zwei"
    keys = spark.createDataFrame([("b", "x/y.txt"), ("c", "x/y.txt"), ("b", "none"), ("b", None), ("b", "../b/x/y.txt")], "bucket string, key string")
    back = {(r["bucket"], r["key"]): (r["content"], r["error"]) for r in O.get_objects(spark, root, keys).collect()}
    assert back == {("b", "x/y.txt"): (b"one", None), ("c", "x/y.txt"): (b"", None), ("b", "none"): (None, "NOT_FOUND"),
                    ("b", None): (None, "NOT_FOUND"), ("b", "../b/x/y.txt"): (None, "NOT_FOUND")}
    assert [r["error"] for r in O.get_objects(spark, root, keys.limit(1), max_bytes=2).collect()] == ["TOO_LARGE"]
    assert not os.listdir(f"{local(root)}/_writing")


def test_file_system_errors_are_rows_and_objects_are_replaced(spark):
    root = scratch_dir(spark, "objects")
    one = spark.createDataFrame([("b", "a", "old")], "bucket string, key string, content string")
    assert report(O.put_objects(one, root)) == [("b", "a", 3, None)]
    more = spark.createDataFrame([("b", "a", "newer"), ("b", "a/under", "x"), ("b", "ok", "y")], "bucket string, key string, content string")
    assert report(O.put_objects(more, root)) == [("b", "a", 5, None), ("b", "a/under", None, O.WRITE_FAILED), ("b", "ok", 1, None)]
    with open(f"{local(root)}/b/a") as f:
        assert f.read() == "newer"
    assert report(O.put_objects(more.limit(0), root)) == []


def test_a_failed_write_reports_nothing(spark):
    root, done = scratch_dir(spark, "objects"), scratch_dir(spark, "report")
    rows = spark.range(20).select(F.lit("b").alias("bucket"), F.col("id").cast("string").alias("key"),
                                  F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    spark.dataSource.register(O.ObjectDataSource)
    try:
        rows.repartition(4, "key").write.format("objects").option("root", root).option("report", done).mode("append").save()
        raise AssertionError("the write should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    left = [f for f in os.listdir(local(done))] if os.path.exists(local(done)) else []
    assert not [f for f in left if f.endswith(".parquet") or f == "_SUCCESS"]


def test_ranges_join_to_the_objects(spark):
    root = scratch_dir(spark, "big")
    os.makedirs(local(root))
    data = {"a.bin": os.urandom(10_007), "empty.bin": b"", "b.bin": b"x" * 4096}
    for name, content in data.items():
        with open(f"{local(root)}/{name}", "wb") as f:
            f.write(content)
    listed = O.list_objects(spark, root)
    assert {r['path'].rsplit('/', 1)[1] for r in listed.collect()} == {'a.bin', 'b.bin'}  # an empty file has no range
    for size in (1000, 4096, 1 << 20):
        rows = O.read_ranges(listed, size).collect()
        assert max(len(r["content"]) for r in rows) <= size
        for name, content in data.items():
            mine = sorted((r["offset"], r["content"]) for r in rows if r["path"].endswith("/" + name))
            assert b"".join(c for _, c in mine) == content


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n é", max_size=30), min_size=1, max_size=6), st.integers(1, 17))
def test_lines_are_whole_whatever_the_range(spark, texts, size):
    root = scratch_dir(spark, "lines")
    os.makedirs(local(root))
    want = []
    for i, text in enumerate(texts):
        raw = text.encode()
        with open(f"{local(root)}/{i}.txt", "wb") as f:
            f.write(raw)
        at = 0
        for line in raw.split(b"\n")[:None if not raw.endswith(b"\n") and raw else -1]:
            want.append((i, at, line.decode()))
            at += len(line) + 1
    rows = O.read_lines(O.list_objects(spark, root), size).collect()
    assert sorted((int(r["path"].rsplit("/", 1)[1][:-4]), r["offset"], r["line"]) for r in rows) == sorted(want)
