"""t1: the flagship and every registered query run on sf0.001 with a stable schema."""

import __spark_entry__ as entry

from conftest import SF001


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"job_id", "op_name", "success", "error"} <= set(df.columns)


def test_every_query_runs(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF001)
        assert df.count() >= 0, name
        for f in df.schema.fields if name in sql else ():  # flat where it is compared with a statement
            assert f.dataType.typeName() in (
                "string", "integer", "long", "boolean", "double", "timestamp", "timestamp_ntz"), (name, f)
