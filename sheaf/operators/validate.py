"""Reference, destination, pipeline, request and URL checks.

Every check adds an error column (NULL = fine) and keeps every row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import blank, ref_error
from ..sources.jobs import Jobs, op_type

# Pipeline error codes, in the order of the checks.
NO_INPUTS = "NO_INPUTS"
NO_OPERATIONS = "NO_OPERATIONS"
INPUT_NAME_REQUIRED = "INPUT_NAME_REQUIRED"
DUPLICATE_INPUT = "DUPLICATE_INPUT"
OP_NAME_REQUIRED = "OP_NAME_REQUIRED"
OP_NAME_IS_INPUT = "OP_NAME_IS_INPUT"
DUPLICATE_OP = "DUPLICATE_OP"
OP_TYPE_MISSING = "OP_TYPE_MISSING"
UNKNOWN_REF = "UNKNOWN_REF"
OP_INPUTS_REQUIRED = "OP_INPUTS_REQUIRED"
UNKNOWN_DEST = "UNKNOWN_DEST"

CONTENT_TYPE_REQUIRED = "CONTENT_TYPE_REQUIRED"
FILES_REQUIRED = "FILES_REQUIRED"
JOB_ID_REQUIRED = "JOB_ID_REQUIRED"
URL_INVALID = "URL_INVALID"
URL_SCHEME = "URL_SCHEME"
URL_HOST = "URL_HOST"


def _allowed_flag(df: DataFrame, bucket_col: str, allowed) -> tuple[DataFrame, Column | None]:
    """Attach a boolean ``__allowed`` column for the allow-list, if any."""
    if allowed is None:
        return df, None
    if isinstance(allowed, DataFrame):
        if allowed.isEmpty():
            return df, None  # as the empty list
        names = (allowed.select(F.col(allowed.columns[0]).alias("__b")).distinct()
                 .withColumn("__ok", F.lit(True)))
        out = (df.join(names, F.col(bucket_col) == F.col("__b"), "left")
               .drop("__b").withColumnRenamed("__ok", "__allowed"))
        return out, F.col("__allowed")
    allowed = list(allowed)
    if len(allowed) == 0:
        return df, None  # empty list = allow all
    return df.withColumn("__allowed", F.col(bucket_col).isin(allowed)), F.col("__allowed")


def check_refs(df: DataFrame, bucket_col: str = "bucket", key_col: str = "key",
               allowed_buckets: Iterable[str] | DataFrame | None = None,
               out: str = "ref_error") -> DataFrame:
    """B1: bucket required, on the allow-list, key required, no '..'."""
    df2, flag = _allowed_flag(df, bucket_col, allowed_buckets)
    res = df2.withColumn(out, ref_error(F.col(bucket_col), F.col(key_col), flag))
    return res.drop("__allowed") if flag is not None else res


def check_destinations(df: DataFrame, dest_col: str = "destination",
                       allowed_buckets=None, out: str = "dest_error") -> DataFrame:
    """B2: a missing destination is fine; otherwise the rules of B1."""
    b, k = f"{dest_col}.bucket", f"{dest_col}.key"
    df2 = df.withColumn("__db", F.col(b)).withColumn("__dk", F.col(k))
    df2 = check_refs(df2, "__db", "__dk", allowed_buckets, "__de")
    return (df2.withColumn(out, F.when(F.col(dest_col).isNotNull(), F.col("__de")))
            .drop("__db", "__dk", "__de"))


def check_pipelines(jobs: Jobs, allowed_buckets=None) -> DataFrame:
    """First structural error of each job, in reading order.

    Returns job_id, error, stage, item (input/op index or destination name).
    Every rule emits candidate rows ranked (stage, index, destination name,
    rule); the first error of a job is the minimum of its candidates, one
    partial aggregate. Name lookups go through one aggregate per (job, name):
    the first input position and the first position a name is known at
    (-1 for inputs). No window or collected list holds a whole job.
    """
    inputs, ops, dests = jobs.inputs, jobs.ops, jobs.dests

    def cand(df, stage, idx, dname, rule, code):
        return df.select("job_id", F.struct(F.lit(stage).alias("stage"), idx.cast("int").alias("idx"),
                                            dname.alias("dname"), F.lit(rule).alias("rule"),
                                            code.alias("code")).alias("e"))

    # (job, name): where a name is first known (inputs at -1) and first input index
    known = (inputs.select("job_id", "name", F.lit(-1).alias("k"), F.col("input_index").alias("fi"))
             .unionByName(ops.select("job_id", F.col("op_name").alias("name"), F.col("op_index").alias("k"),
                                     F.lit(None).cast("int").alias("fi")))
             .groupBy("job_id", "name").agg(F.min("k").alias("known_at"), F.min("fi").alias("first_in")))

    # Stage 3: inputs in order.
    inp = inputs.join(known, ["job_id", "name"], "left")
    inp, allowed = _allowed_flag(inp, "bucket", allowed_buckets)
    in_code = F.coalesce(
        F.when(blank(F.col("name")), F.lit(INPUT_NAME_REQUIRED)),
        F.when(F.col("input_index") > F.col("first_in"), F.lit(DUPLICATE_INPUT)),
        ref_error(F.col("bucket"), F.col("key"), allowed))
    c_in = cand(inp, 3, F.col("input_index"), F.lit(""), 0, in_code)

    # Stage 4: operations in order; rule ranks keep the per-op check order.
    o = ops.join(known.withColumnRenamed("name", "op_name"), ["job_id", "op_name"], "left")
    head = F.coalesce(
        F.when(blank(F.col("op_name")), F.lit(OP_NAME_REQUIRED)),
        F.when(F.col("known_at") == -1, F.lit(OP_NAME_IS_INPUT)),
        F.when(F.col("op_index") > F.col("known_at"), F.lit(DUPLICATE_OP)),
        F.when(F.col("op_type").isNull(), F.lit(OP_TYPE_MISSING)))
    c_op = cand(o, 4, F.col("op_index"), F.lit(""), 1, head)
    c_empty = cand(ops.filter(F.size("inputs") == 0), 4, F.col("op_index"), F.lit(""), 3,
                   F.lit(OP_INPUTS_REQUIRED))
    # A reference must name an input or an earlier operation.
    refs = (ops.select("job_id", "op_index", F.explode("inputs").alias("name"))
            .join(known.select("job_id", "name", "known_at"), ["job_id", "name"], "left")
            .filter(F.col("known_at").isNull() | (F.col("known_at") >= F.col("op_index"))))
    c_ref = cand(refs, 4, F.col("op_index"), F.lit(""), 2, F.lit(UNKNOWN_REF))

    # Stage 5: destinations by name.
    d = dests.join(known.select("job_id", "name", "known_at"), ["job_id", "name"], "left")
    d, dallowed = _allowed_flag(d, "bucket", allowed_buckets)
    d_code = F.coalesce(F.when(F.col("known_at").isNull(), F.lit(UNKNOWN_DEST)),
                        ref_error(F.col("bucket"), F.col("key"), dallowed))
    c_dest = cand(d, 5, F.lit(0), F.col("name"), 0, d_code)

    first = (c_in.unionByName(c_op).unionByName(c_empty).unionByName(c_ref).unionByName(c_dest)
             .filter(F.col("e.code").isNotNull())
             .groupBy("job_id").agg(F.min("e").alias("e")))

    # Stages 1-2 and the list of jobs, from one aggregate.
    flags = (jobs.tags.select("job_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
             .unionByName(inputs.select("job_id", F.lit(1).alias("i"), F.lit(0).alias("o")))
             .unionByName(ops.select("job_id", F.lit(0).alias("i"), F.lit(1).alias("o")))
             .unionByName(dests.select("job_id", F.lit(0).alias("i"), F.lit(0).alias("o")))
             .groupBy("job_id").agg(F.max("i").alias("has_in"), F.max("o").alias("has_ops")))
    stage = (F.when(F.col("has_in") == 0, F.lit(1)).when(F.col("has_ops") == 0, F.lit(2))
             .otherwise(F.col("e.stage")))
    return (flags.join(first, "job_id", "left")
            .select("job_id",
                    F.when(F.col("has_in") == 0, F.lit(NO_INPUTS))
                     .when(F.col("has_ops") == 0, F.lit(NO_OPERATIONS))
                     .otherwise(F.col("e.code")).alias("error"),
                    stage.alias("stage"),
                    F.when(stage == 5, F.col("e.dname"))
                     .when(stage.isin(3, 4), F.col("e.idx").cast("string")).alias("item")))


def check_documents(docs: DataFrame, allowed_buckets: Iterable[str] | None = None) -> DataFrame:
    """B3 on nested job documents: the documents with error, stage and item (as ``check_pipelines``).

    A document is checked inside its row, without a shuffle. For flat tables, or
    an allow-list that is a table, use ``check_pipelines``.
    """
    allow = list(allowed_buckets) if allowed_buckets is not None else []

    def ref(r):
        return ref_error(r["bucket"], r["key"], r["bucket"].isin(allow) if allow else None)

    def err(stage, idx, dname, code):
        return F.struct(F.lit(stage).alias("stage"), idx.cast("int").alias("idx"), dname.alias("dname"),
                        code.alias("code"))

    def listed(names, x):
        return F.coalesce(F.array_contains(names, x), F.lit(False))

    def first_at(names, x):
        return F.coalesce(F.array_position(names, x), F.lit(0)) - 1  # -1: nowhere

    ins = F.coalesce(F.col("inputs"), F.array().cast(docs.schema["inputs"].dataType))
    ops = F.coalesce(F.col("operations"), F.array().cast(docs.schema["operations"].dataType))
    in_names, op_names = F.transform(ins, lambda x: x["name"]), F.transform(ops, lambda x: x["name"])
    no_name = F.lit(None).cast("string")
    e_in = F.transform(ins, lambda x, i: err(3, i, no_name, F.coalesce(
        F.when(blank(x["name"]), F.lit(INPUT_NAME_REQUIRED)),
        F.when(first_at(in_names, x["name"]) < i, F.lit(DUPLICATE_INPUT)),
        ref(x))))

    def unknown(name, i):
        at = first_at(op_names, name)
        return ~(listed(in_names, name) | ((at >= 0) & (at < i)))

    e_op = F.transform(ops, lambda o, i: err(4, i, no_name, F.coalesce(
        F.when(blank(o["name"]), F.lit(OP_NAME_REQUIRED)),
        F.when(listed(in_names, o["name"]), F.lit(OP_NAME_IS_INPUT)),
        F.when(first_at(op_names, o["name"]) < i, F.lit(DUPLICATE_OP)),
        F.when(op_type(o).isNull(), F.lit(OP_TYPE_MISSING)),
        F.when(F.exists(o["inputs"], lambda r: unknown(r, i)), F.lit(UNKNOWN_REF)),
        F.when(F.coalesce(F.size(o["inputs"]), F.lit(0)) <= 0, F.lit(OP_INPUTS_REQUIRED)))))
    dests = F.coalesce(F.array_sort(F.map_entries("destinations")),
                       F.array().cast(f"array<struct<key:string,value:{_type(docs, 'destinations')}>>"))
    e_dest = F.transform(dests, lambda d: err(5, F.lit(0), d["key"], F.coalesce(
        F.when(~(listed(in_names, d["key"]) | listed(op_names, d["key"])), F.lit(UNKNOWN_DEST)),
        ref(d["value"]))))
    first = F.get(F.filter(F.concat(e_in, e_op, e_dest), lambda e: e["code"].isNotNull()), F.lit(0))
    stage = F.when(F.size(ins) == 0, F.lit(1)).when(F.size(ops) == 0, F.lit(2)).otherwise(first["stage"])
    return docs.select(
        *docs.columns,
        F.when(stage == 1, F.lit(NO_INPUTS)).when(stage == 2, F.lit(NO_OPERATIONS))
         .otherwise(first["code"]).alias("error"),
        stage.alias("stage"),
        F.when(stage == 5, first["dname"]).when(stage.isin(3, 4), first["idx"].cast("string")).alias("item"))


def _type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.valueType.simpleString()


def check_file_requests(df: DataFrame, kind: Column | str, allowed_buckets=None) -> DataFrame:
    """B4 (scan, convert, thumbnail, markdown): source ref, content type (convert), then destination.

    ``kind``: the request's kind, one for all or a column. A ``destination`` column
    (struct, null: none) is checked for every kind but scan, which has none.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    out = check_refs(df, "bucket", "key", allowed_buckets, "__re").withColumn("__k", kind)
    rules = [F.col("__re")]
    if "content_type" in df.columns:
        rules.append(F.when((F.col("__k") == "convert") & blank(F.col("content_type")), F.lit(CONTENT_TYPE_REQUIRED)))
    if "destination" in df.columns:
        out = check_destinations(out, "destination", allowed_buckets, "__dest")
        rules.append(F.when(F.col("__k") != "scan", F.col("__dest")))
    return out.withColumn("error", F.coalesce(*rules)).drop("__re", "__k", "__dest")


def check_convert_requests(df: DataFrame, allowed_buckets=None) -> DataFrame:
    """B4 (convert): ``check_file_requests`` of one kind."""
    return check_file_requests(df, "convert", allowed_buckets)


def check_merge_requests(requests: DataFrame, members: DataFrame,
                         request_col: str = "request_id", allowed_buckets=None) -> DataFrame:
    """B4 (merge): at least one file per request, then each member's ref, then the
    request's ``destination`` if it has such a column.

    Members are counted and their first error found in one partial aggregate (so a
    huge merge is fine), joined back to the requests.
    """
    checked = check_refs(members, "bucket", "key", allowed_buckets, "__re")
    per_req = checked.groupBy(request_col).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min(F.when(F.col("__re").isNotNull(), F.struct("position", "__re"))).alias("__bad"))
    out = requests.join(per_req, request_col, "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(0)).cast("bigint"))
    rules = [F.when(F.col("n_files") == 0, F.lit(FILES_REQUIRED)), F.col("__bad.__re")]
    if "destination" in requests.columns:
        out = check_destinations(out, "destination", allowed_buckets, "__dest")
        rules.append(F.col("__dest"))
    return out.withColumn("error", F.coalesce(*rules)).drop("__bad", "__dest")


def check_job_requests(df: DataFrame, id_col: str = "job_id") -> DataFrame:
    """B4 (job lookup / cancel): the id is required."""
    return df.withColumn("error", F.when(blank(F.col(id_col)), F.lit(JOB_ID_REQUIRED)))


# Scheme and authority of a URL; the host drops user info and keeps the port,
# like a parsed URL's Host field.
URL_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
URL_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#]*)"
# What does not parse: control characters, a bad escape in the path, a scheme that
# is none, characters a host may not have, an unclosed bracket, a port that is no number.
URL_CONTROL_RE = r"[\x00-\x1f\x7f]"
URL_ESCAPE_RE = r"^[^?#]*%(?![0-9A-Fa-f]{2})"
URL_NO_SCHEME_RE = r"^(?::|[^A-Za-z/?#:][^/?#:]*:|[A-Za-z][^/?#:]*[^A-Za-z0-9+.\-/?#:][^/?#:]*:)"
URL_HOST_OK_RE = r"^(?:\[[0-9A-Fa-f:.%A-Za-z_~\-]*\]|[^\x00-\x20\[\]:<>\\^`{|}\x7f/?#]*)(?::[0-9]*)?$"


def check_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The URL parses, its scheme is http/https (any case), its host is not empty. A null URL is empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    scheme = F.lower(F.regexp_extract(url, URL_SCHEME_RE, 1))
    host = F.regexp_extract(url, URL_HOST_RE, 1)
    bad = (url.rlike(URL_CONTROL_RE) | url.rlike(URL_ESCAPE_RE) | url.rlike(URL_NO_SCHEME_RE)
           | ~host.rlike(URL_HOST_OK_RE))
    return (df.withColumn("scheme", scheme).withColumn("host", host)
            .withColumn("url_error", F.coalesce(
                F.when(bad, F.lit(URL_INVALID)),
                F.when(~F.col("scheme").isin("http", "https"), F.lit(URL_SCHEME)),
                F.when(F.col("host") == "", F.lit(URL_HOST)))))


def url_hosts(checked: DataFrame) -> DataFrame:
    """Per-host page counts and failures (partial aggregation)."""
    return (checked.groupBy("host")
            .agg(F.count(F.lit(1)).alias("n_urls"),
                 F.count_if(F.col("url_error").isNotNull()).alias("n_bad"),
                 F.count_if(F.col("scheme") == "https").alias("n_https")))
