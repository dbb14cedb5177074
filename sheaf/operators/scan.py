"""Scanner verdicts, signature scans over a corpus, disabled scanner, gate.

A signature scan is one linear pass over the texts for each block of signatures
(``BLOCK_CHARS`` of patterns, so of bounded memory), by an Aho-Corasick
automaton that is broadcast as its patterns and built once a task. Texts stay
where they are read: nothing is shuffled, whatever the texts or patterns are.

A pattern that ends another one matches wherever that one does, so a run of one
character would give all of a block's patterns at each place. Patterns are
therefore put in layers by how many others end them: a place gives one match a
layer at most. The middle layer is tried first. What is found there settles all
patterns that end it, what is not found settles all that it ends, and the layers
on both sides go on alike; most sets have one layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..session import ship, stored

# Scanner replies and messages.
CLEAN_REPLY = "stream: OK"
FOUND_PREFIX = "stream: "
FOUND_SUFFIX = " FOUND"
UNEXPECTED = "unexpected scan response: "
DISABLED_DETAIL = "scanning disabled: no antivirus configured"

# Whitespace as trimmed by the reference (Unicode White_Space, incl. NEL).
_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
# A run is tried from its start only, so that long runs inside a reply stay linear.
TRIM_WS = [(rf"^{_WS}++", ""), (rf"(?<!{_WS}){_WS}++\z", "")]
TRIM_NUL = (r"(?<!\x00)\x00++\z", "")

BLOCK_CHARS = 1 << 20  # characters of patterns in a block: about 60 MB of automaton in a task


def normalize_reply(col: Column) -> Column:
    for pat, rep in TRIM_WS:
        col = F.regexp_replace(col, pat, rep)
    return F.regexp_replace(col, *TRIM_NUL)


def classify_scan_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """reply line -> (clean, detail).

    Exactly 'stream: OK' -> clean; 'stream: X FOUND' -> threat X (prefix removed,
    then suffix, in two steps); anything else -> not clean, 'unexpected ...'.
    """
    r = normalize_reply(F.coalesce(F.col(col), F.lit("")))
    d = (df.withColumn("__r", r)
         .withColumn("__d1", F.expr(f"substring(__r, {len(FOUND_PREFIX) + 1})")))
    found = F.col("__r").startswith(FOUND_PREFIX) & F.col("__r").endswith(FOUND_SUFFIX)
    strip = F.when(F.col("__d1").endswith(FOUND_SUFFIX),
                   F.expr(f"substring(__d1, 1, length(__d1) - {len(FOUND_SUFFIX)})")).otherwise(F.col("__d1"))
    return (d.withColumn("clean", F.col("__r") == CLEAN_REPLY)
            .withColumn("detail", F.when(F.col("clean"), F.lit(None).cast("string"))
                        .when(found, strip)
                        .otherwise(F.concat(F.lit(UNEXPECTED), F.col("__r"))))
            .drop("__r", "__d1"))


def threat_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("clean", "detail").agg(F.count(F.lit(1)).alias("n_files"))


def layers(patterns: list[str]) -> tuple[list[list[int]], list[int]]:
    """Numbers of the (different) patterns by layer, and of each the longest other pattern that ends it (or -1).

    A pattern's layer is the number of patterns that end it, so none of a layer ends another of it.
    """
    backwards = sorted((p[::-1], i) for i, p in enumerate(patterns))
    ends, depth, chain = [-1] * len(patterns), [0] * len(patterns), []
    for word, i in backwards:
        while chain and not word.startswith(chain[-1][0]):
            chain.pop()
        ends[i], depth[i] = (chain[-1][1] if chain else -1), len(chain)
        chain.append((word, i))
    out: list[list[int]] = [[] for _ in range(max(depth, default=-1) + 1)]
    for i, d in enumerate(depth):
        out[d].append(i)
    return out, ends


class Matcher:
    """Which of some patterns a text holds."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        groups, self.ends = layers(patterns)
        self.layer, self.longer, self.layers = {}, {}, []
        for i, e in enumerate(self.ends):
            if e >= 0:
                self.longer.setdefault(e, []).append(i)
        for d, group in enumerate(groups):
            automaton = ahocorasick.Automaton()
            for i in group:
                automaton.add_word(patterns[i], i)
                self.layer[i] = d
            automaton.make_automaton()
            self.layers.append((automaton, len(group), [i for i in group if i in self.longer]))

    def __call__(self, text: str) -> set[int]:
        found: set[int] = set()
        absent: set[int] = set()
        settled = [0] * len(self.layers)
        todo = [(0, len(self.layers))]
        while todo:
            low, high = todo.pop()
            if low >= high:
                continue
            at = (low + high) // 2
            automaton, size, ending = self.layers[at]
            if settled[at] < size:
                for _, i in automaton.iter(text):
                    if i not in found:
                        while i >= 0 and i not in found:
                            found.add(i)
                            settled[self.layer[i]] += 1
                            i = self.ends[i]
                        if settled[at] == size:
                            break
                gone = [j for i in ending if i not in found for j in self.longer[i]]
                while gone:
                    i = gone.pop()
                    if i not in absent:
                        absent.add(i)
                        settled[self.layer[i]] += 1
                        gone += self.longer.get(i, ())
            todo += [(low, at), (at + 1, high)]
        return found


def _block_hits(files: DataFrame, ids: list[str], block: list, sig_type: DataType, sig_id_col: str) -> DataFrame:
    """(ids, signature) of the texts that hold a signature of the block (rows: id, pattern)."""
    by_pattern: dict[str, list] = {}
    for sig, pattern in block:
        by_pattern.setdefault(pattern, []).append(sig)
    shared = files.sparkSession.sparkContext.broadcast((list(by_pattern), list(by_pattern.values())))
    types = {f.name: f.dataType.simpleString() for f in files.schema}
    arrow_type = to_arrow_type(sig_type)
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, sigs = shared.value
        match = Matcher(patterns)
        for batch in batches:
            row, hit = [], []
            for at, text in enumerate(batch.column("__text")):
                for i in match(text.as_py()):
                    row += [at] * len(sigs[i])
                    hit += sigs[i]
            if row:
                taken = [batch.column(c).take(pa.array(row)) for c in ids]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(hit, arrow_type)], [*ids, sig_id_col])

    return files.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in ids], f"`{sig_id_col}` {sig_type.simpleString()}"]))


def scan_hits(files: DataFrame, signatures: DataFrame, id_col: str | list[str] = "file_id",
              text_col: str = "text", sig_id_col: str = "sig_id", pattern_col: str = "pattern") -> DataFrame:
    """(file, signature) pairs where the file's text contains the pattern.

    ``id_col``: one column or a list of columns identifying a file; rows of one file are scanned one by
    one. Null and empty patterns match nothing, null texts hold nothing. Signatures reach the driver a
    block at a time; with several blocks, each block's hits are written before the next is fetched.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    texts = files.select(*ids, F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    sigs = signatures.select(F.col(sig_id_col).alias("id"), F.col(pattern_col).alias("pattern")).filter(
        F.length("pattern") > 0).distinct()
    sig_type = sigs.schema["id"].dataType
    size = sigs.agg(F.sum(F.length("pattern"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    if blocks <= 1:
        return _block_hits(texts, ids, [tuple(r) for r in sigs.collect()] if blocks else [], sig_type, sig_id_col)
    dealt = stored(sigs.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))), "signatures")
    hits = None
    for k in range(blocks):
        rows = [tuple(r) for r in dealt.where(F.col("block") == k).select("id", "pattern").collect()]
        if rows:
            here = stored(_block_hits(texts, ids, rows, sig_type, sig_id_col), "hits")
            hits = here if hits is None else hits.unionByName(here)
    return hits


def scan_corpus(files: DataFrame, signatures: DataFrame, id_col: str = "file_id",
                text_col: str = "text", sig_id_col: str = "sig_id", pattern_col: str = "pattern",
                name_col: str = "sig_name") -> DataFrame:
    """one verdict per file: clean, detail = name of the lowest matching id.

    ``signatures=None`` is the disabled scanner (F3).
    """
    if signatures is None:
        return scan_disabled(files, id_col)
    hits = scan_hits(files, signatures, id_col, text_col, sig_id_col, pattern_col)
    per_file = (hits.groupBy(id_col)
                .agg(F.min(sig_id_col).alias("__sig"), F.count(F.lit(1)).alias("n_hits")))
    # names meet the hits, not the files: clean files would all have a null key there
    names = signatures.select(F.col(sig_id_col).alias("__sig"), F.col(name_col).alias("detail"))
    return (files.select(id_col).join(per_file.join(names, "__sig", "left"), id_col, "left")
            .select(id_col, F.col("__sig").isNull().alias("clean"),
                    F.when(F.col("__sig").isNotNull(), F.col("detail")).alias("detail"),
                    F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits")))


def scan_hashes(files: DataFrame, bad: DataFrame, id_col: str = "file_id", text_col: str = "text",
                bad_id_col: str = "bad_id", bad_hash_col: str = "sha256") -> DataFrame:
    """F2 (a): content-hash scan, an equi-join on sha-256.

    The hash list is joined, not force-broadcast: AQE switches to a broadcast
    at runtime when the measured side is small.
    """
    h = (bad.groupBy(F.col(bad_hash_col).alias("sha256"))
         .agg(F.min(bad_id_col).alias("match_id")))
    return (files.select(id_col, F.sha2(F.col(text_col), 256).alias("sha256"))
            .join(h, "sha256", "left")
            .withColumn("matched", F.col("match_id").isNotNull()))


def scan_disabled(files: DataFrame, id_col: str = "file_id") -> DataFrame:
    """no scanner: clean = false with an explanatory detail, no error."""
    return files.select(id_col, F.lit(False).alias("clean"), F.lit(DISABLED_DETAIL).alias("detail"),
                        F.lit(0).cast("bigint").alias("n_hits"))


def scan_gate(rows: DataFrame, job_col: str, order_col: str, failed: Column,
              out: str = "gated") -> DataFrame:
    """rows after the first failed scan of their job are gated.

    The first failure per job is a (partial) aggregate, written before it is joined back: in a plan of
    its own the join of a job that holds a large share of all rows can be split. Rows at or before
    the failure keep their own result.
    """
    first = stored(rows.filter(failed).groupBy(job_col).agg(F.min(order_col).alias("__first_fail")), "first-failures")
    return (rows.join(first, job_col, "left")
            .withColumn(out, F.coalesce(F.col(order_col) > F.col("__first_fail"), F.lit(False)))
            .drop("__first_fail"))
