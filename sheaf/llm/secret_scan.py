"""Operator 10: secret scans, rules and a character convolutional network.

Rules give the base findings (key assignments, access keys, long hex strings).
Candidates are runs of 16 or more key characters, and values of 6 or more that
follow a name and ``:`` or ``=``. Every one goes with its surroundings through a
small convolutional network in numpy, window by window to its end; its score is
the largest of its windows. The network is trained here on labelled findings:
all candidates that a rule found (positive) against all that none found, with equal
weight of both classes. By a hash of their place one third trains, on every window:
the windows are dealt into shares of about ``SHARE`` by their hash, each share trains
from the common weights, and the mean of what the shares reach is the start of the
next round. One third calibrates the probabilities (Platt) and sets the threshold, the
highest that keeps the recall of the labelled findings at ``RECALL``; sums and counts
over all its candidates do both. The last is held out: ``recall`` reports what the
threshold reaches there. Candidates over the threshold are added; rule findings always stay.

Texts are searched once; the findings (``masked``: with their rows) are kept in
the shared folder and scored.

Defined results: null text is empty and has no findings; without findings or
without other candidates, an empty table included, there is no network and
nothing is added; repeated rows give repeated results and count once in the
training; other columns are ignored or kept as they are. A text of any length is
looked at whole, a few thousand windows at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "model")
# The base rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_VALUE = re.compile(r"""[A-Za-z0-9_]["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")

BEFORE, INSIDE, STRIDE = 20, 44, 36  # characters seen before and from a window's start; step of later windows
RECALL, SEED = 0.95, 7
SHARE, ROUNDS = 5_000, 3  # windows that train together; how often the shares meet
TRAIN, CALIBRATE, HELD_OUT = 0, 1, 2  # thirds of the candidates
WIDTH, CHANNELS, EMBED, EPOCHS, BATCH = 5, 24, 8, 4, 50  # epochs of a round
CLASSES = 98  # printable ASCII, line break or tab, anything else, padding

FIXED, STEPS, FEW, BINS = 1 << 24, 40, 4096, 256

SPANS = "array<struct<kind:int,first:int,last:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' findings in code points, by start and kind."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, found by a rule, windows) of every candidate, by start."""
    long_ = [m.span() for m in _CANDIDATE.finditer(text)]
    taken = [e for _, e in long_]
    first = [s for s, _ in long_]
    values = [m.span(1) for m in _VALUE.finditer(text)]
    values = [(s, e) for s, e in values if (i := bisect_right(taken, s)) == len(long_) or first[i] >= e]  # apart from long runs
    reach = sorted((f, e) for _, f, e in base)
    out, at = [], 0
    for s, e in sorted(long_ + values):
        while at < len(reach) and reach[at][1] <= s:
            at += 1
        known = any(f < e and s < x for f, x in reach[at:at + 4])
        starts = range(s, max(s + 1, e - INSIDE + STRIDE), STRIDE)
        out.append((s, e, known, [text[max(0, w - BEFORE):w].rjust(BEFORE, "\0") + text[w:w + INSIDE] for w in starts]))
    return out


def codes(windows: list[str]) -> np.ndarray:
    """Character classes, one row a window."""
    n = BEFORE + INSIDE
    raw = np.frombuffer("".join(w.ljust(n, "\0")[:n] for w in windows).encode("utf-32-le"), "<u4").reshape(-1, n)
    out = np.full(raw.shape, 96, np.int64)
    printable = (raw >= 32) & (raw < 127)
    out[printable] = raw[printable] - 32
    out[(raw == 10) | (raw == 9)] = 95
    out[raw == 0] = 97
    return out


class Network:
    """Embedding, one convolution, largest and mean response of each filter, logistic output."""

    def __init__(self):
        r = np.random.default_rng(SEED)
        self.p = {"embed": r.normal(0, 0.5, (CLASSES, EMBED)), "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, CHANNELS)),
                  "bias": np.zeros(CHANNELS), "out": r.normal(0, 0.2, 2 * CHANNELS), "shift": np.zeros(1)}
        self.scale, self.offset, self.threshold = 1.0, 0.0, 1.1

    def _forward(self, x):
        e = self.p["embed"][x]
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([e[:, i:i + n] for i in range(WIDTH)], axis=2)
        act = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        top = act.argmax(1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], axis=1)
        return cols, act, top, pooled, pooled @ self.p["out"] + self.p["shift"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 2000])[-1] for i in range(0, len(x), 2000)] or [np.zeros(0)])

    def largest(self, candidates: list[list[str]]) -> np.ndarray:
        """The largest logit of each candidate's windows, a few thousand windows at a time."""
        ends = np.cumsum([len(w) for w in candidates])
        flat = [w for ws in candidates for w in ws]
        z = np.concatenate([self.logits(codes(flat[i:i + 4000])) for i in range(0, len(flat), 4000)] or [np.zeros(0)])
        return np.maximum.reduceat(z, ends - [len(w) for w in candidates]) if len(z) else z

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = ROUNDS * EPOCHS,
              seed: int = 1) -> None:
        r = np.random.default_rng(SEED + seed)
        if weight is None:
            weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                for k, g in self._gradient(x[at], y[at], weight[at]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.p[k] -= 0.004 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)

    def _gradient(self, x, y, weight):
        cols, act, top, pooled, logit = self._forward(x)
        d = weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        back = d[:, None] * self.p["out"][None]
        grad = np.repeat(back[:, None, CHANNELS:] / act.shape[1], act.shape[1], axis=1)
        rows = np.arange(len(x))[:, None]
        grad[rows, top, np.arange(CHANNELS)[None]] += back[:, :CHANNELS]
        grad *= act > 0
        d_cols = grad @ self.p["conv"].T
        n = act.shape[1]
        each = np.zeros((*x.shape, EMBED))
        for i in range(WIDTH):
            each[:, i:i + n] += d_cols[:, :, i * EMBED:(i + 1) * EMBED]
        at = x[:, :, None] * EMBED + np.arange(EMBED)
        d_embed = np.bincount(at.ravel(), each.ravel(), CLASSES * EMBED).reshape(CLASSES, EMBED)
        flat = cols.reshape(-1, cols.shape[2])
        return {"embed": d_embed, "conv": flat.T @ grad.reshape(-1, CHANNELS), "bias": grad.sum((0, 1)),
                "out": pooled.T @ d, "shift": np.array([d.sum()])}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        """Take these weights, in the order of ``flat``."""
        for k, part in zip(self.p, np.split(flat, np.cumsum([v.size for v in self.p.values()])[:-1])):
            self.p[k] = part.reshape(self.p[k].shape)

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """``calibrated`` for logits that are at hand: Platt scaling, classes of equal weight; then the highest
        threshold that keeps RECALL of the positives."""
        weight = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * len(y) / 2
        for _ in range(200):
            p = self.probability(z)
            g, w = weight * (p - y), weight * p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.linalg.solve(h, [(g * z).sum() + self.scale - 1, g.sum()])
            self.scale, self.offset = max(1e-3, self.scale - 0.5 * a), self.offset - 0.5 * b
        found = np.sort(self.probability(z[y == 1]))
        self.threshold = float(found[int((1 - RECALL) * len(found))])

    def over(self, candidates: list[list[str]]) -> np.ndarray:
        """Which candidates (their windows) reach the threshold."""
        return self.probability(self.largest(candidates)) >= self.threshold

    def added(self, base: list[list[tuple]], cands: list[list[tuple]]) -> list[list[tuple[int, int, int]]]:
        """The spans of each text's base findings and of its candidates over the threshold, in order."""
        new = [(i, c) for i, cs in enumerate(cands) for c in cs if not c[2]]
        out = [list(b) for b in base]
        for (i, c), yes in zip(new, self.over([c[3] for _, c in new])):
            if yes:
                out[i].append((3, c[0], c[1]))
        return [sorted(x, key=lambda s: (s[1], s[0])) for x in out]

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.offset, -50, 50)))


SPAN = pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
CANDIDATE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("known", pa.bool_()), ("windows", pa.list_(pa.string()))])
FOUND = f"base {SPANS}, candidates array<struct<first:int,last:int,known:boolean,windows:array<string>>>"


def _records(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, x)) for x in xs] for xs in rows], pa.list_(kind))


def findings(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc_id, base spans, candidates with their windows) of every document; with ``keep``, all its
    columns as a struct of this name."""
    common.ship(docs.sparkSession)
    if keep:
        rows = docs.select(F.col("doc_id"), F.struct("*").alias(keep))
    else:
        rows = common.texts(docs)
    names = ["doc_id", *[keep] * bool(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(common.row_texts(batches) if keep else batches):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            cands = [candidates(t, b) for t, b in zip(texts, base)]
            yield pa.record_batch([*[batch.column(c) for c in names], _records(base, SPAN), _records(cands, CANDIDATE)],
                                  [*names, "base", "candidates"])

    return rows.mapInArrow(run, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in names] + [FOUND]))


def labelled(found: DataFrame) -> DataFrame:
    """(known, part, h, windows): every candidate, found by a rule or not, its third and the hash of its place."""
    c = found.select("doc_id", F.explode("candidates").alias("c"))
    h = F.xxhash64("doc_id", "c.first", "c.last", F.element_at("c.windows", 1))
    return c.select("c.known", F.pmod(F.shiftright(h, 40), F.lit(3)).alias("part"), h.alias("h"), "c.windows")


def third(cands: DataFrame, part: int) -> DataFrame:
    """All candidates of one third, equal ones once."""
    return cands.where(F.col("part") == part).select("known", "h", "windows").distinct()


def _round(shared, turn: int, heavy: dict[bool, float]):
    """From the common weights, one share's windows to (n, w): how many there are and the weights they lead to."""
    def run(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["h", "at", "known", "window"])
        y, own = share["known"].to_numpy(float), Network()
        own.put(shared.value)
        own.train(codes(share["window"].tolist()), y, np.where(y == 1, heavy[True], heavy[False]), EPOCHS,
                  1 + turn + ROUNDS * int(share["share"].iloc[0]))
        return pd.DataFrame({"n": [len(y)], "w": [own.flat()]})
    return run


def trained(rows: DataFrame) -> Network | None:
    """A network trained on all windows (known, h, at, window), share by share (None: one class is missing)."""
    n = {r["known"]: r["count"] for r in rows.groupBy("known").count().collect()}
    if len(n) < 2:
        return None
    total = sum(n.values())
    heavy = {known: total / (2 * m) for known, m in n.items()}
    shares = -(-total // SHARE)
    # as many tasks as shares: by their bytes alone they would be put together, and wait for each other
    rows = rows.withColumn("share", F.pmod(F.xxhash64("h", "at"), F.lit(shares))).repartition(shares, "share")
    net = Network()
    for turn in range(ROUNDS):
        run = _round(rows.sparkSession.sparkContext.broadcast(net.flat()), turn, heavy)
        reached = rows.groupBy("share").applyInPandas(run, "n long, w array<double>").select("n", F.posexplode("w").alias("at", "w"))
        # whole numbers, so that the order of the shares does not matter
        mean = reached.groupBy("at").agg(F.sum(F.round(F.col("n") * F.col("w") * FIXED).cast("long")).alias("w")).orderBy("at").collect()
        net.put(np.array([r["w"] for r in mean], float) / FIXED / total)
    return net


def calibrated(net: Network, rows: DataFrame) -> bool:
    """Platt scaling of the logits of all (known, logit), classes of equal weight, by Newton steps on sums over
    them; then the highest threshold that keeps RECALL of the positives. False: one class is missing."""
    n = {r["known"]: r["count"] for r in rows.groupBy("known").count().collect()}
    if len(n) < 2:
        return False
    total, z = sum(n.values()), F.col("logit")
    each = F.when(F.col("known"), total / (2 * n[True])).otherwise(total / (2 * n[False]))

    def sums(a, b):
        m = F.lit(float(a)) * z + F.lit(float(b))
        p = 1 / (1 + F.exp(-F.least(F.greatest(m, F.lit(-50.0)), F.lit(50.0))))
        g, w = each * (p - F.col("known").cast("double")), each * p * (1 - p) + 1e-6
        against = F.when(F.col("known"), -m).otherwise(m)
        loss = each * (F.greatest(against, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))))
        r = rows.agg(*[F.sum(c) for c in (loss, g * z, g, w * z * z, w * z, w)]).first()
        return r[0] + (a - 1) ** 2 / 2, np.array([r[1] + a - 1, r[2]]), np.array([[r[3] + 1, r[4]], [r[4], r[5] + 1e-3]])

    at = np.array([net.scale, net.offset])
    loss, slope, curve = sums(*at)
    step = np.linalg.solve(curve, slope)
    for _ in range(STEPS):
        new = np.array([max(1e-3, at[0] - step[0]), at[1] - step[1]])
        if np.abs(new - at).max() < 1e-7:
            break
        reached = sums(*new)
        if reached[0] > loss:
            step = step / 2
            continue
        at, (loss, slope, curve) = new, reached
        step = np.linalg.solve(curve, slope)
    net.scale, net.offset = float(at[0]), float(at[1])
    net.threshold = float(net.probability(kth(rows.where("known").select(z.alias("v")), int((1 - RECALL) * n[True]))))
    return True


def kth(values: DataFrame, k: int) -> float:
    """The k-th smallest ``v``, from 0: the bins of the range that holds it are counted until few values are left."""
    while True:
        lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if lo == hi:
            return lo
        if n <= FEW:
            return sorted(r["v"] for r in values.collect())[k]
        bin_ = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))
        for r in values.groupBy(bin_.alias("bin")).count().orderBy("bin").collect():
            if k < r["count"]:
                values = values.where(bin_ == r["bin"])
                break
            k -= r["count"]


def scored(cands: DataFrame, net: Network) -> DataFrame:
    """(known, h, logit): the largest logit over all windows of every candidate."""
    shared = cands.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = shared.value.largest(batch.column("windows").to_pylist())
                yield pa.record_batch([batch.column("known"), batch.column("h"), pa.array(z, pa.float64())], ["known", "h", "logit"])

    return cands.select("known", "h", "windows").mapInArrow(run, "known boolean, h long, logit double")


def fit(found: DataFrame) -> Network | None:
    """A network trained and calibrated on the labelled candidates (None: one class is missing in a third)."""
    common.ship(found.sparkSession)
    cands = labelled(found)
    net = trained(common.stored(third(cands, TRAIN).select("known", "h", F.posexplode("windows").alias("at", "window")), "training"))
    if net is None or not calibrated(net, common.stored(scored(third(cands, CALIBRATE), net).select("known", "logit"), "logits")):
        return None
    return net


def recall(docs: DataFrame) -> DataFrame:
    """One row (n_findings, n_reached, threshold): how many labelled findings of the held-out third,
    all of them, the network would have found without the rules. No network: no row."""
    found = common.stored(findings(docs), "findings")
    net = fit(found)
    some = labelled(found).where(F.col("known") & (F.col("part") == HELD_OUT))
    if net is None:
        return some.select(F.lit(0).cast("long").alias("n_findings"), F.lit(0).cast("long").alias("n_reached"),
                           F.lit(0.0).alias("threshold")).where("false")
    probability = 1 / (1 + F.exp(-(F.lit(net.scale) * F.col("logit") + F.lit(net.offset))))
    return scored(some, net).agg(F.count("*").alias("n_findings"),
                                 F.count_if(probability >= net.threshold).alias("n_reached"),
                                 F.lit(net.threshold).alias("threshold"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the rules' findings and all findings, by start and kind."""
    spark = docs.sparkSession
    found = common.stored(findings(docs), "findings")
    net = fit(found)
    kind = found.schema["doc_id"].dataType.simpleString()
    if net is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = shared.value.added(*_lists(batch))
            yield pa.record_batch([batch.column("doc_id"), batch.column("base"), _records(spans, SPAN)], ["doc_id", "base", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def _lists(batch: pa.RecordBatch) -> tuple[list[list[tuple]], list[list[tuple]]]:
    return tuple([[tuple(s.values()) for s in xs] for xs in batch.column(c).to_pylist()] for c in ("base", "candidates"))


def listed(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                             F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def mask(text: str, spans: list[tuple[int, int]], by: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with all findings in ``text`` masked (``n_chars``, if there, follows); other rows stay as they are."""
    found = common.stored(findings(docs, keep="row"), "findings")
    shared = docs.sparkSession.sparkContext.broadcast(fit(found))
    rows = found.select("row", "base", "candidates")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(common.row_texts(batches)):
            base, cands = _lists(batch)
            spans = base if shared.value is None else shared.value.added(base, cands)
            new = [mask(t, [s[1:] for s in x]) if x else None for t, x in zip(batch.column("text").to_pylist(), spans)]
            yield pa.record_batch([batch.column("row"), pa.array(new, pa.string())], ["row", "masked"])

    out = rows.mapInArrow(run, f"row {kind}, masked string")
    return out.select([
        F.coalesce("masked", "row.text").alias("text") if c == "text" else
        F.coalesce(F.length("masked"), "row.n_chars").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col(f"row.`{c}`") for c in docs.columns])
