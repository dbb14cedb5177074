"""Operator 2: byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its
encoding. A suffix automaton of the vocabulary, fed the piece byte by byte,
names all tokens that end at the current byte; the first of them (longest
first) that may stand after the stored last token of the shorter prefix is
stored. Following the stored tokens back from the end gives the ids.

Two tokens may stand side by side when merging their bytes never joins across
the seam. The tokens that touch the seam while a token is being built are its
outer spine; a join of ranks r across the seam happens when both partners are
there at rank r, that is before either goes into its own next merge (a tie is
won by the join further left).

Texts are cut into pieces by the pre-tokenizer's pattern. Single spaces between
two non-space characters are always piece borders, so whole space-delimited
words are looked up in a bounded memo first. The words a slice of texts adds to it
are fed to the automaton together, a byte of each at a time.

Defined results: null text is empty; empty text has no ids; special-token
strings in a text become their ids, as the tokenizers library does by default;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

MEMO_ENTRIES = 240_000  # or those of the texts at hand; two generations are kept where texts come one by one
PAIR_ENTRIES = 1_000_000
PAIR_BITS = 21  # places for pair tests of many pieces at once
TOGETHER, LONG = 32, 64  # so many pieces, none over so many bytes, are encoded beside each other

# Fixed value: the pre-tokenizer's pattern.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Memo(dict):
    """A dict that computes missing values and forgets the oldest generation when full."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def hold(self, keys, values, used) -> None:
        """Remember new keys with their values; if that is too many, of the others only the ``used`` ones."""
        if len(self) + len(keys) > self.entries:
            kept = {k: self[k] for k in used if k in self}
            self.clear()
            self.update(kept)
            self.old = {}
        self.update(zip(keys, values))



def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place of 2^bits for each key."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class Lookup:
    """Numbers by number (0 or more) in open addressing, many at once; -1: none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = places(keys, self.bits)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of those at one place the last one stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = places(keys, self.bits)
        found, out = self.keys[at], self.values[at]
        wait = np.flatnonzero((found != keys) & (found >= 0))
        while len(wait):
            at[wait] = (at[wait] + 1) & (len(self.keys) - 1)
            found, out[wait] = self.keys[at[wait]], self.values[at[wait]]
            wait = wait[(found != keys[wait]) & (found >= 0)]
        return out


class Unsafe(Exception):
    """A word that cannot be cut off at its spaces."""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for
    themselves, the others in order from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Automaton:
    """Suffix automaton of a list of byte strings; marked states name the strings that end there."""

    def __init__(self, strings: dict[bytes, int]):
        self.next, self.link, self.length = [{}], [0], [0]
        for s in strings:
            at = 0
            for b in s:
                at = self._extend(at, b)
        n = len(self.next)
        self.token = [-1] * n
        for s, t in strings.items():
            at = 0
            for b in s:
                at = self.next[at][b]
            self.token[at] = t
        self.near = [0] * n  # the state itself or its first marked suffix; 0: none
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.near[v] = v if self.token[v] >= 0 else self.near[self.link[v]]
        self.steps = Lookup(np.array([v << 8 | b for v, out in enumerate(self.next) for b in out], np.int64),
                            np.array([w for out in self.next for w in out.values()], np.int64))
        self.columns = [np.array(x, np.int64) for x in (self.link, self.length, self.near, self.token)]

    def _extend(self, at: int, b: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[at].get(b)
        if q is not None:
            return q if length[q] == length[at] + 1 else self._split(at, q, b)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[at] + 1)
        while b not in nxt[at]:
            nxt[at][b] = new
            if at == 0:
                return new
            at = link[at]
        q = nxt[at][b]
        link[new] = q if length[q] == length[at] + 1 else self._split(at, q, b)
        return new

    def _split(self, at: int, q: int, b: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[at] + 1)
        link[q] = copy
        while nxt[at].get(b) == q:
            nxt[at][b] = copy
            if at == 0:
                break
            at = link[at]
        return copy


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(of_letter[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {t: raw(s) for s, t in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of.update({t: s.encode() for s, t in self.special.items()})
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a_id, b_id = vocab[a], vocab[b]
            self.rank[a_id, b_id] = r
            self.parts[vocab[a + b]] = (a_id, b_id, r)
        self.never = len(self.rank)
        self.left, self.right = {}, {}
        reached = {}
        for s, t in sorted(vocab.items(), key=lambda x: self.parts.get(x[1], (0, 0, -1))[2]):
            if self._reached(t):
                reached[t] = True
                self.left[t], self.right[t] = self._spine(t, 0), self._spine(t, 1)
        self.whole = {self.bytes_of[t]: t for t in reached}
        self.automaton = Automaton(self.whole)
        self.pairs = Memo(self._fits, PAIR_ENTRIES)
        self.pattern = regex.compile(PATTERN)
        self.seams = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.piece_memo = Memo(lambda p: np.array(self.piece(p.encode()), "<u4").tobytes())
        self.word_memo = Memo(self._word)
        self.table = [self.bytes_of.get(t, b"") for t in range(max(self.bytes_of) + 1)]
        self.sizes = np.array(list(map(len, self.table)), np.int64)
        self.tested = None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the left (0) or right (1) edge while the token is built, each with the rank
        of the merge that takes it in; the finished token comes first and is never taken in."""
        out, until = [], self.never
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def _reached(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        if token not in self.parts:
            return len(self.bytes_of[token]) == 1
        a, b, r = self.parts[token]
        if a not in self.right or b not in self.left:
            return False
        return not any(q is not None and q < min(x_end, r) and q <= min(y_end, r)
                       for x, x_end in self.right[a] for y, y_end in self.left[b]
                       if (x, y) != (a, b) for q in [self.rank.get((x, y))])

    def _fits(self, pair: tuple[int, int]) -> bool:
        for x, x_end in self.right[pair[0]]:
            for y, y_end in self.left[pair[1]]:
                r = self.rank.get((x, y))
                if r is not None and r < x_end and r <= y_end:
                    return False
        return True

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenizer piece."""
        token = self.whole.get(data)
        if token is not None:
            return [token]
        a = self.automaton
        nxt, link, length, near, mark, fits = a.next, a.link, a.length, a.near, a.token, self.pairs
        last = [0] * (len(data) + 1)
        v = matched = 0
        for i, b in enumerate(data, 1):
            step = nxt[v].get(b)
            while step is None:
                v = link[v]
                matched = length[v]
                step = nxt[v].get(b)
            v = step
            matched += 1
            u = near[v if matched == length[v] else link[v]]
            while True:
                j = i - length[u]
                if j == 0 or fits[last[j], mark[u]]:
                    last[i] = mark[u]
                    break
                u = near[link[u]]
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.table[last[i]]) if hasattr(self, "table") else len(self.bytes_of[last[i]])
        return out[::-1]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs; a place holds the last pair tested there, with its result."""
        if self.tested is None:
            self.tested = np.full(1 << PAIR_BITS, -1, np.int64)
        key = left << 32 | right
        held = self.tested[places(key, PAIR_BITS)]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            keys, which = np.unique(key[new], return_inverse=True)
            fits = np.fromiter(map(self._fits, zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist())), bool, len(keys))
            self.tested[places(keys, PAIR_BITS)] = keys << 1 | fits
            out[new] = fits[which]
        return out

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, as ``piece`` finds them, byte by byte for all of them at once."""
        out = [b""] * len(pieces)
        some = []
        for k, p in enumerate(pieces):
            token = self.whole.get(p)
            if token is not None:
                out[k] = token.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = np.array(self.piece(p), "<u4").tobytes()
            else:
                some.append(k)
        if len(some) < TOGETHER:
            for k in some:
                out[k] = np.array(self.piece(pieces[k]), "<u4").tobytes()
            return out
        some.sort(key=lambda k: -len(pieces[k]))
        link, length, near, mark = self.automaton.columns
        data = np.frombuffer(b"".join(map(pieces.__getitem__, some)), np.uint8)
        sizes = np.array([len(pieces[k]) for k in some], np.int64)
        begin = np.cumsum(sizes) - sizes
        at = begin + np.arange(len(some))  # a piece has a place for each of its prefixes, the empty one too
        last = np.zeros(len(data) + len(some), np.int64)
        state, matched = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for i in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -i, "right"))  # pieces that are that long
            b, v, m = data[begin[:n] + (i - 1)], state[:n], matched[:n]
            step = self.automaton.steps.get(v << 8 | b)
            wait = np.flatnonzero(step < 0)
            while len(wait):
                v[wait] = link[v[wait]]
                m[wait] = length[v[wait]]
                step[wait] = self.automaton.steps.get(v[wait] << 8 | b[wait])
                wait = wait[step[wait] < 0]
            v[:] = step
            m += 1
            u = near[np.where(m == length[v], v, link[v])]
            wait = np.arange(n)
            while len(wait):
                j = i - length[u]
                ok = j == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self._fit(last[at[wait[inner]] + j[inner]], mark[u[inner]])
                last[at[wait[ok]] + i] = mark[u[ok]]
                wait, u = wait[~ok], near[link[u[~ok]]]
        rows, left, back = np.arange(len(some)), sizes.copy(), []
        while len(rows):
            token = last[at[rows] + left[rows]]
            back.append((rows, token))
            left[rows] -= self.sizes[token]
            rows = rows[left[rows] > 0]
        ends = np.cumsum(np.bincount(np.concatenate([r for r, _ in back]), minlength=len(some)))
        ids = np.zeros(int(ends[-1]), "<u4")
        for k, (rows, token) in enumerate(back, 1):
            ids[ends[rows] - k] = token
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        for k, a, b in zip(some, [0, *ends], ends):
            out[k] = raw[a:b]
        return out

    def learn(self, texts: list[str]) -> None:
        """Remember the words of these texts; the pieces of all new ones are encoded together."""
        words = set()
        for text in texts:
            words.update(text.split(" "))
        new = [w for w in words if w not in self.word_memo and w and not w[0].isspace() and not w[-1].isspace()]
        cut = [[" " + w] if w.isascii() and w.isalpha() else self.pattern.findall(" " + w) for w in new]
        used = set(itertools.chain.from_iterable(cut))
        lacking = [p for p in used if p not in self.piece_memo]
        self.piece_memo.hold(lacking, self.pieces([p.encode() for p in lacking]), used)
        ids = self.piece_memo.__getitem__
        self.word_memo.hold(new, [ids(ps[0]) if len(ps) == 1 else b"".join(map(ids, ps)) for ps in cut], words)

    def forget(self) -> None:
        """Empty the memos (tasks do so at their end, so idle workers hold little)."""
        self.tested = None
        for memo in (self.pairs, self.piece_memo, self.word_memo):
            memo.clear()
            memo.old = {}

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece_memo.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        return self._pieces(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.seams is not None and self.seams.search(text):
            out, at = [], 0
            for m in self.seams.finditer(text):
                out += [self._pieces(text[at:m.start()]), np.uint32(self.special[m[0]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._pieces(text[at:])])
        first, *words = text.split(" ")
        if first and first[-1].isspace():
            return self._pieces(text)
        try:
            return b"".join([self._pieces(first), *map(self.word_memo.__getitem__, words)])
        except Unsafe:
            return self._pieces(text)

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[t] for t in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every text; ``exact``: decoding gives the text back.

    ``vocabulary`` is the path of the vocabulary file on every worker.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in common.pieces(batches):
            texts = batch.column("text").to_pylist()
            c.learn(texts)
            ids = [c.encode(t) for t in texts]
            n = np.array([len(x) // 4 for x in ids])
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, values),
                                   pa.array([c.decode(x) == t for x, t in zip(ids, texts)])],
                                  ["doc_id", "n_tokens", "ids", "exact"])
        c.forget()

    t = common.texts(docs)
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, "
                             "exact boolean")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text's encoding and its decoding."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in common.pieces(batches):
            texts = batch.column("text").to_pylist()
            c.learn(texts)
            ids = [c.encode(t) for t in texts]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    t = common.texts(docs)
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
                             "ids_sha256 string, decoded_sha256 string")
