"""Brute-force versions of the operators, for small inputs: plain Python over lists of (doc_id, text)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash


def sha(b):
    return hashlib.sha256(b).hexdigest()


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def op3(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


def op4_base(docs, held):
    each = [re.findall(rb"[^\x20\x09-\x0D]+", lower((t or "").encode())) + [None] for _, t in docs]
    c = Counter(x for w, h in zip(each, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in each]


def ppm(train, texts, order):
    """Escape method C with exclusion, context by context."""
    trie = defaultdict(Counter)
    line = lambda t: [255] * order + list(lower((t or "").encode())) + [254]
    for t in train:
        s = line(t)
        for i in range(order, len(s)):
            for j in range(order + 1):
                trie[tuple(s[i - j:i])][s[i]] += 1
    out = []
    for t in texts:
        s, total = line(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                after = {k: n for k, n in trie.get(tuple(s[i - j:i]), {}).items() if k not in gone}
                if not after:
                    continue
                mass = sum(after.values()) + len(after)
                if s[i] in after:
                    total += math.log10(after[s[i]] / mass)
                    break
                total += math.log10(len(after) / mass)
                gone |= set(after)
            else:
                total -= math.log10(257 - len(gone))
        out.append(total)
    return out


def op6(docs, shingle, k):
    fps = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower((t or "").encode()))
        if not w:
            fps.append(0)
            continue
        g = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps, linked([d for d, _ in docs], fps, k)


def linked(ids, fps, k):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= k:
                root[find(a)] = find(b)
    least = {}
    for d, f in zip(ids, fps):
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return [least[find(f)] for f in fps]


def op7(docs, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    n = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i:i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op8(docs, items, window):
    of = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))
    wins = defaultdict(set)
    for item, t in items:
        w = of(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i:i + n])].add(str(item))
    sizes = {len(x) for x in wins}
    out = []
    for _, t in docs:
        w, hit, ids = of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    ids |= got
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return out


def op9(docs, n):
    first = {}
    key = lambda d: -(1 << 63) if d is None else d
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            s = b[i:i + n]
            first[s] = min(first.get(s, key(d)), key(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < key(d):
                gone.update(range(i, i + n))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(b), len(gone), spans, sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def op10(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    kinds = ["assign", "access", "hex"]
    spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
    n = Counter(k for k, _, _ in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())
