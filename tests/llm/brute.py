"""Plain re-statements of the operators' results, for comparison on small data."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WHITE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in out)
    n = Counter(k for _, k, _ in out)
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest(), joined


def quality(text):
    text = text or ""
    words = re.findall(WHITE, text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WHITE, line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[k : k + m])].add(str(i))
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (x := wins.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def near(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(WHITE, lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    both = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), k in both.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(docs, length=100):
    """Per document n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
