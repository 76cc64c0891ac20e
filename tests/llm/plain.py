"""Brute-force versions of the corpus operators, straight from their definitions."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from itertools import combinations

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec(docs):
    enc = encoding()
    out = []
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    return out


def token_files(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, out = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(docs, k, num, den):
    """(id, set size, component) by comparing every pair."""
    rows = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, u) in combinations([r for r in rows if r[0] is not None and r[1]], 2):
        if den * len(s & u) >= num * len(s | u):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else root(d)) for d, s in rows]


SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def is_private(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def private(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if is_private(k, m[0])] for k, p in SHAPES.items()}


def private_report(docs):
    out = []
    for d, t in docs:
        found = private(t)
        out.append((d, *map(len, found.values()), sha(",".join(f"{k}:{a}:{b}" for k, s in found.items() for a, b in s))))
    return out


def redacted(text):
    spans = sorted((a, -b, k) for k, s in private(text).items() for a, b in s)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, -b)
    return text if not spans else "".join(out) + text[at:]


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def leaks(docs, items, n=8):
    words = leak_words
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(0, len(w) - n) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if (g := tuple(w[j : j + size])) in windows:
                    hit.update(range(j, j + size))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return out


def longest_leak(text, items, n=8):
    """(words of the longest verbatim match that holds a window, the words where it may start)."""
    w, best, at = leak_words(text), 0, set()
    for _, t in items:
        v = leak_words(t)
        for a in range(len(w)):
            for b in range(len(v)):
                k = 0
                while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                    k += 1
                if k >= min(n, len(v)) and k >= best:
                    at = {a} if k > best else {*at, a}
                    best = k
    return best, at


def repeats(docs, n=13):
    first, out = {}, []
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in rows:
        for i in range(len(w) - n + 1 if d is not None else 0):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d)
    for d, w in rows:
        gone = {i + j for i in range(len(w) - n + 1) if d is not None and first[tuple(w[i : i + n])] < d for j in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
