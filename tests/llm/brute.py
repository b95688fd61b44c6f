"""Plain Python versions of the operators' contracts, for small fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def op1(docs, items, length=10):
    by = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(UP))
        for i in range(max(1, len(w) - length + 1) if w else 0):
            by[tuple(w[i : i + length])].add(item)
    sizes = {len(k) for k in by}
    out = []
    for d, text in docs:
        w = WORD.findall((text or "").translate(UP))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in by:
                    hit.update(range(i, i + n))
                    found |= by[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def near_items(docs, items, most=4):
    texts = [(d, WORD.findall((t or "").translate(UP))) for d, t in docs]
    count = Counter(w for _, t in texts for w in t)
    out = {d: set() for d, _ in texts}
    for item, text in items:
        w = WORD.findall((text or "").translate(UP))
        rare = sorted({x for x in w if x in count}, key=lambda x: (count[x], x.encode()))[:most]
        if w and len(rare) == min(most, len(set(w))):
            for d, t in texts:
                if set(rare) <= set(t) and any(set(rare) <= set(t[i : i + 2 * len(w)]) for i, x in enumerate(t) if x in rare):
                    out[d].add(str(item))
    return {d: ",".join(sorted(x)) for d, x in out.items()}


def op3(docs, length=200):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = defaultdict(int)
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def op5(text):
    raw = (text or "").encode()
    p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    return len(raw), len(p), sha(p), zlib.crc32(p[-64:])


def shingles(text, n=3):
    w = TOKEN.findall((text or "").translate(UP))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def op6(docs, least=85):
    sets = [(d, shingles(t)) for d, t in docs]
    comp = {d: d for d, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= least * len(x | y):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UP)


def op7(docs, chars=40, least=5):
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(k := line_key(line)) >= chars:
                held[k].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(line_key(x), ())) >= least and max(held[line_key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def op10(text):
    text, out, counts = text or "", [], []
    for kind, rx in KINDS:
        n = 0
        for m in rx.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, sha(",".join(out)))
