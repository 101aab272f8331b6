"""Plain Python versions of the operators, for small tables."""

import hashlib
import re


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def decontaminate(docs, items, window=10):
    """{(id, text): (n_words, n_hit, n_items, items_sha, contaminated)}"""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= x
        out[d, t] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def substrings(docs, window=50):
    """{(id, text): (n_words, n_removed, kept_sha)}; no id is null."""
    split = {(d, t): re.findall("[^ \t-\r]+", t or "") for d, t in docs}
    least = {}
    for (d, _), w in split.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, d), d)
    out = {}
    for (d, t), w in split.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        out[d, t] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def simhash(text, size=4):
    import xxhash

    w = re.findall(b"[^ \t-\r]+", lower(text).encode())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs):
    fp = {d: simhash(t) for d, t in docs}
    root = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    return {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def pii(text):
    """(counts, base_sha) by plain regular expressions."""

    def luhn(d):
        return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0

    text, out = text or "", []
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out.append([f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])])
    return [*map(len, out), sha(",".join(sum(out, [])))]


def suffixes(docs, length=200):
    """A row (n_bytes, n_removed, n_spans, kept_sha) for each document, in order; every row is a place of its own."""
    raw = [(t or "").encode() for _, t in docs]
    times = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            times[b[p : p + length]] = times.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out
