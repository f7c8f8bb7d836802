"""Plain versions of the operators' rules, for small inputs."""

import hashlib
import itertools
import re

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda line: low(line.strip(SPACE))
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in held or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def contamination(docs, items, window=13):
    windows = {}
    for item, t in items:
        w = BENCH_WORD.findall(low(t or ""))
        if w and item is not None:
            k = min(window, len(w))
            for j in range(len(w) - k + 1):
                windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = BENCH_WORD.findall(low(t or ""))
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, n):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def link_components(docs, n, num, den):
    """Rows without an id take no part."""
    sets = [shingles(t, n) if i is not None else set() for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        if sets[k]:
            groups.setdefault(find(k), []).append(docs[k][0])
    return [(i, len(s), min(groups[find(k)]) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def passage_dedup(docs, window=20):
    """For distinct ids."""
    seen, out = set(), {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone |= set(range(j, j + window))
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out
