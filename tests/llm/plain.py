"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def normalised(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalised(t)].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def repeats(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if g in seen:
                gone[s : s + k] = [True] * k
            seen.add(g)
        kept = " ".join(x for x, c in zip(w, gone) if not c)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def item_words(t):
    out = []
    for w in WORD.findall(lower(t or "")):
        for _ in range(3):
            if len(w) > 1 and ord(w[0]) < 127 and not w[0].isalnum():
                w = w[1:]
            if len(w) > 1 and ord(w[-1]) < 127 and not w[-1].isalnum():
                w = w[:-1]
        out.append(w)
    return out


def held(docs, items, rate=0.2):
    """{(doc, item): distance} by comparing every window with every item."""
    out = {}
    for d, t in docs:
        w = item_words(t)
        for i, x in items:
            v = item_words(x)
            if v and len(w) >= len(v):
                best = min(distance(w[s : s + len(v)], v) for s in range(len(w) - len(v) + 1))
                if best <= int(rate * len(v)):
                    out[d, i] = best
    return out
