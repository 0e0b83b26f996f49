"""Plain brute-force versions for the tests."""

import re
from collections import Counter, defaultdict

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def shingle_set(text, k=5):
    w = spaced(text)
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)] if w else [])


def groups(texts, percent=75):
    """{doc_id: text} -> {doc_id: (set size, component)} over all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k in sorted(sets):
        shared = Counter()
        for s in sets[k]:
            shared.update(having[s])
            having[s].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                x, y = find(k), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}
