"""Plain single-process versions of the operators, for comparison."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, width):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False))


def window_minima(h, least):
    """Place of the leftmost smallest value of every window of ``least``."""
    return [min(range(s, s + least), key=lambda k: (h[k], k)) for s in range(len(h) - least + 1)]


def components(sets, percent=80):
    """index -> smallest index of its component."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def repeated_words(texts, size=50):
    """Per text: positions of words inside an exact run of ``size`` words that another text holds."""
    seqs = [words(t) for t in texts]
    seen = defaultdict(set)
    for i, w in enumerate(seqs):
        for k in range(len(w) - size + 1):
            seen[tuple(w[k:k + size])].add(i)
    out = []
    for w in seqs:
        mark = set()
        for k in range(len(w) - size + 1):
            if len(seen[tuple(w[k:k + size])]) > 1:
                mark.update(range(k, k + size))
        out.append(mark)
    return out
