"""Plain-Python versions of the operators' definitions."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(texts: dict, percent=85):
    """doc_id -> least doc_id of its group, over all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    where, parent = {}, {d: d for d in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: top(d) for d in texts}, {d: len(s) for d, s in sets.items()}
