"""Plain-Python definitions that the operators are held against."""

import re

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def grams(text, n):
    w = words(text)
    if 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard_rows(docs, n, threshold):
    """Rows of the join under its result definition: docs is a list of (id, text)."""
    sets = {}
    for i, t in docs:
        g = frozenset(grams(t, n))
        if i is not None and g:
            sets.setdefault(g, set()).add(i)
    rows = {}
    reps = [(min(ids), g) for g, ids in sets.items()]
    for g, ids in sets.items():
        for i in ids - {min(ids)}:
            rows[(min(ids), i)] = 1.0
    for x, (a, ga) in enumerate(reps):
        for b, gb in reps[x + 1 :]:
            common = len(ga & gb)
            union = len(ga) + len(gb) - common
            if a != b and common and common + 1e-9 >= threshold * union:
                k = (min(a, b), max(a, b))
                rows[k] = max(rows.get(k, 0), round(common / union, 6))
    return {(a, b, j) for (a, b), j in rows.items()}


def jaccard_classes(docs, n, threshold):
    """(id, smallest id of its group, other sets near its own) of every id that isn't null."""
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(frozenset(grams(t, n)), set()).add(i)
    sets.pop(frozenset(), None)
    group, links = {i: i for i, _ in docs if i is not None}, {}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    def unite(a, b):
        a, b = sorted((root(a), root(b)))
        group[b] = a

    for g, ids in sets.items():
        for i in ids:
            unite(min(ids), i)
        links[g] = 0
    known = list(sets)
    for x, a in enumerate(known):
        for b in known[x + 1 :]:
            if len(a & b) and len(a & b) + 1e-9 >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                unite(min(sets[a]), min(sets[b]))
    total = dict.fromkeys(group, 0)
    for g, ids in sets.items():
        for i in ids:
            total[i] += links[g]
    return {(i, root(i), total[i]) for i in group}


def exact_runs(text, item, n):
    """(position, words) of maximal runs of n or more words that agree at one alignment."""
    t, q = words(text), words(item)
    n = min(n, len(q))
    out = set()
    if not n:
        return out
    for shift in range(-len(q) + 1, len(t)):
        run = 0
        for k in range(len(q) + 1):
            if k < len(q) and 0 <= shift + k < len(t) and t[shift + k] == q[k]:
                run += 1
            else:
                if run >= n:
                    out.add((shift + k - run, run))
                run = 0
    return out


def near_stretch(text, item, share, slack):
    """(position, terms) of the first stretch with the most of the item's terms, if they are enough."""
    from math import ceil

    t, q = words(text), words(item)
    terms = set(q)
    if not terms:
        return None
    need, span = ceil(round(share * len(terms), 9)), ceil(round(slack * len(q), 9))
    best = (0, 0)
    for i in range(len(t)):
        if t[i] in terms:
            c = len(terms & set(t[i : i + span]))
            if c > best[0]:
                best = (c, i)
    return (best[1], best[0]) if best[0] >= need else None
