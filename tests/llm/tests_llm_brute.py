"""Brute-force versions of operators, for tests."""

import collections
import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_hits(texts, items, window=13):
    low = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    patterns = collections.defaultdict(set)
    for item, t in items:
        w = low(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(item)
    sizes = {len(p) for p in patterns}
    for t in texts:
        w, hit, found = low(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        yield len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def brute_cut(texts, window):
    first, out = {}, {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, t in texts:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def brute_links(texts, n=5, threshold=0.8):
    sets = {}
    for t in dict.fromkeys(texts):
        if w := words(t):
            sets[t] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    links = {t: {u for u in sets if u != t and len(sets[t] & sets[u]) >= threshold * len(sets[t] | sets[u]) - 1e-9} for t in sets}
    ids = collections.defaultdict(list)
    for i, t in enumerate(texts):
        ids[t].append(i)
    out = {}
    for i, t in enumerate(texts):
        if t not in sets:
            out[i] = (i, 0, 1)
            continue
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        out[i] = (min(min(ids[u]) for u in seen), len(links[t]), len(ids[t]))
    return out


def brute_merge(ids, find):
    """Merge the leftmost pair of the lowest rank until no pair is known; ``find`` gives rank (None) and product."""
    ids = list(ids)
    while True:
        found = [(r, i, p) for i in range(len(ids) - 1) if (r := (f := find(ids[i], ids[i + 1]))[0]) is not None for p in f[1:]]
        if not found:
            return ids
        _, i, p = min(found)
        ids[i : i + 2] = [p]


def brute_pack(lengths, capacity, linear, quadratic):
    """Sequences and pieces of cost-balanced packing, by trying every sequence."""
    n = -(-sum(lengths) // capacity)
    whole = sum(x // capacity for x in lengths)
    free, cost, pieces, late = [capacity] * (n - whole), [0.0] * (n - whole), whole, []
    for x in sorted((x % capacity for x in lengths), reverse=True):
        if x:
            best = min(((cost[s], s) for s in range(len(free)) if free[s] >= x), default=None)
            if best is None:
                late.append(x)
                continue
            free[best[1]] -= x
            cost[best[1]] += linear * x + quadratic * x * x
            pieces += 1
    for x in late:
        while x:
            s = max(range(len(free)), key=lambda s: (free[s], -s))
            part = min(x, free[s])
            free[s], x, pieces = free[s] - part, x - part, pieces + 1
    return pieces, sum(free)
