"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def groups(rows, k, percent):
    """doc -> (set size, least doc reachable), over all pairs."""
    sets, parent = {}, {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(frozenset(shingles(text, k)))
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = list(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    n = len(x & y)
                    if n and 100 * n >= percent * (len(x) + len(y) - n):
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d][0]), root(d)) for d in docs}


def leaks(docs, items, k=5, percent=80):
    """doc, item -> best similarity, over all windows of an item's size."""
    found = {}
    for doc, text in docs:
        w = words(text)
        for item, other in items:
            v = words(other)
            if not w or not v:
                continue
            kk = min(k, len(v))
            own = Counter(tuple(v[i : i + kk]) for i in range(len(v) - kk + 1))
            for p in range(max(1, len(w) - len(v) + 1)):
                part = w[p : p + len(v)]
                win = Counter(tuple(part[i : i + kk]) for i in range(len(part) - kk + 1))
                least, most = sum((own & win).values()), sum((own | win).values())
                if 100 * least >= percent * most:
                    found[doc, item] = max(found.get((doc, item), 0), least / most)
    return found


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """The four base patterns, as written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[0], order.index(s[1])))


def segmentations(word, scores, unknown=-25.0):
    """Score and number of pieces of every way to cut a word into pieces, or characters by their bytes."""
    if not word:
        return [(0.0, 0)]
    out = []
    for k in range(1, len(word) + 1):
        head = [(scores[word[:k]], 1)] if word[:k] in scores else []
        if k == 1:
            head.append((unknown * len(word[0].encode()), len(word[0].encode())))
        if head:
            out += [(a + s, b + n) for a, b in head for s, n in segmentations(word[k:], scores, unknown)]
    return out


def best_pieces(word, scores, unknown=-25.0):
    """The number of pieces of the best segmentation; of equals, that with the longer last piece."""
    best, most = [(0.0, 0)], max(map(len, scores))
    for j in range(1, len(word) + 1):
        ways = [(best[i][0] + scores[word[i:j]], j - i, best[i][1] + 1) for i in range(max(0, j - most), j) if word[i:j] in scores]
        size = len(word[j - 1].encode())
        ways.append((best[j - 1][0] + unknown * size, most + 1, best[j - 1][1] + size))
        top = max(ways, key=lambda w: (w[0], w[1]))
        best.append((top[0], top[2]))
    return best[-1][1]
