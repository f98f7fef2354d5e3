"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def base_counts(text):
    w = spaced(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def contamination(text, items):
    """(hit positions, item ids)."""
    w, hit, ids = plain(text), set(), set()
    for item, t in items:
        x = plain(t)
        n = min(10, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[s : s + n]:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
    return hit, sorted(ids)


def shingles(text):
    w = spaced((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def near_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def later_copies(docs, min_words):
    """Deleted lines of each document (numbers of lines with a word), documents by rising id."""
    lines = {i: [x for x in (t or "").split("\n") if spaced(x)] for i, t in docs}
    seen = defaultdict(list)
    for i in sorted(lines):
        for p, x in enumerate(lines[i]):
            seen[x].append((i, p))
    out = {}
    for i, own in lines.items():
        gone = set()
        for p, x in enumerate(own):
            best = 0
            for j, q in seen[x]:
                if (j, q) >= (i, p):
                    break
                m = 0
                while p + m < len(own) and q + m < len(lines[j]) and own[p + m] == lines[j][q + m]:
                    m += 1
                best = max(best, m)
            if sum(len(spaced(y)) for y in own[p : p + best]) >= min_words:
                gone |= set(range(p, p + best))
        out[i] = gone
    return out
