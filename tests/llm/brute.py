"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def near(docs, percent=85):
    sets = {}
    for i, text in docs:
        w = words(text, True)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    found = Union(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                found.join(a, b)
    return {i: (len(sets[i]), found.root(i), found.root(i) == i) for i in ids}


def without_repeats(docs, length=20):
    """Rows in order; a list of (n_words, n_removed, sha of kept words) by id."""
    seen, out = set(), collections.defaultdict(list)
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or "")):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            if key in seen:
                gone[s:s + length] = [True] * length
            seen.add(key)
        out[i].append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def scores(docs, levels, weight=0.25):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    one, two = collections.Counter(), collections.Counter()
    rows = [(i, [None, *words(t, True), None]) for i, t in docs]
    for i, t in rows:
        if not held_out(i):
            one.update(t[1:])
            two.update(zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        plain = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t[1:]]
        score = 0.0
        for before, w, p in zip(t, t[1:], plain):
            count = max([0, *[x for x in levels if x <= two[before, w]]])
            score += math.log10(weight * count / one[before] + (1 - weight) * p) if one[before] else math.log10(p)
        out.append((i, held_out(i), len(t) - 1, sum(one[w] > 0 for w in t[1:]), n, sum(map(math.log10, plain)), score))
    return out


def fixed_spans(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def named(spans):
    return ",".join(f"{kind}:{start}:{stop}" for start, _, stop, kind in sorted(spans))


def entropy(text):
    counts = collections.Counter(text)
    return -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """Targets of sources by sharing the excess anew until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, goal, live = share * sum(sizes.values()), {}, set(order)
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            goal |= {s: left * weight[s] / total for s in live}
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
        left -= sum(goal[s] for s in over)
        live -= set(over)
    return goal
