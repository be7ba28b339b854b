"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash

from rillmark.llm import sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingle_set(text):
    w = WORD.findall(low(text))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(docs):
    sets = {d: shingle_set(text) for d, text in docs}
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def cut(docs, length=200):
    count = Counter()
    for _, text in docs:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(low(text))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in docs:
        w = ITEM_WORD.findall(low(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def tree_match(one, two, a=0, b=0):
    """Simple tree matching as in the textbook: size and pairs of the best match of two nodes."""
    from rillmark.llm.html_extract import kids_of

    left, right = kids_of(one)[a], kids_of(two)[b]
    best = {(-1, y): (0, []) for y in range(-1, len(right))} | {(x, -1): (0, []) for x in range(-1, len(left))}
    for x, k in enumerate(left):
        for y, m in enumerate(right):
            found = [best[x - 1, y], best[x, y - 1]]
            if one[k][1] == two[m][1]:
                n, pairs = tree_match(one, two, k, m)
                found.append((best[x - 1, y - 1][0] + n, best[x - 1, y - 1][1] + pairs))
            best[x, y] = max(found, key=lambda f: f[0])
    n, pairs = best[len(left) - 1, len(right) - 1]
    return n + 1, [(a, b), *pairs]


def induced(pages):
    """Texts of the pages of one host, by the definition of the wrapper: page -> text, or None where
    the wrapper doesn't say. ``pages``: (id, html)."""
    from rillmark.llm import html_extract as h

    parsed = {i: h.parse(html or "") for i, html in pages}
    no = {i: h.declared_parts(order)[0] for i, (order, _) in parsed.items()}
    said = {i: tuple(t for n, t, _ in found if not no[i][n]) for i, (_, found) in parsed.items()}
    different = {}
    for i in parsed:
        different.setdefault(said[i], i)
    shapes = Counter(tuple(parsed[i][0]) for i in different.values())
    if len(different) < h.SEVERAL:
        return dict.fromkeys(parsed)
    (wrapper, n), *others = shapes.most_common()
    assert all(m < n for _, m in others), "the test needs one most common tree"
    slot = {}
    for i, (order, _) in parsed.items():
        pairs = h.match_trees(order, list(wrapper))  # one of several best matches; tested by itself
        own = []
        for k, above in enumerate(h.parents(order)):
            own.append(pairs.get(k, own[above] if above >= 0 else 0))
        slot[i] = own, pairs
    having, count, free = Counter(), Counter(), Counter()
    for i in different.values():
        texts = {(slot[i][0][n], t): len(t) - k for n, t, k in parsed[i][1]}
        having.update({s for s, _ in texts})
        count.update(texts.keys())
        free.update(texts)
    template = {x for x, n in count.items() if n >= h.SEVERAL and 2 * n > having[x[0]]}
    varying = [0] * len(wrapper)
    for (s, t), n in free.items():
        varying[s] += 0 if (s, t) in template else n
    top, keep = h.content_slots(list(wrapper), varying, h.declared_parts(list(wrapper)))
    out = {}
    for i, (_, found) in parsed.items():
        own, pairs = slot[i]
        kept = [t for n, t, _ in found if keep[own[n]] and not no[i][n] and (own[n], t) not in template]
        out[i] = "\n".join(kept) if top in pairs.values() else None
    return out


def spark_hash(*values):
    """xxhash64 of longs (int) and ints (as a tuple of one), signed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def propagated(links, quota, rounds):
    """Balanced label propagation of nodes with one or more hubs, node by node."""
    shards = len(quota)
    nodes = sorted({n for n, _ in links}, key=lambda n: (spark_hash(n), n))
    at = {n: i % shards for i, n in enumerate(nodes)}
    seen = []
    for turn in range(rounds):
        rows = Counter(at.values())
        seen.append([rows[s] for s in range(shards)])
        room = [quota[s] - rows[s] for s in range(shards)]
        hope = [max(x, -(-quota[s] // 4)) for s, x in enumerate(room)]
        here = defaultdict(Counter)
        for n, h in links:
            here[h][at[n]] += 1
        targets = {}
        for h, own in here.items():
            left = size = sum(own.values())
            targets[h] = []
            for fits, mine, _, s in sorted(((min(size, own[s] + hope[s], quota[s]), own[s], spark_hash(h, (s,)), s) for s in range(shards)), reverse=True):
                if left > 0:
                    targets[h].append((s, max(0, min(fits, left) - mine)))
                    left -= fits
        votes = defaultdict(Counter)
        for n, h in links:
            free = sum(f for _, f in targets[h])
            to = at[n]
            if free and at[n] not in {s for s, _ in targets[h]}:
                drawn = spark_hash(n, (turn,), (1,)) % free
                for s, f in targets[h]:
                    if drawn < f:
                        to = s
                        break
                    drawn -= f
            votes[n][to] += here[h][to]
        asks = {n: to for n, v in votes.items() if (to := max((c, s) for s, c in v.items())[1]) != at[n]}
        asked = Counter((at[n], to) for n, to in asks.items())
        matrix = np.array([[asked[i, j] for j in range(shards)] for i in range(shards)])
        moves = dict(np.ndenumerate(sharding.granted(matrix, np.array(seen[-1]), np.array(quota))))
        if not any(moves.values()):
            break
        order = sorted(asks, key=lambda n: (spark_hash(n, (turn,), (2,)) % (1 << 20), n))
        goes = Counter()
        was = dict(at)
        for n in order:
            pair = was[n], asks[n]
            if goes[pair] < moves[pair]:
                goes[pair] += 1
                at[n] = asks[n]
    return at, seen


def levels(texts, order):
    """For each order the n-grams that end at a predicted byte, with how often they do; the longest
    context there is counts, so shorter ones only where a text begins."""
    longest = Counter()
    for t in texts:
        for end in range(2, len(t) + 1):
            longest[t[max(0, end - order) : end]] += 1
    return longest


def kneser_ney(texts, order=5):
    """Probability of a byte after the bytes before it, by interpolated modified Kneser-Ney; texts
    are bytes that begin and end with a space."""
    longest = levels(texts, order)
    count = {order: Counter({g: n for g, n in longest.items() if len(g) == order})}
    for o in range(order - 1, 0, -1):
        count[o] = Counter(g[1:] for g in count[o + 1])
        if o > 1:
            count[o].update({g: n for g, n in longest.items() if len(g) == o})
    cut = {}
    for o in count:
        n = [sum(c == k for c in count[o].values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        cut[o] = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    total, taken = defaultdict(Counter), defaultdict(Counter)
    for o in count:
        for g, n in count[o].items():
            total[o][g[:-1]] += n
            taken[o][g[:-1]] += cut[o][min(n, 3) - 1]

    def p(gram):
        out = 1 / 257
        for o in range(1, len(gram) + 1):
            g = gram[-o:]
            if total[o][g[:-1]]:
                n = count[o][g]
                own = (n - cut[o][min(n, 3) - 1]) / total[o][g[:-1]] if n else 0
                out = own + taken[o][g[:-1]] / total[o][g[:-1]] * out
        return out

    return lambda t: -sum(np.log(min(max(p(t[max(0, end - order) : end]), 1e-12), 1)) for end in range(2, len(t) + 1))


def witten_bell(texts, order=5):
    """The same with Witten-Bell interpolation of plain counts."""
    longest = levels(texts, order)
    count = {o: Counter() for o in range(1, order + 1)}
    for g, n in longest.items():
        for o in range(1, len(g) + 1):
            count[o][g[-o:]] += n
    total, kinds = defaultdict(Counter), defaultdict(Counter)
    for o in count:
        for g, n in count[o].items():
            total[o][g[:-1]] += n
            kinds[o][g[:-1]] += 1

    def p(gram):
        out = 1 / 257
        for o in range(1, len(gram) + 1):
            g = gram[-o:]
            all_, types = total[o][g[:-1]], kinds[o][g[:-1]]
            if all_:
                out = count[o][g] / (all_ + types) + types / (all_ + types) * out
        return out

    return lambda t: -sum(np.log(min(max(p(t[max(0, end - order) : end]), 1e-12), 1)) for end in range(2, len(t) + 1))
