"""Plain versions of the operators' rules, for small data."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    w, s = words(text), text or ""
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    count, inside = Counter(grams), [False] * len(w)
    for j, g in enumerate(grams):
        if count[g] > 1:
            inside[j : j + 5] = [True] * 5
    seen, repeated = set(), 0
    for line in s.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), repeated, sum(inside)


def coverage(text, n):
    """Share of word characters inside n-grams found twice or more."""
    w = words(text)
    grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
    count, inside = Counter(grams), [False] * len(w)
    for j, g in enumerate(grams):
        if count[g] > 1:
            inside[j : j + n] = [True] * n
    return sum(len(x) for x, i in zip(w, inside, strict=True) if i) / max(sum(map(len, w)), 1)


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(values, radius=3):
    """Of (id, fingerprint) rows: the smallest id reachable (ids may be None)."""
    prints = sorted({f for _, f in values})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in values:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [least.get(root(f)) for _, f in values]


def near_component_ids(rows, n=5, least=0.8):
    """Of (id, text): the smallest id reachable over pairs of similar n-word shingle sets; texts of fewer words must be equal."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or {tuple(w)})
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]


def dedup_substrings(docs, n):
    """docs: (order key, text), in order; kept text of each."""
    seen, out = set(), []
    for _, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            if k in seen:
                gone[j : j + n] = [True] * n
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """rows: (doc_id, text, source); (doc_id, source, size, source_size, target, taken) by the stated procedure."""
    sized = [(d, s, len(words(t)), int(hashlib.md5((f"text:{t or ''}" if d is None else str(d)).encode()).hexdigest()[:15], 16)) for d, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(z for _, x, z, _ in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, free, left = {}, list(sources), share * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total >= most * size[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            target[s] = most * size[s]
            free.remove(s)
        left -= sum(target[s] for s in above)
    out = []
    for s in sources:
        full = int(target[s] // size[s]) if size[s] else 0
        need, below, cut = target[s] - full * size[s], 0, -1
        mine = Counter()
        for _, x, z, h in sized:
            if x == s:
                mine[h] += z
        for h in sorted(mine):
            if below + mine[h] >= need or h == max(mine):
                cut = h if abs(below + mine[h] - need) < abs(need - below) else h - 1
                break
            below += mine[h]
        out += [(d, x, z, size[s], target[s], z * (full + (h <= cut))) for d, x, z, h in sized if x == s]
    return out


def dedup_lines(docs):
    """docs: (doc_id, text), a row each; (n_lines, n_dropped, kept text)."""
    last = 1 << 62
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (last if d is None else d))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    s = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
