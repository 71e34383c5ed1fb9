"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def components(n, pairs):
    """Least member reachable from each of n nodes."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            if root[a] != least or root[b] != least:
                root[a] = root[b] = least
                changed = True
    return root


def simhash(text, shingle=3):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def simhash_roots(rows, shingle=3, max_bits=2):
    prints = [simhash(t, shingle) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= max_bits]
    return prints, components(len(rows), pairs)


def simhash_groups(rows, shingle=3, max_bits=2):
    """rows: (doc_id, text). (fingerprint hex, component id) of each row."""
    prints, root = simhash_roots(rows, shingle, max_bits)
    ids = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        ids[r] += [i] if i is not None else []
    return [(f"{p:016x}", min(ids[r], default=None)) for p, r in zip(prints, root)]


def dedup_lines(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text). (kept text, lines, dropped) of each row."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(ASCII_LOWER)
    found = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                found[k].append(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in found.items() if len(set(v)) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def dedup_spans(rows, cut, sentences, min_words, across=True):
    """rows: (doc_id, text) with distinct ids; cut: a text's sentences. Kept
    text of each row: of the shortest runs from and to every sentence with
    enough sentences and words the first stays whole, others go."""
    cuts = [cut(t or "") for _, t in rows]
    found = defaultdict(set)
    for (i, _), parts in zip(rows, cuts):
        w = [words(u.translate(ASCII_LOWER)) for u in parts]
        at = [k for k, x in enumerate(w) if x]
        enough = lambda a, b: b - a >= sentences and sum(len(w[k]) for k in at[a:b]) >= min_words
        runs = set()
        for a in range(len(at)):
            runs.add((a, next((b for b in range(a + 1, len(at) + 1) if enough(a, b)), None)))
            runs.add((next((x for x in range(a, -1, -1) if enough(x, a + 1)), None), a + 1))
        for a, b in runs:
            if a is not None and b is not None:
                found[tuple(" ".join(w[k]) for k in at[a:b])].add((i, at[a], at[b - 1] + 1))
    gone = defaultdict(set)
    for places in found.values():
        first = min(places)
        if across and max(places)[0] == first[0]:
            continue
        for i, a, b in places - {first}:
            gone[i].update(k for k in range(a, b) if i != first[0] or k >= first[2])
    return ["".join(u for k, u in enumerate(parts) if k not in gone[i]) for (i, _), parts in zip(rows, cuts)]


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, t = words(text), text or ""
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    count, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def uniform(doc_id, seed=42):
    h = hashlib.md5(f"{'' if doc_id is None else doc_id}:{seed}".encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / 2 ** 52


def mix(rows, source_weights=(5, 2, 1), budget=1.5, max_epochs=2.0):
    """rows: (doc_id, text, source) with distinct ids. doc_id -> (size,
    source_size, target, copies)."""
    def weight(t):
        t = t or ""
        return max(0.05, 1 - 4 * (sum(t.count(c) for c in "#*$%&|<>") / max(len(t), 1)))

    size = {i: len(words(t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    w = {s: source_weights[k % len(source_weights)] for k, s in enumerate(sources)}
    target, open_ = {s: 0.0 for s in sources}, set(sources)
    left = budget * sum(total.values())
    while open_ and left > 1e-9:  # share, stop at the cap, share the excess again
        each = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += each * w[s]
            if target[s] >= max_epochs * total[s] - 1e-9:
                left += target[s] - max_epochs * total[s]
                target[s] = max_epochs * total[s]
                open_.discard(s)
    out = {}
    for s in sources:
        epochs = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        mine = sorted((-math.log(uniform(i)) / weight(t), i) for i, t, x in rows if x == s)
        for _, i in mine:
            end = before + size[i]
            chosen = before < rest and end - rest <= rest - before
            out[i] = (size[i], total[s], target[s], epochs + chosen)
            before = end
    return out


def cosine_links(rows, threshold=0.93):
    """rows: (vec_id, embedding, label). (n_links, component id) of each row."""
    def usable(e, label):
        return label is not None and e is not None and len(e) and all(v is not None and math.isfinite(v) for v in e) and any(e)

    x = [np.array(e, dtype=float) if usable(e, label) else None for _, e, label in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    pairs.append((i, j))
    root = components(len(rows), pairs)
    n = Counter(k for p in pairs for k in p)
    ids = defaultdict(list)
    for r, row in zip(root, rows):
        ids[r] += [row[0]] if row[0] is not None else []
    return [(n[i], min(ids[r], default=None)) for i, r in enumerate(root)]


def shard_of(key, tree):
    """The shard of a key in a tree of regions of racks of (shard, weight)."""
    def least(level, children):  # (child number, weight, what is below)
        def draw(number, weight):
            h = hashlib.md5(f"{'' if key is None else key}:{level}:{number}".encode()).hexdigest()
            return -math.log((int(h[:13], 16) + 0.5) / 2 ** 52) / weight
        return min(children, key=lambda c: (draw(c[0], c[1]), c[0]))

    weight = lambda racks: sum(w for rack in racks for _, w in rack)
    n, regions = 0, []
    for r, region in enumerate(tree):
        regions.append((r, weight(region), [(n + k, weight([rack]), rack) for k, rack in enumerate(region)]))
        n += len(region)
    rack = least(2, least(1, regions)[2])[2]
    return least(3, [(s, w, None) for s, w in rack])[0]
