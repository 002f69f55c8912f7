"""Plain versions of the operators, for small tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import regex

_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, lower):
    raw = (text or "").encode()
    return (raw.translate(_LOW) if lower else raw).split()


def shingles(text, k=5):
    w = words(text, True)
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def least(pairs, nodes):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, percent=75):
    """doc_id -> (n_shingles, component_id) by prefix-filtered comparison of all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[frozenset(s)].append(d)
    reps = [min(v) for v in by_set.values()]
    df = defaultdict(int)
    for d in reps:
        for s in sets[d]:
            df[s] += 1
    seen, pairs = defaultdict(list), set()
    links = [(v[0], x) for v in by_set.values() for x in v[1:]]
    for d in sorted(reps, key=lambda d: len(sets[d])):
        own = sorted(sets[d], key=lambda s: (df[s], s))
        tested = set()
        for s in own[: len(own) - (-(-percent * len(own) // 100)) + 1]:
            for e in seen[s]:
                if e not in tested:
                    tested.add(e)
                    both = len(sets[d] & sets[e])
                    if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                        pairs.add((d, e))
            seen[s].append(d)
    comp = least([*links, *pairs], sets)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def repeats(docs, window=20):
    """doc_id -> (n_words, n_removed, sha256 of what is kept)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = words(t, False)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = hashlib.md5(b" ".join(w[i : i + window])).digest()
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def line_runs(docs, min_lines=2, min_words=20):
    """doc_id -> (n_lines, n_removed, maximal runs, longest run, text left)."""
    where, out, bodies = defaultdict(list), {}, {}
    for d, t in sorted(docs):
        lines = (t or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        body = bodies[d] = [lines[i].rstrip(" \t\r\x0b\x0c").strip(" ") for i in solid]
        runs = []
        for i in range(len(body)):
            n = 0
            for e, j in where[body[i]]:
                k = 0
                while i + k < len(body) and j + k < len(bodies[e]) and body[i + k] == bodies[e][j + k]:
                    k += 1
                n = max(n, k)
            where[body[i]].append((d, i))
            if n >= min_lines or n and len(body[i].split()) >= min_words:
                runs.append((i, i + n))
        gone = {solid[k] for i, j in runs for k in range(i, j)}
        most = [r for r in runs if (r[0] - 1, r[1]) not in runs]
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (len(solid), len(gone), len(most), max([j - i for i, j in runs], default=0), t if t is None or not gone else left)
    return out


def near_vectors(vectors, cosine=0.9):
    """Row by row: (vec_id, n_links, component_id), as a sorted list."""
    unit = []
    for k, (i, v) in enumerate(vectors):
        if i is None or v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        x = np.array(v, float)
        unit.append((k, i, x / np.linalg.norm(x)))
    n, pairs = defaultdict(int), []
    for dim in {len(x) for *_, x in unit}:
        own = [u for u in unit if len(u[2]) == dim]
        m = np.stack([u[2] for u in own])
        a, b = np.nonzero(np.triu(m @ m.T >= cosine, 1))
        for p, q in zip(a.tolist(), b.tolist()):
            n[own[p][0]] += 1
            n[own[q][0]] += 1
            pairs.append((own[p][1], own[q][1]))
    comp = least(pairs, {i for i, _ in vectors if i is not None})
    return sorted(((i, n[k], comp.get(i)) for k, (i, _) in enumerate(vectors)), key=lambda r: (r[0] is None, r))


def contained(docs, items, percent=75):
    sets = {i: shingles(t) for i, t in items if t}
    out = set()
    for d, t in docs:
        own = shingles(t)
        for i, s in sets.items():
            both = len(own & s)
            if s and 100 * both >= percent * len(s):
                out.add((d, i, len(s), both))
    return out


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def crc(data):
    return zlib.crc32(data)


def quality(text, model):
    """Score of a text by a fitted rule ensemble, from statistics counted here."""
    t = text or ""
    n, space = max(len(t), 1), "[ \\t\\n\\x0b\\f\\r]+"
    words = [w for w in regex.split(space, t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    count = lambda p: sum(len(m) for m in regex.findall(p, t))
    x = {
        "log_chars": math.log1p(n), "letters": count(r"\p{L}+") / n, "upper": count(r"\p{Lu}+") / n, "digits": count("[0-9]+") / n,
        "symbols": count(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'\"-]+") / n, "spaces": count(space) / n, "stops": t.count(".") / n_words,
        "word_length": (len(t) - count(space)) / n_words, "distinct_words": len(set(words)) / n_words, "distinct_lines": len(set(lines)) / n_lines,
        "line_words": math.log1p(n_words / n_lines),
    }
    v = [x[f] for f in model.features]
    total = model.bias + sum(slope * min(max(v[f], low), high) for f, slope, low, high in model.linear)
    total += sum(w for terms, w in model.rules if all((v[f] > cut) == up for f, up, cut in terms))
    return 1 / (1 + math.exp(-total))


def language(text, model, dims=1 << 13):
    """Language and cosine of the closest centroid, from n-grams counted here."""
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0
    raw, found = b" " + text.lower().encode() + b" ", defaultdict(int)
    for i in range(len(raw) - 1):
        two = (raw[i] * 257 + raw[i + 1]) % 2**32
        found[(two * 2246822519 % 2**32) >> 19] += 1
        if i + 2 < len(raw):
            three = (two * 2654435761 + raw[i + 2] * 40503) % 2**32
            found[(three * 2246822519 % 2**32) >> 19] += 1
    v = np.zeros(dims)
    for k, n in found.items():
        v[k] = math.log1p(n) * model.idf[k]
    cosine = model.centroids @ (v / np.linalg.norm(v))
    return model.languages[int(cosine.argmax())], float(cosine.max())
