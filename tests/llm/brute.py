"""The pipeline's stages by their definitions, in plain Python on a few rows."""

import hashlib
import math
import re
from collections import Counter

import xxhash

from cuewright.llm import mixing, neardup, quality, secrets

M64 = (1 << 64) - 1


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def xx(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def xx2(a, b):
    """Of two longs, the first's hash being the second's seed."""
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))


def features(text):
    h = [xx(w) for w in split(text)]
    return [x >> 48 for x in h + [xx2(a, b) for a, b in zip(h, h[1:])]]


def base_counts(text):
    """(n_words, base_failed)"""
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    return len(w), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality_verdicts(rows, trusted):
    """(score, kept) of each row (a dict with doc_id and text)."""
    raw, good = Counter(), Counter()
    found = [features(r["text"]) for r in rows]
    for r, f in zip(rows, found, strict=True):
        raw.update(f)
        if r["doc_id"] in trusted:
            good.update(f)
    scale = sum(good.values()) / max(1, sum(raw.values()))
    p = quality.PSEUDO
    weight = {b: round(1e6 * math.log((good[b] + p) / (raw[b] * scale + p))) if good else 0 for b in raw}
    out = []
    for r, f in zip(rows, found, strict=True):
        n, failed = base_counts(r["text"])
        score = sum(weight[b] for b in f) / (max(1, 2 * n - 1) * 1e6)
        out.append((score, not failed and score >= quality.MIN_SCORE))
    return out


def first_of_classes(rows):
    """Rows but for near copies; of equal rows one."""
    words = [tuple(split((r["text"] or "").lower())) for r in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    head = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= neardup.THRESHOLD * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = head[i], head[j]
                head = [a if x == b else x for x in head]
    key = lambda i: (-math.inf if rows[i]["doc_id"] is None else rows[i]["doc_id"], hashlib.md5(" ".join(words[i]).encode()).digest())
    best = {}
    for i, h in enumerate(head):
        if words[i] and (h not in best or key(i) < key(best[h])):
            best[h] = i
    return [r for i, r in enumerate(rows) if not words[i] or best[head[i]] == i]


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def without_benchmark(rows, items):
    found = set()
    for text in items:
        w = tokens(text)
        k = min(10, len(w))
        if w:
            found.update((k, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    sizes = {k for k, _ in found}
    hit = lambda w: any((k, tuple(w[i : i + k])) in found for k in sizes for i in range(len(w) - k + 1))
    return [r for r in rows if not hit(tokens(r["text"]))]


def battery(token):
    """(p_random, p_text, n, encoding) from the whole list of symbols."""
    base = token.rstrip("=")
    enc, letters = next((i, a) for i, (p, a) in enumerate(secrets.ENCODINGS) if re.search(p, base))
    x, k = [letters.index(c) for c in base], len(letters)
    n, df = len(x), k - 1
    chi = sum((c - n / k) ** 2 / (n / k) for c in Counter(x).values()) + (k - len(set(x))) * n / k
    z1 = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    up = [2 * v >= k for v in x]
    runs, u = 1 + sum(a != b for a, b in zip(up, up[1:])), sum(up)
    mu = 2 * u * (n - u) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z2 = (runs - mu) / math.sqrt(var) if var > 0 else 9.0
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    z3 = (sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / spread + 1 / n) * math.sqrt(n) if spread > 0 else 9.0
    e = k * {10: secrets.DIGIT_REPEAT, 16: secrets.HEX_REPEAT}.get(k, secrets.TEXT_REPEAT) - 1
    share = secrets.COMMON_SHARE
    common = sum(c in secrets.COMMON for c in base.lower())
    z4 = (n * share - common - 0.5) / math.sqrt(n * share * (1 - share) * secrets.COMMON_SPREAD) if k == 26 else (df + (n - 1) * e - chi) / math.sqrt(2 * df + 4 * n * e)
    tail = lambda z: max(1e-15, math.erfc(z / math.sqrt(2)) / 2)
    half = -(math.log(tail(z1)) + math.log(min(1, 2 * tail(abs(z2)))) + math.log(min(1, 2 * tail(abs(z3)))))
    return math.exp(-half) * (1 + half + half * half / 2), tail(z4), n, enc


def known_secrets(t):
    """Base spans (start, kind, end)."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def all_secrets(texts):
    """Spans (start, kind, end) of each text, the procedure taken over all."""
    base = [known_secrets(t) for t in texts]
    cands = []
    for t, known in zip(texts, base, strict=True):
        own = set()
        for pattern, _ in secrets.ENCODINGS:
            for m in re.finditer("(?a)" + pattern.removeprefix("^").removesuffix("+$") + "{20,}={0,2}", t):
                if not any(a < m.end() and m.start() < b for a, _, b in known):
                    own.add((m.start(), m.end(), *battery(m[0])))
        cands.append(own)
    edge = lambda p: math.exp(-math.floor(-math.log(p) * secrets.BINS) / secrets.BINS)
    group = lambda n, enc: (enc, min(int(math.log2(n)), 12))
    by = {}
    for own in cands:
        for _, _, _, p_text, n, enc in own:
            by.setdefault(group(n, enc), []).append(edge(p_text))
    limit = {c: max([p for p in ps if p <= secrets.FDR * sum(q <= p for q in ps) / len(ps)], default=-1.0) for c, ps in by.items()}
    out = []
    for known, own in zip(base, cands, strict=True):
        good = [(a, b) for a, b, p, q, n, enc in own if p >= secrets.ALPHA and edge(q) <= limit[group(n, enc)]]
        good = [(a, 3, b) for a, b in good if not any(x <= a and b <= y and y - x > b - a for x, y in good)]
        out.append(sorted(known + good))
    return out


def masked(text, spans):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    return secrets.MASK.join([*out, text[at:]])


def mixed(rows, rate=mixing.RATE):
    """Each row's topic, n_tokens, weight, keep_prob and kept."""
    cell, size = [], []
    for r in rows:
        t = r["text"] or ""
        cell.append((r["source"], r["lang"], next((name for name, pattern in mixing.TOPICS if re.search(pattern, t)), "prose")))
        size.append(len(split(t)))
    tokens = Counter()
    for c, n in zip(cell, size, strict=True):
        tokens[c] += n
    goals = []
    for axis in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[axis]] += n
        power = {x: n**mixing.TEMPERATURE for x, n in sums.items() if n}
        goals.append({x: v / sum(power.values()) for x, v in power.items()})
    live = {c: float(n) for c, n in tokens.items() if n}
    for _ in range(3000):
        for axis, goal in enumerate(goals):
            sums = Counter()
            for c, v in live.items():
                sums[c[axis]] += v
            live = {c: v * goal[c[axis]] / sums[c[axis]] for c, v in live.items()}
    lift = {c: v / tokens[c] for c, v in live.items()}
    want, low, high = rate * sum(tokens[c] for c in lift), 0.0, 1e30
    for _ in range(400):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(1.0, lift[c] * middle) * tokens[c] for c in lift) < want else (low, middle)
    out = []
    for r, c, n in zip(rows, cell, size, strict=True):
        p = lift.get(c, 0.0) * high
        digest = hashlib.md5("\x00".join(["mix", "" if r["doc_id"] is None else str(r["doc_id"]), r["text"] or ""]).encode()).hexdigest()
        u = int(digest[:13], 16) / (1 << 52)
        out.append({"topic": c[2], "n_tokens": n, "weight": max(1.0, p) if c in lift else 0.0, "keep_prob": min(1.0, p), "kept": u < min(1.0, p)})
    return out
