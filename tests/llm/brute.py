"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lower(text: str) -> str:
    return text.encode().lower().decode()


def shingles(text: str | None) -> set:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def licenses(text: str | None) -> tuple:
    w, starts, labels = LICENSE_WORD.findall(lower(text or "")), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def secrets(text: str | None) -> tuple:
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(spans.encode()).hexdigest(), spans


def license_labels(text: str, phrases: dict, templates: dict, coverage: float, drift: int) -> tuple[str, float]:
    """Labels and score: for each phrase or template, every diagonal with a common word pair, the words that agree on it, and neighbours added up."""
    w = LICENSE_WORD.findall(lower(text))
    labels, best = set(), 0.0
    for words, label, base in [*((p.split(), x, True) for p, x in phrases.items()), *((p.split(), x, False) for p, x in templates.items())]:
        m, agree = len(words), {}
        for d in range(-m, len(w)):
            pairs = any(0 <= d + i and d + i + 1 < len(w) and w[d + i : d + i + 2] == words[i : i + 2] for i in range(m - 1))
            if pairs:
                agree[d] = sum(0 <= d + i < len(w) and w[d + i] == words[i] for i in range(m))
        groups = []
        for d in sorted(agree):
            if not groups or d - groups[-1][-1] > drift:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            share = max(agree[d] for d in g) / m if base else min(1.0, sum(agree[d] for d in g) / m)
            best = max(best, share)
            if (base and any(agree[d] == m for d in g)) or (not base and share >= coverage):
                labels.add(label)
    return ",".join(sorted(labels)), round(best, 9)


def random_spans(text: str | None, window: int, thresholds: dict[str, float], allowed: list[str]) -> list[tuple[int, int]]:
    """Candidates in which some window reaches the entropy of their class, each window counted anew."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
        s = m[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(p, s) for p in allowed):
            continue
        least = thresholds["hex" if re.fullmatch("[0-9a-fA-F]+", s) else "base64"]
        if any(round(-sum(n / window * math.log2(n / window) for n in Counter(s[i : i + window]).values()), 9) >= least for i in range(len(s) - window + 1)):
            out.append(m.span())
    return out


def words_once(texts: dict[int, str | None], window: int = 50) -> dict[int, list[str]]:
    """The words of each text that are in no window of words that stands in an earlier text, or earlier in its own."""
    seen, left = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        left[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return left


def edit_distance_within(item: str, text: str) -> int:
    """Least edits between ``item`` and any part of ``text``, by the whole matrix."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def sections(text: str, tokens: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """Line, start, end, tokens and crossing tokens; a token goes where most of its characters are, else to the earlier line."""
    lines, at = [], 0
    while True:
        end = text.find("\n", at) + 1
        if not end or end == len(text):
            lines.append((at, len(text)))
            break
        lines.append((at, end))
        at = end
    line_of = [k for k, (s, e) in enumerate(lines) for _ in range(s, e)]
    char_of = [c for c, x in enumerate(text) for _ in x.encode()]
    counts, crossing, b = [0] * len(lines), [0] * len(lines), 0
    for t in tokens:
        held = Counter(line_of[c] for c in dict.fromkeys(char_of[b : b + len(t)]))
        owner = min(held, key=lambda k: (-held[k], k))
        counts[owner] += 1
        crossing[owner] += len(held) > 1
        b += len(t)
    return [(k, s, e, counts[k], crossing[k]) for k, (s, e) in enumerate(lines)]


def quality_features(text: str, bits: int) -> dict[int, float]:
    """Words and runs of punctuation, alone, in pairs, and the same again at distance 1 or 2, hashed; index 0 is the intercept."""
    mix, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", text)]
    grams = h + [(a * mix & full) ^ b for a, b in zip(h, h[1:], strict=False)]
    grams += [d * mix & full for d in (1, 2) for a, b in zip(h, h[d:], strict=False) if a == b]
    counts = Counter(1 + (g >> (64 - bits)) for g in grams)
    return {0: 1.0} | {i: math.sqrt(n / len(grams)) for i, n in counts.items()}


def ftrl(rows: list[tuple[dict[int, float], int]], passes: int, alpha: float, beta: float, l1: float, l2: float) -> dict[int, float]:
    """Weights by follow-the-regularised-leader, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def toxicity_features(text: str, fixed: set, learned: set, you: set, disguises: dict, near: int) -> list[float]:
    words, known = re.findall(r"\w+", text.lower()), fixed | learned
    n, raw = max(len(words), 1), text.encode()
    size = max(len(raw), 1)
    close = sum(w in known and any(v in you for v in words[max(0, i - near) : i + near + 1]) for i, w in enumerate(words))
    capitals = sum(65 <= b <= 90 for b in raw)
    marks = sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    hidden = re.findall(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+", text.lower())
    a, b = sum(w in fixed for w in words), sum(w in learned for w in words)
    return [100 * a / n, 100 * b / n, a, b, 100 * close / n, 100 * sum(w in you for w in words) / n, capitals / size, float(capitals / size > 0.3), marks / size, raw.count(b"!") / size, len(hidden) / n, sum(h.translate(disguises) in known for h in hidden), len(words) ** 0.25]
