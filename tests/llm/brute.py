"""Plain-Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def phrases(docs: list[tuple[int, str | None]], k: int = 13) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def factors(docs: list[tuple[int, str | None]], k: int = 13) -> dict[int, list[tuple]]:
    """Greedy factors (start, words, reference, its start), each extended while the copy in the reference goes on."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, tuple[int, int]] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), (d, i))
    out: dict[int, list[tuple]] = {}
    for d, w in words.items():
        found = [first[tuple(w[i : i + k])] for i in range(len(w) - k + 1)]
        out[d], i = [], 0
        while i < len(found):
            ref, at = found[i]
            n = 1
            while ref < d and i + n < len(found) and found[i + n] == (ref, at + n):
                n += 1
            if ref < d:
                out[d].append((i, n + k - 1, ref, at))
            i += n
    return out


def repeated_bytes(docs: list[tuple[int, str | None]], width: int = 400) -> dict[int, tuple]:
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        spans = len([x for x in bytes(gone).split(b"\x00") if x])
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def shingles(t: str | None) -> frozenset:
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t: str | None) -> list[str]:
    return [w.translate(LOWER) for w in TERM.findall(t or "")]


def ranked(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], top: int = 10) -> list[tuple]:
    """(item, rank, document, score); items that repeat id and text once."""
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in {i for i in items if i[1] is not None}:
        scores = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 8 * m)) for x in set(terms(text)) if x in b)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def bucket_counts(t: str | None) -> tuple[int, Counter]:
    w = terms(t)
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def drawn(docs: list[tuple[int, str | None]], target: list[str | None], percent: int = 5) -> dict[int, tuple]:
    """n_features, weight, score and rank by id (ids are distinct)."""
    bags = {d: bucket_counts(t) for d, t in docs}
    s, t = sum((b for _, b in bags.values()), Counter()), sum((bucket_counts(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (all_s + 10_000) / ((s[x] + 1) * (all_t + 10_000)))) for x in s}
    out = {}
    for d, (_, bag) in bags.items():
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] * c for x, c in bag.items())
        out[d] = (sum(bag.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((d for d, (n, _) in bags.items() if n >= 20), key=lambda d: (-out[d][2], d))
    rank = {d: i + 1 for i, d in enumerate(able[: percent * len(able) // 100])}
    return {d: (*v, rank.get(d)) for d, v in out.items()}


_PLAIN = re.compile(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
_LATIN = {c: c + 32 for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7}


def _grams(words: list[str], k: int = 3) -> set[tuple]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], least: float = 0.6) -> dict[tuple, tuple]:
    """(score, overlaps) of the best passage, and all passages as good, by document and item: every item against every passage."""

    def cut(t: str | None) -> list[str]:
        return [w.translate(_LATIN) for w in _PLAIN.findall(t or "")]

    bags = [(i, t.strip(), cut(t)) for i, t in items if cut(t)]
    n, mean, df = len(bags), sum(len(w) for *_, w in bags) / len(bags), Counter(x for *_, w in bags for x in set(w))
    widths, out = {}, {}
    for *_, w in bags:
        size = next(s for s in (256 * 4**c for c in range(20)) if len(w) <= s)
        widths[size] = max(widths.get(size, 0), len(w))
    for item, text, w in bags:
        weight = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, tf in Counter(w).items()}
        stop = re.search(r"\n|[.?!](?=\s)", text)
        half = (len(text.split()) + 1) // 2
        question, answer = (text[: stop.end()], text[stop.end() :]) if stop else (" ".join(text.split()[:half]), " ".join(text.split()[half:]) or text)
        question, answer = _grams(cut(question)), _grams(cut(answer))
        width = next(widths[s] for s in sorted(widths) if len(w) <= s)
        for d, t in docs:
            words = cut(t)
            for passage, start in enumerate(range(0, len(words), width)):
                part = words[start : start + 2 * width]
                score = sum(weight[x] for x in weight.keys() & set(part)) / sum(weight.values())
                if score < least:
                    continue
                have = _grams(part, 1) | _grams(part, 2) | _grams(part, 3)
                shares = tuple(len(g & have) / len(g) if g else 0.0 for g in (question, answer))
                key = tuple(round(x, 9) for x in (score, *shares))
                if min(shares) >= least:
                    best, passages = out.get((d, item), ((0.0,), []))
                    if key >= best:
                        out[d, item] = (key, [*passages, passage] if key == best else [passage])
    return out
