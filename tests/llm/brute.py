"""Plain versions of the operators' contracts, for tests only."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words, windows, places = WORD.findall(text), {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for found in windows.values():
        if len(found) > 1:
            for i in found:
                places |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple[int, int]], radius: int = 3) -> list[int]:
    """prints: (doc_id, fingerprint); the smallest doc_id reachable from each."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[a] = b
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(prints))]


def line_dedup(rows: list[tuple[int, str | None]], min_chars: int = 10) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_lines, n_dropped, kept text)."""
    first: dict[str, int] = {}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                first.setdefault(key(line), doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def ratio_tokens(text: str | None) -> list[str]:
    """Runs of letters, of digits and of other signs, for ASCII texts."""
    return re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+", text or "")


def grams(tokens: list[str], buckets: int) -> list[int]:
    """Buckets of unigrams and bigrams; a bigram's hash goes on from its first word's."""
    one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, tokens[1:], strict=False)]
    signed = [h - (1 << 64) if h >> 63 else h for h in one + two]
    return [h % buckets for h in signed]


def mean_ratios(docs: list[tuple[int, str | None]], trusted: set[int], buckets: int, smoothing: float = 1.0) -> list[float]:
    """Mean log ratio of each document, by counting all grams twice."""
    counts = [[0] * buckets, [0] * buckets]
    for i, text in docs:
        for b in grams(ratio_tokens(text), buckets):
            counts[0][b] += 1
            counts[1][b] += i in trusted
    raw, good = map(sum, counts)
    if not good:
        return [0.0] * len(docs)
    ratio = [math.log((g + smoothing) / (good + smoothing * buckets)) - math.log((r + smoothing) / (raw + smoothing * buckets)) for r, g in zip(*counts, strict=True)]
    return [sum(ratio[b] for b in found) / len(found) if (found := grams(ratio_tokens(t), buckets)) else 0.0 for _, t in docs]
