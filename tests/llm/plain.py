"""Plain versions of the operators, one row at a time, to hold the Spark jobs against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def line_dedup(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or doc == min(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(rows: list[tuple[int, str | None]], width: int = 20) -> list[tuple[int, int, int, str]]:
    first: dict[tuple[str, ...], tuple[int, int]] = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            body = tuple(w[i : i + width])
            first[body] = min(first.get(body, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (doc, i):
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    w = words((text or "").translate(UPPER))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(rows: list[tuple[int, int]], most: int = 3) -> dict[int, int]:
    """Smallest id reachable, of (id, fingerprint) rows."""
    rows = sorted(rows)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= most
    ]
    return {rows[i][0]: rows[r][0] for i, r in enumerate(roots(len(rows), links))}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
