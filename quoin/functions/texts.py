"""Texts put together from many pieces."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a piece by which it is looked up, pieces that are sought one by one, and bytes looked through at a time.
PARTS, FEW, STRETCH = (64, 8), 8, 1 << 20


def _windows(text: bytes, width: int) -> np.ndarray:
    """A number for each ``width`` bytes in a row, ``width`` being a power of two."""
    h, step = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), 1
    while step < width:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 ^ (step * 0x51ED2701)) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h


def _held(text: bytes, since: int, pieces: list[bytes]) -> set[bytes]:
    """Those of some pieces that occur in ``text`` and end behind ``since``: met by that part of theirs (the end, the
    start or the middle) which fewest others share, then compared whole."""
    held = {p for p in pieces if len(p) < PARTS[-1] and text.find(p, max(0, since - len(p) + 1)) >= 0}
    for width, below in zip(PARTS, (None, *PARTS)):
        some = [p for p in pieces if len(p) >= width and (below is None or len(p) < below)]
        if not some:
            continue
        parts = [[(int(_windows(p[o : o + width], width)[0]), o) for o in (len(p) - width, 0, (len(p) - width) // 2)] for p in some]
        shared = Counter(h for own in parts for h, _ in own)
        by_part: dict[int, list[tuple[bytes, int]]] = {}
        for p, own in zip(some, parts):
            h, o = min(own, key=lambda x: shared[x[0]])
            by_part.setdefault(h, []).append((p, o))
        known, marks = np.array(sorted(by_part), np.uint64), np.zeros(1 << 20, bool)
        marks[(known >> np.uint64(44)).astype(np.int64)] = True
        for at in range(max(0, since - max(map(len, some)) + 1), len(text) - width + 1, STRETCH):
            h = _windows(text[at : at + STRETCH + width - 1], width)
            hits = np.flatnonzero(marks[(h >> np.uint64(44)).astype(np.int64)])
            for i in hits[np.isin(h[hits], known)]:
                for p, o in by_part[int(h[i])]:
                    start = at + int(i) - o
                    if start >= 0 and start + len(p) > since and p not in held and text.startswith(p, start):
                        held.add(p)
    return held


def joined_once(pieces: list[str]) -> str:
    """Pieces joined by blanks, each left out if the text before it holds it.

    The second half of the pieces is looked for in what the first half added, all at once, and so on within
    the halves: every text is gone through as often as the pieces can be halved, not once a piece.
    """
    text = bytearray()

    def add(some: list[bytes]) -> None:
        if len(some) > FEW:
            half, since = len(some) // 2, len(text)
            add(some[:half])
            rest = some[half:]
            gone = _held(bytes(text[max(0, since - longest) :]), min(since, longest), rest) if len(text) > since else ()
            add([p for p in rest if p not in gone])
            return
        since = len(text)
        for p in some:
            if text and text.find(p, max(0, since - len(p) + 1)) >= 0:
                continue
            text.extend(b" " + p if text else p)

    each = list(dict.fromkeys(p.encode("utf-8", "surrogatepass") for p in pieces if p))
    longest = max(map(len, each), default=0)
    add(each)
    return text.decode("utf-8", "surrogatepass")


def pieces_joined(pieces: Column) -> Column:
    """An array of texts as one, each left out if what stands before it holds it; null if one is null."""

    def joined(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None or any(p is None for p in r) else joined_once(r))

    return F.pandas_udf(joined, "string")(pieces)
