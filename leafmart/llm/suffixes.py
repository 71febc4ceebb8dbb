"""Suffix arrays by Larsson-Sadakane refinement, which operator 4 uses, and common prefixes by Kasai's rule, both in numpy."""

from __future__ import annotations

import numpy as np


def refine(keys: np.ndarray, depth: int | None = None, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of a sequence whose symbols have the integer ranks `keys`.

    Groups of equal prefixes are refined by the ranks `step`, 2 `step`, ... symbols further on; only groups of more than one
    suffix are sorted again. With `depth`, refinement ends when groups agree in that many symbols, and equal suffixes share a
    rank. `step` is the number of symbols that a key stands for.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.ones(n, bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    heads = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    h = step
    while depth is None or h < depth:
        alone = first.copy()
        alone[:-1] &= first[1:]
        at = np.flatnonzero(~alone)  # places of groups that are not yet single
        if len(at) == 0 or h >= n:
            break
        some = order[at]
        after = np.full(len(some), -1, np.int64)
        inside = some + h < n
        after[inside] = rank[some[inside] + h]
        key = rank[some] * (n + 1) + after + 1
        turn = np.argsort(key, kind="stable")
        some, key = some[turn], key[turn]
        order[at] = some
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first[at] = new
        head = np.flatnonzero(new)
        rank[some] = np.repeat(at[head], np.diff(np.append(head, len(at))))
        h *= 2
    return order, rank


def byte_keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end counts as zeros."""
    padded = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + len(data)]
    return key


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the suffix array, at most `limit` (Kasai's rule).

    Going through the text from left to right, the length falls by one at most from a place to the next. The text is cut into
    lanes that go forward together; each lane starts from nothing.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((data.astype(np.int16), np.full(limit + 1, -1, np.int16)))
    width = -(-n // lanes)
    place = np.arange(0, n, width, dtype=np.int64)
    length = np.zeros(len(place), np.int64)
    out = np.zeros(n, np.int64)
    for _ in range(width):
        live = np.flatnonzero(place < n)
        p = place[live]
        b = before[p]
        at = np.where(b < 0, 0, length[live])
        grow = np.flatnonzero((b >= 0) & (at < limit))
        while len(grow):
            x, y = p[grow] + at[grow], b[grow] + at[grow]
            same = (padded[x] == padded[y]) & (x < n) & (y < n)
            grow = grow[same]
            at[grow] += 1
            grow = grow[at[grow] < limit]
        out[p] = at
        length[live] = np.maximum(at - 1, 0)
        place += 1
        if len(live) < len(place):
            place, length = place[live], length[live]
    return out[order]
