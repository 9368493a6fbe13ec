"""Suffix arrays by grouping suffixes on their Lyndon prefixes (Baier 2016, linear, not recursive)."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Suffix array of integer ``symbols``, whose last one is unique and the smallest.

    Phase 1 refines groups of suffixes, held as ranges of an array, from the highest group down. When
    a group is reached, each of its suffixes finds the previous suffix of a smaller group; that
    suffix's Lyndon prefix takes in the group's, once for each suffix that points to it, so it moves
    to the end of its own group: further up, the more pointers it got. Phase 2 goes through the groups
    in ascending order: each suffix that is placed puts the one before it, and then the chain of
    previous smaller suffixes, next in their groups. Nothing is renamed and nothing recurses.
    """
    n = len(symbols)
    if n == 0:
        return []
    order = np.argsort(symbols, kind="stable")
    ordered = np.asarray(symbols)[order]
    first = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    sizes = np.diff(np.r_[first, n])
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    head = np.empty(n, np.int64)
    head[order] = np.repeat(first, sizes)
    width = np.zeros(n, np.int64)
    width[first] = sizes
    sa, isa, group, size = order.tolist(), at.tolist(), head.tolist(), width.tolist()
    prev = [-1] * n

    end = n
    while end > 0:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                k = size[g] - 1
                if k:
                    size[g] = k
                    top = g + k
                    x, p = sa[top], isa[j]
                    sa[p] = x
                    isa[x] = p
                    sa[top] = j
                    isa[j] = group[j] = top
                    size[top] = 1
        else:
            pointers: dict[int, int] = {}
            for i in sorted(sa[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    pointers[j] = pointers.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, c in pointers.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for j in by_count[c]:
                    g = group[j]
                    size[g] -= 1
                    top = g + size[g]
                    x, p = sa[top], isa[j]
                    sa[p] = x
                    isa[x] = p
                    sa[top] = j
                    isa[j] = top
                    moved[g] = moved.get(g, 0) + 1
                for g, m in moved.items():
                    new = g + size[g]
                    size[new] = m
                    if new != g:
                        for x in range(new, new + m):
                            group[sa[x]] = new
        end = start

    out, filled, placed = [0] * n, [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            j = prev[j]
    return out
