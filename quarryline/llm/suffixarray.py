"""Linear-time suffix array by grouping (no recursion, no renaming).

Phase 1 sorts suffixes into groups of equal Lyndon prefix. Groups are intervals of one array, named by where they
start, so that comparing starts compares groups. The highest unprocessed group's suffixes find their previous smaller
suffix (the nearest one to the left in a lower group) by following pointers that are known already; each suffix that
is pointed at moves to a new group right above its own, further up the more often it was pointed at, for its Lyndon
prefix is now longer by that many copies of the group's. Phase 2 goes through the result in ascending order: the
suffix before each one, and those along its previous-smaller pointers, are the next of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Positions of the suffixes of an integer sequence in ascending order (an end counts as below every symbol)."""
    n = len(symbols)
    if n == 0:
        return []
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    group_np = np.empty(n, np.int64)
    group_np[order] = starts[np.cumsum(new) - 1]
    at_np = np.empty(n, np.int64)
    at_np[order] = np.arange(n)
    size_np = np.zeros(n, np.int64)
    size_np[starts] = np.diff(np.concatenate((starts, [n])))
    sa, at, group, size = order.tolist(), at_np.tolist(), group_np.tolist(), size_np.tolist()
    prev = [-1] * n
    end = n
    while end:
        g = group[sa[end - 1]]
        if end - g == 1:  # the common case: a group of one
            i = sa[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            end = g
            if j >= 0:
                h = group[j]
                s = size[h]
                if s > 1:
                    last, p = h + s - 1, at[j]
                    q = sa[last]
                    sa[p], at[q] = q, p
                    sa[last], at[j] = j, last
                    size[h] = s - 1
                    group[j] = last
                    size[last] = 1
            continue
        count: dict[int, int] = {}
        for i in sorted(sa[g:end]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        end = g
        if not count:
            continue
        by: dict[tuple[int, int], list[int]] = {}
        for j, c in count.items():
            by.setdefault((-c, group[j]), []).append(j)
        for c, h in sorted(by):
            members = by[c, h]
            top = h + size[h]
            for j in members:
                top -= 1
                p, q = at[j], sa[top]
                sa[p], at[q] = q, p
                sa[top], at[j] = j, top
            size[h] -= len(members)
            for j in members:
                group[j] = top
            size[top] = len(members)
    out, nxt, placed = [-1] * n, list(range(n)), bytearray(n)
    j = n - 1
    i = -1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = prev[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
