"""Suffix order of an integer sequence by Lyndon groups.

The longest Lyndon prefix of a suffix ends where its next smaller suffix begins. Suffixes
with equal Lyndon prefixes form a group, and groups sort as their prefixes do. Groups start
as the classes of the first symbol and are final in descending order: when one is reached,
each of its suffixes finds its previous smaller suffix (the nearest to the left that isn't
in a finished group, followed over the pointers of finished ones). That one's prefix grows
by this group's prefix, once for each such child, so it moves to a new group just above its
old one. Then suffixes are emitted: taken in ascending order, each suffix lets those whose
prefix ends where it begins take the next free place of their group. Nothing is ever
renamed and no step recurses.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Groups in ascending order, group of each position 1..n, prefix length per group."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    sorted_places, edges = (order + 1).tolist(), [0, *cuts.tolist(), n]
    members = [sorted_places[a:b] for a, b in zip(edges, edges[1:])]
    count = len(members)
    group_of = np.zeros(n + 1, np.int64)
    group_of[order + 1] = np.repeat(np.arange(count), np.diff(np.concatenate([[0], cuts, [n]])))
    group: list[int] = group_of.tolist()
    length = [1] * count
    below = list(range(-1, count - 1))
    above = [*range(1, count), -1]
    finished = bytearray(n + 1)
    smaller = [0] * (n + 1)
    descending: list[int] = []
    current = count - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = []
        if own:
            descending.append(current)
            grown: dict[tuple[int, int], list[int]] = {}
            for i in own:
                finished[i] = 1
            last, times = 0, 0
            for i in own:  # in text order, so children of one parent follow each other
                j = i - 1
                while finished[j]:
                    j = smaller[j]
                smaller[i] = j
                if j == last:
                    times += 1
                    continue
                if last:
                    grown.setdefault((group[last], times), []).append(last)
                last, times = j, 1
            if last:
                grown.setdefault((group[last], times), []).append(last)
            # the more children, the higher: ascending order puts each above the one before
            touched: dict[int, int] = {}
            for (old, times), moved in sorted(grown.items()) if len(grown) > 1 else grown.items():
                lower = touched.get(old, old)
                fresh = len(members)
                touched[old] = fresh
                members.append(moved)
                length.append(length[old] + times * length[current])
                higher = above[lower]
                above.append(higher)
                below.append(lower)
                above[lower] = fresh
                if higher >= 0:
                    below[higher] = fresh
                for p in moved:
                    group[p] = fresh
        current = below[current]
    return descending[::-1], group, length


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in ascending order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ascending, group, length = lyndon_groups(text)
    place = np.asarray(group[1:], np.int64)
    ends = np.arange(1, n + 1) + np.asarray(length, np.int64)[place]
    rank = np.zeros(len(length), np.int64)
    rank[ascending] = np.arange(len(ascending))
    sizes = np.bincount(rank[place], minlength=len(ascending))
    free = (np.cumsum(sizes) - sizes).tolist()
    place = rank[place].tolist()
    by_end = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by_end], np.arange(1, n + 3)).tolist()
    waiting = (by_end + 1).tolist()
    out = [0] * n
    for j in waiting[first[n] :]:  # their prefixes reach the end of the text
        at = place[j - 1]
        out[free[at]] = j
        free[at] += 1
    for k in range(n):
        i = out[k]
        a, b = first[i - 1], first[i]
        while a < b:
            j = waiting[a]
            at = place[j - 1]
            out[free[at]] = j
            free[at] += 1
            a += 1
    return np.asarray(out, np.int64) - 1
