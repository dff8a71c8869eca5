"""Suffix sorting by linear grouping.

First, suffixes are grouped by their longest Lyndon prefixes. Groups are taken in
descending order; each suffix of a group points to the nearest earlier suffix of a
lower group (its previous smaller one), and the suffixes pointed to move, by how
often they are, to new groups directly above their own. Second, suffixes are emitted
in ascending order: each one places those that it directly follows, along the
pointers, at the front of their groups. No names are given twice and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def _initial(text: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Groups by the first symbol, ascending."""
    order = np.argsort(text, kind="stable")
    s = text[order]
    cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    group = np.empty(len(text), np.int64)
    group[order] = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(text))))
    return group.tolist(), [x.tolist() for x in np.split(order, cuts[1:])]


def lyndon_groups(text: np.ndarray) -> tuple[list[int], list[int], list[list[int]], list[int]]:
    """Group of each suffix, previous smaller pointers, members, and the groups in ascending order."""
    n = len(text)
    group, members = _initial(text)
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members))) + [-1]
    previous, jump, done = [-1] * n, [-1] * n, bytearray(n + 1)
    descending = []
    g = len(members) - 1
    while g >= 0:
        mine = members[g]
        if len(mine) > size[g]:
            mine = [i for i in mine if group[i] == g]
        if len(mine) > 1:
            mine.sort()
        members[g] = mine
        descending.append(g)
        times: dict[int, int] = {}
        for i in mine:
            p = i - 1
            if p >= 0 and (done[p] or group[p] == g):
                q = jump[p]
                while q >= 0 and (done[q] or group[q] == g):
                    q = jump[q]
                while p != q:
                    jump[p], p = q, jump[p]
            jump[i] = previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for i in mine:
            done[i] = 1
        if times:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moves.setdefault((-k, group[p]), []).append(p)
            for key in sorted(moves) if len(moves) > 1 else moves:
                some, h = moves[key], key[1]
                if len(some) == size[h]:
                    continue
                new = len(members)
                members.append(some)
                size.append(len(some))
                size[h] -= len(some)
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
                for p in some:
                    group[p] = new
        g = below[g]
    return group, previous, members, descending[::-1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order; an end counts as less than any symbol."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    closed = np.append(np.unique(text, return_inverse=True)[1] + 1, 0)
    group, previous, members, ascending = lyndon_groups(closed)
    front = [0] * len(members)
    at = 0
    for g in ascending:
        front[g] = at
        at += len(members[g])
    out, placed = [0] * (n + 1), bytearray(n + 1)
    out[0], placed[n] = n, 1
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)
