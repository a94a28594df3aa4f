"""Suffix arrays in linear grouping: Lyndon-prefix groups, then each group's order.

First suffixes are grouped by their first symbol. Groups are taken in descending order; each
suffix of a group points to the nearest earlier one of a lower group, and the suffixes so
pointed at move to new groups right behind their own, by how often they are met: that puts
the group's prefix behind theirs. In the end a group holds the suffixes with one Lyndon
prefix. The second pass walks the order from the smallest suffix and places, along the
pointers, whatever is next in its group, so no group is ever renamed or sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Order of all suffixes; the last symbol must be the smallest and occur once."""
    n = len(symbols)
    if n == 0:
        return []
    values = np.asarray(symbols)
    order = np.argsort(values, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(values[order]) != 0)).tolist() + [n]
    group = [0] * n
    members: list[list[int]] = []
    flat = order.tolist()
    for g, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        members.append(flat[a:b])
        for i in members[g]:
            group[i] = g
    before = list(range(-1, len(members) - 1))
    after = [*range(1, len(members)), -1]
    smaller = _group(group, members, before, after)
    return _emit(group, members, after, smaller)


def _group(group: list[int], members: list[list[int]], before: list[int], after: list[int]) -> list[int]:
    n = len(group)
    smaller, done = [-1] * n, [False] * n
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        for i in own:
            done[i] = True
        met: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        if met:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in met.items():
                moved.setdefault((-times, group[j]), []).append(j)
            for (_, old), rows in sorted(moved.items()) if len(moved) > 1 else moved.items():
                new = len(members)
                rows.sort()
                members.append(rows)
                for j in rows:
                    group[j] = new
                nxt = after[old]
                before.append(old)
                after.append(nxt)
                after[old] = new
                if nxt >= 0:
                    before[nxt] = new
        now = before[now]
    return smaller


def _emit(group: list[int], members: list[list[int]], after: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    place, at, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = after[g]
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    place[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = smaller[j]
    return out
