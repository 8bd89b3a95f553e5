"""Suffix arrays by linear grouping, for many small texts at once.

A text is a row of pieces, each after a separator that is smaller than any byte.
Suffixes end at their piece. Two phases, in numpy, one group per text and step,
all texts in step:

1. Suffixes are grouped by their Lyndon prefix. Groups start as first bytes and
   are processed in descending order. Each member's previous-smaller pointer goes
   to the nearest position before it in a lower group, found by following known
   pointers. The positions pointed to are moved, by how many members point there,
   to new groups right behind their old one.
2. Groups are emitted in ascending order. A member continues, after its Lyndon
   prefix, with a suffix of the same group (so many times) and then with one of
   a lower group, whose place is known: sorting by these two orders the group.
   No group is renamed and sorted again.

Every position is a group member once and moves at most as often as it has
children in the pointer tree; the number of steps is the largest number of groups
of one text. Texts of like size should be taken together.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the number of the range of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes), owner


def suffix_order(data: np.ndarray, separator: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Positions by text and suffix; separators come first in each text.

    ``data``: bytes; ``separator``: where a separator stands instead; ``text``: the
    number of the text of each position, ascending; each text starts with a separator.
    """
    n = len(data)
    first = data.astype(np.int32) + 1
    first[separator] = 0
    key = text.astype(np.int32) * 257 + first
    order = np.argsort(key, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    sorted_key = key[order]
    begins = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    starts = np.flatnonzero(begins)
    group = np.empty(n + 1, np.int32)
    group[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    group[n] = -1
    size = np.zeros(n, np.int32)
    size[starts] = np.diff(np.r_[starts, n])
    ends = np.cumsum(np.bincount(text, minlength=texts))
    stops = ends - np.bincount(text, minlength=texts) + np.bincount(text[separator], minlength=texts)

    before = np.arange(-1, n - 1, dtype=np.int32)
    last = np.arange(n, dtype=np.int32)
    moved = np.zeros(n, bool)
    at = ends.copy()
    active = np.flatnonzero(at > stops)
    while len(active):
        high = at[active]
        low = group[order[high - 1]]
        where, owner = ranges(low, high - low)
        member, own = order[where], low[owner]
        pointer = member - 1
        todo = np.flatnonzero(group[pointer] >= own)
        while len(todo):
            pointer[todo] = before[pointer[todo]]
            todo = todo[group[pointer[todo]] >= own[todo]]
        before[member] = pointer
        inner = ~separator[pointer]
        parent, reach = pointer[inner], last[member[inner]]
        at[active] = low
        active = active[low > stops[active]]
        if not len(parent):
            continue
        by_parent = np.argsort(parent, kind="stable")
        parent, reach = parent[by_parent], reach[by_parent]
        heads = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        children = np.diff(np.r_[heads, len(parent)])
        parent = parent[heads]
        last[parent] = np.maximum(last[parent], np.maximum.reduceat(reach, heads))
        old = group[parent]
        by_group = np.lexsort((children, old))
        parent, children, old = parent[by_group], children[by_group], old[by_group]
        heads = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        count = np.diff(np.r_[heads, len(old)])
        zone = np.repeat(old[heads] + size[old[heads]] - count, count)  # the group's end takes what moves
        target = zone + np.arange(len(old)) - np.repeat(heads, count)
        moved[parent] = True
        occupant = order[target]
        stays = occupant[~moved[occupant]]
        freed = place[parent]
        freed = freed[freed < zone]
        order[freed], place[stays] = stays, freed
        order[target], place[parent] = parent, target
        moved[parent] = False
        size[old[heads]] -= count
        subset = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (children[1:] != children[:-1])])
        number = np.diff(np.r_[subset, len(old)])
        size[target[subset]] = number
        group[parent] = np.repeat(target[subset], number)

    following = last + 1
    rank = np.full(n + 1, -1, np.int32)
    at = stops.copy()
    active = np.flatnonzero(at < ends)
    while len(active):
        low = at[active]
        high = low + size[low]
        where, owner = ranges(low, high - low)
        member, own = order[where], low[owner]
        then, times = following[member], np.zeros(len(member), np.int64)
        todo = np.flatnonzero(group[then] == own)
        while len(todo):
            times[todo] += 1
            then[todo] = following[then[todo]]
            todo = todo[group[then[todo]] == own[todo]]
        known = rank[then]
        by = np.lexsort((known, times, owner))
        sorted_ = member[by]
        known, times, owner = known[by], times[by], owner[by]
        heads = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (times[1:] != times[:-1]) | (owner[1:] != owner[:-1])])
        order[where] = sorted_
        rank[sorted_] = np.repeat(where[heads], np.diff(np.r_[heads, len(sorted_)]))  # equal suffixes share a rank
        at[active] = high
        active = active[high < ends[active]]
    return order
