"""Suffix sorting by Lyndon grouping, in linear time and without recursive renaming.

Phase 1 puts suffixes in groups of one Lyndon prefix each.  Groups start as the
suffixes of equal first symbol and are processed from the highest down.  Every
member of a group points to its previous smaller: the nearest suffix before it in a
lower group.  Those pointed to are lengthened by the group's prefix once for each
member that points to them, so they leave their own group for new ones right
above it, those with more pointers higher.

Phase 2 emits the order inside the groups: going through the sorted suffixes from
the smallest, the suffix just before the one at hand, and what its chain of
previous-smaller pointers reaches, are the smallest of their groups not emitted
yet; the chain ends at one that has been.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """Phase 1: groups of suffixes in ascending order, the group of each suffix (its place in
    that order), and the previous-smaller pointers (-1: none)."""
    n = len(text)
    members: list[list[int]] = []
    below: list[int] = []  # the group next below; -1: none
    above: list[int] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        if x in by_symbol:
            by_symbol[x].append(i)
        else:
            by_symbol[x] = [i]
    for g, x in enumerate(sorted(by_symbol)):
        members.append(by_symbol[x])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[x]:
            group[i] = g
    if not members:
        return [], [], []
    above[-1] = -1
    done = bytearray(len(members))
    smaller = list(range(-1, n - 1))
    g = len(members) - 1
    ordered: list[int] = []
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]  # others have left
        members[g] = own
        done[g] = 1
        ordered.append(g)
        times: dict[int, int] = {}
        for i in own:
            p = smaller[i]
            if p >= 0 and done[group[p]]:
                path = [i]
                while p >= 0 and done[group[p]]:
                    path.append(p)
                    p = smaller[p]
                smaller[i] = p
                # later searches that pass through this group go on from p
                for q in path[1:]:
                    if group[q] == g:
                        smaller[q] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            new: dict[tuple[int, int], int] = {}
            if len(times) == 1:
                levels = [(0, list(times))]
            else:
                by_times: dict[int, list[int]] = {}
                for p, t in times.items():
                    if t in by_times:
                        by_times[t].append(p)
                    else:
                        by_times[t] = [p]
                levels = sorted(by_times.items(), reverse=True)
            for t, points in levels:
                for p in points:
                    h = group[p]
                    key = (h, t)
                    k = new.get(key)
                    if k is None:
                        k = new[key] = len(members)
                        members.append([])
                        done.append(0)
                        up = above[h]
                        below.append(h)
                        above.append(up)
                        above[h] = k
                        below[up] = k  # there is one above: the group at hand is higher than h
                    members[k].append(p)
                    group[p] = k
        g = below[g]
    ordered.reverse()
    full = [g for g in ordered if members[g]]
    place = {g: k for k, g in enumerate(full)}
    return [members[g] for g in full], [place[x] for x in group], smaller


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order.  Symbols are compared as they are;
    the end counts as smaller than any symbol."""
    n = len(text)
    groups, group, smaller = lyndon_groups(text)
    free, at = [], 0  # where each group's next suffix goes
    for own in groups:
        free.append(at)
        at += len(own)
    out = [-1] * n
    placed = bytearray(n)

    def chain(i: int) -> None:
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = smaller[i]

    chain(n - 1)  # the empty suffix at the end is the smallest of all
    for k in range(n):
        chain(out[k] - 1)
    return out
