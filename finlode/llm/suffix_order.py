"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group's order is emitted."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start places of all suffixes of ``text`` in ascending order; symbols are integers above 0.

    First suffixes are put in groups by their first symbol. Groups are taken in descending order. Each suffix of a group
    points to the nearest suffix before it that is in a lower group, its previous smaller one. A suffix pointed to so
    many times has that many copies of the group's prefix after its own, so it moves to a new group just above those
    that stay, more copies above fewer. At the end a group holds the suffixes with one longest Lyndon prefix.

    Then the order is emitted from the smallest suffix on: once a suffix has its place, the suffixes whose Lyndon prefix
    it follows, found along the pointers from the one before it, get the next places of their groups. No names are
    given anew and nothing is sorted again.
    """
    n = len(text) + 1
    symbols = [*text, 0]  # the end is smaller than any symbol
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    order = sorted(by_symbol)
    members = [by_symbol[c] for c in order]
    number = {c: k for k, c in enumerate(order)}
    group = [number[c] for c in symbols]
    below = list(range(-1, len(order) - 1))  # each group's next lower one
    above = [*range(1, len(order)), -1]
    done = bytearray(n)  # of suffixes in the current group or above
    previous = [-1] * n
    jump = [i - 1 for i in range(n)]  # towards the previous smaller suffix, shortened on the way
    now = len(order) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            j = jump[i]
            if j >= 0 and done[j]:
                path = [i]
                while j >= 0 and done[j]:
                    path.append(j)
                    j = jump[j]
                for x in path:
                    jump[x] = j
            previous[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        members[now] = own
        if count:
            # those with more copies are moved first, so those moved later come to lie between them and what stays;
            # counts add up to the group's size, so there are at most about the root of it to sort
            levels: dict[int, dict[int, list[int]]] = {}
            for j, c in count.items():
                levels.setdefault(c, {}).setdefault(group[j], []).append(j)
            for c in sorted(levels, reverse=True):
                for old, moved in levels[c].items():
                    new = len(members)
                    members.append(moved)
                    for j in moved:
                        group[j] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
        now = below[now]
    # places of the groups
    bottom = group[n - 1]
    start = [0] * len(members)
    at, g = 0, bottom
    while g >= 0:
        start[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            j = previous[j]
    return out[1:]
