"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes, then emitted group by group."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start places of all suffixes of ``text`` in lexicographic order (a suffix comes before what it begins).

    First, groups of suffixes with a common prefix are handled from the highest down. The previous smaller place of a member is the nearest
    place before it whose group is lower; that place's prefix grows by the group's prefix, once per member that points to it, so such
    places move to new groups just above their own, more members higher. At the end a group is the suffixes with one Lyndon prefix.
    Second, the order is read off from the lowest suffix on: behind each suffix come the places whose Lyndon prefix ends there, found by
    following the pointers, and each takes the next free slot of its group. Nothing is renamed and nothing recurs.
    """
    n = len(text)
    if not n:
        return []
    letters = sorted(set(text))
    number = {c: i for i, c in enumerate(letters)}
    group = [number[c] for c in text]                # group of each place
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(letters) - 1))        # the next lower group of each group, and the next higher one
    above = list(range(1, len(letters) + 1))
    size = [len(m) for m in members]
    before = [-1] * n                                # previous smaller place
    skip = list(range(-1, n - 1))                    # the place to look at next, over places of higher groups
    done = bytearray(n)
    order = []                                       # groups from the highest down
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        order.append(g)
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            j = skip[i]
            while j >= 0 and done[j]:
                nxt = skip[j]
                if nxt >= 0 and done[nxt]:
                    skip[j] = skip[nxt]
                j = nxt
            skip[i] = before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            moves.setdefault(group[j], {}).setdefault(times, []).append(j)
        for h, by_times in moves.items():
            if len(by_times) == 1 and len(next(iter(by_times.values()))) == size[h]:
                continue                             # the whole group grows alike: it stays
            top, last = above[h], h
            for times in sorted(by_times):
                some, new = by_times[times], len(members)
                members.append(some)
                size.append(len(some))
                size[h] -= len(some)
                below.append(last)
                above.append(top)
                above[last] = new
                for j in some:
                    group[j] = new
                last = new
            below[top] = last
        g = below[g]
    slot = [0] * len(members)
    at = 0
    for g in reversed(order):
        slot[g] = at
        at += len(members[g])
    out = [-1] * n
    placed = bytearray(n)

    def follow(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = 1
            j = before[j]

    follow(n - 1)
    for k in range(n):
        follow(out[k] - 1)
    return out

