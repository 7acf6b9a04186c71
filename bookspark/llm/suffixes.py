"""Linear-time suffix sorting by groups of Lyndon prefixes, without recursion or renaming."""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(group of each suffix, previous-smaller pointer of each suffix, groups in ascending order, their sizes).

    At first a group holds the suffixes that begin with one symbol.  Groups are closed from the highest down.  As one
    is closed, each of its suffixes points to the nearest suffix on its left that is in a lower group; what is pointed to
    begins with its own group's prefix followed by the closed group's, once for each pointer it gets, and so goes to a new group just
    above its own, higher the more pointers.  In the end suffixes share a group if they share their longest Lyndon prefix.
    """
    n = len(text)
    symbols = sorted(set(text))
    group_of = {c: g for g, c in enumerate(symbols)}
    group = [group_of[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))  # the next lower group
    back = list(range(-1, n - 1))  # candidates for the pointer; jumps over closed suffixes
    closed = bytearray(n)
    pointer = [-1] * n
    descending = []
    top = len(symbols) - 1
    higher = list(range(1, len(symbols) + 1))
    higher[-1:] = [-1]
    while top >= 0:
        descending.append(top)
        live = members[top] if size[top] == len(members[top]) else [i for i in members[top] if group[i] == top]
        if len(live) == 1:
            i = live[0]
            closed[i] = 1
            p = i - 1
            while p >= 0 and closed[p]:
                p = back[p]
            back[i] = pointer[i] = p
            if p >= 0 and size[g := group[p]] > 1:
                size[g] -= 1
                new = len(members)
                group[p] = new
                members.append([p])
                size.append(1)
                up = higher[g]
                below.append(g)
                higher.append(up)
                below[up] = new
                higher[g] = new
            members[top] = live
            top = below[top]
            continue
        for i in live:
            closed[i] = 1
        times: dict[int, int] = {}
        for i in live:
            p = i - 1
            while p >= 0 and closed[p]:
                p = back[p]
            back[i] = pointer[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                key = (k, group[p])
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            for (k, g), who in sorted(moves.items(), reverse=True) if len(moves) > 1 else moves.items():
                if len(who) == size[g]:
                    continue  # all that is left of the group: it stays where it is
                size[g] -= len(who)
                new = len(members)
                for p in who:
                    group[p] = new
                members.append(who)
                size.append(len(who))
                up = higher[g]
                below.append(g)
                higher.append(up)
                below[up] = new
                higher[g] = new
        members[top] = live
        top = below[top]
    return group, pointer, descending[::-1], size


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text (non-negative integers) in ascending order; a suffix precedes what it begins.

    With the groups made, one sweep emits all: the suffix left of each one emitted, and what its pointers lead to, go to
    the fronts of their groups in turn.
    """
    n = len(text)
    if not n:
        return []
    group, pointer, order, size = lyndon_groups(text)
    front = [0] * len(size)
    at = 0
    for g in order:
        front[g] = at
        at += size[g]
    out = [-1] * n
    placed = bytearray(n)
    k, s = -1, n
    while True:
        j = s - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = pointer[j]
        k += 1
        if k == n:
            return out
        s = out[k]
