"""Suffix array by linear grouping: no recursion and no renaming."""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in order.

    First phase: suffixes are grouped by first byte; groups, highest first, push the
    suffixes just before them into groups of their own. ``before[s]`` is the nearest
    earlier suffix of a lower group; those found for a group are parted by how many of
    its members they precede, and each part becomes a new group right above its old
    one. Every group is then the suffixes of one longest Lyndon prefix, and ``before``
    holds previous smaller suffixes. Second phase: suffixes in final order, the empty
    one first, place those just before them at the head of their group.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # where a suffix is in ``order``
    group = [0] * n  # the group of a suffix: where it starts in ``order``
    end = [0] * n  # the last place of the group that starts here
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s], group[s], end[start] = i, start, i
    before = [-1] * n
    last = n - 1
    while last >= 0:
        first = group[order[last]]
        if first == last:  # a group of one needs no parts
            s = order[first]
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[s] = p
            if p >= 0:
                old = group[p]
                at = end[old]
                if at > old:
                    other, hole = order[at], place[p]
                    order[hole], order[at] = other, p
                    place[other], place[p] = hole, at
                    end[old] = at - 1
                    end[at] = group[p] = at
            last -= 1
            continue
        found: dict[int, int] = defaultdict(int)
        for s in sorted(order[first : last + 1]):
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[s] = p
            found[p] += 1
        found.pop(-1, None)
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, times in found.items():
            parts[-times, group[p]].append(p)
        for _, old in sorted(parts) if len(parts) > 1 else parts:
            members = parts[_, old]
            stop = at = end[old]
            if at - old + 1 == len(members):
                continue  # the whole group moves: it stays
            for p in members:
                other, hole = order[at], place[p]
                order[hole], order[at] = other, p
                place[other], place[p] = hole, at
                at -= 1
            end[old] = at
            end[at + 1] = stop
            for p in members:
                group[p] = at + 1
        last = first - 1
    head = list(range(n))
    out = [-1] * n
    placed = bytearray(n)
    i, s = -1, n - 1
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[head[g]] = s
            head[g] += 1
            placed[s] = 1
            s = before[s]
        i += 1
        if i == n:
            return out
        s = out[i] - 1
