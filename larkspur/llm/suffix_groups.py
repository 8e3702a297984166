"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix, the part before the next smaller suffix. Groups are
processed from the greatest down: each gives its members their previous-smaller pointers, and the
suffixes pointed at are moved, by how often, into new groups behind what is left of their own.
Then one pass from the least suffix on follows the pointers and emits each group's order. Nothing is
renamed and nothing recurses.

`arrays` works on many short blocks in step, one group of each block at a time, in numpy.
"""

from __future__ import annotations

import numpy as np


def arrays(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix arrays of the blocks of `s` that begin at `begin`; each block's last value is less than its others.

    Block b's array takes the places of the block itself and holds places in `s`.
    """
    n = len(s)
    begin = np.asarray(begin, np.int64)
    size = np.diff(np.append(begin, n))
    long_first = np.argsort(-size, kind="stable")
    b0, size = begin[long_first], size[long_first]
    block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    key = block * 512 + s
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    head = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    length = np.diff(np.append(head, n))
    group = np.full(n + 1, -1, np.int64)  # n: no suffix
    group[sa] = np.repeat(head, length)
    last = np.zeros(n, np.int64)
    last[head] = head + length - 1
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    prev = np.full(n + 1, n, np.int64)
    before = np.arange(-1, n)
    before[begin] = n
    mark = np.zeros(n, bool)
    end, low = b0 + size - 1, b0
    while len(end):
        g0 = group[sa[end]]
        m = end - g0 + 1
        if len(m) == int(m.sum()):
            i, g = sa[g0], g0
        else:
            off = np.cumsum(m) - m
            i = sa[np.repeat(g0 - off, m) + np.arange(int(m.sum()))]
            g = np.repeat(g0, m)
        p = before[i]
        todo = np.flatnonzero(group[p] > g)
        while len(todo):
            p[todo] = prev[p[todo]]
            todo = todo[group[p[todo]] > g[todo]]
        prev[i] = p
        todo = np.flatnonzero(group[p] == g)
        while len(todo):
            p[todo] = prev[p[todo]]
            todo = todo[group[p[todo]] == g[todo]]
        prev[i] = p
        q = np.sort(p)
        q = q[: np.searchsorted(q, n)]
        if len(q):
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            k = np.diff(np.append(first, len(q)))
            q = q[first]
            old = group[q]
            o = np.lexsort((k, old))
            q, k, old = q[o], k[o], old[o]
            cut = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            moved = np.diff(np.append(cut, len(q)))
            heads = old[cut]
            zone = np.repeat(last[heads] - moved + 1, moved)
            dest = zone + np.arange(len(q)) - np.repeat(cut, moved)
            here = at[q]
            mark[q] = True
            there = sa[dest]
            there = there[~mark[there]]
            free = here[here < zone]
            sa[free], at[there] = there, free
            sa[dest], at[q] = q, dest
            mark[q] = False
            last[heads] -= moved
            run = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (k[1:] != k[:-1])))
            many = np.diff(np.append(run, len(q)))
            group[q] = np.repeat(dest[run], many)
            last[dest[run]] = dest[run] + many - 1
        end = g0 - 1
        go = end >= low
        if not go.all():
            end, low = end[go], low[go]
    out = np.full(n, -1, np.int64)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    front = np.arange(n)
    out[b0] = b0 + size - 1
    placed[b0 + size - 1] = True
    for x in range(int(size[0]) if len(size) else 0):
        j = before[out[b0[: np.searchsorted(-size, -x)] + x]]
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            placed[j] = True
            j = prev[j]
            j = j[~placed[j]]
    return out
