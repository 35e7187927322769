"""Sorted-edge greedy matching of weighted cells on a line, by levels of Hamming distance: the step that runs in tasks.

A cell is a side (0 left, 1 right), a pattern of bits, a value and a count. Edges join left and right cells; their order
is (bits that differ, difference of the values, mask of the bits that differ, left below right or not, left cell). Each
edge in turn takes as many rows as both of its cells have left. As values differ by less than one bit does, the edges
of one number of differing bits, a level, all come before those of the next.

Within a level the nearest free left and right cells of two patterns are always neighbours among the free cells of those
patterns. So a linked list of neighbours and a heap of their distances replace the edges: n cells cost some n log n steps.

A task may hold only the cells of a range of values. Cells beyond it are further from a cell than the range's end is,
so that an edge is decided here while it is shorter than the way to the ends. What may depend on cells outside is frozen:
at distance d, the cells within d of an open end, and those within d of a frozen cell of the other side. Frozen
cells are left to a later round, with other ranges. Every edge taken is one that the whole would take, in full, and all
earlier edges of its two cells are decided, so that going on with the rest gives the same result.

The functions here go to the executors by value: they need numpy there, but not this package.
"""

from __future__ import annotations

import heapq
import math
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = 6
#: Rows of a bucket of the sampled matching whose free ones are counted together.
SPAN = 32


class Zone:
    """What is frozen from one open end: cells in order of their distance from it, per side."""

    def __init__(self, cells: list[tuple[float, int]], sides, free):
        # (distance from the end, cell) of each side, nearest first.
        self.order = [sorted(c for c in cells if sides[c[1]] == s) for s in (0, 1)]
        self.at = [0, 0]
        self.far = [-math.inf, -math.inf]  # the frozen cell of each side furthest from the end
        self.free, self.frozen = free, set()

    def grow(self, d: float) -> None:
        """Freeze what may depend on cells beyond the end by edges up to ``d``."""
        moved = True
        while moved:
            moved = False
            for s in (0, 1):
                order = self.order[s]
                while self.at[s] < len(order) and order[self.at[s]][0] <= max(d, self.far[1 - s] + d):
                    x, cell = order[self.at[s]]
                    self.at[s] += 1
                    if self.free[cell]:
                        self.frozen.add(cell)
                        self.far[s] = x
                        moved = True


def match_level(side, pattern, value, free, level, low_open=False, high_open=False):
    """Match the cells at ``level``; ``free`` is changed in place. Gives {difference of values: rows matched}.

    The arguments are lists, a place for each cell, in order of (side, pattern, value). An open end says that there may be
    cells beyond the lowest or highest value.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for i, n in enumerate(free):
        if n:
            groups.setdefault((side[i], pattern[i]), []).append(i)
    lefts, rights = ([p for s, p in groups if s == which] for which in (0, 1))
    cell_of: list[int] = []  # of each node of the lists of neighbours
    before: list[int] = []
    after: list[int] = []
    nodes: dict[int, list[int]] = {}
    heap: list[tuple] = []

    def edge(a: int, b: int) -> tuple:
        left, right = (cell_of[a], cell_of[b]) if side[cell_of[a]] == 0 else (cell_of[b], cell_of[a])
        return abs(value[left] - value[right]), pattern[left] ^ pattern[right], value[left] > value[right], left, right

    def across(a: int, b: int) -> bool:
        return side[cell_of[a]] != side[cell_of[b]]

    for p in lefts:
        for q in rights:
            if bin(p ^ q).count("1") == level:
                first = len(cell_of)
                merged = sorted(groups[0, p] + groups[1, q], key=lambda i: (value[i], side[i]))
                cell_of += merged
                for node in range(first, len(cell_of)):
                    before.append(node - 1 if node > first else -1)
                    after.append(node + 1 if node + 1 < len(cell_of) else -1)
                    nodes.setdefault(cell_of[node], []).append(node)
                heap += [edge(node, node + 1) for node in range(first, len(cell_of) - 1) if across(node, node + 1)]
    heapq.heapify(heap)
    zones = []
    if heap and (low_open or high_open):
        low, high = min(value), max(value)
        if low_open:
            zones.append(Zone([(value[i] - low, i) for i in nodes], side, free))
        if high_open:
            zones.append(Zone([(high - value[i], i) for i in nodes], side, free))
    out: dict[float, int] = {}
    while heap:
        d, _, _, left, right = heapq.heappop(heap)
        if not free[left] or not free[right]:
            continue
        if d:
            for z in zones:
                z.grow(d)
        if any(left in z.frozen or right in z.frozen for z in zones):
            continue
        m = min(free[left], free[right])
        out[d] = out.get(d, 0) + m
        for cell in (left, right):
            free[cell] -= m
            if not free[cell]:
                for node in nodes[cell]:
                    a, b = before[node], after[node]
                    if a >= 0:
                        after[a] = b
                    if b >= 0:
                        before[b] = a
                    if a >= 0 and b >= 0 and across(a, b):
                        heapq.heappush(heap, edge(a, b))
    return out


def match_samples(left, left_of, right, right_of, starts, m):
    """(left, right, distance) as arrays of places: in every bucket each left row in turn takes the nearest of ``m`` free right rows.

    ``left`` and ``right`` are rows of numbers by bucket, in a random order there; ``left_of`` and ``right_of`` name their
    buckets, in ascending order. ``starts`` has a uniform number for each left row: the candidates are the bucket's free
    rows from that share of their order on, going round. The first of equals is taken. A step takes the next left row
    of all buckets at once.
    """
    import numpy as np

    kinds, number = np.unique(np.concatenate([left_of, right_of]), return_inverse=True)
    n_left, n_right = (np.bincount(x, minlength=len(kinds)) for x in (number[:len(left_of)], number[len(left_of):]))
    first_left, first_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    steps = np.minimum(n_left, n_right)
    order = np.argsort(-steps, kind="stable")  # Buckets that still go on come first.
    steps, n_right, first_left, first_right = steps[order], n_right[order], first_left[order], first_right[order]
    # The free rows of a bucket: a ring of neighbours, and counts of runs of SPAN rows to find one by its number.
    after, before = np.arange(1, len(right) + 1), np.arange(-1, len(right) - 1)
    full = n_right > 0
    after[(first_right + n_right - 1)[full]], before[first_right[full]] = first_right[full], (first_right + n_right - 1)[full]
    spans = -(-int(n_right.max(initial=1)) // SPAN)
    free = (np.arange(spans * SPAN) < n_right[:, None]).reshape(len(kinds), spans, SPAN)
    counts = free.sum(axis=2)
    out = []
    for i in range(int(steps.max(initial=0))):
        n = int(np.searchsorted(-steps, -i, side="left"))
        row, left_row = np.arange(n), first_left[:n] + i
        size = n_right[:n] - i
        at = (starts[left_row] * size).astype(np.int64) % size
        upto = np.cumsum(counts[:n], axis=1)
        span = (upto <= at[:, None]).sum(axis=1)
        at = at - (upto[row, span] - counts[row, span])
        place = span * SPAN + (np.cumsum(free[row, span], axis=1) <= at[:, None]).sum(axis=1)
        near = np.empty((n, m), np.int64)
        near[:, 0] = first_right[:n] + place
        for j in range(1, m):
            near[:, j] = after[near[:, j - 1]]
        distances = np.abs(right[near] - left[left_row][:, None, :]).sum(axis=2) / right.shape[1]
        best = distances.argmin(axis=1)
        taken = near[row, best]
        out.append((left_row, taken, distances[row, best]))
        place = taken - first_right[:n]
        free[row, place // SPAN, place % SPAN] = False
        counts[row, place // SPAN] -= 1
        a, b = before[taken], after[taken]
        after[a], before[b] = b, a
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


#: Of md5: left rotations by round and the sines' table.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]


def _md5_block(words):
    """md5 of messages of one block each: 16 rows of words, padded; gives 4 rows of words."""
    import numpy as np

    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            word = i
        elif kind == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            word = (5 * i + 1) % 16
        elif kind == 2:  # b ^ c ^ d
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            word = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = 7 * i % 16
        turn = _TURNS[kind][i % 4]
        np.add(f, a, out=f), np.add(f, np.uint32(_SINES[i]), out=f), np.add(f, words[word], out=f)
        np.left_shift(f, np.uint32(turn), out=g), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return np.stack([a + start[0], b + start[1], c + start[2], d + start[3]])


def md5_numbers(texts, suffix: bytes, first: int = 8192):
    """The two halves of the md5 of every text with ``suffix``, as big-endian numbers: an array of (rows, 2).

    ``texts`` is an Arrow array of strings without nulls. Texts of one length are hashed together, ``first`` at a time.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros((0, 2), np.uint64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    out = np.empty((len(texts), 4), "<u4")
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        total = size + len(suffix)
        if total > 55:  # more than a block
            for i in which.tolist():
                out[i] = np.frombuffer(hashlib.md5(data[ends[i]:ends[i + 1]].tobytes() + suffix, usedforsecurity=False).digest(), "<u4")
            continue
        block = np.zeros((first, 64), np.uint8)
        block[:, size:total + 1] = np.frombuffer(suffix + b"\x80", np.uint8)
        block[:, 56:64] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
        for k in range(0, len(which), first):
            some = which[k:k + first]
            block[:len(some), :size] = data[ends[some][:, None] + np.arange(size)]
            out[some] = _md5_block(np.ascontiguousarray(block[:len(some)].view("<u4").T)).T
    return out.view(">u8").astype(np.uint64)


def match_pair(side, pattern, value, free, levels=range(LEVELS), low_open=False, high_open=False):
    """(level, difference, rows) of all ``levels`` of one pair of datasets, nearest first; ``free`` is changed in place."""
    out = []
    for level in levels:
        out += [(level, d, m) for d, m in sorted(match_level(side, pattern, value, free, level, low_open, high_open).items())]
    return out
