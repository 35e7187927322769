"""Growing trees on the cells of one task, in arrays: the step of :mod:`trees` for cell tables of a bounded size.

The functions go to the executors by value: they need numpy there, but not this package.
"""

from __future__ import annotations

import math
import sys
from hashlib import md5

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A split must raise the sum of squares by more than rounding can.
MIN_RISE = 1.0 + 1e-12
#: Counts up to which Poisson draws follow the exact distribution; above, a rounded normal one with the same mean and variance.
EXACT_POISSON = 16
#: Pairs of a cell and a tree that are handled at a time: some 10 MB of arrays.
BLOCK_ENTRIES = 40_000


def histograms(bins, place, n_nodes, weights):
    """Per feature the running sums along the bins, for each node and weight: arrays (nodes, bins)."""
    for f in range(bins.shape[1]):
        width = int(bins[:, f].max(initial=0)) + 1
        key = place * width + bins[:, f]
        yield [np.cumsum(np.bincount(key, w, n_nodes * width).reshape(n_nodes, width), axis=1) for w in weights]


def best_splits(score_of, bins, place, n_nodes, weights, allowed=None):
    """(feature, bin, score) of each node's best split; feature -1 where there is none. Ties: first feature, lowest bin."""
    feature, cut, best = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.full(n_nodes, -np.inf)
    for f, sums in enumerate(histograms(bins, place, n_nodes, weights)):
        if sums[0].shape[1] < 2:
            continue  # No child is empty, so that the last bin is no cut.
        score = score_of([s[:, :-1] for s in sums], [s[:, -1:] - s[:, :-1] for s in sums])
        if allowed is not None:
            score[~allowed[:, f]] = -np.inf
        at = score.argmax(axis=1)
        top = score[np.arange(n_nodes), at]
        better = top > best
        feature[better], cut[better], best[better] = f, at[better], top[better]
    return feature, cut, best


def squares_over_sum(a, b):
    n = a + b
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, (a * a + b * b) / n, np.nan)


def class_score(left, right):
    """Sum of squared class counts over the children's sizes; no child may be empty."""
    score = squares_over_sum(*left) + squares_over_sum(*right)
    score[np.isnan(score)] = -np.inf
    return score


def poisson_ends(n):
    """Cumulative probabilities of 0, 1, 2, ... under Poisson(n), up to where a uniform of 52 bits can lie."""
    out, p, total, k = [], math.exp(-n), 0.0, 0
    while total < 1.0 - 1e-13 and k < 100:
        total += p
        out.append(total)
        k += 1
        p *= n / k
    return out


def poisson_draws(counts, names, tail):
    """How often each cell of ``counts`` rows is drawn, by the md5 of its name and ``tail``, as ``trees.poisson_draw``."""
    out = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts > 0)
    digests = np.frombuffer(b"".join([md5(names[i] + tail).digest() for i in some.tolist()]), ">u8").reshape(-1, 2).astype(np.uint64)
    # Digits 1 to 13 and 14 to 26 of the 32 of a digest.
    first, second = digests[:, 0] >> np.uint64(12), ((digests[:, 0] & np.uint64(0xFFF)) << np.uint64(40)) | (digests[:, 1] >> np.uint64(24))
    u, v = ((x.astype(np.float64) + 0.5) / float(16 ** 13) for x in (first, second))
    n = counts[some]
    drawn = np.zeros(len(some), np.int64)
    for k in np.unique(n[n <= EXACT_POISSON]).tolist():
        drawn[n == k] = np.searchsorted(poisson_ends(k), u[n == k], side="right")
    wide = n > EXACT_POISSON
    z = np.sqrt(-2.0 * np.log(u[wide])) * np.cos(2.0 * math.pi * v[wide])
    step = np.sqrt(n[wide].astype(np.float64)) * z
    drawn[wide] = np.maximum(0, n[wide] + (np.sign(step) * np.floor(np.abs(step) + 0.5)).astype(np.int64))
    out[some] = drawn
    return out


def grow_classes(bins, w0, w1, depth, chosen, keys, seed, owner):
    """Splits of several classification trees at a time, as arrays (tree, node, feature, bin, l0, l1, r0, r1, gain).

    ``owner`` says which tree a row belongs to; ``keys`` start the hashed orders of the nodes of each tree.
    """
    out = []
    d = bins.shape[1]
    # The open nodes: their trees and numbers, and the place of each row among them.
    tree, at, place = np.arange(len(keys)), np.ones(len(keys), np.int64), owner
    for _ in range(depth):
        a0, a1 = np.bincount(place, w0, len(tree)), np.bincount(place, w1, len(tree))
        open_ = (a0 > 0) & (a1 > 0)  # Nodes of one class are leaves.
        keep = open_[place]
        a0, a1, tree, at = a0[open_], a1[open_], tree[open_], at[open_]
        if not len(tree):
            break
        place = (np.cumsum(open_) - 1)[place[keep]]
        bins, w0, w1 = bins[keep], w0[keep], w1[keep]
        allowed = np.ones((len(tree), d), bool)
        if chosen < d:
            allowed[:] = False
            tails = [f":{f}:{seed}".encode() for f in range(d)]
            for i, (t, n) in enumerate(zip(tree.tolist(), at.tolist())):
                start = md5(f"{keys[t]}:{n}".encode())
                order = []
                for f, tail in enumerate(tails):
                    digest = start.copy()
                    digest.update(tail)
                    order.append((digest.digest(), f))
                order.sort()
                allowed[i, [f for _, f in order[:chosen]]] = True
        feature, cut, score = best_splits(class_score, bins, place, len(tree), (w0, w1), allowed)
        parent = squares_over_sum(a0, a1)
        split = (feature >= 0) & (score > parent * MIN_RISE)
        if not split.any():
            break
        keep = split[place]
        bins, w0, w1, place = bins[keep], w0[keep], w1[keep], place[keep]
        right = bins[np.arange(len(bins)), feature[place]] > cut[place]
        r0, r1 = np.bincount(place, w0 * right, len(tree)), np.bincount(place, w1 * right, len(tree))
        out.append([x[split] for x in (tree, at, feature, cut, a0 - r0, a1 - r1, r0, r1, score - parent)])
        tree, at = np.repeat(tree[split], 2), (2 * at[split][:, None] + [0, 1]).ravel()
        place = 2 * (np.cumsum(split) - 1)[place] + right
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 9


def value_score(left, right):
    (lw, ls), (rw, rs) = left, right
    with np.errstate(invalid="ignore", divide="ignore"):
        score = ls * ls / lw + rs * rs / rw
    score[~((lw > 0) & (rw > 0))] = -np.inf
    return score


def tree_values(bins, w, y, depth, owner):
    """The value that a regression tree on weighted cells gives each cell, those without weight included.

    ``owner`` is the tree of each cell, numbered from 0: the trees of several models grow at a time, each on its own cells.
    """
    value = np.zeros(len(bins))
    wy = w * y
    wyy = wy * y
    rows, place, nodes = np.arange(len(bins)), owner, int(owner.max(initial=-1)) + 1
    for level in range(depth + 1):
        weight, total = np.bincount(place, w, nodes), np.bincount(place, wy, nodes)
        value[rows] = (total / np.maximum(weight, 1e-300))[place]
        if level == depth:
            break
        feature, cut, score = best_splits(value_score, bins, place, nodes, (w, wy))
        second = np.bincount(place, wyy, nodes)
        # Variance must fall by more than rounding can lower it.
        split = (feature >= 0) & (score - total * total / np.maximum(weight, 1e-300) > 1e-12 * np.maximum(second, 1e-300))
        if not split.any():
            break
        if not split.all():
            keep = split[place]
            rows, place, bins, w, wy, wyy = rows[keep], place[keep], bins[keep], w[keep], wy[keep], wyy[keep]
        place = 2 * (np.cumsum(split) - 1)[place] + (bins[np.arange(len(bins)), feature[place]] > cut[place])
        nodes = 2 * int(split.sum())
    return value


def boosted_margins(bins, n0, n1, iterations, depth, step, owner):
    """Margins of gradient-boosted trees under logistic loss, per cell: class 1 where positive.

    The first tree fits the labels -1 and 1 and counts whole; each further one fits the negative gradient and counts by ``step``.
    ``owner`` is the model of each cell, numbered from 0.
    """
    w = n0 + n1
    label = np.where(w > 0, (n1 - n0) / np.maximum(w, 1e-300), 0.0)
    margin = tree_values(bins, w, label, depth, owner)
    for _ in range(iterations - 1):
        up, down = 4.0 / (1.0 + np.exp(2.0 * margin)), -4.0 / (1.0 + np.exp(-2.0 * margin))
        gradient = np.where(w > 0, (n1 * up + n0 * down) / np.maximum(w, 1e-300), 0.0)
        margin = margin + step * tree_values(bins, w, gradient, depth, owner)
    return margin


def votes_of(bins, owner, forests, trees, nodes, features, cuts, left, right, depth):
    """Sum over the trees of its forest of the leaf value that each cell reaches; the arrays after ``owner`` are the splits, a row each.

    ``owner`` and ``forests`` are the forest of each cell and split, numbered from 0. ``left`` and ``right`` are whole numbers; node 0
    has the value of an unsplit root as its right. Some trees at a time.
    """
    votes = np.zeros(len(bins), np.int64)
    every, number = np.unique(trees, return_inverse=True)
    some = max(1, BLOCK_ENTRIES // max(1, len(bins)))
    wide = int(owner.max(initial=-1)) + 1
    for lo in range(0, len(every), some):
        mine = np.flatnonzero((number >= lo) & (number < lo + some))
        n = min(some, len(every) - lo)
        at = ((number[mine] - lo) * wide + forests[mine] << depth) + nodes[mine]
        feature = np.full(n * wide << depth, -1)
        cut, low, high = (np.zeros(n * wide << depth, np.int64) for _ in range(3))
        feature[at], cut[at], low[at], high[at] = features[mine], cuts[mine], left[mine], right[mine]
        base = (np.arange(n)[:, None] * wide + owner << depth).ravel()
        feature[np.arange(n * wide) << depth] = -1
        value = high[base]
        entry, row, node = np.arange(n * len(bins)), np.tile(np.arange(len(bins)), n), np.ones(n * len(bins), np.int64)
        for _ in range(depth):
            go = feature[base + node] >= 0
            entry, row, base, node = entry[go], row[go], base[go], node[go]
            if not len(entry):
                break
            here = base + node
            up = bins[row, feature[here]] > cut[here]
            value[entry] = np.where(up, high[here], low[here])
            node = 2 * node + up
            inside = node < 1 << depth
            entry, row, base, node = entry[inside], row[inside], base[inside], node[inside]
        votes += value.reshape(n, len(bins)).sum(axis=0)
    return votes
