"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of words with smallest period q, at least max(12, 2q) words long, that neither neighbour extends. So
each of its words occurs twice or more in it, and, for q >= K, each lies in a group of K words that does. A word that
occurs, by itself or in such groups, too rarely within its segment can join no run: it splits the segment. The counts
are taken anew in the smaller segments until nothing changes. Segments too short for a run go as well.

This is done for K = 1, 2, 4, ...; the level of K serves the lags from 2K to 4K - 1 (from 1 for K = 1). The surviving
segments are scanned by lag: words that equal the word q further on, in stretches of q or more (and of 12 - q or more),
make a run. Lags below 8 are all scanned. Above, a run at lag q holds K + 1 consecutive places whose group of K words
recurs q words further on, one of them a multiple of K: a segment is scanned only at lags that such a place shows. A place
whose recurrence lies with it in one known run of a period up to K + 1 shows nothing, since two runs overlap in less than
the sum of their periods. So the work grows with the words, except in long texts of very few different words, where up
to K lags may be scanned in a level.

All texts of a slice are worked on together, as one sequence of word numbers with a different number between any two.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_columns

MIN_LENGTH = 12
DENSE_K = 2


def splice(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places of the original words after the planted repetition of a tenth of the documents, or None where there is none."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def bounds(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key's class, size of each key's class)."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return inverse, counts[inverse]


class Segments:
    """What survives of a sequence: places, words, segment and gram numbers, all in order of place."""

    def __init__(self, words: np.ndarray):
        self.place = np.arange(len(words))
        self.gram = words.astype(np.int64)
        self.k = 1
        self.fits = np.ones(len(words), bool)  # whether the gram of k words lies in the segment
        self.segment = np.zeros(len(words), np.int64)

    def keep(self, alive: np.ndarray, shortest: int) -> bool:
        """Drop the dead places and the segments below ``shortest``; whether anything went."""
        # A segment's places are consecutive, so that gaps in them are its ends.
        cut = np.concatenate(([True], (np.diff(self.place) > 1) | (np.diff(self.segment) > 0) | ~alive[1:] | ~alive[:-1])) if len(alive) else alive
        label = np.cumsum(cut)
        good = alive & (np.bincount(label, alive)[label] >= shortest)
        gone = not good.all()
        self.place, self.gram, self.fits = self.place[good], self.gram[good], self.fits[good]
        label = label[good]
        self.segment = np.cumsum(np.concatenate(([0], np.diff(label) > 0))) if len(label) else label
        self._fit(self.k)
        return gone

    def _fit(self, k: int) -> None:
        """Mark the places whose next ``k`` words are in their segment."""
        n = len(self.place)
        self.fits = np.zeros(n, bool)
        if n >= k:
            self.fits[:n - k + 1] = self.segment[:n - k + 1] == self.segment[k - 1:]

    def covered(self) -> np.ndarray:
        """Places in a gram that occurs twice or more in their segment."""
        n = len(self.place)
        at = np.flatnonzero(self.fits)
        marks = np.zeros(n + 1, np.int64)
        if len(at):
            grams, _ = number(self.gram[at])
            _, often = number(self.segment[at] * (grams.max() + 1) + grams)
            twice = at[often > 1]
            marks += np.bincount(twice, minlength=n + 1)
            marks -= np.bincount(twice + self.k, minlength=n + 1)
        return np.cumsum(marks[:n]) > 0

    def split(self, shortest: int) -> None:
        """Frequency splitting until the segments are stable."""
        self.keep(np.ones(len(self.place), bool), shortest)
        while len(self.place) and self.keep(self.covered(), shortest):
            pass

    def double(self) -> None:
        """Grams of twice the length."""
        k, n = self.k, len(self.place)
        self._fit(2 * k)
        at = np.flatnonzero(self.fits)
        pairs = np.full(n, -1, np.int64)
        if len(at):
            _, grams = np.unique(self.gram, return_inverse=True)
            pairs[at] = number(grams[at] * (grams.max() + 1) + grams[at + k])[0]
        self.gram, self.k = pairs, 2 * k


def stretches(words: np.ndarray, lo: int, hi: int, lag: int, found: dict) -> None:
    """Add the runs of period ``lag`` within words[lo:hi] that no smaller lag has found."""
    same = words[lo:hi - lag] == words[lo + lag:hi]
    starts, ends = bounds(same)
    long = ends - starts >= max(lag, MIN_LENGTH - lag)
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        found.setdefault((lo + a, lo + b + lag), lag)


def shown_lags(s: Segments, found: dict, n: int) -> list[tuple[int, int]]:
    """(segment, lag) for the lags 2k to 4k - 1 shown by the recurrence of a gram at a multiple of k, in order of lag."""
    at = np.flatnonzero(s.fits)
    if not len(at):
        return []
    k = s.k
    grams, _ = number(s.gram[at])
    group, _ = number(s.segment[at] * (grams.max() + 1) + grams)
    place = s.place[at]
    key = group * (n + 4 * k) + place
    order = np.argsort(key, kind="stable")
    key_sorted = key[order]
    anchors = np.flatnonzero(place % k == 0)
    base = key[anchors]
    # Keys of another group are further off than any lag: places are below n and lags below 4k.
    lo = np.searchsorted(key_sorted, base + 2 * k)
    hi = np.searchsorted(key_sorted, base + 4 * k)
    many = hi - lo
    anchors, lo = anchors[many > 0], lo[many > 0]
    many = many[many > 0]
    if not len(anchors):
        return []
    first = np.repeat(np.cumsum(many) - many, many)
    others = order[np.repeat(lo, many) + np.arange(many.sum()) - first]
    here = np.repeat(anchors, many)
    lag = place[others] - place[here]
    # How far the known runs of small period that start at or before a place reach.
    reach = np.zeros(n + 1, np.int64)
    for (a, b), q in found.items():
        if q <= k + 1:
            reach[a] = max(reach[a], b)
    reach = np.maximum.accumulate(reach)
    new = reach[place[here]] < place[here] + lag + k
    wanted = np.unique(lag[new] * (int(s.segment[-1]) + 1) + s.segment[at[here[new]]])
    return [(int(w % (s.segment[-1] + 1)), int(w // (s.segment[-1] + 1))) for w in wanted]


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    s = Segments(words)
    while True:
        lags = range(1 if s.k == 1 else 2 * s.k, 4 * s.k)
        s.split(max(MIN_LENGTH, 2 * lags[0]))
        if not len(s.place):
            break
        if s.k <= DENSE_K:
            # Dead places differ from all others, and so no stretch of equal words crosses them.
            alive = -1 - np.arange(len(words))
            alive[s.place] = words[s.place]
            for lag in lags:
                stretches(alive, 0, len(words), lag, found)
        else:
            edges = np.concatenate(([0], np.flatnonzero(np.diff(s.segment)) + 1, [len(s.place)]))
            first, last = s.place[edges[:-1]], s.place[edges[1:] - 1] + 1
            for segment, lag in shown_lags(s, found, len(words)):
                stretches(words, int(first[segment]), int(last[segment]), lag, found)
        s.double()
    return sorted((a, b - a, q) for (a, b), q in found.items())


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:n]) > 0


def _slice_runs(lists: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, found in one sequence."""
    numbers: dict[bytes, int] = {}
    parts = []
    for i, words in enumerate(lists):
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1 - i]))  # a number of its own ends each text
    edges = np.cumsum([0] + [len(w) + 1 for w in lists])
    out: list[list] = [[] for _ in lists]
    if parts:
        for start, length, period in find_runs(np.concatenate(parts)):
            i = int(np.searchsorted(edges, start, "right")) - 1
            out[i].append((start - int(edges[i]), length, period))
    return out


def find_periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period), n_words and collapsed text of every document of ``docs(doc_id, text)``.

    Words are runs of anything but the six ASCII white-space characters, numbered from 0. The collapsed text has the
    words, joined by a space, that no run holds after its first period. ``planted`` first replaces the end of a tenth of
    the documents by a repetition (see ``splice``). A null text has no words; a null doc_id counts as an empty one in
    the choice of that tenth; repeated rows each get a row; other columns are ignored; an empty table gives an empty one.
    A row is bounded by its document.
    """
    return _map(docs, planted, digests=False)


def run_digests(docs: DataFrame, planted: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null without any), runs_sha256 and collapsed_sha256."""
    return _map(docs, planted, digests=True)


def _map(docs, planted, digests):
    def step(rows):
        lists = [(t or b"").split() for t in rows["text"]]  # splits at the same six characters
        if planted:
            for i, doc_id in enumerate(rows["doc_id"]):
                at = splice(len(lists[i]), doc_id)
                if at is not None:
                    lists[i] = [lists[i][j] for j in at.tolist()]
        names = (["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] if digests
                 else ["doc_id", "n_words", "runs", "collapsed"])
        out: dict[str, list] = {n: [] for n in names}
        for doc_id, words, runs in zip(rows["doc_id"], lists, _slice_runs(lists)):
            gone = repeats(len(words), runs).tolist() if runs else None
            collapsed = b" ".join([w for w, g in zip(words, gone) if not g] if gone else words)
            if digests:
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                row = (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
                       sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest())
            else:
                row = (doc_id, len(words), [{"start": a, "length": n, "period": q} for a, n, q in runs], collapsed.decode())
            for name, value in zip(names, row):
                out[name].append(value)
        return out

    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
              if digests else "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), step, schema)
