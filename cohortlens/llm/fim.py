"""Fill-in-middle transformation: cut a text at unit boundaries and move its middle to the end.

A text, as UTF-8 bytes, is taken in blocks of a fixed size. A Fenwick tree over the blocks holds how many units end and
how many code points start in each. The block of the n-th unit's end is found by binary-lifting descent, which also
gives the code points before the block; the end itself is looked for in that block alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_columns

BLOCK = 4096
NEWLINE = 10


class Blocks:
    """Fenwick trees of unit ends and code points over the blocks of one text (UTF-8). A unit is a line with its newline."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = data, block
        raw = np.frombuffer(data, np.uint8)
        starts = np.arange(0, max(1, len(data)), block)
        ends = raw == NEWLINE
        heads = (raw & 0xC0) != 0x80
        if len(data):
            units = np.add.reduceat(ends, starts, dtype=np.int64).tolist()
            points = np.add.reduceat(heads, starts, dtype=np.int64).tolist()
        else:
            units, points = [0], [0]
        if data and data[-1] != NEWLINE:
            units[-1] += 1  # the last line ends with the text
        self.n, self.n_chars = sum(units), sum(points)
        self.size = len(units)
        self.units, self.points = self._tree(units), self._tree(points)
        self.top = 1 << (self.size.bit_length() - 1)

    @staticmethod
    def _tree(counts: list[int]) -> list[int]:
        tree = [0, *counts]
        for i in range(1, len(tree)):
            above = i + (i & -i)
            if above < len(tree):
                tree[above] += tree[i]
        return tree

    def cut(self, n: int) -> tuple[int, int]:
        """(byte offset, code points before it) of the end of the first ``n`` units."""
        if n <= 0:
            return 0, 0
        if n >= self.n:
            return len(self.data), self.n_chars
        at, left, points, step = 0, n, 0, self.top
        while step:  # the last block before which fewer than n units end
            if at + step <= self.size and self.units[at + step] < left:
                at += step
                left -= self.units[at]
                points += self.points[at]
            step >>= 1
        lo = hi = at * self.block
        for _ in range(left):
            hi = self.data.index(b"\n", hi) + 1
        here = np.frombuffer(self.data, np.uint8, hi - lo, lo)
        return hi, points + int(np.count_nonzero((here & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document: the first 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(doc_id: int | None, data: bytes, seed: int, fim_percent: int, spm_percent: int, marks: tuple[bytes, bytes, bytes],
              block: int = BLOCK) -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, code points of the prefix, of the middle) of one text."""
    tree = Blocks(data, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(m in data for m in marks) or h3 % 100 >= fim_percent:
        return tree.n, "plain", data, None, None
    low, high = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (a, before), (b, upto) = tree.cut(low), tree.cut(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return tree.n, "spm", s + suffix + p + prefix + m + middle, before, upto - before
    return tree.n, "psm", p + prefix + s + suffix + m + middle, before, upto - before


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that ``transform`` was given, from its output and form alone."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output[len(first):].partition(second)
    two, _, middle = rest.partition(m)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _check_marks(marks: tuple[str, str, str]) -> None:
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("the three marks must differ and not be empty")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks {a!r} and {b!r} overlap: a text cut between them could not be restored")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
                   marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document of ``docs(doc_id, text)``.

    ``n`` is the number of units (lines with their newline). The two cuts and the form are drawn from the sha256 of the
    seed and doc_id, so that a repeated task draws alike. ``marks`` stand before prefix, suffix and middle. Form is psm
    or spm; plain, with the text as it is and null lengths, if the text is empty, contains a mark, or is not drawn
    (``fim_percent``). A null text counts as empty; a null doc_id draws like an empty one; repeated rows each get a row;
    other columns are ignored; an empty table gives an empty one. A row is bounded by its document.
    """
    return _map(docs, seed, fim_percent, spm_percent, marks, block, digests=False)


def fim_digests(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
                marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), block: int = BLOCK) -> DataFrame:
    """``fill_in_middle`` with output_sha256 and, of the text rebuilt from output and form, restored_sha256 for the output."""
    return _map(docs, seed, fim_percent, spm_percent, marks, block, digests=True)


def _map(docs, seed, fim_percent, spm_percent, marks, block, digests):
    _check_marks(marks)
    keys = tuple(m.encode() for m in marks)

    def step(rows):
        out = {"doc_id": rows["doc_id"], "n": [], "form": [], "prefix_chars": [], "middle_chars": []}
        out |= {"output_sha256": [], "restored_sha256": []} if digests else {"output": []}
        for doc_id, data in zip(rows["doc_id"], rows["text"]):
            n, form, output, before, middle = transform(doc_id, data or b"", seed, fim_percent, spm_percent, keys, block)
            for name, value in (("n", n), ("form", form), ("prefix_chars", before), ("middle_chars", middle)):
                out[name].append(value)
            if digests:
                out["output_sha256"].append(sha256(output).hexdigest())
                out["restored_sha256"].append(sha256(restore(output, form, keys)).hexdigest())
            else:
                out["output"].append(output.decode())
        return out

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
    schema += "output_sha256 string, restored_sha256 string" if digests else "output string"
    return map_columns(docs.select("doc_id", F.col("text").cast("binary").alias("text")), step, schema)
