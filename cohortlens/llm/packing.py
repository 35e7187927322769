"""Bounded-space online packing of token sequences.

A task reads its documents in order and keeps a fixed number of open windows. A document's last, shorter part goes to
the open window that it fits best. When it fits none, the fullest window is filled up with the part's head and
emitted, and the rest is placed again. At the end of a partition its open windows are poured together, so that at
most one is not full. These leftovers, with their ids, meet in groups of a fixed size and are poured together again,
level by level, until one is left.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe import default_pattern, encoder, vocabulary_file
from cohortlens.llm.common import materialise

WINDOW = 1024
OPEN_WINDOWS = 32
MERGE_GROUP = 256
END_ID = 0

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "part long, ids binary")


def special_tokens(data: bytes) -> dict[str, int]:
    """Text -> id of the added tokens of a tokenizers file; those that normalise or strip their surroundings are an error."""
    added = json.loads(data).get("added_tokens", []) if data.lstrip().startswith(b"{") else []
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that are normalised or strip their surroundings are not supported")
    return {t["content"]: t["id"] for t in added}


def document_encoder(data: bytes, pattern: str):
    """text -> ids (32-bit little-endian) as the tokenizers library gives them: added tokens found in the text keep their own id."""
    encode, special = encoder(data, pattern), special_tokens(data)
    if not special:
        return encode
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    ids = {t: i.to_bytes(4, "little") for t, i in special.items()}

    def run(text: str) -> bytes:
        parts = marks.split(text)
        return encode(text) if len(parts) == 1 else b"".join(ids[p] if k % 2 else encode(p) for k, p in enumerate(parts))

    return run


class Packer:
    """Open windows of one task. Pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, base: int, window: int, n_open: int):
        self.base, self.window, self.n_open = base, window, n_open
        self.n = 0
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.out: list[tuple] = []

    def emit(self, pieces: list, part: int | None = None) -> None:
        """Write a window's pieces; ``part`` marks a leftover, which keeps its ids."""
        import zlib

        at = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.n, at, part, ids if part is not None else None))
            at += n
        self.n += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.emit([(doc_id, start, total, ids[4 * start:4 * (start + self.window)])])
            start += self.window
        while start < total:
            rest = total - start
            fits = [i for i, (used, _) in enumerate(self.open) if used + rest <= self.window]
            if fits:
                i = max(fits, key=lambda i: self.open[i][0])  # ties: the oldest
                take = rest
            elif len(self.open) < self.n_open:
                self.open.append((0, []))
                i, take = len(self.open) - 1, rest
            else:
                i = max(range(len(self.open)), key=lambda i: self.open[i][0])
                take = self.window - self.open[i][0]
            used, pieces = self.open[i]
            pieces.append((doc_id, start, total, ids[4 * start:4 * (start + take)]))
            start += take
            if used + take == self.window:
                self.emit(pieces)
                del self.open[i]
            else:
                self.open[i] = (used + take, pieces)

    def pour(self, pieces: list, part: int | None) -> None:
        """Fill windows with ``pieces`` one after the other; the last, shorter one is a leftover of ``part``."""
        used, window = 0, []
        for doc_id, start, total, ids in pieces:
            while ids:
                take = min(len(ids) // 4, self.window - used)
                window.append((doc_id, start, total, ids[:4 * take]))
                start, ids, used = start + take, ids[4 * take:], used + take
                if used == self.window:
                    self.emit(window)
                    used, window = 0, []
        if window:
            self.emit(window, part)

    def finish(self, part: int) -> None:
        self.pour([p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces], part)
        self.open = []

    def rows(self):
        """The rows so far, as an Arrow batch."""
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
        kinds = [pa.int64()] * 8 + [pa.binary()]
        cols = list(zip(*self.out)) if self.out else [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def pack_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, window: int = WINDOW,
                   n_open: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids, with those of the file's added tokens where a text spells one, and then ``end_id``; a null text counts as empty, so such a document is ``end_id`` alone.
    Sequences hold ``window`` ids, but for one at most over the whole table. Repeated rows are packed each by itself.
    Equal fits go to the window opened first. Which documents share a sequence depends on the partitioning; what a task
    packs depends on its rows alone, so a repeated task packs alike, and the result is written once before it is read.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_file("byte_bpe_50k.json", path))
    pattern = pattern or default_pattern()

    def pack(batches):
        import struct

        from pyspark import TaskContext

        encode, end = document_encoder(vocabulary.value, pattern), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, window, n_open)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, min(256, batch.num_rows - lo))
                for doc_id, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                    packer.add(doc_id, encode(text or "") + end)
                yield packer.rows()
        packer.finish(part)
        yield packer.rows()

    def merge(level: int):
        def run(batches):
            import pyarrow as pa

            table = pa.Table.from_batches(batches).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            rows = table.to_pydict()
            group = min(rows["part"]) // merge_group if rows["part"] else 0
            packer = Packer((level << 56) | (group << 32), window, n_open)
            packer.pour(list(zip(rows["doc_id"], rows["start"], rows["doc_tokens"], rows["ids"])), group)
            yield packer.rows()

        return run

    packed = materialise(docs.select("doc_id", "text").mapInArrow(pack, PIECE), "packed")
    done = [packed.where("part is null")]
    left, level = packed.where("part is not null"), 0
    # A level leaves one window a group: the number of levels is the logarithm of the number of partitions.
    while (tops := left.agg(F.max("part").alias("top"), F.min("part").alias("low")).first())["top"] is not None:
        if tops["top"] == tops["low"]:
            done.append(left)
            break
        level += 1
        grouped = left.withColumn("_group", F.floor(F.col("part") / merge_group)).groupBy("_group")
        merged = materialise(grouped.applyInArrow(_as_group(merge(level)), PIECE), "merged")
        done.append(merged.where("part is null"))
        left = merged.where("part is not null")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "ids")


def _as_group(run):
    def merge_table(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(run(table.to_batches())))

    return merge_table


