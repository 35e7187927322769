"""Byte-level BPE by overlapping chunks.

Texts of up to one chunk are encoded where they are read. A longer text is cut into chunks that overlap. Each chunk is
pre-tokenised by itself, in parallel, around its two overlaps. A pre-token boundary of a kind that no later or earlier
text can undo (the end of a run of letters or digits, or a space after any other character) marks where two chunks
resynchronise: the text is cut at the first such boundary that both chunks found. A pair without one is not cut. The
pieces between cuts are encoded in parallel and put together in order. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import map_columns, per_task

CHUNK = 1 << 15
OVERLAP = 512


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver (below 2 MB) to be broadcast; ``path`` may name another one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a rank file, or of a byte-level BPE file of the JSON kind (without its special tokens)."""
    import base64
    import json

    if not data.lstrip().startswith(b"{"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    spec = json.loads(data)
    # Byte-level vocabularies write each byte as one printable character.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(data: bytes, pattern: str):
    """text -> little-endian 32-bit ids as bytes."""
    import tiktoken

    core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return lambda text: core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def decoder(data: bytes):
    """ids as bytes -> the tokens' bytes, put together."""
    import numpy as np

    ranks = ranks_of(data)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return lambda ids: b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def sure_boundaries(text: str, matches) -> list[int]:
    """Ends of pre-tokens that hold whatever stands further left or right."""
    out = []
    for m in matches:
        e = m.end()
        if 0 < e < len(text):
            a, b = text[e - 1], text[e]
            if (b in " \t\r\n" and not a.isspace()
                    or b.isascii() and (a.isalpha() and not b.isalpha() or a in "0123456789" and not b.isdigit())):
                out.append(e)
    return out


def chunk_rows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, k, body, zone_in, zone_out): a long text's chunks, each with the overlaps at its ends."""
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    k = F.col("k")
    cut = lambda start, size: F.substring(F.col("text"), (start + 1).cast("int"), F.lit(size))
    return (docs.withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
            .select("row", "doc_id", "k", cut(k * chunk, chunk).alias("body"),
                    F.when(k > 0, cut(k * chunk, overlap)).alias("zone_in"),
                    cut((k + 1) * chunk, overlap).alias("zone_out")))


def stitched_pieces(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, piece, text): pieces of long texts whose encodings, in order, are the text's encoding."""
    chunks = chunk_rows(docs, chunk, overlap)

    @per_task
    def make():
        import regex

        pre = regex.compile(pattern)

        def zone(left: str, right: str) -> list[int]:
            """Sure boundaries inside ``right`` by pre-tokenising from a little before it."""
            text = left + right
            return [e - len(left) for e in sure_boundaries(text, pre.finditer(text)) if e > len(left)]

        def step(rows):
            return {"row": rows["row"], "doc_id": rows["doc_id"], "k": rows["k"], "body": rows["body"],
                    "heads": [zone("", z) if z else [] for z in rows["zone_in"]],
                    "tails": [zone(b[-64:], z) if z else [] for b, z in zip(rows["body"], rows["zone_out"])]}

        return step

    found = map_columns(chunks.repartition("row", "k"), make,
                        "row long, doc_id long, k int, body string, heads array<int>, tails array<int>")
    w = Window.partitionBy("row").orderBy("k")
    # The cut between a chunk and the next lies ``cut`` characters into the next one's body.
    cut = F.array_min(F.array_intersect("tails", F.lead("heads").over(w)))
    linked = (found.withColumn("cut", cut).withColumn("was", F.lag("cut").over(w))
              .withColumn("next_body", F.lead("body").over(w)))
    own = F.expr("substring(body, coalesce(was, 0) + 1)")
    more = F.when(F.col("cut").isNotNull(), F.expr("substring(next_body, 1, cut)")).otherwise(F.lit(""))
    piece = F.sum(F.when(F.col("was").isNotNull(), 1).otherwise(0)).over(w)
    parts = linked.select("row", "doc_id", "k", piece.alias("piece"), F.concat(own, more).alias("part"))
    return (parts.groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"),
                                              F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
            .select("row", "doc_id", "piece", F.concat_ws("", F.col("p.part")).alias("text")))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK,
                     overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (32-bit little-endian) and decoded bytes of every document; see ``encode_digests`` for the cases."""
    return _encode(docs, path, pattern, chunk, overlap, digests=False)


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK,
                   overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Special tokens are never made: their spelling is ordinary text. A null text counts as empty and has no tokens.
    Repeated rows each get a row; other columns are ignored. A text is put together again in one row, so a row is
    bounded by its document.
    """
    return _encode(docs, path, pattern, chunk, overlap, digests=True)


def _encode(docs, path, pattern, chunk, overlap, digests):
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pattern = pattern or default_pattern()
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path=path))

    @per_task
    def whole():
        from hashlib import sha256

        encode, decode = encoder(vocabulary.value, pattern), decoder(vocabulary.value)

        def step(rows):
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids": [], "decoded": []}
            for text in rows["text"]:
                ids = encode(text)
                decoded = decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids"].append(sha256(ids).hexdigest() if digests else ids)
                out["decoded"].append(sha256(decoded).hexdigest() if digests else decoded)
            return out

        return step

    @per_task
    def piecewise():
        encode, decode = encoder(vocabulary.value, pattern), decoder(vocabulary.value)

        def step(rows):
            ids = [encode(t) for t in rows["text"]]
            return {k: rows[k] for k in ("row", "doc_id", "piece")} | {"ids": ids, "decoded": [decode(x) for x in ids]}

        return step

    kind = "string" if digests else "binary"
    short = map_columns(docs.where(F.length("text") <= chunk), whole,
                        f"doc_id long, n_tokens long, ids {kind}, decoded {kind}")
    pieces = stitched_pieces(docs.where(F.length("text") > chunk), pattern, chunk, overlap)
    # Spread the pieces anew: the parts of a long text are encoded by different tasks.
    encoded = map_columns(pieces.repartition("row", "piece"), piecewise,
                          "row long, doc_id long, piece long, ids binary, decoded binary")
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded")))
    whole_ids = F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))")
    whole_text = F.expr("aggregate(p.decoded, cast('' as binary), (a, x) -> concat(a, x))")
    long = (encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), parts.alias("p"))
            .select("doc_id", whole_ids.alias("ids"), whole_text.alias("decoded"))
            .select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                    *[(F.sha2(c, 256) if digests else F.col(c)).alias(c) for c in ("ids", "decoded")]))
    out = short.unionByName(long)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digests else out
