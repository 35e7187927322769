"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A text's bag holds its five-word shingles with their numbers. Weights are discretised into the unit steps 0-1, 1-2, ...;
these are grouped into dyadic levels [0,1), [1,2), [2,4), [4,8), ... For each shingle and level there is one Poisson
process with the level's width as rate. Every point carries a signature position and a step inside its level, and it
counts only if the shingle's weight covers that step. A signature keeps the earliest point of each position. A process
stops once it has passed the latest of these, so that few points are drawn. Two signatures agree in a position with
the probability of the bags' weighted Jaccard similarity.

Texts that agree in all rows of a band share a bucket. Each distinct bucket is verified exactly by multiset overlap,
in blocks of a bounded size; a block hands on its local components, never pairs. Components across blocks make the
classes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import connected_components, map_columns, materialise, per_task, split_by_bitmap
from cohortlens.llm.quality import WordHashes, hash_words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
BLOCK_TEXTS = 2000
BLOCK_WORDS = 500_000


def mixed(z):
    """Well-mixed 64-bit numbers from 64-bit numbers (the published splitmix64 finaliser)."""
    import numpy as np

    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bag(text: str, known: WordHashes, width: int = SHINGLE):
    """(shingle hashes, their numbers) of a text; empty below ``width`` words."""
    import numpy as np

    h = hash_words(text, known).astype(np.uint64)
    n = max(0, len(h) - width + 1)
    key = h[:n].copy()
    for j in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j]
    return np.unique(mixed(key), return_counts=True)


def bag_minhash(bags: list, size: int):
    """One row of ``size`` point times for each bag (infinity for an empty bag), for all bags at once."""
    import numpy as np

    best = np.full((len(bags), size), np.inf)
    owner = np.repeat(np.arange(len(bags)), [len(k) for k, _ in bags])
    if not len(owner):
        return best
    key = np.concatenate([k for k, _ in bags])
    weight = np.concatenate([c for _, c in bags])
    # One process for each dyadic level below the weight: level 0 is [0, 1), level d is [2^(d-1), 2^d).
    owners, keys, weights, lows, widths = [owner], [key], [weight], [np.zeros(len(key))], [np.ones(len(key))]
    low = 1
    while (deep := weight > low).any():
        owners.append(owner[deep])
        weights.append(weight[deep])
        keys.append(mixed(key[deep] ^ np.uint64(low)))
        lows.append(np.full(deep.sum(), float(low)))
        widths.append(np.full(deep.sum(), float(low)))
        low *= 2
    owner, key, weight, lows, widths = map(np.concatenate, (owners, keys, weights, lows, widths))
    time, flat = np.zeros(len(key)), best.reshape(-1)
    while len(key):
        key = mixed(key)
        time = time - np.log1p((key >> np.uint64(11)) * -(2.0 ** -53)) / widths
        draw = mixed(key ^ np.uint64(0x5851F42D4C957F2D))
        at = ((draw >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        step = np.floor(lows + (draw & np.uint64(0xFFFFFFFF)) * 2.0 ** -32 * widths)
        good = step < weight
        np.minimum.at(flat, owner[good] * size + at[good].astype(np.int64), time[good])
        latest = best.max(axis=1)
        go = time < latest[owner]
        owner, key, weight, lows, widths, time = owner[go], key[go], weight[go], lows[go], widths[go], time[go]
    return best


def band_keys(signatures, bands: int, rows: int):
    """64-bit bucket keys, one column a band."""
    import numpy as np

    bits = signatures[:, :bands * rows].copy().view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64)), bits.shape[:2])
    for j in range(rows):
        key = mixed(key ^ bits[:, :, j])
    return key.view(np.int64)


def overlaps(bags: list):
    """Matrix of the multiset overlaps of all bags."""
    import numpy as np

    m = len(bags)
    total = np.zeros((m, m), np.float32)
    if not m:
        return total
    owner = np.repeat(np.arange(m), [int(c.sum()) for _, c in bags])
    # The i-th occurrence of a shingle is an element of its own: overlap is then plain intersection.
    key = np.concatenate([np.repeat(k, c) for k, c in bags])
    nth = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in bags]).astype(np.uint64)
    _, col, df = np.unique(mixed(key ^ mixed(nth)), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    owner, col = owner[shared], col[shared]
    known, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, len(known), 2048):
        a, b = np.searchsorted(col, (lo, lo + 2048))
        here = np.zeros((m, min(2048, len(known) - lo)), np.float32)
        here[owner[a:b], col[a:b] - lo] = 1
        rows = np.flatnonzero(here.any(axis=1))
        part = here[rows]
        if len(rows) == m:
            total += part @ part.T
        else:
            total[np.ix_(rows, rows)] += part @ part.T
    return total


def linked_roots(bags: list, similarity: Fraction):
    """For each bag the lowest index that links of ``similarity`` or more lead to; empty bags link with none."""
    import numpy as np

    m = len(bags)
    sizes = np.array([int(c.sum()) for _, c in bags], np.int64)
    p, q = similarity.numerator, similarity.denominator
    shared, near = overlaps(bags), np.zeros((m, m), bool)
    slices = [slice(lo, lo + 256) for lo in range(0, m, 256)]
    for s in slices:  # overlap / (a + b - overlap) >= p / q, in whole numbers, some rows at a time
        near[s] = (p + q) * shared[s].astype(np.int64) >= p * (sizes[s, None] + sizes[None, :])
    del shared
    near &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(near, True)
    root = np.arange(m)
    while True:
        low = np.concatenate([np.where(near[s], root[None, :], m).min(axis=1) for s in slices]) if m else root
        low = low[low]
        if (low == root).all():
            return root
        root = low


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, keys): one row per document with an id and a text."""

    @per_task
    def make():
        known = WordHashes()

        def step(cols):
            from hashlib import md5

            out = {k: [] for k in ("text_key", "n_shingles", "keys")}
            texts = cols["text"]
            for lo in range(0, len(texts), 512):
                part = texts[lo:lo + 512]
                bags = [bag(t, known, width) for t in part]
                keys = band_keys(bag_minhash(bags, bands * rows), bands, rows).tolist()
                out["text_key"] += [int(md5(t.encode()).hexdigest()[:15], 16) for t in part]
                out["n_shingles"] += [int(c.sum()) for _, c in bags]
                out["keys"] += [k if len(b[0]) else [] for k, b in zip(keys, bags)]
            return {"doc_id": cols["doc_id"]} | out

        return step

    return map_columns(docs, make, "doc_id long, text_key long, n_shingles long, keys array<long>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    width: int = SHINGLE, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, class_id and kept of every document: class_id is the smallest id of its class, which is the one kept.

    Equal texts are one class, whatever their length. Different texts link when the multisets of their ``width``-word
    shingles have a weighted Jaccard similarity of ``similarity`` or more (equality included); classes are what links
    reach. A text below ``width`` words links with equal texts only. Rows that share an id are one document. A null
    text is a class by itself; a null id has a null class and is kept. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    ids = docs.where("doc_id is not null")
    exact = Fraction(str(similarity))
    signed = materialise(signatures(ids.where("text is not null"), bands, rows, width), "signatures")
    # One row per distinct text; its smallest id stands for it.
    texts = materialise(signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
                                                       F.first("keys").alias("keys")), "texts")
    members = texts.select("text_key", "n_shingles", F.explode("keys").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    held = materialise(members.join(full, "bucket"), "buckets")
    # Buckets of the same texts are verified once.
    sets = (held.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"),
                                       F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("y"))
            .groupBy("n", "words", "x", "y").agg(F.min("bucket").alias("bucket"))
            .select("bucket", F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("words") / block_words)).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("text_key", F.lit(2)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = (held.join(sets, "bucket").select("bucket", "text_key", own.alias("own"), other.alias("other"))
              .select("bucket", "text_key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    wanted = materialise(texts.join(held.select("text_key").distinct(), "text_key", "left_semi")
                         .select("text_key", F.col("first_id").alias("doc_id")), "wanted")
    # Only texts that share a bucket are shuffled.
    likely, _ = split_by_bitmap(ids.where("text is not null"), F.col("doc_id"), wanted.select("doc_id"))
    bodies = (likely.withColumn("text_key", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
              .join(wanted, ["text_key", "doc_id"]))

    def verify(table):
        import pyarrow as pa

        known, seen = WordHashes(), set()
        doc_ids, bags = [], []
        # Rows arrive in any order; in order of ids, a component's root is its smallest id.
        table = table.sort_by([("doc_id", "ascending"), ("text_key", "ascending")])
        for key, doc_id, text in zip(*(table.column(c).to_pylist() for c in ("text_key", "doc_id", "text"))):
            if key not in seen:  # a repeated row
                seen.add(key)
                doc_ids.append(doc_id)
                bags.append(bag(text, known, width))
        root = linked_roots(bags, exact)
        pairs = [(doc_ids[i], doc_ids[r]) for i, r in enumerate(root) if i != r]
        return pa.table({"src": pa.array([a for a, _ in pairs], pa.int64()), "dst": pa.array([b for _, b in pairs], pa.int64())})

    edges = (blocks.join(bodies, "text_key").select("bucket", "i", "j", "text_key", "doc_id", "text")
             .groupBy("bucket", "i", "j").applyInArrow(verify, "src long, dst long"))
    # Copies of a text, and texts that share an id, are links too.
    copies = signed.join(texts.select("text_key", "first_id"), "text_key").select(F.col("doc_id").alias("src"), F.col("first_id").alias("dst"))
    shared = signed.select("doc_id", "text_key").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = (signed.join(shared, "doc_id").join(texts.select("text_key", "first_id"), "text_key")
               .select(F.col("doc_id").alias("src"), F.col("first_id").alias("dst")))
    classes = connected_components(edges.union(several), "neardup")
    firsts = (copies.distinct().groupBy("src").agg(F.min("dst").alias("first_id"))
              .join(classes, F.col("first_id") == F.col("node"), "left")
              .select(F.col("src").alias("doc_id"), F.coalesce("component", "first_id").alias("class_id")))
    found = docs.select("doc_id").where("doc_id is not null").join(firsts, "doc_id", "left")
    out = found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; of rows that share an id one stays.

    The row that stays of a shared id is the one whose text comes first in order. Rows without an id all stay.
    """
    named = docs.where("doc_id is not null")
    verdict = near_duplicates(docs, **params).where("doc_id is not null").groupBy("doc_id").agg(
        F.first("kept").alias("kept"), F.count("*").alias("rows"))
    special = materialise(verdict.where("not kept or rows > 1"), "special")
    # Rows of other ids, most of them, stay where they are; the rest meet the table of special ids.
    likely, other = split_by_bitmap(named, F.col("doc_id"), special.select("doc_id"))
    once = likely.join(special, "doc_id", "left_anti").select(docs.columns)
    order = F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(*[F.col(c) for c in docs.columns]))
    one = (likely.join(special.where("kept"), "doc_id", "left_semi").groupBy("doc_id")
           .agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*"))
    return other.unionByName(once).unionByName(one).unionByName(docs.where("doc_id is null"))
