"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Word uni- and bigrams are hashed into buckets. Two multinomials are counted,
one over the trusted documents and one over the whole corpus. A document's
score is its mean log-likelihood ratio per n-gram; it is kept when the score
reaches a fixed threshold and the base rules hold. The ratio of a bucket is a
whole number of micronats, so that scores are the same in any order of
summation, on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import bounded_fraction, hash_fraction, map_columns, per_task

BUCKETS = 1 << 16
MAX_TARGET_DOCS = 50_000
MIN_SCORE = -0.25
#: Weight of the prior belief that a bucket is as frequent in the target as in the corpus, in occurrences.
PRIOR = 10
WINDOW = 5
SYMBOLS = "#*$%&|<>"


class WordHashes(dict):
    """60-bit md5 hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        from hashlib import md5

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = int(md5(word).hexdigest()[:15], 16)
        return h


def grams(hashes, buckets: int):
    """Buckets of the unigrams, then (offset) of the bigrams."""
    import numpy as np

    one = hashes % buckets
    return np.concatenate([one, (one[:-1] * 31 + one[1:]) % buckets + buckets])


def repeated_words(hashes, width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    import numpy as np

    n = len(hashes) - width + 1
    if n < 2:
        return 0
    h = hashes.astype(np.uint64)
    key = h[:n].copy()
    for j in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def hash_words(text: str, known: WordHashes):
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on [\x20\x09-\x0D] alone
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: each task sums its own documents first."""

    @per_task
    def make():
        import numpy as np

        known, total = WordHashes(), np.zeros(2 * buckets, np.int64)

        def step(rows):
            parts = [grams(hash_words(t, known), buckets) for t in rows["text"] if t]
            if parts:
                total[:] += np.bincount(np.concatenate(parts), minlength=2 * buckets)

        def finish():
            at = np.flatnonzero(total)
            return {"bucket": at.tolist(), "n": total[at].tolist()}

        step.finish = finish
        return step

    return (map_columns(docs.select("text"), make, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def trusted_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TARGET_DOCS) -> DataFrame:
    """Texts of documents labelled good; about ``max_docs`` of them at most, by a hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    share = bounded_fraction(good, max_docs)
    picked = good.where(hash_fraction(F.col("doc_id"), share)) if share < 1 else good
    # About max_docs ids of 8 bytes: small by construction.
    return docs.join(F.broadcast(picked), "doc_id", "left_semi")


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  max_target_docs: int = MAX_TARGET_DOCS) -> list[int]:
    """Log ratio target/raw of each bucket in micronats (2 x ``buckets`` numbers).

    Counts are smoothed towards a ratio of one, so that a rare n-gram which the target happens to lack weighs little:
    a document need not be labelled to score well, in a small corpus either.
    """
    import math

    raw = gram_counts(docs, buckets)
    target = gram_counts(trusted_documents(docs, labels, max_target_docs), buckets)
    both = (raw.withColumnRenamed("n", "n_raw")
            .join(target.withColumnRenamed("n", "n_target"), "bucket", "left").collect())  # at most 2 x buckets rows
    n_raw, n_target = [0] * (2 * buckets), [0] * (2 * buckets)
    for r in both:
        n_raw[r["bucket"]], n_target[r["bucket"]] = r["n_raw"], r["n_target"] or 0
    all_raw, all_target = sum(n_raw), sum(n_target)
    if not all_target:
        return [0] * (2 * buckets)
    expected = all_target / all_raw
    return [round(1e6 * math.log((t + PRIOR * expected) / (r + PRIOR) / expected)) for r, t in zip(n_raw, n_target)]


SCORED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def judge(texts: list, ratios, known: WordHashes, min_score: float, buckets: int) -> dict[str, list]:
    """The figures and verdict of each text."""
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")}
    for text in texts:
        text = text or ""
        h = hash_words(text, known)
        n, rep = len(h), repeated_words(h)
        failed = n < 10 or 100 * rep > 20 * n
        score = round(int(ratios[grams(h, buckets)].sum()) / (2 * n - 1) / 1e6, 6) if n else 0.0
        for k, v in (("n_words", n), ("word_chars", len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))),
                     ("n_symbols", sum(map(text.count, SYMBOLS))), ("n_dup_lines", repeated_lines(text)),
                     ("n_repeat_words", rep), ("base_failed", failed), ("kept", not failed and score >= min_score), ("score", score)):
            out[k].append(v)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, buckets: int = BUCKETS,
                  max_target_docs: int = MAX_TARGET_DOCS) -> DataFrame:
    """One row per document with its figures, score and verdict.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are ignored. A null text counts as
    empty, and an empty text fails the base rules. Repeated rows each get a row. Without any trusted document all
    ratios are 0 and only the base rules decide. A score equal to ``min_score`` is kept.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(bucket_ratios(docs, labels.select("doc_id", "quality"), buckets, max_target_docs))

    @per_task
    def make():
        import numpy as np

        known, ratios = WordHashes(), np.array(shared.value, np.int64)

        def step(rows):
            return {"doc_id": rows["doc_id"]} | judge(rows["text"], ratios, known, min_score, buckets)

        return step

    return map_columns(docs, make, SCORED)


def quality_filter(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns (see there for nulls and ties)."""
    min_score, buckets = params.get("min_score", MIN_SCORE), params.get("buckets", BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(bucket_ratios(
        docs.select("doc_id", "text"), labels.select("doc_id", "quality"), buckets, params.get("max_target_docs", MAX_TARGET_DOCS)))

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        known, ratios = WordHashes(), np.array(shared.value, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, min(1024, batch.num_rows - lo))
                got = judge(part.column("text").to_pylist(), ratios, known, min_score, buckets)
                yield part.filter(pa.array(got["kept"]))

    return docs.mapInArrow(keep, docs.schema)
