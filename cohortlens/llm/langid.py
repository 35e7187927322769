"""Language identification with hyperdimensional letter n-gram profiles.

Every letter of every script has a fixed random vector of +1/-1 of its own. A trigram's vector is
the first letter's rotated twice, times the second's rotated once, times the
third's (binding by permutation). A document is the sum of its trigrams'
vectors (bundling); a language's prototype is the sum of its training
documents. A document is compared with every prototype by cosine.

All sums are of whole numbers below 2**24 and so are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_columns, per_task

DIMENSIONS = 1024
FOLDS = 5
UNKNOWN = "und"
BLOCK_CHARS = 1 << 19
#: Letters below this code point have a row in one table, each other one a generator seeded with its code point.
LATIN = 384
#: A text is of an unlearned language below this part of the cosine that all but LOW of a language's training documents reach.
FLOOR = 0.5
LOW = 0.01
#: Fewer training documents tell nothing of a language's cosines.
MIN_FLOOR_DOCS = 8


def letter_vectors(dimensions: int, seed: int = 7):
    """A function: code points -> one row of +1/-1 each; what is no letter (0) has one too."""
    import numpy as np

    low = (np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (LATIN, dimensions)) * 2 - 1).astype(np.int8)
    drawn: dict = {}

    def rows(points):
        out = low[np.minimum(points, LATIN - 1)]
        for i in np.flatnonzero(points >= LATIN):
            point = int(points[i])
            if point not in drawn:
                if len(drawn) >= 1 << 14:  # some MB a task
                    drawn.clear()
                drawn[point] = (np.random.Generator(np.random.PCG64([seed, point])).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
            out[i] = drawn[point]
        return out

    return rows


def trigram_vectors(ids, bits, rows):
    """One row per trigram id (three places of ``bits`` bits): letter vectors, rotated twice, once and not, multiplied."""
    twice, once, plain = rows
    mask = (1 << bits) - 1
    return (twice[ids >> 2 * bits] * once[(ids >> bits) & mask] * plain[ids & mask]).astype("float32")


def letter_table():
    """Each code point, or 0 for what is no letter, which also bounds words."""
    import numpy as np

    return np.array([cp if chr(cp).isalpha() else 0 for cp in range(0x110000)], np.int32)


def text_letters(texts: list[str], table):
    """Letters of all texts as code points, a bound before and after each word, and the text each belongs to."""
    import numpy as np

    lows = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lows) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lows])
    out = table[points]
    owner = np.searchsorted(ends, np.arange(len(points)), side="left")
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
    return out[keep], np.minimum(owner[keep], len(texts) - 1)


def trigram_counts(texts: list[str], table):
    """(text index, trigram id, count) of the trigrams around each letter, the letters of these texts and the bits of
    a letter's place in an id."""
    import numpy as np

    points, owner = text_letters(texts, table)
    present = np.zeros(len(table), bool)
    present[points] = present[0] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(len(table), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    s, bits = place[points], max(1, (len(alphabet) - 1).bit_length())
    mid = s[1:-1] > 0
    ids = (s[:-2][mid] << 2 * bits) | (s[1:-1][mid] << bits) | s[2:][mid]
    # At most 18 bits a letter and 9 for the 512 texts of a block.
    key, n = np.unique((owner[1:-1][mid] << 3 * bits) | ids, return_counts=True)
    return key >> 3 * bits, key & ((1 << 3 * bits) - 1), n, alphabet, bits


def bundle(texts: list[str], letters, table, group=None):
    """One bundled vector per text, or per ``group`` number of the texts."""
    import numpy as np

    doc, ids, n, alphabet, bits = trigram_counts(texts, table)
    plain = letters(alphabet)
    vectors = (np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain)
    rows = len(texts) if group is None else int(max(group)) + 1
    if group is not None:
        doc = np.asarray(group)[doc]
    known, col = np.unique(ids, return_inverse=True)
    total = np.zeros((rows, plain.shape[1]), np.float32)
    for lo in range(0, len(known), 4096):  # some MB of trigram vectors at a time
        at = (col >= lo) & (col < lo + 4096)
        counts = np.zeros((rows, min(4096, len(known) - lo)), np.float32)
        np.add.at(counts, (doc[at], col[at] - lo), n[at])
        total += counts @ trigram_vectors(known[lo:lo + 4096], bits, vectors)
    return total


def blocks(texts: list) -> list[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters and 512 texts at most."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS or i - lo >= 511:
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return out + [(lo, len(texts))] * (lo < len(texts))


def held_out(id_col="doc_id"):
    """True where crc32 of the id as text is a multiple of FOLDS; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """All rows with an id, text and lang."""
    return docs.where("lang is not null and text is not null and doc_id is not null")


def train_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, list[int]]:
    """Language -> prototype, from all ``training_rows``.

    Each task bundles its own rows and emits one vector a language; Spark adds them. The driver receives languages x
    ``dimensions`` numbers.
    """
    return prototypes_of(training_rows(docs), dimensions)


def prototypes_of(rows: DataFrame, dimensions: int) -> dict[str, list[int]]:
    @per_task
    def make():
        import numpy as np

        letters, table = letter_vectors(dimensions), letter_table()
        total: dict = {}

        def step(rows):
            langs = sorted(set(rows["lang"]))
            number = {x: i for i, x in enumerate(langs)}
            for lo, hi in blocks(rows["text"]):
                group = [number[x] for x in rows["lang"][lo:hi]]
                for x, got in zip(langs, bundle(rows["text"][lo:hi], letters, table, group).astype(np.int64)):
                    total[x] = total[x] + got if x in total else got

        def finish():
            return {"lang": [x for x in total for _ in range(dimensions)], "at": list(range(dimensions)) * len(total),
                    "v": [v for x in total for v in total[x].tolist()]}

        step.finish = finish
        return step

    sums = (map_columns(rows.select("text", "lang"), make, "lang string, at int, v long")
            .groupBy("lang", "at").agg(F.sum("v").alias("v")).orderBy("lang", "at").collect())
    out: dict[str, list[int]] = {}
    for r in sums:
        out.setdefault(r["lang"], []).append(r["v"])
    return {k: v for k, v in out.items() if any(v)}


def predictor(prototypes: dict[str, list[int]], dimensions: int):
    """texts -> (languages, scores), made once a task."""
    import numpy as np

    letters, table = letter_vectors(dimensions), letter_table()
    langs = sorted(prototypes)
    protos = np.array([prototypes[x] for x in langs], np.float64).reshape(len(langs), dimensions)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-300)

    def predict(texts: list) -> tuple[list[str], list[float]]:
        texts = [t or "" for t in texts]
        found, scores = [], []
        for lo, hi in blocks(texts):
            vectors = bundle(texts[lo:hi], letters, table).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = np.round(vectors @ protos.T / np.maximum(norms, 1e-300)[:, None], 6) if langs else np.zeros((hi - lo, 1))
            best = cosines.argmax(axis=1)  # ties: the first in name order
            for i, t in enumerate(texts[lo:hi]):
                known = bool(langs) and any(map(str.isalpha, t))
                found.append(langs[best[i]] if known else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, cosines[i, best[i]]))) if known else 0.0)
        return found, scores

    return predict


def identify_language(docs: DataFrame, train: DataFrame | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document.

    Trains on all rows of ``train`` (default: ``docs``) that are not held out. A null text, or one without a letter, or
    any text when nothing could be learned, is ``und`` with score 0. A null id is never held out and never trained on.
    Equal cosines go to the first language by name. Repeated rows each get a row; other columns are ignored.
    """
    source = (docs if train is None else train).select("doc_id", "text", "lang")
    model = train_prototypes(source.where(~held_out()), dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @per_task
    def make():
        predict = predictor(shared.value, dimensions)

        def step(rows):
            found, scores = predict(rows["text"])
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": found, "score": scores}

        return step

    return map_columns(docs.select("doc_id", "text", held_out().alias("held_out")), make,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def cosine_floors(rows: DataFrame, model, dimensions: int) -> dict[str, float]:
    """Language -> smallest cosine of a text in it, from the cosines of the training rows that are predicted rightly.

    A language with few of them takes the lowest floor of the others, or 0. The driver receives a row a language.
    """

    @per_task
    def make():
        predict = predictor(model.value, dimensions)

        def step(rows):
            found, scores = predict(rows["text"])
            mine = [(x, round(s, 3)) for x, s, lang in zip(found, scores, rows["lang"]) if x == lang]
            return {"lang": [x for x, _ in mine], "score": [s for _, s in mine]}

        return step

    low = (map_columns(rows.select("text", "lang"), make, "lang string, score double").groupBy("lang")
           .agg(F.count("*").alias("n"), F.percentile("score", F.lit(LOW)).alias("low")).collect())
    floors = {r["lang"]: FLOOR * r["low"] for r in low if r["n"] >= MIN_FLOOR_DOCS}
    least = min(floors.values(), default=0.0)
    return {x: floors.get(x, least) for x in model.value}


def language_filter(docs: DataFrame, min_score: float = 0.0, languages: list[str] | None = None,
                    dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents with a predicted language (in ``languages``, if given) and a score of ``min_score`` or more.

    The score must also reach the language's floor (``cosine_floors``), so that texts in no learned language and random
    letters are rejected, as are texts without a letter. Prototypes and floors come from all rows that are not held out. All columns stay as they are.
    """
    rows = training_rows(docs.select("doc_id", "text", "lang").where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(prototypes_of(rows, dimensions))
    floors = cosine_floors(rows, shared, dimensions)

    def keep(batches):
        import pyarrow as pa

        predict = predictor(shared.value, dimensions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, min(1024, batch.num_rows - lo))
                found, scores = predict(part.column("text").to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= max(min_score, floors[x]) and (languages is None or x in languages)
                                            for x, s in zip(found, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
