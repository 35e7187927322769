"""Secret scans in DataFrame functions alone.

Base rules are regular expressions. Further secrets come from two character Markov models, one of random strings (the
values that the base rules find) and one of ordinary identifiers (other word-like strings): a run of 8 or more characters
with a letter is a secret if the log-likelihood ratio of the two is high enough.

Positions come from splitting a text at a rule's matches: a match starts after all earlier gaps and matches. Only
texts with a match go that way; the others pass as one row without a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import bounded_fraction, hash_fraction

# The base rules. A run too short for the access or hex rule holds no later match either, so that their
# lengths can stand in the patterns; an assignment with too short a value must still be consumed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What the models see; letters count in small form.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A run of 8 or more such characters with a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{8,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_]{3,}(?![A-Za-z0-9+/_=-])"
MAX_TRAIN_DOCS = 20_000
MIN_RATIO = 12_000_000
MIN_RATIO_PER_STEP = 400_000


def bigram_counts(strings: DataFrame) -> DataFrame:
    """(pair, n) over all strings of column ``s``; the one-character string before a step is its state."""
    # The characters are split once, so that a long string costs its length.
    steps = F.expr("transform(array(split(lower(s), '')), c -> zip_with(slice(c, 1, greatest(1, size(c) - 1)), slice(c, 2, size(c)), (x, y) -> concat(x, coalesce(y, ''))))[0]")
    return (strings.where("length(s) > 1").select(F.explode(steps).alias("pair"))
            .groupBy("pair").agg(F.count("*").alias("n")))


def labelled_samples(docs: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """Random strings (values found by the base rules in any text) and identifiers (of about ``max_docs`` texts)."""
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), 2), F.regexp_extract_all("text", F.lit(ACCESS), 0),
                      F.regexp_extract_all("text", F.lit(HEX), 0))
    secrets = (docs.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(values).alias("s"))
               .where("length(s) >= 16 and s rlike '[0-9]'"))
    share = bounded_fraction(docs.select("doc_id"), max_docs)
    some = docs.where(hash_fraction(F.coalesce("doc_id", F.lit(-1)), share)) if share < 1 else docs
    words = F.array_except(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0), values)
    return secrets, some.select(F.explode(words).alias("s")).where("not s rlike '[0-9]'")


def train_ratios(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> list[int]:
    """ln P(random) - ln P(identifier) of every step between two characters, in millionths, add-one smoothed.

    The driver receives a count for each pair of characters: at most the square of the alphabet for either model.
    """
    size = len(ALPHABET)
    known = set(ALPHABET)
    logs = []
    for strings in labelled_samples(docs, max_docs):
        n = {r["pair"]: r["n"] for r in bigram_counts(strings).collect() if len(r["pair"]) == 2 and set(r["pair"]) <= known}
        logs.append([math.log((n.get(a + b, 0) + 1) / (sum(n.get(a + c, 0) for c in ALPHABET) + size)) for a in ALPHABET for b in ALPHABET])
    return [round(1e6 * (r - i)) for r, i in zip(*logs)]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: int, pattern: str, good: str, value: int = 0) -> str:
    """SQL for the array of (kind, nth, gap, size, good) of a rule's matches.

    ``good`` is SQL over ``m.hit``, the match, and ``m.value``, the pattern's group ``value``. Gaps and matches are zipped,
    so that each pattern runs over a text a fixed number of times.
    """
    quoted = _quoted(pattern)
    zipped = f"arrays_zip(split(text, {quoted}, -1), regexp_extract_all(text, {quoted}, 0), regexp_extract_all(text, {quoted}, {value}))"
    return (f"transform(filter(transform({zipped}, z -> named_struct('gap', z.`0`, 'hit', z.`1`, 'value', z.`2`)), m -> m.hit is not null), (m, i) -> named_struct('kind', {kind}, 'nth', i, "
            f"'gap', cast(length(m.gap) as bigint), 'size', cast(length(m.hit) as bigint), 'good', {good}))")


def find_secrets(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, min_ratio: int = MIN_RATIO,
                 min_ratio_per_step: int = MIN_RATIO_PER_STEP) -> DataFrame:
    """doc_id and secrets, an array of (start, end, kind) in text order, of every document.

    Kinds are assign, access, hex (base rules) and random (Markov models). Positions are code points, the end
    exclusive. Letters are scored in small form: capitals are rare in identifiers, so that a model with case calls headings
    and names in capitals random. A random span that overlaps a base span is not given. A null text counts as empty.
    Repeated rows each get a row; other columns are ignored. Without any labelled sample both models are uniform and give no span.
    """
    docs = docs.select("doc_id", "text")
    ratios = train_ratios(docs, max_train_docs)
    model = f"cast(split('{','.join(map(str, ratios))}', ',') as array<bigint>)"

    def scored(run: str) -> str:
        # Split once into characters and folded over their pairs, so that a run costs its length.
        codes = f"transform(split(lower({run}), ''), x -> instr('{ALPHABET}', x) - 1)"
        pairs = f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (x, y) -> x * {len(ALPHABET)} + y)"
        ratio = f"aggregate(transform(array({codes}), c -> {pairs})[0], 0L, (a, i) -> a + get({model}, i))"
        return f"{ratio} >= greatest({min_ratio}L, {min_ratio_per_step}L * (length({run}) - 1))"

    # Every run is scored where its text lies; only texts with a match are taken apart into positions.
    runs = f"array_distinct(regexp_extract_all(text, {_quoted(CANDIDATE)}, 0))"
    docs = docs.withColumn("odd", F.expr(f"coalesce(exists({runs}, r -> {scored('r')}), false)"))
    any_rule = f"odd or coalesce(rlike(text, {_quoted(f'{ASSIGN}|{ACCESS}|{HEX}')}), false)"
    rules = [_matches(0, ASSIGN, "length(m.value) >= 6", 2), _matches(1, ACCESS, "true"), _matches(2, HEX, "true"),
             f"if(odd, {_matches(3, CANDIDATE, scored('m.hit'))}, array())"]
    cells = (docs.withColumn("row", F.monotonically_increasing_id())
             .select("row", "doc_id", F.explode_outer(F.expr(f"if({any_rule}, concat({', '.join(rules)}), null)")).alias("s"))
             .select("row", "doc_id", "s.*"))
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = (cells.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
              .withColumn("start", F.col("end") - F.col("size")))
    spans = placed.withColumn("good", F.coalesce("good", F.lit(False)))
    # A random span must lie clear of the base spans before and after it.
    base = F.col("good") & (F.col("kind") < 3)
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    clear = (F.coalesce(F.max(F.when(base, F.col("end"))).over(ahead), F.lit(-1)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(behind), F.lit(1 << 62)) >= F.col("end"))
    spans = spans.withColumn("good", F.col("good") & ((F.col("kind") < 3) | clear))
    names = F.array(*[F.lit(k) for k in KINDS])
    return (spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                     F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("start", "kind", "end")))).alias("s"))
            .select("doc_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                                  F.get(names, x["kind"]).alias("kind"))).alias("secrets")))


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and list of all spans from ``find_secrets``."""
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("secrets")).alias("spans"))
