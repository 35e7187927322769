"""Fill-in-middle, periodic runs and BPE with word ends against plain versions, round trips and the tokenizers library."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pytest

from cohortlens.llm import catalog, common, fim, periodic, wordbpe
from tests.conftest import SF001
from tests.llm.test_rows import AWKWARD, frame

LONG = "a line of text\n" * 40_000 + "é😀 without end"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(rows):
    return {r.doc_id: r for r in rows}


# --- fill-in-middle ---

def plain_fim(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = by_id(catalog.op11_fill_in_middle(spark, SF001).collect())
    assert len(got) == len(docs)
    forms = set()
    for d in docs:
        n, form, before, middle, output = plain_fim(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, before, middle, sha(output), sha(d.text))
        forms.add(form)
    assert forms >= {"psm", "spm"}


def test_fim_cases(spark):
    rows = AWKWARD + [(20, "a\n\nb"), (21, "\n"), (22, "x <P> y\nz\n"), (23, "ends < with\n<"), (24, LONG), (25, "one line")]
    for block in (fim.BLOCK, 5):
        got = fim.fill_in_middle(frame(spark, rows), block=block).collect()
        assert len(got) == len(rows)
        want = [plain_fim(i, t or "") for i, t in rows]
        assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted(
            (str(i), *w) for (i, _), w in zip(rows, want)) if block == fim.BLOCK else True
        assert {r.doc_id: r.output for r in got} == {i: w[4] for (i, _), w in zip(rows, want)}
    assert fim.fill_in_middle(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, rows), marks=("<P", "P<", "M"))


def test_fenwick_cuts_against_lines():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab\né😀\n") for _ in range(rng.randrange(60)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = fim.Blocks(text.encode(), rng.choice([1, 2, 3, 7, 64]))
        assert (tree.n, tree.n_chars) == (len(units), len(text))
        for n in range(len(units) + 1):
            head = "".join(units[:n])
            assert tree.cut(n) == (len(head.encode()), len(head))


def test_fim_rates(spark):
    rows = [(i, f"first {i}\nsecond\nthird\n") for i in range(400)]
    got = fim.fill_in_middle(frame(spark, rows), fim_percent=50, spm_percent=0, seed=11).collect()
    plain = sum(r.form == "plain" for r in got)
    assert 140 < plain < 260 and not any(r.form == "spm" for r in got)
    marks = tuple(m.encode() for m in ("<P>", "<S>", "<M>"))
    assert {r.doc_id: fim.restore(r.output.encode(), r.form, marks).decode() for r in got} == dict(rows)


# --- periodic runs ---

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def spliced(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_against_all_lags():
    rng = random.Random(1)
    total = 0
    for t in range(1500):
        kind = t % 6
        if kind == 0:
            w = [rng.randrange(2) for _ in range(rng.randrange(120))]
        elif kind == 1:
            w = [rng.randrange(50) for _ in range(rng.randrange(80))]
            w += (w[-rng.randrange(1, 40):] or [1]) * rng.randrange(1, 5) + [rng.randrange(50) for _ in range(10)]
        elif kind == 2:
            w = [1] * rng.randrange(60) + [2] + [1] * rng.randrange(60) + [2]
            w = w * rng.randrange(1, 4) + [3] + w
        elif kind == 3:
            a, w = [0], [0, 1]
            for _ in range(rng.randrange(3, 9)):
                a, w = w, w + a
        elif kind == 4:
            w = [rng.randrange(5) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9)
            w[rng.randrange(len(w))] = 7
            w = w * rng.randrange(1, 4) + [rng.randrange(5) for _ in range(20)] + w
        else:
            w = [int(rng.random() < 0.1) for _ in range(rng.randrange(200))]
        want = plain_runs(w)
        total += len(want)
        assert periodic.find_runs(np.array(w, np.int64)) == want
    assert total > 2000


def test_runs_of_documents(spark):
    docs = [d for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = by_id(catalog.op12_periodic_runs(spark, SF001).collect())
    assert len(got) == len(docs)
    for d in docs:
        words = spliced(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        runs = plain_runs(words)
        r = got[d.doc_id]
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert sum(r.n_runs > 0 for r in got.values()) >= 10


def test_runs_cases(spark):
    rows = AWKWARD + [(30, "x y " * 6), (31, "x y " * 5 + "x"), (32, "a " * 11), (33, " 　 " * 12 + "\x1c"), (34, "p q r s t u v " * 2 + "w")]
    got = periodic.find_periodic_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    r = by_id(got)
    triples = lambda i: [(x.start, x.length, x.period) for x in r[i].runs]
    assert triples(5) == [(0, 60_000, 1)] and r[5].collapsed == "word"
    assert triples(30) == [(0, 12, 2)] and r[30].collapsed == "x y" and triples(31) == [] and triples(32) == []
    assert triples(33) == [(0, 12, 1)] and triples(34) == [(0, 14, 7)] and r[34].collapsed == "p q r s t u v w"
    assert (r[1].n_words, r[1].runs, r[1].collapsed) == (0, [], "") and r[2].collapsed == "" and r[3].n_words == 0
    assert periodic.find_periodic_runs(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, np.int64), lambda n: np.tile(np.random.default_rng(0).integers(0, 3000, n // 4), 4),
                                  lambda n: np.random.default_rng(0).integers(0, 300, n)])
def test_runs_of_long_texts_grow_with_the_words(make):
    t0 = time.perf_counter()
    periodic.find_runs(make(200_000))
    assert time.perf_counter() - t0 < 20


# --- BPE with word ends ---

@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(wordbpe.FILE))


@pytest.fixture(scope="module")
def codec():
    data = wordbpe.vocabulary_file(wordbpe.FILE)
    return wordbpe.Codec(data, wordbpe.Merges(json.loads(data)))


def test_word_bpe_of_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = by_id(catalog.op13_word_bpe(spark, SF001).collect())
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_word_bpe_random_texts(codec, library):
    rng = random.Random(3)
    bits = [*"aàÉßİıſſKÅ 's 't're 've'm'll'd 0½²Ⅷ٣ \u0085 \x1c\x1d 　日本語éΣςΑ😀👍🏽‍ǅȺȾ", "<|endoftext|>", "<|startoftext|>", "'S", "'LL", "</w>", "hello", "the", "ing",
            "aaaa", "\n\n", "ŉ", "é", ";", "Å"]
    texts = []
    for k in range(3000):
        if k % 3 == 0:
            pick = lambda: rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0x250), rng.randrange(32, 127), rng.randrange(0x250, 0x3000)])
            texts.append("".join(chr(pick()) for _ in range(20)))
        elif k % 3 == 1:
            texts.append("".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 90))))
        else:
            texts.append("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))))
    for text, ids in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_word_bpe_pair_test_equals_merging(codec):
    m = codec.merges
    byte = {c: b for b, c in enumerate(wordbpe.byte_letters())}

    def spelled(t):
        last = t.endswith("</w>")
        out = [byte[c] for c in (t[:-4] if last else t)]
        out[-1] += 256 * last
        return out

    rng = random.Random(4)
    ids = list(m.names)
    pairs = [(a, b) for a, b in zip(rng.choices(ids, k=5000), rng.choices(ids, k=5000)) if not m.names[a].endswith("</w>")]
    got = m.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [m.merge(spelled(m.names[a]) + spelled(m.names[b])) == [a, b] for a, b in pairs]
    assert 0 < got.sum() < len(got)


def test_word_bpe_merges_out_of_order_and_unknown_symbols():
    from tokenizers import Tokenizer, models

    rng = random.Random(6)
    for trial in range(30):
        vocab = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>"])}
        merges = []
        while len(merges) < 14:
            a, b = rng.choice([t for t in vocab if not t.endswith("</w>")]), rng.choice(list(vocab))
            if [a, b] not in merges and len(a + b) < 14:
                merges.append([a, b])
                vocab.setdefault(a + b, len(vocab))
        rng.shuffle(merges)  # ranks that do not follow from training
        library = Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m) for m in merges], end_of_word_suffix="</w>"))
        m = wordbpe.Merges({"model": {"type": "BPE", "vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}})
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 70))) for _ in range(60)] + ["acb", "ca"]
        for w, ids in zip(words, m.encode([w.encode() for w in words])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(w).ids, (merges, w)


def test_word_bpe_cases(spark, library):
    rows = AWKWARD + [(40, "One<|endoftext|>two <|startoftext|>"), (41, "antidisestablishmentarianism" * 2000), (42, "a" * 50_000)]
    got = wordbpe.encode_words(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert wordbpe.encode_words(frame(spark, rows).limit(0)).count() == 0


def test_slices_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * 100] * 30 + ["y" * 5000] + [None] * 5 + ["z"] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices(batch, rows=1024, size=1000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 1024 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000) for p in parts)
    assert len(parts) < 15
