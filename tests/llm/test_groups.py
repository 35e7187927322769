"""Operators over pairs, sequences, models and paths, and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bpe, catalog, licences, neardup, packing, secrets, vectors
from tests.conftest import SF001, SF01
from tests.llm.test_rows import AWKWARD, frame


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_classes(rows, p=4, q=5):
    sets, bags, first, holders = Sets(), {}, {}, defaultdict(list)
    for i, t in rows:
        sets.join(i, first.setdefault(t, i))
    for t, i in first.items():
        w = t.encode().split()
        bags[t] = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        for s in bags[t]:
            holders[s].append(t)
    for a, b in {(a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1:]}:
        n = sum((bags[a] & bags[b]).values())
        if (p + q) * n >= p * (sum(bags[a].values()) + sum(bags[b].values())):
            sets.join(first[a], first[b])
    return {i: sets.find(i) for i, _ in rows}


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(3):
        keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        wa, wb = rng.integers(0, 7, 60), rng.integers(0, 7, 60)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        s = neardup.bag_minhash([(keys[w > 0], w[w > 0]) for w in (wa, wb)], 8192)
        assert abs((s[0] == s[1]).mean() - true) < 0.025
    assert np.isinf(neardup.bag_minhash([(keys[:0], wa[:0])], 8)).all()


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in catalog.op4_bag_minhash(spark, SF01).collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}


def test_near_duplicates_multisets_and_blocks(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # one large group of near copies, some of them too far off
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, "a b c d e f " * 30), (101, "a b c d e f " * 15), (102, "a b c d e f " * 27)]  # sets equal, multisets not
    want = brute_classes(rows)
    for size in (neardup.BLOCK_TEXTS, 7):
        got = neardup.near_duplicates(frame(spark, rows), block_texts=size).collect()
        assert {r.doc_id: r.class_id for r in got} == want
    assert want[101] == 101 and want[102] == 100


def test_near_duplicate_cases(spark):
    rows = AWKWARD + [(8, "same text twice"), (9, None), (10, ""), (11, "first text of a shared id"), (11, "second text of a shared id")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[8].class_id == 6 and not by[8].kept and by[9].class_id == 9 and by[10].class_id == 2 and by[None].kept and by[None].class_id is None
    df = frame(spark, rows)
    once = neardup.drop_near_duplicates(df)
    assert once.columns == df.columns
    assert Counter(r.doc_id for r in once.collect()) == Counter([1, 2, 3, None, 5, 6, 7, 9, 11])
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_edges_that_differ_in_each_evaluation(spark):
    """Edges may come out of a shuffle in another order, and so with other roots, each time they are computed."""
    from cohortlens.llm.common import connected_components, map_columns

    def step(rows):
        import random

        flip = [random.random() < 0.5 for _ in rows["id"]]
        a = [x if x % 50 == 0 else x - 1 for x in rows["id"]]
        return {"src": [y if f else x for x, y, f in zip(rows["id"], a, flip)], "dst": [x if f else y for x, y, f in zip(rows["id"], a, flip)]}

    edges = map_columns(spark.range(1000), step, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: i // 50 * 50 for i in range(1000)}


def test_linked_roots_thresholds_are_inclusive():
    known = neardup.WordHashes()
    a, b = (neardup.bag(" ".join(map(str, range(n))), known) for n in (12, 14))  # 8 shingles of 10: exactly 0.8
    assert neardup.linked_roots([a, b], Fraction(4, 5)).tolist() == [0, 0]
    assert neardup.linked_roots([a, b], Fraction(81, 100)).tolist() == [0, 1]


PLAIN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in PLAIN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_base_and_models(spark):
    rng = random.Random(3)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = ["token", "=", ":", " ", "'", '"', "secret", "abcdef", "12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", ".", "-", "\n", "API_KEY"]
    rows = AWKWARD + [(50 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    rows += [(1000, "password: token: abcdefgh"), (1001, "deadbeef" * 5000)]
    hidden = ["".join(rng.choice(b62) for _ in range(32)) for _ in range(40)]
    rows += [(2000 + i, f"😀 and {h} there") for i, h in enumerate(hidden)]
    docs = frame(spark, rows).unionByName(spark.read.parquet(f"{SF001}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"),
                                          allowMissingColumns=True)
    got = secrets.secret_digests(secrets.find_secrets(docs)).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((i, hashlib.sha256(base_secrets(t).encode()).hexdigest()) for i, t in texts)
    by = {r.doc_id: r for r in got}
    for r in got:
        text = dict(texts)[r.doc_id]
        assert set(base_secrets(text).split(",")) - {""} <= set(r.spans.split(","))
    assert sum(by[2000 + i].spans == "random:6:38" for i in range(40)) >= 38
    assert not any("random" in r.spans for r in got if (r.doc_id or 0) >= 10_000)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_random_spans_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    ratios = secrets.train_ratios(docs)
    n, at = len(secrets.ALPHABET), {c: i for i, c in enumerate(secrets.ALPHABET)}
    rng = random.Random(9)
    tokens = ["".join(rng.choice("abcXYZ019_-") for _ in range(rng.randint(8, 40))) for _ in range(60)]
    small, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    one_case = ["".join(rng.choices(a, k=k)) for a, k in ((small, 20), (small.upper(), 24), (mixed, 14)) for _ in range(30)]
    plain = ["CONCLUSION", "HttpRequestHandler", "getElementById", "DISCLAIMER", "README_FIRST", "2024-01-15", "1234567890123456"]
    tokens += one_case + plain
    rows = docs.union(spark.createDataFrame([(-1 - i, f" {t} ") for i, t in enumerate(tokens)], "doc_id long, text string"))
    ratios = secrets.train_ratios(rows)
    got = {r.doc_id: r.spans for r in secrets.secret_digests(secrets.find_secrets(rows)).collect()}
    pattern = re.compile(secrets.CANDIDATE)
    for i, t in enumerate(tokens):
        m = pattern.fullmatch(t)
        total = sum(ratios[at[a] * n + at[b]] for a, b in zip(t.lower(), t.lower()[1:]))
        good = m and total >= max(secrets.MIN_RATIO, secrets.MIN_RATIO_PER_STEP * (len(t) - 1)) and not base_secrets(t)
        if not base_secrets(t):
            assert got[-1 - i] == (f"random:1:{1 + len(t)}" if good else ""), t
    assert sum(got[-61 - i] != "" for i in range(90)) >= 70
    assert not any(got[-151 - i] for i in range(len(plain)))


def test_long_runs_take_time_in_proportion(spark):
    import time

    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    labelled = [(i, "api_key = " + "".join(rng.choices(alphabet, k=30)) + " ordinary words of a plain text teach the other model" * 20)
                for i in range(200)]
    seconds = []
    for n in (100_000, 400_000):
        docs = frame(spark, labelled + [(100, "data " + "".join(rng.choices(alphabet, k=n)))])
        t0 = time.perf_counter()
        got = {r.doc_id: r.spans for r in secrets.secret_digests(secrets.find_secrets(docs)).collect()}
        seconds.append(time.perf_counter() - t0)
        assert got[100] == f"random:5:{5 + n}"
    assert seconds[1] < 4 * seconds[0] + 20


def check_packing(docs, pieces, window=1024):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = library.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    ids = [(i, np.array([*e.ids, 0], "<u4").tobytes()) for (i, _), e in zip(docs, found)]
    assert sum(len(x) // 4 for _, x in ids) == sum(p.length for p in pieces)
    by_id = defaultdict(list)
    for i, x in ids:
        by_id[i].append(x)
    seqs, cover = defaultdict(list), Counter()
    for p in pieces:
        assert any(len(x) == 4 * p.doc_tokens and zlib.crc32(x[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32 for x in by_id[p.doc_id])
        seqs[p.sequence_id].append((p.offset, p.length))
        cover.update((p.doc_id, p.doc_tokens, k) for k in range(p.start, p.start + p.length))
    want = Counter((i, len(x) // 4, k) for i, x in ids for k in range(len(x) // 4))
    assert cover == want
    short = 0
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= window
        short += end < window
    return short


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    short = check_packing([(r.doc_id, r.text) for r in docs.collect()], catalog.op8_packing(spark, SF01).collect())
    assert short <= 1


def test_packing_cases_and_levels(spark):
    rows = AWKWARD + [(100 + i, "some words " * (i % 90)) for i in range(200)]
    rows += [(400, "a <|endoftext|> b"), (401, "<|endoftext|>" * 3), (402, "<|endoftext|")]
    docs = frame(spark, rows).repartition(23)
    pieces = packing.pack_documents(docs, window=64, n_open=3, merge_group=3).collect()
    assert check_packing(rows, pieces, 64) <= 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_tokens_equal_the_json_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = bpe.encoder(bpe.vocabulary_file("byte_bpe_50k.json"), P.PATTERN)
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()] + ["\n\n  a b\x1c c ²½Ⅷ é 日本 <|endoftext|>"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sets, links = Sets(), Counter()
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1:]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {i: (links[i], sets.find(i)) for i, _ in rows if i is not None}


def test_vectors_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(i, rng.normal(size=16).round(6).tolist()) for i in range(400)]
    hub = rng.normal(size=16)
    rows += [(1000 + i, (hub + 0.12 * rng.normal(size=16)).tolist()) for i in range(500)]  # a dense ball
    rows += [(2000 + i, (0.5 * hub).tolist()) for i in range(30)] + [(3000, rows[0][1]), (3001, [1.0, 2.0]), (3002, [1.0, 2.1])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [None] * 16), (4005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int")).withColumn("key", F.lit("k"))
    want = brute_vectors(rows)
    got = vectors.near_duplicate_vectors(df, shard_nodes=150, block_nodes=100, block_queries=130, min_recall=0.999).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    true = sum(n for n, _ in want.values())
    assert sum(min(found[i][0], want[i][0]) for i in want) >= 0.99 * true
    assert all(found[i][0] <= want[i][0] for i in want)
    poor = vectors.near_duplicate_vectors(df, shard_nodes=150, block_nodes=100, block_queries=130, probes=1, degree=1, min_recall=1.1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in poor if r.vec_id is not None} == want  # ends by comparing whole blocks
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.995 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in catalog.op7_flat_graph(spark, SF01).collect()}
    assert got == brute_vectors(rows)


def searched(queries, own, x, **options):
    a, b, n = vectors.range_search(queries, own, x, vectors.robust_prune(x), 0.9, **options)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
    found = np.zeros((len(queries), len(x)), bool)
    found[a, b] = True
    return found, n / max(1, len(queries))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_search_finds_the_range():
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=(600, 24))
    x[300:] = x[:300] + 0.2 * rng.normal(size=(300, 24))
    x = unit(x)
    true = x @ x.T >= 0.9
    members, _ = searched(x, np.arange(600), x)
    strangers, _ = searched(x, np.full(600, -1), x)
    assert not (members & ~true).any() and not (strangers & ~true).any()
    assert (members & true).sum() >= 0.999 * true.sum() and (strangers & true).sum() >= 0.99 * true.sum()
    assert (searched(x, np.full(600, -1), x, beam=600)[0] == true).all()  # everything is compared
    assert (searched(x[:7], np.full(7, -1), x, share=3, beam=600)[0] == true[:7]).all()


def test_graph_search_visits_few_nodes():
    rng = np.random.Generator(np.random.PCG64(9))
    visits = []
    for n in (500, 4000):
        x = rng.normal(size=(n, 48))
        x[n // 2:] = x[:n // 2] + 0.2 * rng.normal(size=(n // 2, 48))
        x = unit(x)
        found, visited = searched(x[::4], np.arange(0, n, 4), x)
        assert (found == (x[::4] @ x.T >= 0.9)).all()
        visits.append(visited)
    assert visits[1] < 2 * visits[0] and visits[1] < 4000 / 10


def test_graph_search_in_a_dense_ball():
    rng = np.random.Generator(np.random.PCG64(10))
    x = unit(rng.normal(size=(1, 16)) + 0.1 * rng.normal(size=(800, 16)))
    found, visited = searched(x, np.arange(800), x)
    assert (found == (x @ x.T >= 0.9)).all() and visited < 2 * 800  # bounded by comparing all, not by its edges


def test_graph_search_passes_over_far_blocks():
    rng = np.random.Generator(np.random.PCG64(11))
    x = unit(np.eye(16)[:1] + 0.05 * rng.normal(size=(300, 16)))
    far = unit(np.eye(16)[1:2] + 0.05 * rng.normal(size=(50, 16)))
    found, visited = searched(far, np.full(50, -1), x)
    assert not found.any() and visited <= 16


def test_recall_is_audited_by_query(spark):
    """A ball of 200 found links must not hide pairs that were missed."""
    rng = np.random.Generator(np.random.PCG64(12))
    ball, pairs = rng.normal(size=16) + 0.05 * rng.normal(size=(60, 16)), rng.normal(size=(20, 16))
    x = np.concatenate([ball, pairs, pairs + 0.01 * rng.normal(size=(20, 16))])
    nodes = vectors.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    nodes = nodes.selectExpr("key", "dim", "vec", "vec_id rep", "1L copies")
    links = nodes.where("rep < 60").selectExpr("key", "59L links")
    assert abs(vectors.audit_recall(nodes, links, 100, 0.9) - 0.6) < 1e-9
    assert vectors.audit_recall(nodes, links.union(nodes.where("rep >= 60").selectExpr("key", "1L links")), 100, 0.9) == 1.0
    assert vectors.audit_recall(nodes.where("rep = 60"), links, 1, 0.9) == 1.0


def test_licence_texts_are_read_from_a_zip_and_never_missing(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("licence_texts/B.txt", "b ©")
        z.writestr("licence_texts/A-1.0.txt", "a")
        z.writestr("licence_texts/note.md", "no")
    assert licences.whole_texts(zipfile.Path(tmp_path / "p.zip", "licence_texts/")) == [("A-1.0", "a"), ("B", "b ©")]
    for folder in (tmp_path, tmp_path / "none"):
        with pytest.raises(FileNotFoundError):
            licences.whole_texts(folder)
    assert {"MIT", "Apache-2.0"} <= {name for name, _ in licences.whole_texts()}


def test_licences_cases(spark):
    rows = [(1, "/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "/a/b/c/x", "no statement"), (3, "/a/b/LICENSE", "Released under the MIT License."),
            (4, "/k/y", "x\nAll rights reserved.\ny"), (5, "/z/q", None), (6, None, "nothing"), (None, "/a/w", "Released under the MIT License."), (2, "/a/b/c/x", "no statement"),
            (7, "/z/r", "licence plates are read by a camera at the gate of the long road to the old town"), (8, "/ab/x", "not below a")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("licence", F.lit(1)).withColumn("term", F.lit("t"))
    got = licences.scan_licences(files).collect()
    assert len(got) == len(rows)
    by = {r.file_id: r for r in got}
    assert (by[1].stated, by[1].licence) == ("Apache-2.0", "Apache-2.0")
    assert (by[2].licence, by[2].inherited_from) == ("MIT", "/a/b") and by[4].stated == "Proprietary"
    assert by[None].licence == "Apache-2.0" and by[None].stated is None
    assert by[5].licence is by[6].licence is by[7].licence is by[8].licence is None
    assert licences.scan_licences(files.limit(0)).count() == 0


def test_licence_headers_and_whole_texts(spark):
    code = "\n".join(f"value_{i} = compute(value_{i // 2}, {i})" for i in range(200))
    notice = ("{0} This program is free software{3} you can redistribute it and/or modify\n{0} it under the terms of the GNU {1}General Public License as published by\n"
              "{0} the Free Software Foundation, either version {2} of the License, or\n{0} (at your option) any later version.\n")
    mpl = ("{0} This Source Code Form is subject to the terms of the Mozilla Public\n{0} License, v. 2.0. If a copy of the MPL was not distributed with this\n"
           "{0} file, You can obtain one at http://mozilla.org/MPL/2.0/.\n")
    isc = licences.TEXTS.joinpath("ISC.txt").read_text()
    cases = [("GPL-3.0", "# x.py\n# Copyright (C) 2020 Someone\n#\n" + notice.format("#", "", 3, ":") + code), ("MPL-2.0", mpl.format("//") + code),
             ("MPL-2.0", "/* " + mpl.format(" *")[2:] + " */\n" + code), ("GPL-3.0", "/*\n" + notice.format("  ", "", 3, ":") + "*/\n" + code),
             ("GPL-2.0", notice.format("", "", 2, ";")), ("AGPL-3.0", notice.format("", "Affero ", 3, ":")), ("GPL-3.0", notice.format("", "", 3, ":")),
             ("ISC", "Copyright (c) 2020 Someone\n\n" + isc), ("ISC", "".join(f"// {x}\n" for x in isc.splitlines()) + code), (None, "# a\n" * 50_000 + "# licence plates\n")]
    cases += [(p.stem, "Copyright 2020 Someone\n" + p.read_text()) for p in sorted(licences.TEXTS.glob("*.txt"))]
    rows = [(i, f"/{i}/x", t) for i, (_, t) in enumerate(cases)] + [(1000, "/0/below/y", code)]
    # Without other files no term would be rare.
    rows += [(2000 + r.doc_id, f"/z{r.doc_id}/d", r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    by = {r.file_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "file_id long, path string, text string")).where("file_id < 2000").collect()}
    assert [by[i].stated for i in range(len(cases))] == [k for k, _ in cases]
    assert (by[1000].stated, by[1000].licence, by[1000].inherited_from) == (None, "GPL-3.0", "/0")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    from tools.check_oracles import digest

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    res = con.execute(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    assert rows and digest(df.columns, rows)[0] == digest([d[0] for d in res.description], res.fetchall())[0]


def test_pipeline_against_brute_force(spark):
    """Each stage by its plain rule: the figures, the model's own predictions, all pairs, plain expressions, the ids."""
    import corpus_pipeline as P
    from cohortlens.llm import langid, pii, quality
    from cohortlens.llm.common import materialise

    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("extra", F.lit(7))
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "near_dedup", "pii", "packing"]
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(materialise(stage(spark, steps[-1], SF001), f"test-{name}"))
    tables = [{r.doc_id: r.text for r in s.collect()} for s in steps[:5]]
    assert all(s.columns == docs.columns for s in steps[:5])
    assert tables[1].keys() == {r.doc_id for r in quality.quality_rules(docs, labels).collect() if r.kept}
    assert tables[2].keys() == {r.doc_id for r in langid.identify_language(steps[1]).collect() if r.lang_pred != "und"}
    assert tables[3].keys() == {c for i, c in brute_classes(list(tables[2].items())).items()}
    assert tables[4].keys() == tables[3].keys()
    for i, t in tables[3].items():
        assert not pii.base_spans(tables[4][i])
        assert (tables[4][i] == t) == (not pii.scan(t, pii.anchors()))
    assert check_packing(list(tables[4].items()), steps[5].collect()) <= 1
    assert P.run(spark, SF001).count() == steps[5].count()


def test_pipeline_stages_with_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names and no rows at all, for every stage."""
    import corpus_pipeline as P

    docs = frame(spark, AWKWARD + [(8, "ein Text mit genug Wörtern, der für sich allein steht und bleiben darf")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") > 5, F.lit("de"))).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    kept = {"quality_rules": Counter([None, 8]), "language_id": Counter([None, 5, 6, 6, 7, 8]),
            "near_dedup": Counter([None, 1, 2, 3, 5, 6, 7, 8]), "pii": Counter([None, 1, 2, 3, 5, 6, 6, 7, 8])}
    for name, stage in P.STAGES:
        out, none = stage(spark, docs, SF001), stage(spark, docs.limit(0), SF001)
        assert none.count() == 0
        if name == "packing":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert check_packing(rows, out.collect()) <= 1
        else:
            assert out.columns == none.columns == docs.columns
            assert Counter(r.doc_id for r in out.collect()) == kept[name], name


def test_pipeline_rejects_unlearned_languages(spark):
    """Random letters and texts in languages that no document is labelled with; the others stay."""
    import corpus_pipeline as P

    rng = random.Random(4)
    planted = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(k)) for k in (100, 400, 2000, 9000) for _ in range(5)]
    planted += [t * k for k in (1, 3, 10) for t in (
        "to jest zupełnie inny język i nie ma go wśród wyuczonych bo pisze po polsku z wieloma znakami ",
        "Это текст на русском языке, которого нет среди выученных, и потому его надо отбросить. ",
        "tämä on suomenkielinen teksti jota ei ole opetettu mallille lainkaan ja siksi se pitäisi hylätä ")]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    good = P.keep_good_quality(spark, docs, SF01)
    new = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in P.keep_known_language(spark, good.unionByName(new, allowMissingColumns=True), SF01).select("doc_id").collect()}
    known = {r.doc_id for r in good.select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    assert len(kept & known) >= 0.995 * len(known)
