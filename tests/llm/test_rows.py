"""Operators that work row by row: figures, languages, personal data, extraction, tokens."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bpe, catalog, extract, langid, pii, quality
from tests.conftest import SF001, SF01

AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (None, "an id that is null here and some more words to pass the rule of ten"),
           (5, "word " * 60_000), (6, "same text twice"), (6, "same text twice"), (7, "  \x1c é 日本語 😀 " * 50)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Columns whose names clash with what the operators make.
    return df.select("*", F.lit("x").alias("kept"), F.lit(1.5).alias("n_words"), F.lit("fr").alias("lang"), F.lit(0).alias("row"),
                     F.lit("s").alias("key"), F.lit(3).alias("component")) if extra else df


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_figures_and_score(spark):
    labels = spark.createDataFrame([(6, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.quality_rules(frame(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD)
    texts = {i: t for i, t in AWKWARD}
    for r in got:
        n = brute_figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_quality_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").collect() if r.quality == 1}
    import math

    def grams(text):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        m = quality.BUCKETS
        return [x % m for x in h] + [(a % m * 31 + b % m) % m + m for a, b in zip(h, h[1:])]

    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(g := grams(t))
        if i in good:
            target.update(g)
    e = sum(target.values()) / sum(raw.values())
    ratio = {b: round(1e6 * math.log((target[b] + quality.PRIOR * e) / (n + quality.PRIOR) / e)) for b, n in raw.items()}
    got = {r.doc_id: r for r in catalog.op1_quality_rules(spark, SF001).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        g = grams(t)
        score = round(sum(ratio[b] for b in g) / max(1, len(g)) / 1e6, 6)
        assert got[i].score == pytest.approx(score, abs=2e-6)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.MIN_SCORE)


def test_quality_keeps_clean_and_drops_junk(spark):
    got = {r.doc_id: r for r in catalog.op1_quality_rules(spark, SF01).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    junk = [i for i, t in texts.items() if "%%%" in t and "***" in t and not got[i].base_failed]
    clean = [i for i, t in texts.items() if not re.search(r"[#*$%&|<>!]", t) and not got[i].base_failed]
    assert sum(got[i].kept for i in clean) >= 0.99 * len(clean)
    assert sum(got[i].kept for i in junk) <= 0.2 * len(junk)


def test_quality_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("kept", F.lit(1))
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    kept = {r.doc_id for r in catalog.op1_quality_rules(spark, SF001).collect() if r.kept}
    out = quality.quality_filter(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == kept
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert all(r.score == 0 for r in quality.quality_rules(docs, labels.limit(0)).collect())


def test_language_held_out_accuracy(spark):
    got = catalog.op9_language_id(spark, SF01).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = AWKWARD + [(20, "12345 !?"), (21, "été"), (22, "𐐀𐐁𐐂 deseret")]
    got = langid.identify_language(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[20].lang_pred == "und"
    assert by[21].lang_pred == "fr" and not by[None].held_out
    empty = frame(spark, rows).limit(0)
    assert langid.identify_language(empty).count() == 0
    untrained = langid.identify_language(frame(spark, rows), train=empty)
    assert {r.lang_pred for r in untrained.collect()} == {"und"}
    kept = langid.language_filter(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 21, 22}


def test_language_models_see_every_training_row(spark):
    """A language of one document among 60,000 is learned: no sample stands for the training rows."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"))
    train = rows.where(~langid.held_out())
    model = langid.train_prototypes(train)
    one, n = langid.train_prototypes(train.limit(1)), train.count()
    assert model["en"] == [n * v for v in one["en"]]
    rare = [i for i in range(60_000, 60_100) if zlib.crc32(str(i).encode()) % 5][:4]
    more = rows.unionByName(spark.createDataFrame([(i, "жук ждёт", "ru") for i in rare[:1]] + [(i, "жук", None) for i in rare[1:]], "doc_id long, text string, lang string"))
    kept = langid.language_filter(more).where(F.col("doc_id") >= 60_000)
    assert {r.doc_id for r in kept.collect()} == set(rare)
    assert {r.lang_pred for r in langid.identify_language(more).where(F.col("doc_id") >= 60_000).collect()} == {"ru"}


def test_language_vectors_against_letter_by_letter():
    import numpy as np

    letters, table = langid.letter_vectors(64), langid.letter_table()
    for text, s in (("Ab é, ab", "\0ab\0é\0ab\0"), ("Жю, 漢字 ذ 𝒳\U00020000!", "\0жю\0漢字\0ذ\0𝒳\U00020000\0")):
        v = [letters(np.array([ord(c)]))[0].astype(int) for c in s]
        want = sum((np.roll(a, 2) * np.roll(b, 1) * c for x, a, b, c in zip(s[1:], v, v[1:], v[2:]) if x != "\0"), np.zeros(64))
        assert (langid.bundle([text, ""], letters, table) == np.array([want, np.zeros(64)])).all()
        # The same letters have the same vectors in whatever company.
        assert (langid.bundle(["xyz Ωмир", text], letters, table)[1] == want).all()


def test_every_letter_has_its_own_vector(spark):
    import numpy as np

    letters = langid.letter_vectors(1024)
    points = np.array([0, *map(ord, "abzéаяذж漢字𝒳"), 0x0430 + 0x200, 0x4E00, 0x4E80])
    v = letters(np.unique(points)).astype(int)
    assert set(np.unique(v)) == {-1, 1} and abs(v @ v.T - 1024 * np.eye(len(v))).max() < 200
    assert (letters(points[::-1])[::-1] == letters(points)).all()
    # Two scripts whose letters lie 512 apart, with the same words.
    rng = random.Random(3)
    words = ["".join(chr(0x430 + rng.randrange(16)) for _ in range(5)) for _ in range(40)]
    shift = lambda t: "".join(chr(ord(c) + 0x200) if c != " " else c for c in t)
    rows = [(i, " ".join(rng.choices(words, k=30)), "one") for i in range(60)]
    rows = [(i, shift(t) if i % 2 else t, "two" if i % 2 else "one") for i, t, _ in rows]
    got = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.doc_id % 2, r.lang_pred) for r in got} == {(0, "one"), (1, "two")}


def test_pii_base_spans_equal_plain_expressions(spark):
    automaton = pii.anchors()
    rng = random.Random(5)
    letters = "0123456789012345678901 -.+()@@..aZ_%:/ \né😀"
    for _ in range(20_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert sorted(s for s in pii.scan(t, automaton) if s[0] in pii.BASE_KINDS) == sorted(pii.base_spans(t)), t
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in catalog.op10_pii(spark, SF01).collect():
        base = pii.joined(pii.base_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_email == sum(s[0] == "email" for s in pii.base_spans(docs[r.doc_id]))


def test_pii_parsers_and_mask(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00 is mine, https://bob:pw@x.org/ account no. 123-456-789, 4111 1111 1111 1111, +1 (377) 555-0271"
    spans = pii.scan(text, pii.anchors())
    assert {k for k, _, _ in spans} == {"iban", "userinfo", "email", "account", "card", "phone"}
    assert pii.mask(text, spans) == "IBAN: [IBAN] is mine, https://[USERINFO]/ account no. [ACCOUNT], [CARD], [PHONE]"
    rows = AWKWARD + [(30, text)]
    df = frame(spark, rows).withColumn("n_chars", F.length("text"))
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    masked = pii.mask_documents(df)
    assert masked.columns == df.columns
    by = {r.doc_id: r for r in masked.collect()}
    assert by[1].text is None and by[5].text == "word " * 60_000
    assert by[30].n_chars == len(by[30].text) and "4111" not in by[30].text
    assert pii.find_pii(df.limit(0)).count() == 0


def test_extraction_against_the_article_element(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF01}/pages.parquet").collect()
    got = {r.page_id: r for r in catalog.op2_html_extraction(spark, SF01).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("a < b <p>c", "a < b\n\nc"),
    ("<p>x<script>var a='<p>no</p>'", "x"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<nav>menu</nav>", ""),
    ("<div class=content><p>" + "long words " * 20 + "<div class='ad'>buy</div><p>end &lt;b&gt; &#233;&nbsp;x</div>"
     "<div id=comments><p>" + "I think so " * 20 + "</div>", ("long words " * 20).strip() + "\n\nend <b> é x"),
    ("<article><header><h1>Title</h1></header><p>One.<p>Two <i>th</i>ree<aside>no</aside></article><p>" + "outside " * 30, "Title\n\nOne.\n\nTwo three"),
    ("<div id='header'>Site name</div><div class='entry-header'><h1>Title</h1></div><p>" + "text " * 30 + "<div class='site-alert'>" + "note " * 30,
     "Title\n\n" + ("text " * 30).strip()),
    ("<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>" + "text " * 30 + "</body>", ("text " * 30).strip()),
])
def test_extraction_cases(html, text):
    assert extract.extract_text(html) == text


BODY = "".join(f"<p>Paragraph {i} tells the story of the page at some length.</p>" for i in range(6))
STORY = "\n\n".join(f"Paragraph {i} tells the story of the page at some length." for i in range(6))


@pytest.mark.parametrize("html,text", [
    *[(f"<div class='{c}'>{BODY}</div><div class='sidebar-left'>aside</div>", STORY) for c in (
        "content has-sidebar", "no-sidebar", "site cookie-consent", "post-with-comments", "layout with-menu")],
    (f"<form id=aspnet>{BODY}</form>", STORY),
    (f"<div class=sidebar><article>{BODY}</article></div><p>" + "other " * 90, STORY),
    # A list of comments stays out, also when it is longer than the text or made of articles.
    (f"<div>{BODY}</div><div id=comments>" + "<article><p>I disagree with all of it.</p></article>" * 30 + "</div>", STORY),
    (f"<article>{BODY}</article><div class='cookie-consent'>We use cookies.</div>", STORY),
    ("<p>before<svg viewBox='0 0 1 1'/></p><p>after<math/> all</p>", "before\n\nafter all"),
    ("<p>x<svg><text>no</text></svg>y", "x y"),
])
def test_extraction_names_are_checked_by_what_they_hold(html, text):
    assert extract.extract_text(html) == text


@pytest.mark.parametrize("html,text", [
    # A body in a div is not lost to teasers, whether there are several or one.
    (f"<div>{BODY * 3}</div>" + "<article><h2><a href=x>Another story</a></h2><p>Short.</p></article>" * 4, "\n\n".join([STORY] * 3)),
    (f"<div>{BODY * 3}</div><nav>menu</nav><div>x</div><article>Read on.</article>", "\n\n".join([STORY] * 3)),
    # Articles stay whole beside shorter text.
    (f"<article>{BODY}<p>End.</p></article><div>Some more text beside the article of this page.</div>", STORY + "\n\nEnd."),
    (f"<article>{BODY}</article><article><p>Second.</p></article><div>{BODY}</div>", STORY + "\n\nSecond."),
])
def test_extraction_compares_articles_with_text_beside_them(html, text):
    got = extract.extract_text(html)
    assert got.startswith(text) and len(got) < len(text) + 40


@pytest.mark.parametrize("inline", [
    "<button>Subscribe</button>", "<span class='ad'>Buy now</span>", "<a class='ad' href=x>Buy now</a>", "<a class='share' href=x>Tweet</a>",
    "<span hidden>secret words</span>", "<label>Your name</label>", "<i role=alert>Careful</i>", "<b><span class='newsletter-signup'>Join <u>us</u></span></b>"])
def test_extraction_leaves_inline_boilerplate_out(inline):
    assert extract.extract_text(f"<article><p>Body one.</p>{inline}<p>Body two.</p></article>") == "Body one.\n\nBody two."
    assert extract.extract_text(f"<article><p>Body one, {inline} still one.</p><p>Body two.</p></article>") == "Body one, still one.\n\nBody two."
    assert extract.extract_text(f"<div><p>{'Body one ' * 30}{inline}</p><p>Body two.</p></div>") == ("Body one " * 30).strip() + "\n\nBody two."


def test_extraction_regions_against_definitions():
    """Surge and dive by their definitions, line by line: a window's sum leaves zero, and comes back to it."""
    rng = random.Random(8)
    for _ in range(400):
        window, floor = rng.randrange(1, 5), rng.choice([1, 20, 80])
        lines = [("x" * rng.choice([0, 1, 5, 30, 90]) or "y" * 7, 0, rng.random() < 0.5, 0) for _ in range(rng.randrange(1, 30))]
        size = [0 if boiler else len(t) for t, _, boiler, _ in lines]
        sums = [sum(size[i:i + window]) for i in range(len(size))]
        want = []
        least = min(floor, max(sums))
        for j, n in enumerate(size):
            if n:
                lo = hi = j  # a window that starts at a counting line is not zero
                while lo and sums[lo - 1]:
                    lo -= 1
                while hi + 1 < len(sums) and sums[hi + 1]:
                    hi += 1
                if max(sums[lo:hi + 1]) >= least:
                    want.append(lines[j][0])
        assert extract.main_lines(lines, window, floor) == want


@pytest.mark.parametrize("html", ["<div class=ad>x" * 20_000, "<div class='" + "ad-" * 30_000 + "!'>x", "<article>x" * 20_000])
def test_extraction_of_nested_parts_is_linear(html):
    test_extraction_is_linear(html)


@pytest.mark.parametrize("html", ["<a " * 30_000, '<a "' * 30_000, "<" * 50_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>" * 20_000 + "x", "<head>" * 40_000, "<p>a <i>b</i>" * 20_000])
def test_extraction_is_linear(html):
    import time

    t = time.time()
    extract.extract_text(html)
    assert time.time() - t < 5


def test_extraction_frame(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "v", "<p>x"), (3, "v", "<p>x")], "page_id long, url string, html string")
    got = extract.extract_pages(pages.withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert extract.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (500, 40)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = AWKWARD + [(40, "x" * 50_000), (41, " " * 20_000 + "it's 12,5 done"), (42, "日本語テキスト" * 6000), (43, "\n\n  a b\x1c c" * 3000),
                      (44, "<|endoftext|> 'sx !'s"), (45, "²½Ⅷ é" * 3000), (46, "\x85a b 1٣'re" * 900)]
    docs = frame(spark, rows).unionByName(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").limit(40), allowMissingColumns=True)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = b"".join(i.to_bytes(4, "little") for i in lib.encode_ordinary(r.text or ""))
        want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, chunk=chunk, overlap=overlap).collect())
    assert got == want
    whole = bpe.encode_documents(docs, chunk=chunk, overlap=overlap).where("doc_id = 43").first()
    assert bytes(whole.decoded).decode() == "\n\n  a b\x1c c" * 3000
    assert bpe.encode_digests(docs.limit(0)).count() == 0
