"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import brute_path  # noqa: F401
import brute
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, htmltext, langid, licenses, linededup, ngramjoin, packing, quality, textkernel, tokencount, tokenids

VOCAB = ["red", "blue", "Green", "déjà", "VU", "x1", "of", "the", "straße", "日本", "a"]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, gone string, gone_id long, row long, cell int, n_tokens int, part string, tie string"


def prose(r, n):
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text) with near copies, shared lines, null and empty and long texts, null and repeated ids."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(n)]
    for i in range(0, n, 4):
        w = docs[i].split()
        w[r.randrange(len(w))] = "edit"
        docs.append(" ".join(w))
    docs += [docs[1], docs[1].upper(), docs[2] + "\n" + docs[3], docs[3] + "\n\n" + docs[2] + "\n" + docs[2], "", "  \n\t", "...", " ".join(words) + "\n" + docs[5]]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + [rows[1], rows[2], (None, docs[4]), (None, None), (len(docs), None), (3, docs[7]), (None, "only here")]


def table(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    full = [(d, t, None if (d or 0) % 7 == 3 else ["en", "de"][(d or 0) % 2], None if (d or 0) % 5 == 4 else "s", 1, "g", 2, 3, 4, 5, "p", "t") for d, t in rows]
    return spark.createDataFrame(full, NAMES).repartition(3)


def key(rows):
    return sorted(rows, key=repr)


def test_kernel_words_and_ngrams():
    r = random.Random(3)
    texts = [prose(r, n) for n in (0, 1, 2, 3, 50)] + ["", "É é ÀÉÎ Ünïcode", "日本 語", "a\nb", "x" * 5000]
    h, s, e, per = textkernel.words(*textkernel.buffers(pa.array(texts)))
    got = {}
    for i, t in enumerate(texts):
        own = h[per[i] : per[i + 1]].tolist()
        want = brute.words(t)
        assert len(own) == len(want)
        for a, b in zip(own, want):
            assert got.setdefault(b, a) == a
    assert len(set(got.values())) == len(got)
    g, doc, pos = textkernel.ngrams(h, per, 3)
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(brute.grams(t, 3))


def test_line_dedup(spark):
    rows = corpus()
    df = table(spark, rows)
    got = linededup.dedup_lines(df)
    assert got.columns == df.columns
    assert key([tuple(x) for x in got.select("doc_id", "text").collect()]) == key(brute.line_dedup(rows))
    left = linededup.dedup_lines(df, drop_emptied=True).select("doc_id", "text").collect()
    want = [b for a, b in zip(rows, brute.line_dedup(rows)) if a == b or any(x.strip(" \t\r") for x in (b[1] or "").split("\n"))]
    assert key([tuple(x) for x in left]) == key(want)
    assert linededup.dedup_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1 << 20, 1 << 30])
def test_line_dedup_of_long_texts_and_a_full_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(linededup, "MAX_BITS", bits)
    monkeypatch.setattr(linededup, "_SEGMENT", 10)
    r = random.Random(8)
    long = "\n".join(f"line {r.randrange(40_000)}" for _ in range(100_000))
    rows = [(1, long), (2, "x" * 2_000_000 + "\nend"), (3, "x" * 2_000_000 + "\nline 7\n"), (4, "a line of its own"), (5, "\n\n \n")]
    got = linededup.dedup_lines(table(spark, rows, False)).collect()
    assert key([tuple(x) for x in got]) == key(brute.line_dedup(rows))


def test_line_dedup_moves_no_text_without_repeats(spark, tmp_path):
    """Only the branch of rows that lose lines has an exchange of texts."""
    table(spark, corpus()).write.parquet(f"{tmp_path}/d")
    plan = linededup.dedup_lines(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    top, _, below = plan.partition("Join")
    assert top.count("MapInArrow") == 2 and "Union" in top  # the union's first branch is a mapped pass alone


def check_kept(kept, rows):
    """``kept`` is a choice that :func:`brute.keep_one` allows."""
    stay, free = brute.keep_one(rows)
    left = [(x.doc_id, x.text) for x in kept.collect()]
    for choice in free:
        assert sum(x in choice for x in left) == 1, choice
    assert key([x for x in left if not any(x in c for c in free)]) == key(stay)


def got_classes(df):
    return sorted(tuple(x) for x in ngramjoin.classes(df).collect())


def test_jaccard_join(spark):
    rows = corpus(2) + [(4, "some other text of this id"), (5, None)]
    df = table(spark, rows)
    assert got_classes(df) == sorted(brute.classes(rows))
    kept = ngramjoin.keep_one(df)
    assert kept.columns == df.columns
    check_kept(kept, rows)
    for empty in (table(spark, []), table(spark, [(None, "a b c"), (None, None)])):
        assert ngramjoin.classes(empty).count() == 0 and ngramjoin.keep_one(empty).count() == empty.count()


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_large_groups_in_tiles_and_fragments(spark, monkeypatch, small):
    """A group of near copies, one of copies, and a line that all share; with small limits they are cut in many ways."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 20)):
            w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(20)]
    rows += [(200 + i, "a line that every one of these shares " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.choice([2, 6, 7, 8, 30])))) for i in range(60)]
    if small:
        for name, v in (("TILE", 4), ("FRAGMENT", 300), ("BLOCK", 500), ("PREFIXES", 200), ("CELL", 100), ("HOT", 20), ("EDGES", 0)):
            monkeypatch.setattr(ngramjoin, name, v)
    assert got_classes(table(spark, rows, False)) == sorted(brute.classes(rows))


@pytest.mark.parametrize("nested", [False, True])
def test_jaccard_join_misses_no_pair_at_the_threshold(spark, nested):
    """Pairs of similarity 0.5 exactly, of equal size or one inside the other: all are linked; just below it, none."""
    r = random.Random(nested)
    new = lambda k: [f"n{r.randrange(10**9)}" for _ in range(k)]
    rows, far = [], set()
    for i in range(400):
        k = r.randint(4, 40)
        near = i % 2 == 0
        # n-grams of a run of k words are k - 2; a common run, then other ones
        both = new(3 * k + 2)
        if nested:
            a, b = both, both + new(3 * k + (0 if near else 1))
        else:
            own = 3 * k // 2 * 1
            both = new(2 * own + 2)
            a, b = both + new(own), both + new(own + (0 if near else 1))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        if not near:
            far |= {2 * i, 2 * i + 1}
    want = [(d, d if d in far else d - d % 2, int(d not in far)) for d, _ in rows]
    assert got_classes(table(spark, rows, False)) == sorted(want)


def test_jaccard_join_of_very_long_texts(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(50000)}" for _ in range(300_000)]
    other = [w if i % 50 else "edit" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "short text here"), (4, " ".join(long[:100_000])), (5, "x" * 3_000_000)]
    assert got_classes(table(spark, rows, False)) == sorted(brute.classes(rows))


def test_overlaps():
    r = random.Random(5)
    g = [np.unique(np.array([r.randrange(900) for _ in range(200)], np.uint64)) for _ in range(600)]
    i, j = np.nonzero(np.triu(np.ones((600, 600), np.bool_), 1))
    c = ngramjoin.overlaps(g, i, j)
    for k in random.Random(1).sample(range(len(i)), 200):
        assert c[k] == len(np.intersect1d(g[i[k]], g[j[k]]))


@pytest.mark.parametrize("most", [0, 1000])
def test_groups_of_random_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(ngramjoin, "EDGES", most)
    assert ngramjoin.groups(spark.createDataFrame([], "a long, b long")).count() == 0
    r = random.Random(7)
    edges = [(a, b) for a, b in ((r.randrange(200), r.randrange(200)) for _ in range(150)) if a != b] + [(i, i + 1) for i in range(300, 330)]
    got = {x.node: x.first for x in ngramjoin.groups(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {k: v for k, v in brute.components(edges).items() if k != v}


def test_language_id(spark):
    r = random.Random(4)
    make = {"en": "the of and thing with ing tion", "de": "der und schön über straße nicht", "fr": "les une été à le garçon où"}
    rows = [(i, " ".join(r.choice(make[lang].split()) for _ in range(r.randint(3, 40))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    train = spark.createDataFrame([(d, t, k) for d, t, k in rows[:120]], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(d, t, None) for d, t, _ in rows[120:]] + [(None, None, None), (900, "", None), (901, "12 34 --", None), (902, "ლლლ ძძძ ჭჭჭ წწწ ჟჟჟ ღღღ ყყყ", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(test, train).collect()}
    right = sum(got[d].language == k for d, _, k in rows[120:])
    assert right >= 0.97 * 60
    assert not any(got[d].accepted for d in (None, 900, 901, 902)) and got[901].language is None and got[901].posterior == 0
    cols = lambda t: langid.columns([t])[0].tolist()
    plain = brute.naive_bayes([(k, t) for _, t, k in rows[:120]], [t for _, t, _ in rows[120:]], cols, langid.BUCKETS, langid.ALPHA)
    for (d, _, _), (lang, _, _, post) in zip(rows[120:], plain):
        assert got[d].language == lang and math.isclose(got[d].posterior, post, rel_tol=1e-6)
    df = table(spark, corpus())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() <= df.count()
    assert langid.keep_identified(table(spark, [])).count() == 0
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [x.accepted for x in langid.identify(none).collect()] == [False]


def test_language_columns_by_plain_loops():
    """Character 1- to 3-grams of a text in lower case, everything that isn't a letter one space, hashed step by step."""
    import re

    def columns(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = re.sub("  +", " ", t)
        t = t if t.startswith(" ") else " " + t  # every text begins with a space
        out = []
        for i in range(len(t)):
            h = 0
            for n, k in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                if i + n >= len(t):
                    break
                h = (h * 0x01000193 + ord(t[i + n]) * k) % (1 << 32)
                x = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
                out.append((x ^ (x >> 16)) & 0xFFFF)
        return sorted(out)

    r = random.Random(21)
    for t in ["a", "ab c", "é!!É", " x ", "日本", "x"] + [prose(r, n) for n in (1, 2, 20, 50)]:
        got = langid.columns([t])[0].tolist()
        assert sorted(got) == columns(t), t


def test_language_columns_do_not_span_texts():
    r = random.Random(2)
    texts = ["", "a", "!", "ab c", "é!!É", " x ", "日本"] + [prose(r, 20) for _ in range(5)]
    col, doc = langid.columns(texts)
    for i, t in enumerate(texts):
        assert sorted(col[doc == i].tolist()) == sorted(langid.columns([t])[0].tolist())


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = langid.identify(b, a).join(b, "doc_id")
    assert got.where("language = lang").count() >= 0.95 * b.count()


def test_quality_rules(spark):
    r = random.Random(6)
    good = [(i, " ".join(r.choice(["house", "tree", "The", "running", "of"]) for _ in range(r.randint(5, 60)))) for i in range(260)]
    bad = [(1000, "buy### now$$$ it&&& is%%% free*** " * 5), (1001, "SHOUTING ALL DAY LONG FOR NOTHING " * 5), (1002, "same " * 80), (1003, None), (1004, ""), (1005, "!!! ???")]
    rows = [(d, t, "en" if d is None or d % 2 else None, "s") for d, t in good + bad + [good[0], (None, good[1][1])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("bin", F.lit(1)).withColumn("symbols", F.lit("x"))
    got = [x.doc_id for x in quality.kept(df).collect()]
    assert not set(got) & {1000, 1001, 1002, 1003, 1004, 1005}
    assert len(got) == len(good) + 2
    assert quality.kept(df.where("false")).count() == 0


def test_quality_of_groups_by_plain_loops(spark):
    """Groups above and below the least size, with their own habits; what is usual in one is far out in another."""
    r = random.Random(7)
    rows = []
    for k, (lang, source, n) in enumerate([("en", "a", 60), ("en", "b", 45), ("en", "c", 10), ("de", "a", 20), ("de", None, 15), ("xx", "a", 5), (None, None, 40)]):
        for i in range(n):
            t = " ".join(r.choice([x + ["", "#", "$$", "***"][min(3, k % 4)] if r.random() < 0.3 else x.upper() if k == 1 and r.random() < 0.6 else x for x in ("house", "tree", "running", "of", "a", "größe")]) for _ in range(r.randint(3, 50)))
            if r.random() < 0.1:
                t = r.choice(["SHOUT " * 30, "### $$$ a " * 20, "same " * 40, "x" * 300, "b " * 50])
            rows.append((100 * k + i, t, lang, source))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "!?", None, None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [tuple(x) for x in quality.kept(df).collect()]
    want = brute.quality(rows, quality)
    assert key(got) == key(want) and 20 < len(rows) - len(want)


def long_rows():
    r = random.Random(20)
    return [(1, "x" * 1_500_000), (2, " ".join(r.choice(["the", "of", "river", "Straße", "日本"]) for _ in range(300_000))), (3, "a short text of words"), (4, "the river of " * 100_000 + "\n" * 1000), (5, " " * 100_000), (None, "z " * 1000)]


def test_very_long_texts(spark):
    """Texts of megabytes, with and without spaces, beyond every block's bound."""
    rows = long_rows()
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
    enc = bpe.encoder(bpe.read_ranks(bpe.VOCABULARY))
    assert key([tuple(x) for x in tokencount.token_counts(df, table_size=20).collect()]) == key([(d, len(enc.encode_ordinary(t))) for d, t in rows])
    cols = lambda t: langid.columns([t])[0].tolist()
    train = [("en", "the river of words"), ("de", "der Fluss und Straße")]
    plain = brute.naive_bayes(train, [t for _, t in rows], cols, langid.BUCKETS, langid.ALPHA)
    got = {x.doc_id: x for x in langid.identify(df, spark.createDataFrame(train, "lang string, text string")).collect()}
    for (d, t), (lang, _, n, _) in zip(rows, plain):
        assert got[d].language in (lang, None) and (got[d].language is not None or not got[d].accepted)
    assert key([tuple(x) for x in quality.kept(df).collect()]) == key(brute.quality([(d, t, "en", "s") for d, t in rows], quality))
    keyed = [tuple(x) for x in packing.keyed(df).select("curve_key", "doc_id", "n_tokens", "tie").collect()]
    assert sorted((d is None, d or 0, n) for _, d, n, _ in keyed) == sorted((d is None, d or 0, len(brute.words(t)) + 1) for d, t in rows)
    assert sorted((tuple(x) for x in packing.pack(df).collect()), key=lambda p: p[:2]) == brute.pack(keyed, packing.CAPACITY)
    items = [(1, "short text of words and more of it"), (2, " ".join(rows[1][1].split()[1000:1030])), (3, " ".join(rows[1][1].split()[:5000]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x)[:2] for x in decontam.contained(df, bench).collect()}
    assert {(2, 2), (2, 3)} <= got and not any(d in (1, 5, None) for d, _ in got)


def test_packing(spark):
    rows = corpus(3)
    df = table(spark, rows)
    keyed = [tuple(x) for x in packing.keyed(df).select("curve_key", "doc_id", "n_tokens", "tie").collect()]
    assert sorted((d is None, d or 0, n) for _, d, n, _ in keyed) == sorted((d is None, d or 0, len(brute.words(t)) + 1) for d, t in rows)
    got = [tuple(x) for x in packing.pack(df, 64).select("seq_id", "seq_offset", "doc_id", "doc_offset", "n_tokens").collect()]
    assert sorted(got, key=lambda p: p[:2]) == brute.pack(keyed, 64)
    given = [(p.doc_id, p.n_tokens) for p in packing.pack(df, 64, tokens="cell").collect()]
    assert sum(n for _, n in given) == 4 * len(rows)
    assert packing.pack(table(spark, [])).count() == 0


def test_curve_cells_by_plain_loops():
    """The projection of a bag of words, word by word and bucket by bucket."""
    from collections import Counter

    def mix(x):
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * k % (1 << 64)
        return x ^ (x >> 33)

    r = random.Random(14)
    texts = ["", "one", "the the the of"] + [prose(r, r.randint(1, 300)) for _ in range(30)]
    h, _, _, per = textkernel.words(*textkernel.buffers(pa.array(texts)))
    got = packing.cells(h, per).tolist()
    for i in range(len(texts)):
        weight = {b: int(math.sqrt(n) * 1024) for b, n in Counter(x % 4096 for x in h[per[i] : per[i + 1]].tolist()).items()}
        long = math.sqrt(max(1, sum(w * w for w in weight.values())))
        want = []
        for d in range(3):
            z = sum(w * (1 - 2 * ((mix(b + 0x5EED) >> d) & 1)) for b, w in weight.items()) / long
            z /= 1 + abs(z) / 2
            want.append(min(1023, max(0, math.floor((z + 2) / 4 * 1024))))
        assert got[i] == want


def test_hilbert_curve():
    pts = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(pts, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = pts[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # neighbours on the curve touch
    assert [brute.hilbert(p, 3) for p in pts.tolist()] == keys.tolist()


def test_language_training_sample_is_per_language(spark):
    r = random.Random(3)
    rows = [("rare", f"xyzzy plugh {i} {prose(r, 3)}") for i in range(30)] + [("common", f"{prose(r, 4)} {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    langs, logp = langid.train(df, 200)
    assert langs == ["common", "rare"]
    assert np.array_equal(logp[:, 1], langid.train(df.where("lang = 'rare'"))[1][:, 0])
    assert langid._share([1, 10, 3000, 6000], 5000) == 2494 and langid._share([5], 100) == 500


def test_license_scan(spark):
    lines = [w for _, w, _ in licenses.TEMPLATES]
    docs = [(i, f"some text\n{t}\nmore text") for i, t in enumerate(lines)]
    docs += [(100, "RELEASED under the   MIT License!"), (101, "Copyright 2020 A\nLicensed under the Apache License, Version 2.0."), (102, "the license of my dog"), (103, "Licensed under the Apache License, Version 1.1."), (104, None), (105, ""), (None, lines[0]), (0, docs[0][1]), (106, "license " * 5000)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("verdict", F.lit(1)))
    rows = {}
    for x in got.collect():
        rows.setdefault(x.doc_id, []).append(x)
    for i, (name, _, _) in enumerate(licenses.TEMPLATES):
        assert rows[i][0].license == name and rows[i][0].verdict == "exact", (i, rows[i])
    assert len(rows[0]) == 2 and rows[100][0].verdict == rows[101][0].verdict == "exact" and rows[101][0].license == "Apache-2.0"
    assert rows[102][0].verdict == rows[103][0].verdict == rows[106][0].verdict == "unconfirmed"
    assert 104 not in rows and 105 not in rows and None in rows
    want = sorted((d is None, d or 0, f, l, *map(repr, licenses.judge(b))) for d, t in docs for f, l, b in licenses.blocks(t or ""))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.first_line, x.last_line, *map(repr, (x.license, x.saved, x.missing, x.extra, x.verdict))) for x in got.collect()) == want


@pytest.mark.parametrize("width", [60, 72, 80])
def test_license_wording_wrapped_and_named(width):
    import textwrap

    for name, wording, _ in licenses.TEMPLATES:
        text = "an article of some words\n\n" + textwrap.fill(wording, width, break_on_hyphens=False) + "\n\nand its end"
        got = [licenses.judge(b) for _, _, b in licenses.blocks(text)]
        assert [(g[0], g[4]) for g in got] == [(name, "exact")], (wording, got)
    mit = next(w for _, w, _ in licenses.TEMPLATES if w.startswith("Permission"))
    head, tail = mit.split("The above")
    text = f"MIT License\n\nCopyright (c) 2020 A B\n\n{textwrap.fill(head, width)}\n\n{textwrap.fill('The above' + tail, width)}\n"
    got = [(f, licenses.judge(b)) for f, _, b in licenses.blocks(text)]
    assert [(f, g[0], g[4]) for f, g in got] == [(0, "MIT", "exact"), (2, "MIT", "exact")]
    for text, name in (("Distributed under GPL version 3", "GPL-3.0"), ("CC BY 4.0", "CC-BY-4.0"), ("Released under CC0 1.0", "CC0-1.0")):
        assert [licenses.judge(b)[::4] for _, _, b in licenses.blocks(text)] == [(name, "exact")], text


def test_license_differences_are_longest_common_subsequences():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 25))] for _ in range(2))
        missing, extra = licenses.differences(a, b)
        n = brute.lcs(a, b)
        assert licenses.common(a, b) == n and len(a) - len(missing) == n == len(b) - len(extra)
        left, right = list(a), list(b)
        for w in missing:
            left.remove(w)
        for w in extra:
            right.remove(w)
        assert sorted(left) == sorted(right)


def test_license_scan_finds_planted_texts(spark):
    """Whole licences, wrapped anyhow, with words changed: found where they stand, and told by plain counting of words; no part of the module is asked."""
    import re
    import textwrap

    r = random.Random(12)
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    long = [t for t in licenses.TEMPLATES if len(words(t[1])) > 30]
    rows, want = [], {}
    for i in range(60):
        name, wording, marks = long[i % len(long)]
        own = wording.split()
        free = [k for k in range(8, len(own) - 8) if not set(words(own[k])) & set(marks.split())]  # a naming word must stay
        for k in r.sample(free, [0, 2, 5][i // 20]):
            own[k] = r.choice(["zork", "zork plugh", own[k] + " zork"])
        body = textwrap.fill(" ".join(own), r.choice([50, 72, 79, 400]), break_on_hyphens=False)
        before = [f"line {k} of no meaning" for k in range(r.randint(0, 3))]
        rows.append((i, "\n".join([*before, "", body, "", "the end of it"])))
        n = brute.lcs(words(wording), words(body))
        apart = len(words(wording)) + len(words(body)) - 2 * n
        want[i] = (len(before) + 1, len(before) + body.count("\n") + 1, name, "modified" if apart else "exact", apart)
    got = {}
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.first_line, x.last_line, x.license, x.verdict, len(x.missing) + len(x.extra)))
    for i, x in want.items():
        assert got[i] == [x], (i, rows[i], got[i], x)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_ties_and_long_texts(spark):
    """Equal savings go to the template named first; a text of a million words without a line feed is one line."""
    rows = [(1, "license " + "word " * 400_000), (2, "license"), (3, "license")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2][3:] == got[3][3:] and got[1].verdict == "unconfirmed" and (got[1].first_line, got[1].last_line) == (0, 0)
    first = [n for n, *_ in licenses.TEMPLATES]
    saved = [1 - len(c.compress(b"license")) / len(licenses._compressors()[0].compress(b"license")) for *_, c in licenses._compressors()[1]]
    assert got[2].license == first[saved.index(max(saved))]


def test_feistel_is_a_permutation():
    for n in (0, 1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(tokenids.permute(np.arange(n), n).tolist()) == list(range(n))
    assert tokenids.permute(np.arange(1000), 1000).tolist() != tokenids.permute(np.arange(1000), 1000, b"other").tolist()


def shard_rows(rows, length, records):
    """[(slot, shard, doc_id, seq, n_ids, record)] by plain loops; rows equal in id and text are interchangeable."""
    import hashlib

    enc = bpe.encoder(bpe.read_ranks(bpe.VOCABULARY))
    tie = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True)
    seqs = []
    for d, t in sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        ids = [*enc.encode_ordinary(t), tokenids.END]
        for k in range(0, len(ids), length):
            own = ids[k : k + length]
            seqs.append((d, k // length, len(own), np.array(own + [tokenids.END] * (length - len(own)), "<u2").tobytes()))
    slots = tokenids.permute(np.arange(len(seqs)), len(seqs)).tolist()
    return sorted((s, s // records, *x) for s, x in zip(slots, seqs))


@pytest.mark.parametrize("slices, partitions", [(4, 4096), (3, 2), (1, 1)])
def test_token_ids_round_trip(spark, tmp_path, monkeypatch, slices, partitions):
    monkeypatch.setattr(tokenids, "SLICES", slices)
    monkeypatch.setattr(tokenids, "PARTITIONS", partitions)
    monkeypatch.setattr(tokenids, "HELD", 2000)
    rows = corpus(4, 30) + [(900, "one long run without a space " + "y" * 30_000)]
    folder = f"file://{tmp_path}/shards"
    got = [(*x[:5], bytes(x.record)) for x in tokenids.shards(table(spark, rows), folder, length=16, records=8).collect()]
    want = shard_rows(rows, 16, 8)
    assert got == want
    disk = list(tokenids.read_slots(folder))
    assert [x.astype("<u2").tobytes() for x in disk] == [x[-1] for x in want]
    again = list(tokenids.read_slots(folder, 13, 9))
    assert [x.tolist() for x in again] == [x.tolist() for x in disk[13:22]]
    assert not [f for f in os.listdir(f"{tmp_path}/shards") if f.startswith(".") and not f.endswith(".crc")]
    assert tokenids.shards(table(spark, []), f"file://{tmp_path}/none").count() == 0


def test_token_ids_query_leaves_shards(spark, tmp_path):
    from quillon.llm.common import shared_folder
    from quillon.llm.queries import op7_token_ids

    rows = corpus(5, 20)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    top = shared_folder(spark).removeprefix("file://") + "/op7_token_ids"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    got = op7_token_ids(spark, str(tmp_path)).collect()
    (new,) = set(os.listdir(top)) - before
    disk = [x.astype("<u2").tobytes() for x in tokenids.read_slots(f"file://{top}/{new}")]
    assert [x.slot for x in got] == list(range(len(disk))) and [bytes(x.record) for x in got] == disk
    assert [(*x[:5], bytes(x.record)) for x in got] == shard_rows(rows, tokenids.LENGTH, tokenids.RECORDS)


def test_pretokens_and_counts(spark):
    import regex

    r = random.Random(1)
    bits = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "日本", "　", "'ve", "😀", "_", "\r\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    code, s, e, d = bpe.pretokens(texts)
    got = [[] for _ in texts]
    for a, b, c in zip(s.tolist(), e.tolist(), d.tolist()):
        got[c].append(bpe.string(code, a, b))
    split = regex.compile(bpe.PATTERN)
    assert got == [split.findall(t) for t in texts]
    enc = bpe.encoder(bpe.read_ranks(bpe.VOCABULARY))
    rows = [(i, t) for i, t in enumerate(texts[:300])] + corpus(9)
    want = key([(d, None if t is None else len(enc.encode_ordinary(t))) for d, t in rows])
    df = table(spark, rows)
    assert key([tuple(x) for x in tokencount.token_counts(df, table_size=50).collect()]) == want
    assert tokencount.token_counts(table(spark, [])).count() == 0


def site(n, host="a.example"):
    """Pages with one navigation and footer, and an article of their own."""
    r = random.Random(host)
    out = []
    for i in range(n):
        paras = "".join(f"<p>{prose(r, 12)} {i} {k}.</p>" for k in range(r.randint(1, 4)))
        out.append((i, f"https://{host}/p/{i}", f"<html><head><title>t{i}</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/x>About us</a></ul></nav><article><h1>Title {i}</h1>{paras}</article><footer>&copy; Example</footer></body></html>"))
    return out


def test_html_extraction(spark):
    pages = site(40)
    odd = [(900, None, "<p>no host</p>"), (901, "https://single.example/", "<nav>Menu</nav><p>Text<br>more</p>"), (902, "https://a.example/z", None), (903, "https://a.example/y", ""), (904, "https://b.example/1", "<p>same</p>"), (905, "https://b.example/2", "<p>same</p>"), (None, "https://a.example/q", pages[0][2]), pages[1], (906, "rel/path", "<b>un<i>closed"), (907, "https://long.example", "<p>" + "long text " * 20000)]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("branches", F.lit(3))
    rows = [(x.page_id, x.text) for x in htmltext.extract(df).collect()]
    got = dict(rows)
    assert len(rows) == len(pages) + len(odd)
    for i, _, source in pages:
        assert "Home" not in got[i] and "Example" not in got[i] and "var x" not in got[i]
        assert f"Title {i}" in got[i]
        for para in htmltext.re.findall(r"<p>(.*?)</p>", source.split("<article>")[1]):
            assert para in got[i]
    assert got[900] == "no host" and got[901] == "Menu\nText\nmore" and got[902] is None and got[903] == ""
    assert got[904] == got[905] == "same" and got[None] == got[0] and got[906] == "unclosed" and len(got[907]) > 100000
    assert htmltext.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [40, 150])
def test_html_varying_boilerplate_goes_and_near_copies_stay(spark, n):
    r = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    pages, kept = [], {}
    for i in range(n):
        links = "".join(f"<li><a href=/l{k}>Menu{k}</a>" for k in range(4 + i % 3))
        if i % 10 == 1:  # a near copy of the page before
            paras = [kept[i - 1][0], kept[i - 1][1] + " edited"]
        else:
            paras = [some(30), some(40)]
        kept[i] = paras
        pages.append((i, "https://v.example/", f"<body><nav><ul>{links}</ul></nav><div class=ad>Advert{i % 3} buy our best thing</div><article><p>{paras[0]}<p>{paras[1]}</article><footer>Example pages, rendered for you by server {some(1)}</footer></body>"))
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == n
    for i, paras in kept.items():
        assert got[i] == "\n".join(paras), (i, got[i])


def random_site(r, host, n):
    """Pages with menus, adverts and footers that vary as pages' do, and articles, some of them copies or near copies."""
    words = [f"w{i}" for i in range(3000)]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    menus = ["".join(f"<li><a href=/m{r.randrange(9)}>{some(1)}</a>" for _ in range(r.randint(2, 5))) for _ in range(r.choice([1, 3, n]))]
    foots = [some(6) for _ in range(r.choice([1, 2, n]))]
    bodies: list[str] = []
    for i in range(n):
        new = "".join(f"<p>{some(r.choice([3, 20, 40]))}</p>" for _ in range(r.randint(0, 4)))
        bodies.append(r.choice(bodies) + r.choice(["", "<p>more</p>"]) if bodies and r.random() < 0.2 else new)
    return [(f"https://{host}/{i}", f"<html><body><div class=top><ul>{r.choice(menus)}</ul></div>{r.choice(['', '<hr>', '<div class=ad>buy ' + some(1) + '</div>'])}<article>{b}</article><footer>{r.choice(foots)}</footer></body></html>") for i, b in enumerate(bodies)]


@pytest.mark.parametrize("nodes, branches", [(200_000, 2_000), (0, 2_000), (0, 0), (30, 1)])
def test_html_against_plain_style_trees(spark, monkeypatch, nodes, branches):
    """Every page's text, for hosts solved in a task, level by level, and with branches of each page's own."""
    monkeypatch.setattr(htmltext, "NODES", nodes)
    monkeypatch.setattr(htmltext, "BRANCHES", branches)
    r = random.Random(3)
    sites = [random_site(r, f"h{k}.example", n) for k, n in enumerate((1, 2, 3, 8, 25, 40))]
    pages = [(i, u, h) for i, (u, h) in enumerate(x for s in sites for x in s)]
    grams = lambda t: htmltext.features([t])[0].tolist()
    want, i = {}, 0
    for s in sites:
        distinct = sorted({h for _, h in s})
        keys = {h: set() for h in distinct}
        for h in distinct:
            long = sorted({x for *_, t, _, _ in htmltext.walk(htmltext.parse(h)) if t is not None and len(grams(t)) >= htmltext.LONG for x in grams(t)})
            keys[h] = set(htmltext.bands(np.array(long, np.uint64), np.zeros(len(long), np.int64))[0].tolist())
        left_out = set()
        from collections import Counter

        count = Counter(k for v in keys.values() for k in v)
        order = lambda h: tuple(row[h])
        hashed = spark.createDataFrame([(h,) for h in distinct], "html string").select("html", F.xxhash64("html"), F.xxhash64(F.lit(1), "html")).collect()
        row = {x[0]: (x[1], x[2]) for x in hashed}
        for k, n in count.items():
            if n > 1 and 2 * n <= len(distinct):
                own = [h for h in distinct if k in keys[h]]
                left_out |= set(own) - {min(own, key=order)}
        tree = brute.Site([htmltext.parse(h) for h in distinct if h not in left_out], grams, htmltext.SAMPLE, htmltext.GAMMA, htmltext.THRESHOLD, htmltext.RARE)
        for _, h in s:
            want[i] = tree.text(htmltext.parse(h), htmltext.BLOCK)
            i += 1
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    bad = [k for k in want if got[k] != want[k]]
    assert not bad, (len(bad), pages[bad[0]], got[bad[0]], want[bad[0]])
    assert sum(got[i] != htmltext.clean_text(htmltext.parse(h), frozenset()) for i, _, h in pages) > 20  # and something was cut


def test_html_importance_takes_every_feature(spark):
    """A text with one constant phrase, whose n-grams have the least hashes, and many words of its own on each page."""
    r = random.Random(4)
    phrase = min((" ".join(f"c{r.randrange(9999)}" for _ in range(6)) for _ in range(20_000)), key=lambda t: htmltext.features([t])[0][-1])  # the largest of its four
    least = htmltext.features([phrase])[0].tolist()
    some = (" ".join(f"w{r.randrange(9999)}" for _ in range(30)) for _ in range(20_000))
    own = [t for t in some if htmltext.features([f"{phrase} {t}"])[0][:4].tolist() == least][:40]
    assert len(own) == 40 and len(least) == 4
    pages = [(i, "https://s.example/", f"<body><p>Menu of all pages</p><div>{phrase} {t}</div></body>") for i, t in enumerate(own)]
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{phrase} {t}" for i, t in enumerate(own)}


@pytest.mark.parametrize("limit", [8 << 20, -1])
def test_html_long_text_that_comes_once_a_task(spark, monkeypatch, limit):
    """No task sees the footer twice, so its features are sent as prints, and counted whole afterwards; with and without broadcasts."""
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", limit)
    asked = []
    real = htmltext._features
    monkeypatch.setattr(htmltext, "_features", lambda pages, nodes: (asked.append(nodes.count()), real(pages, nodes))[1])
    r = random.Random(5)
    foot = prose(r, 60)
    own = [" ".join(f"w{r.randrange(9999)}" for _ in range(50)) for _ in range(4)]
    pages = [(i, "https://f.example/", f"<body><p>{t}</p><footer>{foot}</footer></body>") for i, t in enumerate(own)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([*pages, (4, *pages[3][1:])], 5), "page_id long, url string, html string")
    got = {x.page_id: x.text for x in htmltext.extract(df).collect()}
    assert got == {i: t for i, t in enumerate([*own, own[3]])} and asked == [1]


@pytest.mark.parametrize("few, many, bits, held", [(32, 4096, 24, 8 << 20), (0, 0, 24, 0), (0, 0, 24, 8 << 20), (3, 5, 24, 100), (0, 0, 6, 0), (0, 0, 6, 8 << 20)])
def test_html_counts_by_task_and_print(monkeypatch, few, many, bits, held):
    """However counts are sent, what is counted is right, and a text whose prints leave it open is never taken for important."""
    import math
    from collections import Counter

    for name, v in (("FEW", few), ("MANY", many), ("BITS", bits), ("HELD", held)):
        monkeypatch.setattr(htmltext, name, v)
    r = random.Random(6)
    tasks = [random_site(r, f"h{k % 2}.example", 20) for k in range(4)]
    styles, features, shown, sent = {}, {}, Counter(), []
    for task in tasks:
        counts = htmltext.Counts()
        pages = [(u.split("/")[2], h) for u, h in task]
        for i in range(0, len(pages), 7):
            counts.add([h for h, _ in pages[i : i + 7]], [x for _, x in pages[i : i + 7]])
        sent += [x for b in counts.rows() for x in b.to_pylist()]
        for host, source in pages:
            for key, style, _, text, link, _ in htmltext.walk(htmltext.parse(source)):
                at = (host, htmltext._signed(key))
                if text is None:
                    styles.setdefault(at, Counter())[htmltext._signed(style)] += 1
                else:
                    shown[at] += 1
                    features.setdefault(at, Counter()).update({*htmltext.features([text])[0].tolist(), *([] if link is None else [htmltext._key("l", link)])})
    sent.sort(key=lambda x: (x["host"], x["node"]))
    batches = [htmltext.pa.RecordBatch.from_pylist(sent[i : i + 9]) for i in range(0, len(sent), 9)]
    got = [x for b in htmltext._merge(iter(batches)) for x in b.to_pylist()]
    assert {(x["host"], x["node"], x["style"]): x["m"] for x in got if x["kind"] == htmltext.STYLE} == {(*at, s): n for at, c in styles.items() for s, n in c.items() if n > 1}
    nodes = {(x["host"], x["node"]): x for x in got if x["kind"] == htmltext.NODE}
    left = {(x["host"], x["node"]) for x in got if x["kind"] == htmltext.OPEN}
    assert len(nodes) + len(left) == sum(x["kind"] != htmltext.STYLE for x in got) and not left & nodes.keys()
    for at, c in [*styles.items(), *features.items()]:
        rest, m = sum(n * math.log(n) for n in c.values()), c.total()
        if at in nodes:
            x = nodes[at]
            assert (x["m"], x["l"], x["single"], x["text"]) == (m, len(c), sum(n == 1 for n in c.values()), at in features) and abs(x["imp"] - rest / m) < 1e-9
        elif at in styles:
            assert m == 1
        elif at not in left:
            assert rest == 0 or 1 - rest / m / math.log(shown[at]) >= htmltext.THRESHOLD
    assert few or left  # nothing but prints: the menus are open


def test_html_sends_less_than_half_its_markup():
    """What is shuffled of articles, with the keys of near copies: one row a node for structure, under three bytes a feature for texts."""
    r = random.Random(7)
    menu = "".join(f"<li><a href=/m{k}>Menu {k}</a></li>" for k in range(12))
    text = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(60))
    pages = [f"<body><nav><ul>{menu}</ul></nav><article>{''.join(f'<p>{text()}</p>' for _ in range(r.randint(2, 6)))}</article></body>" for _ in range(400)]
    counts = htmltext.Counts()
    for i in range(0, 400, 64):
        counts.add(["a.example"] * len(pages[i : i + 64]), pages[i : i + 64])
    sent = sum(len(x) + 28 for b in counts.rows() for x in b.column("data").to_pylist()) + sum(map(len, htmltext.near_keys(pages)))
    assert sent < 0.5 * sum(map(len, pages))


def test_html_importance_by_hand():
    root = htmltext.ROOT_SIGNED
    nodes = [(root, 0.0, 1, 10, 0, False), (1, 0.05, 1, 10, 0, True), (2, 0.9, 10, 10, 10, True), (3, 0.1, 1, 10, 0, False), (4, 0.2, 1, 10, 0, True)]
    styles = [(root, 10, [1, 2, 3]), (3, 10, [4])]
    assert sorted(htmltext.branches(nodes, styles)) == [1, 3]


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, prose(r, n)) for i, n in enumerate((3, 5, 12, 30, 30))] + [(7, None), (8, ""), (9, "...")]
    rows = corpus(6, 20)
    rows += [(500 + i, prose(r, 20) + " " + t + "\n" + prose(r, 20)) for i, t in items if t] + [(600, items[1][1]), (601, items[3][1].replace(" ", "\n")), (602, " ".join(items[4][1].split()[:24]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    df = table(spark, rows)
    got = key([tuple(x) for x in decontam.contained(df, bench).collect()])
    want = key(brute.contained(rows, items))
    assert got == want and len(want) >= 6
    bad = {(d, t) for d, t in rows if brute.contained([(d, t)], items)}
    left = decontam.clean(df, bench)
    assert left.columns == df.columns
    assert key([(x.doc_id, x.text) for x in left.collect()]) == key([x for x in rows if x not in bad])
    assert decontam.contained(table(spark, []), bench).count() == 0
    assert decontam.contained(df, bench.where("false")).count() == 0 and decontam.clean(df, bench.where("false")).count() == len(rows)


def test_decontamination_in_slices(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, prose(r, 20)) for i in range(6)]
    rows = [(i, prose(r, 9) + " " + t) for i, (_, t) in enumerate(items)]
    monkeypatch.setattr(decontam, "SLICE_CHARS", 150)
    bench, df = spark.createDataFrame(items, "item_id long, text string"), table(spark, rows)
    assert key([tuple(x) for x in decontam.contained(df, bench).collect()]) == key(brute.contained(rows, items))
    assert decontam.clean(df, bench).count() == 0


@pytest.mark.parametrize("text", ["", "x", "it's we'll 12,5  a\n\n b "])
def test_single_counts(text):
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    table_ = tokencount.compact(["it", " a"], [1, 1])
    assert tokencount.count([text], table_, ranks).tolist() == [len(bpe.encoder(ranks).encode_ordinary(text))]


def test_two_vocabularies_in_one_worker():
    empty, text = tokencount.compact([], []), "Größe straße"
    for name in (bpe.VOCABULARY, bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")):
        ranks = bpe.read_ranks(name)
        assert tokencount.count([text], empty, ranks).tolist() == [len(bpe.encoder(ranks).encode_ordinary(text))]
