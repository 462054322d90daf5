"""The pipeline against its stages done by brute force, and the entry's queries."""

import brute_path  # noqa: F401
import brute
import corpus_pipeline
from test_operators import corpus, key, prose  # noqa: F401

from quillon.llm import langid, packing


def test_pipeline(spark, tmp_path):
    import random

    r = random.Random(11)
    items = [(i, " ".join(f"bench{i}x{r.randrange(50)}" for _ in range(20))) for i in range(3)]
    rows = [(d, t) for d, t in corpus(12, 40)] + [(700, "fine start here " + items[0][1] + " and an end"), (701, items[1][1])]
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    cols = lambda t: langid.columns([t])[0].tolist()
    texts = [t or "" for _, t in rows]
    import math

    scored = brute.naive_bayes([("en", t) for _, t in rows if t is not None], texts, cols, langid.BUCKETS, langid.ALPHA)
    step = [x for x, (_, s, n, p) in zip(rows, scored) if any(map(str.isalpha, x[1] or "")) and s > -math.log(langid.BUCKETS) * n and p >= langid.MIN_POSTERIOR]
    deduped = brute.line_dedup(step)
    step = [b for a, b in zip(step, deduped) if a == b or any(x.strip(" \t\r") for x in b[1].split("\n"))]
    stay, free = brute.keep_one(step)
    assert all(len(c) == 1 for c in free)  # no class here has two rows to choose from
    step = stay + [x for c in free for x in c]
    step = [x for x in step if not brute.contained([x], items)]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.dtypes == docs.dtypes
    assert key([(x.doc_id, x.text) for x in at.collect()]) == key(step)
    assert all(x.n_chars == len(x.text) for x in at.collect())
    keyed = [tuple(x) for x in packing.keyed(spark.createDataFrame(step, "doc_id long, text string")).collect()]
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda p: p[:2]) == brute.pack(keyed, packing.CAPACITY)


def test_stages_and_queries():
    import __spark_entry__ as e

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    names = e.queries().keys()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gone string, row_hash string, h string, sig int, row int, print int, class_id int"


def stages(spark, rows, tmp_path):
    """What each stage but the last returns, and the pieces of the last."""
    full = [(d, t, lang, "s", len(t or ""), "g", "r", "h", 1, 2, 3, 4) for d, t, lang in rows]
    at = docs = spark.createDataFrame(full, COLUMNS)
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, None), (3, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.schema(at.schema).parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert at.dtypes == docs.dtypes
        out.append(at.collect())
    return out


def test_every_stage_on_an_empty_table(spark, tmp_path):
    assert [len(x) for x in stages(spark, [], tmp_path)] == [0] * 5


def test_every_stage_on_odd_rows_and_clashing_names(spark, tmp_path):
    import random

    r = random.Random(5)
    some = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    near = some(30)
    long = "\n".join(some(20) for _ in range(20_000))
    rows = [
        (1, near, "en"), (2, near + " end", "en"), (3, None, "en"), (4, "", None), (5, "\n \n", "en"), (None, "free text here " + some(8), "en"), (None, None, None),
        (6, "twice " + some(8), "en"), (7, "own " + some(9), None), (7, "other " + some(9), "en"), (8, long, "en"), (9, some(5) + " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " + some(5), "en"), (10, "x" * 400_000, "en"), (11, "12 34", "en"),
    ]
    rows.append(rows[7])  # equal in id and text
    known, deduped, one, clean, packed = stages(spark, rows, tmp_path)
    ids = lambda x: sorted((y.doc_id for y in x), key=lambda d: (d is None, d))
    assert set(ids(known)) <= {1, 2, 6, 7, 8, 9, 10, None} and ids(known).count(6) == 2 and {1, 2, 7, 8, 9, None} <= set(ids(known))
    assert ids(deduped) == ids(known)
    assert ids(one).count(1) == 1 and 2 not in ids(one) and ids(one).count(6) == 1 and ids(one).count(7) == 2 and ids(one).count(None) == 1
    assert ids(clean) == [d for d in ids(one) if d != 9]
    assert all(x.n_chars == len(x.text) and x.gone == "g" and x.class_id == 4 for x in clean)
    assert sum(p.n_tokens for p in packed) == sum(len(brute.words(x.text)) + 1 for x in clean)
