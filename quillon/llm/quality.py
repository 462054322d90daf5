"""Quality rules with thresholds that follow each language and source.

Every document gets four measures of its text: the share of symbols among its visible
characters, of capitals among its ASCII letters, of words that repeat the word before, and the
mean bytes of a word, each drawn a little towards a usual value (``PRIOR``).  A quantile sketch of each measure is kept per language and source: counts in
bins of equal width, so a quantile is off by one bin at most, sketches merge by adding counts, and
the result is the same however rows are split or tasks retried.  A group of fewer than
``MIN_GROUP`` documents uses its language's merged sketch, and a language below that the sketch of
everything.  A document is kept if each measure lies within ``FENCE`` interquartile ranges of the middle half
(the range counts as ``LEAST`` bins at least), the first three being bounded above only.

Plan: one mapped pass over the text, whose small result is written once; an aggregation with
map-side combine; and a join of documents with thresholds, one row per group, that Spark
broadcasts if its size allows.

The resolution is 1/512 for the three shares and 1/16 of a byte for words: that is the bound on a quartile's error.  A quartile of fewer values than ``MIN_GROUP`` says
little about a group, hence the way over the language; it is the same at every size of the corpus.

Defined results: null texts and texts without a word are dropped; null languages and sources are
groups of their own; repeated rows each count; texts are measured whole, however long; values on a bound are within it; columns other than doc_id, lang, source and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches, strings, written

MEASURES = ("symbols", "capitals", "repeats", "word_bytes")
BINS = {"symbols": 512, "capitals": 512, "repeats": 512, "word_bytes": 16}
MIN_GROUP, FENCE, LEAST = 30, 3, {"symbols": 8, "capitals": 16, "repeats": 8, "word_bytes": 8}
#: Added above and below each measure, so that a text of a few words isn't an outlier by chance.
PRIOR = {"symbols": (0, 64), "capitals": (0, 64), "repeats": (0, 32), "word_bytes": (160, 32)}
SYMBOLS = "#*$%&|!@^~=+<>{}\\_"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_SEEN = np.ones(256, np.int64)
_SEEN[[9, 10, 11, 12, 13, 32]] = 0
_SEEN[0x80:0xC0] = 0  # the bytes that follow a character's first
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = 1


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Bins of the four measures, and the words, of each text of a block."""
    raw, off = tk.buffers(texts)
    h, start, end, per = tk.words(raw, off)
    words = np.diff(per)
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    first = per[:-1][words > 0]
    again[first] = 0
    part = lambda a, b, m: (a + PRIOR[m][0]) * BINS[m] // (b + PRIOR[m][1])
    return {
        "symbols": part(_per_doc(_SYMBOL[raw], off), _per_doc(_SEEN[raw], off), "symbols"),
        "capitals": part(_per_doc(_CAPITAL[raw], off), _per_doc(_LETTER[raw], off), "capitals"),
        "repeats": part(_per_doc(again, per), words, "repeats"),
        "word_bytes": part(_per_doc(end - start, per), words, "word_bytes"),
        "words": words,
    }


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, symbols, capitals, repeats, word_bytes)`` of every document that has a word."""

    def run(batches):
        for b in batches:
            for i, t in tk.blocks(strings(b, "text")):
                m = measure(t)
                part = b.slice(i, len(t))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(m[k].astype(np.int32)) for k in MEASURES)], ["doc_id", "lang", "source", *MEASURES]).filter(pa.array(m["words"] > 0))

    schema = docs.select("doc_id", "lang", "source").schema
    for k in MEASURES:
        schema = schema.add(k, "integer")
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def sketches(m: DataFrame) -> DataFrame:
    """``(lang, source, measure, bin, n)``: the sketches of every group."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in MEASURES)))
    return m.select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, measure, size, q1, q3)``: the lowest bins up to which a quarter, and three quarters, of the values lie."""
    w = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("size", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("bin")))
    return run.groupBy(*keys, "measure").agg(F.max("size").alias("size"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(lang, source, low_<measure>, high_<measure>)``: bounds, in bins, of every group."""
    own = quartiles(sketch, "lang", "source")
    lang = quartiles(merged(sketch, "lang"), "lang").withColumnsRenamed({"lang": "l", "measure": "lm", "size": "ls", "q1": "l1", "q3": "l3"})
    all_ = quartiles(merged(sketch)).withColumnsRenamed({"measure": "am", "size": "asize", "q1": "a1", "q3": "a3"})
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).join(all_, F.col("measure") == F.col("am"))
    pick = lambda a, b, c: F.when(F.col("size") >= MIN_GROUP, F.col(a)).when(F.col("ls") >= MIN_GROUP, F.col(b)).otherwise(F.col(c))
    q1, q3 = pick("q1", "l1", "a1"), pick("q3", "l3", "a3")
    least = F.create_map(*(F.lit(v) for kv in LEAST.items() for v in kv))[F.col("measure")]
    reach = F.greatest(q3 - q1, least) * FENCE
    x = x.select("lang", "source", "measure", (q1 - reach).alias("low"), (q3 + reach).alias("high"))
    one = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{c}_{k}")
    return x.groupBy("lang", "source").agg(*(one(k, c) for k in MEASURES for c in ("low", "high")))


def kept(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source)`` of the documents within their group's thresholds."""
    small_batches(docs)
    m = written(measured(docs), "quality")
    t = thresholds(sketches(m)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    x = m.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")))
    ok = F.col("word_bytes").between(F.col("low_word_bytes"), F.col("high_word_bytes"))
    for k in MEASURES[:3]:
        ok &= F.col(k) <= F.col(f"high_{k}")
    return x.where(ok).select("doc_id", "lang", "source")


_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+')"
_CLASS = "".join("\\" + c if c in "^\\" else c for c in SYMBOLS)
SQL = rf"""
with w as (select doc_id, lang, source, text, {_WORDS} as w from documents where text is not null),
m as (select doc_id, lang, source,
  {", ".join(f"({x} + {PRIOR[m][0]}) * {BINS[m]} // ({y} + {PRIOR[m][1]}) as {m}" for m, x, y in zip(MEASURES, "scrb", "vakk"))}
  from (select doc_id, lang, source, len(w) as k, strlen(array_to_string(w, '')) as b,
    length(regexp_replace(text, '[^{_CLASS}]', '', 'g')) as s, length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) as v,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as a,
    len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] = x[2])) as r from w) where k > 0),
long as (select lang, source, unnest(['symbols', 'capitals', 'repeats', 'word_bytes']) as measure, unnest([symbols, capitals, repeats, word_bytes]) as bin from m),
sk as (select lang, source, measure, bin, count(*) as n from long group by all),
q as (select lang, source, measure, max(size) as size, min(bin) filter (upto * 4 >= size) as q1, min(bin) filter (upto * 4 >= size * 3) as q3
  from (select *, sum(n) over (partition by lang, source, measure) as size, sum(n) over (partition by lang, source, measure order by bin) as upto from sk) group by all),
ql as (select lang, measure, max(size) as size, min(bin) filter (upto * 4 >= size) as q1, min(bin) filter (upto * 4 >= size * 3) as q3
  from (select *, sum(n) over (partition by lang, measure) as size, sum(n) over (partition by lang, measure order by bin) as upto from (select lang, measure, bin, sum(n) as n from sk group by all)) group by all),
qa as (select measure, max(size) as size, min(bin) filter (upto * 4 >= size) as q1, min(bin) filter (upto * 4 >= size * 3) as q3
  from (select *, sum(n) over (partition by measure) as size, sum(n) over (partition by measure order by bin) as upto from (select measure, bin, sum(n) as n from sk group by all)) group by all),
p as (select q.lang, q.source, q.measure,
  case when q.size >= {MIN_GROUP} then q.q1 when ql.size >= {MIN_GROUP} then ql.q1 else qa.q1 end as q1,
  case when q.size >= {MIN_GROUP} then q.q3 when ql.size >= {MIN_GROUP} then ql.q3 else qa.q3 end as q3
  from q join ql on q.lang is not distinct from ql.lang and q.measure = ql.measure join qa on qa.measure = q.measure),
t as (select *, {FENCE} * greatest(q3 - q1, case measure {" ".join(f"when '{k}' then {v}" for k, v in LEAST.items())} end) as reach from p),
bad as (select m.doc_id, m.lang, m.source, bool_or(x > q3 + reach or (measure = 'word_bytes' and x < q1 - reach)) as out
  from (select row_number() over () as r, *, unnest(['symbols', 'capitals', 'repeats', 'word_bytes']) as mm, unnest([symbols, capitals, repeats, word_bytes]) as x from m) m
  join t on t.lang is not distinct from m.lang and t.source is not distinct from m.source and t.measure = m.mm group by r, m.doc_id, m.lang, m.source)
select doc_id, lang, source from bad where not out
"""
