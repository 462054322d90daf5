"""Steps of the document checks that hold no more in Python, and run no oftener, with more or larger documents."""

import tracemalloc

import pyarrow as pa

from quillon import queries
from quillon.operators import documents
from quillon.sources import frontmatter

DIR = "/root/testdata/sf0.001"


class _Plan:
    """Stands for a DataFrame and hands back the function that it is given."""

    columns = ("path", "text", "body_from")

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def _batch(n, text):
    return pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(n)], "text": [text] * n, "body_from": pa.array([1] * n, pa.int32())})


def _peak(f, batch):
    """(rows out, largest batch out, MB of Python objects at most)."""
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in f(iter([batch]))]
        return sum(sizes), max(sizes), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_go_on_in_small_batches():
    """a batch of many documents isn't held as rows of lines all at once."""
    rows, most, mb = _peak(documents.lines(_Plan()), _batch(2_000, "# T\n" + "- **a** b\n" * 18 + "x"))
    assert rows == 40_000 and most <= documents.ROWS and mb < 5
    rows, most, mb = _peak(documents.lines(_Plan()), _batch(1, "# Tx\n" * 40_000))
    assert rows == 40_001 and most <= documents.ROWS and mb < 8


def test_front_matter_runs_for_its_own_columns_only(spark):
    """what reads bodies doesn't parse YAML, and a filter doesn't parse it again."""
    files = spark.createDataFrame([("a.md", "---\nschema_class: x\n---\nb\n")], "path string, text string")
    docs = frontmatter.documents(files)
    assert "ArrowEvalPython" not in plan(docs.select("path", "text", "body_from"))
    assert plan(docs.where("fm_error is null").where("schema_class = 'x'")).count("ArrowEvalPython") == 1
    assert docs.columns == ["path", "text", "fm", "fm_error", "body_from", "schema_class"]


def test_numeric_claims_are_found_before_the_join(spark):
    """only lines with a claim meet the fields."""
    p = plan(queries.QUERIES["q_numeric_drift"](spark, DIR))
    assert p.index("Join") < p.index("instr(")
    assert p.count("MapInArrow") == 1 and p.count("ArrowEvalPython") == 1


def test_front_matter_head_is_what_split_finds(spark):
    """The column's block and first line against split(), on odd texts."""
    long = "x" * 99 + "\n"
    texts = ["", None, "---", "---\n", "---\n---", "---\n---\n", "---\n\n---\nb", "---\r\na: 1\r\n---\r\nb", "﻿---\na: 1\n---\nb", "﻿﻿---\na: 1\n---\nb", " ---\na: 1\n---\n", "---\na: 1\n --- \n---x\n---\n---\n", "---\na: 1\n----\n", "---\r\n---\r", "---\ra: 1\n---\n"]
    texts += ["\n---\na: 1\n---\n", "---\na: |\n  x\n---\n  y\n---\n", "--- \na: 1\n---\n", "---\na: 1 ---\n---\n", "---\na: '\U0001f600'\n---\nb", "---\na: 1\n---\r\r\n---\n", "---\n[1]\n---\n", "---\na: [1\n---\n", "---\na: 1\x85---\n", "---\n" + long * 20_000, "---\n# " + long * 20_000 + "---\nb"]
    want = [(*(frontmatter.parsed(b) if (b := frontmatter.split(t or "")[0]) is not None else (None, None, None)), frontmatter.split(t or "")[2]) for t in texts]
    files = spark.createDataFrame([(f"{i:02}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.fm, r.fm_error, r.schema_class, r.body_from) for r in frontmatter.documents(files).collect()}
    assert [got[f"{i:02}"] for i in range(len(texts))] == want and sum(w[0] is not None for w in want) > 5


def test_plain_entries_are_what_yaml_reads():
    """blocks of plain words, read without the YAML parser."""
    import yaml

    plain = ["a: 1\n", "a: 007\nb: 0x1F\nc: 0o17\n", "a: true\nb: FALSE\nc: null\nd: NULL\ne: no\nf: yes\n", "d: 2024-01-05\ne: x y z\nf: a/b.md\n", "schema_class: note\nmembers: 3\n", "_: x\n", "a: 1e\n", "a: tRue\n", "a: 12 monkeys\n"]
    for block in plain:
        assert frontmatter._entries(block) == yaml.load(block, frontmatter._Loader), block
    left = ["", "{}", "a: 1\na: 2\n", "a: 1.5\n", "a: 1e3\n", "true: x\n", "null: x\n", "1: x\n", "a: [1\n", "a: b: c\n", "a: b # c\n", "a: 1 \n", "a:  1\n", "a: -1\n", "a: ...\n", "a:\n", "a: x\n b\n", "a: 'x'\n", "a: x\r\n", "a: " + "1" * 5000 + "\n", "a: x", "a: é\n", "k" * 1100 + ": x\n", "a: x\n---\n"]
    for block in left:
        assert frontmatter._entries(block) is None, block
    assert frontmatter.parsed("a: 1\na: 2\n")[1] and frontmatter.parsed("a: " + "1" * 5000 + "\n")[1]


def test_front_matter_is_read_once_on_every_core(spark):
    """one pass for both codes, over more tasks than the file has row groups."""
    df = queries.QUERIES["q_front_matter"](spark, DIR)
    assert plan(df).count("ArrowEvalPython") == 1 and "hashpartitioning(p_partkey" in plan(df)


def test_links_are_read_once(spark):
    """one pass over the links and one over the headings."""
    p = plan(queries.QUERIES["q_dead_links"](spark, DIR))
    assert p.count("MapInArrow") == 2 and "ArrowEvalPython" not in p


def test_link_findings_of_every_kind(spark):
    """all codes at once; a repeated path doesn't repeat a finding of the links to it."""
    text = "[a](b.md#x) [b](b.md#y) [c](gone.md) [d](l.md#x) [e](u.md#x) [f](/b.md) [g](../../q) [h](sub) [i](sub/c.txt#z) [j](#w) [k](b.md#) [l](https://x.y)\n"
    rows = [("d/a.md", text, "ok"), ("d/b.md", "# X\n", "ok"), ("d/b.md", "# X\n", "ok"), ("d/l.md", None, "link"), ("d/u.md", None, "too_large"), ("d/sub/c.txt", "", "ok")]
    files = spark.createDataFrame(rows, "path string, text string, state string")
    docs = frontmatter.documents(files.where("path = 'd/a.md'"))
    found = lambda root: sorted((r.code, r.quoted[0].content) for r in documents.link_findings(docs, files, root).collect())
    common = [("E0011", "../../q"), ("E0012", "l.md#x"), ("E0110", "gone.md"), ("E0111", "#w"), ("E0111", "b.md#y"), ("W0048", "u.md#x")]
    assert found(False) == sorted([*common, ("E0010", "/b.md")])
    assert found(True) == sorted([*common, ("E0110", "/b.md")])


def test_edges_parse_front_matter_once(spark):
    """governing documents need paths alone."""
    p = plan(queries.QUERIES["q_governance_edges"](spark, DIR))
    assert p.count("ArrowEvalPython") == 1 and "MapInArrow" not in p


def test_reserved_terms_need_no_yaml(spark):
    """one Python worker a task, that of the lines."""
    p = plan(queries.QUERIES["q_reserved_term"](spark, DIR))
    assert p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p


def test_sections_need_no_yaml(spark):
    """headings and ends of files, each from the lines alone."""
    p = plan(queries.QUERIES["q_section_spans"](spark, DIR))
    assert p.count("MapInArrow") == 2 and "ArrowEvalPython" not in p


def test_bold_terms_go_on_in_small_batches():
    """as lines do."""
    rows, most, mb = _peak(documents.bold_terms(_Plan()), _batch(5_000, "**a** **b** **c** **d**\n"))
    assert rows == 20_000 and most <= documents.ROWS and mb < 5
