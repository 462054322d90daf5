"""Whole projects on disk, family by family, against the findings expected of them."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.functions import markup
from quillon.functions.globs import match_regex, walk_regex
from quillon.operators import catalog, findings
from quillon.sources import config, corpus, frontmatter
from quillon.sources.config import ConfigError
from quillon.streaming import incremental


def project(tmp_path, files, conf):
    base = {"config.yaml": "file_globs: ['docs/**/*.md']\n", "schemas/none.json": '{"type": "object"}'}
    for name, text in {**files, **{f".quillon/{k}": v for k, v in {**base, **conf}.items()}}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def found(spark, root):
    return [(x.code, x.file, x.line) for x in Engine(spark, root).check().collect()]


def test_clean_and_schema(spark, tmp_path):
    memo = {"additionalProperties": False, "required": ["title", "kind", "schema_class"], "properties": {"kind": {"enum": ["red", "blue"]}, "title": {"minLength": 1, "type": "string"}, "on": {"format": "date"}, "schema_class": {"const": "memo"}}, "type": "object"}
    files = {
        "docs/ok.md": "---\nschema_class: memo\ntitle: T\nkind: red\non: 2024-01-05\n---\nbody\n",
        "docs/bad.md": "---\nschema_class: memo\ntitle: ''\nkind: c\nextra: 1\non: soon\n---\n",
        "docs/missing.md": "---\nschema_class: memo\ntitle: T\n---\n",
        "docs/none.md": "no front-matter\n",
        "docs/broken.md": "---\na: [1\n---\n",
        "docs/twice.md": "---\na: 1\na: 2\n---\n",
        "docs/bytes.md": b"\xff\xfe\x00",
        "docs/lost.md": "---\nschema_class: other\n---\n",
    }
    root = project(tmp_path, files, {"schemas/memo.json": json.dumps(memo), "config.yaml": "file_globs: ['docs/**/*.md', 'nothing/*.md']\nrequire_frontmatter: ['docs/n*.md']\nunknown: fine\n"})
    got = found(spark, root)
    assert got == sorted(got[:1]) + got[1:]
    assert set(got) == {("E0050", "docs/bad.md", 3), ("E0050", "docs/bad.md", 4), ("E0050", "docs/bad.md", 5), ("E0050", "docs/bad.md", 6), ("E0050", "docs/missing.md", 1), ("W0040", "docs/none.md", 1), ("E0001", "docs/broken.md", 1), ("E0001", "docs/twice.md", 1), ("E0003", "docs/bytes.md", 1), ("W0045", "docs/lost.md", 1), ("W0046", "config.yaml", 1)}


def test_routes_citations_links_markers_sections(spark, tmp_path):
    plan = "# Plan\n\n## Requirements\n\n### P1 first\n### P2 second\n\n## Completed phases\n\n- **P2** done\n- **P9** done\n"
    a = (
        "# A\n\nSee docs/b.md:2 and docs/b.md:9, ../x.md:1, /abs.md:1, gone.md:3, http://host/x.md:1 and docs/b.md:3-1.\n\n[ok](b.md#beta) [dead](nope.md) [anchor](b.md#nope) [ext](https://x.y) ![img](pic%20one.png) [out](../../z.md) [abs](/docs/b.md) `[code](no.md)` [self](#a) [dir](../docs) [r][ref] [plus](b+c.md)\n\n"
        "[ref]: absent.md\n\n```\n[fenced](no.md)\n```\n\nProvenance: Ann.\nProvenance: Nobody\n"
    )
    files = {"docs/a.md": a, "docs/b.md": "# B\n\n## Beta\n## Beta\n", "docs/pic one.png": "x", "docs/b+c.md": "x\n", "docs/plan.md": plan, "docs/sub/BadName.md": "x\n", "docs/sub/two.md": "x\n", "people.md": "# P\n## Team\n- **Ann.** one\n## Others\n- **Nobody** x\n", "rules.md": "x"}
    routes = """
routes:
- {files: docs/a.md, governed_by: rules.md, citations: true, links: true, marker_rules: [{pattern: 'Provenance: (.*)', element: list-item-bold-name, target_doc: people.md, target_section: '## Team'}]}
- files: docs/plan.md
  governed_by: rules.md
  section_rules:
  - {section: '## Requirements', element: h3, match: '^P', count: '>= 3'}
  - {disjoint: [{section: '## Requirements', id_from: h3-heading, id_pattern: '^(P[0-9]+)'}, {section: '## Completed phases', id_from: bullet-lead, id_pattern: '^(P[0-9]+)'}]}
- {files: 'docs/sub/*.md', governed_by: absent.md, naming: '[a-z]+\\.md'}
- {files: 'docs/sub/t*.md', governed_by: rules.md}
"""
    got = [(x.code, x.file, x.line, x.quoted[0].content if x.quoted else None) for x in Engine(spark, project(tmp_path, files, {"routes.yaml": routes})).check().collect()]
    assert set(got) == {
        ("E0101", "docs/a.md", 3, "docs/b.md:9"), ("E0011", "docs/a.md", 3, "../x.md:1"), ("E0010", "docs/a.md", 3, "/abs.md:1"), ("E0100", "docs/a.md", 3, "gone.md:3"), ("E0101", "docs/a.md", 3, "docs/b.md:3-1"),
        ("E0110", "docs/a.md", 5, "nope.md"), ("E0111", "docs/a.md", 5, "b.md#nope"), ("E0011", "docs/a.md", 5, "../../z.md"), ("E0010", "docs/a.md", 5, "/docs/b.md"), ("E0110", "docs/a.md", 5, "absent.md"),
        ("E0112", "docs/a.md", 14, "Nobody"), ("E0120", "docs/plan.md", 1, "## Requirements"), ("E0121", "docs/plan.md", 1, "P2"), ("W0041", "docs/sub/BadName.md", 1, "BadName.md"), ("E0032", "docs/sub/two.md", 1, "docs/sub/*.md, docs/sub/t*.md"),
        ("E0031", "routes.yaml", 1, "absent.md"), ("E0030", "docs/b.md", 1, None), ("E0030", "docs/b+c.md", 1, None),
    }


def test_pins(spark, tmp_path):
    text = "# T\n\n## One\nbody\n\n## Two\nmore\n"
    whole, one = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"## One\nbody\n").hexdigest()
    pins = f"""
pins:
- {{governing: g, file: docs/t.md, sha256: {whole}}}
- {{governing: g2, file: docs/t.md, sha256: {'0' * 64}}}
- {{governing: g, file: docs/t.md, section: '## One', sha256: {one}}}
- {{governing: g, file: docs/t.md, section: '## Two', sha256: {one}}}
- {{governing: g, file: docs/t.md, section: '## Nope', sha256: {one}}}
- {{governing: g, file: docs/no.md, sha256: {one}}}
unpinned:
- {{file: docs/t.md, governing: g, reason: moved, owner: me}}
- {{file: docs/t.md, governing: g}}
"""
    e = Engine(spark, project(tmp_path, {"docs/t.md": text}, {"pins.yaml": pins}))
    assert sorted(x.code for x in e.check().collect()) == ["E0061", "E0061", "E0062", "E0063", "L0001", "W0042"]
    from quillon.operators.documents import pin_updates

    new = pin_updates(frontmatter.documents(e.all_files.where("state = 'ok'").select("path", "text")), e.pins[0]).collect()
    assert {(x.section, x.actual) for x in new} == {(None, whole), ("## Two", hashlib.sha256(b"## Two\nmore\n").hexdigest())}


def test_vocabulary_and_catalogs(spark, tmp_path):
    vocab = """
terms: [{term: Alpha, status: registered, sense: s}, {term: Beta, status: reserved}, {term: Gam, status: registered}, {term: Gam, status: draft}]
label_schemes: {allow: ['^OK-[0-9]+$']}
anti_patterns: [{pattern: 'very [a-z]+', register: plain}]
numeric_claims: [{field: members}, {field: core_parts}]
"""
    doc = "---\nmembers: 28\ncore_parts: [a, b]\n---\n**Alpha** and **Omega** here.\nBeta and Betas and Beta.\nAB-C12 but not `ZZ-Z99`, OK-12.\nThis is very nice, `very bad`.\nWe have 27 members of all.\nThere are two core parts; twenty-eight members.\nOnly seven core_parts now\nQ-7 Q-123 Q-x\n"
    cats = "version: 1\ncatalogs: [{namespace: 'Q-', comprehensive: true, codes: ['Q-7']}, {namespace: 'R-', comprehensive: false, codes: []}]\n"
    got = [(x.code, x.line) for x in Engine(spark, project(tmp_path, {"docs/d.md": doc}, {"vocabulary.yaml": vocab, "catalogs.yaml": cats})).check().collect()]
    assert sorted(got) == sorted([("E0090", 5), ("E0092", 6), ("E0091", 7), ("E0093", 8), ("E0094", 9), ("E0094", 10), ("E0094", 11), ("E0113", 12), ("W0044", 1)])
    with pytest.raises(ConfigError):
        config.catalogs({"catalogs": []})
    with pytest.raises(ConfigError):
        config.routes({"routes": [{"files": "a", "governed_by": "b", "colour": 1}]})
    with pytest.raises(ConfigError):
        config.vocabulary({"anti_patterns": [{"pattern": "(?=x)"}]})


RULES = """
version: 1
pattern:
  id: p
  keys: [{name: m, source: registry.yaml, select: $.matrix, indexed_by: $key}, {name: people, source: 'people/*.json', select: $.list, indexed_by: $.id}]
  rules:
  - id: domains
    context: {schema_class: primer}
    let: {expected: 'key("m", $self.phase)'}
    assert: 'every(d in $expected.required, d in $self.domains)'
    code: R-E0100
    message: 'phase {{$self.phase}} wants {{join($expected.required, "+")}}'
  - {id: owner, context: 'docs/p*.md', assert: 'defined(key("people", $self.owner))', code: R-E0101, message: 'no {{$self.owner}}'}
"""


def rule_project(tmp_path):
    doc = lambda phase, doms, owner: f"---\nschema_class: primer\nphase: {phase}\ndomains: [{doms}]\nowner: {owner}\nscore: 1.5\n---\n"
    files = {"docs/p1.md": doc("one", "a, b", "ann"), "docs/p2.md": doc("one", "a", "bob"), "docs/q3.md": doc("none", "", "zed"), "registry.yaml": "matrix: {one: {required: [a, b]}, two: {required: []}}\n", "people/x.json": '{"list": [{"id": "ann"}, {"id": "old"}]}', "people/y.json": '{"list": [{"id": "cy"}]}'}
    return project(tmp_path, files, {"patterns/p.yaml": RULES})


def test_rules_and_indexes(spark, tmp_path):
    e = Engine(spark, rule_project(tmp_path))
    got = [(x.code, x.file, x.message, [tuple(q) for q in x.quoted]) for x in e.check().collect()]
    assert got == [("R-E0100", "docs/p2.md", 'phase [see: phase] wants [see: join($expected.required, "+")]', [("phase", "one"), ('join($expected.required, "+")', "a+b")]), ("R-E0101", "docs/p2.md", "no [see: owner]", [("owner", "bob")])]
    report = json.loads(e.report())
    assert report["summary"] == {"errors": 2, "warnings": 0, "lints": 0, "files_checked": 3} and [f["code"] for f in report["findings"]] == ["R-E0100", "R-E0101"]
    edges = spark.createDataFrame([("docs/p1.md", "registry.yaml"), ("docs/p2.md", "registry.yaml"), ("docs/q3.md", "x")], "a string, b string")
    part = [x.file for x in e.check_changed(["docs/p1.md"], edges).collect()]
    assert part == ["docs/p2.md", "docs/p2.md"] and e.check_changed(["docs/q3.md"], edges).count() == 0


def test_static_analysis():
    from quillon.plans.analysis import analyse
    from quillon.plans.rules import Rule

    s = {"c": {"additionalProperties": False, "properties": {"a": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "integer"}, "o": {"type": "object"}}}}
    codes = lambda test: [i.code for i in analyse(Rule.of("r", test, context="c"), s)]
    assert codes('$self.zz == "x"') == ["E0021"] and codes('$self.n == "x"') == ["E0022"] and codes('$self.a == "q"') == ["W0050"] and codes('$self.a in ["x", "q"]') == ["W0050"]
    assert codes('$self.a == "x" and $self.n == 3 and $self.o.any == 1 and $self.a != null') == []


def test_front_matter_table():
    s = frontmatter.split
    assert s("---\na: 1\n---\nbody") == ("a: 1\n", "body", 4) and s("﻿---\r\na: 1\r\n---\r\nb")[0] == "a: 1\r\n" and s("---\n---\nx") == ("{}", "x", 3)
    assert s("---\na: 1\n")[0] is None and s("text")[0] is None and s("---\na: |\n  x\n---\n  y\n---\n")[0] == "a: |\n  x\n"
    y = frontmatter.load_yaml("d: 2024-01-01\nyes: no\nt: true\nn: 0x1F\nf: 1.5\ne: ~\n1: x\n")
    assert y == {"d": "2024-01-01", "yes": "no", "t": True, "n": 31, "f": 1.5, "e": None}
    assert frontmatter.rules_value({"f": 1.5, "i": 1 << 70, "x": [True, 2]}) == {"f": None, "i": None, "x": [True, 2]}
    with pytest.raises(Exception, match="deep"):
        frontmatter.load_yaml("a: " + "[" * 300 + "]" * 300)


def test_markup():
    assert markup.heading_slugs("# A b\n# A b\n\nSet *ext*\n====\n<a id=\"Top\"></a>\n<!-- <a id=no> -->\n```\n# no\n```\n") == ["a-b", "a-b-1", "set-ext", "Top", "top"]
    assert markup.heading_slugs("# !!\n# a\n") == ["a"]
    assert markup.bold_spans("**a** **" + "x" * 70 + "** **b c** ** ** x") == [(1, "a"), (1, "b c"), (1, "")]
    assert markup.bold_spans("****x****") == [] and markup.bold_spans("h\n**a\nb** c **d** e", 2) == [(3, "d")] and markup.bold_spans("**a") == []
    assert [x[1] for x in markup.links("[a](b(c).md 'T') [n](<x y.md>) ![i](p.png) [![in](q.png)](out.md)\n\n    [code](z.md)\n")] == ["b(c).md", "x y.md", "p.png", "out.md", "q.png"]
    assert markup.code_ranges("a `b` ``c ` d`` `e") == [(2, 5), (6, 15)]
    assert [(x.level, x.title) for x in markup.lines("# T #\n####### no\n  ## In\n#x") if x.level] == [(1, "T"), (2, "In")]


def test_globs():
    import re

    assert re.match(match_regex("docs/*.md"), "docs/a/b.md") and not re.match(walk_regex("docs/*.md"), "docs/a/b.md")
    assert re.match(walk_regex("docs/**/*.md"), "docs/b.md") and re.match(walk_regex("**/x?.m[de]"), "a/b/x1.md") and not re.match(walk_regex("docs/[!a]*.md"), "docs/ab.md")


def test_confinement(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/f.md").write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "link")
    root = str(tmp_path)
    assert corpus.open_no_follow(root, "a/./f.md") == b"x" and corpus.walk(root, "**/*.md") == ["a/f.md"]
    for path, code in (("/etc/x", "E0010"), ("a/../../x", "E0011"), ("link/f.md", "E0012")):
        with pytest.raises(corpus.ConfinementError) as e:
            corpus.open_no_follow(root, path)
        assert e.value.code == code


def test_forms(spark):
    row = {"code": "E0050", "severity": "error", "summary": "s", "message": "m " * 400, "help": "do", "file": "a.md", "line": 3, "column": 0, "explain_ref": "E0050", "quoted": [{"label": "v", "content": "one\ntwo\x07"}]}
    text = findings.text_form(row)
    assert "  --> a.md:3:0" in text and "    | two\\x07" in text and "help: do" in text
    short = findings.compact_form(row)
    assert len(short.encode()) <= 512 and short.startswith("a.md:3 E0050 v=one two") and short.endswith("…")
    assert findings.exit_status(0, 1) == 0 and findings.exit_status(0, 1, True) == 1 and findings.exit_status(1, 0) == 1 and findings.exit_status(0, 0, failed=True) == 2
    assert len(catalog.CODES) == 43 and catalog.explain("X-E0050") and catalog.explain("E9999") is None


def test_closure_and_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a long, b long")
    assert sorted(x.node for x in incremental.closure(e, spark.createDataFrame([(2,)], "node long")).collect()) == [1, 2, 3]
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("j", 4), (None, 5), (None, 6)], "k string, n long")
    assert sorted(tuple(x) for x in incremental.shared_key_edges(rows, "k", "n").collect()) == [(1, 2), (1, 3)]


def test_stream_of_tables(spark, tmp_path):
    from quillon.operators import rules
    from quillon.plans.rules import Rule

    src = f"{tmp_path}/in"
    spark.range(10).withColumn("ok", F.col("id") % 3 == 0).write.parquet(src)
    arriving = spark.readStream.schema("id long, ok boolean").parquet(src)
    check = lambda df: rules.check(df, [Rule.of("ok", "$self.ok")], "t", F.col("id"))
    q = incremental.check_stream(arriving, check, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_determinism(spark, tmp_path):
    e = Engine(spark, rule_project(tmp_path))
    a = e.report()
    e.all_files, e.files = e.all_files.repartition(3), e.files.repartition(2)
    assert e.report() == a


def test_schema_validator():
    from quillon.operators.schema import errors, unknown_keywords

    s = {"$defs": {"p": {"type": "integer", "minimum": 1}}, "properties": {"a": {"$ref": "#/$defs/p"}, "l": {"items": {"oneOf": [{"type": "string"}, {"type": "integer", "multipleOf": 2}]}, "uniqueItems": True, "contains": {"const": "x"}}}, "if": {"required": ["a"]}, "then": {"required": ["b"]}, "not": {"required": ["zz"]}, "dependentRequired": {}}
    kinds = lambda v: sorted((p, k) for p, k, _ in errors(v, s))
    assert kinds({"a": 0}) == [("", "required"), ("/a", "minimum")] and kinds({"l": ["x", 3, "x"]}) == [("/l", "uniqueItems"), ("/l/1", "oneOf")] and kinds({"zz": 1, "l": [2]}) == [("", "not"), ("/l", "contains")]
    assert unknown_keywords(s) == ["dependentRequired"]


def test_edges_and_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main

    root = rule_project(tmp_path)
    e = Engine(spark, root)
    got = {frozenset(x) for x in e.edges().collect()}
    assert frozenset(("docs/p1.md", "registry.yaml")) in got and frozenset(("docs/p1.md", "people/x.json")) in got and frozenset(("docs/q3.md", "people/x.json")) not in got
    whole = [tuple(x)[:6] for x in e.check().collect()]
    assert [tuple(x)[:6] for x in e.check_changed(["registry.yaml"]).collect()] == whole and [tuple(x)[:6] for x in e.check_changed(["/etc/x"]).collect()] == whole
    assert main(["explain", "E0050"]) == 0 and main(["explain", "E9999"]) == 2 and "schema" in capsys.readouterr().out
    assert main(["init", "--root", f"{tmp_path}/new"]) == 0 and "config.yaml" in capsys.readouterr().out
    assert main(["init", "--root", f"{tmp_path}/new"]) == 0 and capsys.readouterr().out == ""


def test_manifest_drift_and_pin_renewal(spark, tmp_path):
    from quillon.operators.documents import pin_updates
    from quillon.sources import project as P

    root = str(tmp_path)
    assert set(P.init(root, ".quillon")) == set(P.SKELETON) and P.init(root, ".quillon") == []
    (tmp_path / ".quillon/config.yaml").write_text("file_globs: ['docs/*.md']\n")
    assert P.init(root, ".quillon") == []
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("text\n")
    (tmp_path / ".quillon/pins.yaml").write_text("pins:\n- {governing: g, file: docs/a.md, sha256: old}\n")
    e = Engine(spark, root)
    assert sorted((x.code, x.file) for x in e.check().collect()) == [("E0060", ".quillon/config.yaml"), ("E0061", "docs/a.md")]
    docs = frontmatter.documents(e.files.where("state = 'ok'").select("path", "text"))
    assert len(P.renew_pins(f"{root}/.quillon", pin_updates(docs, e.pins[0]), dry_run=True)) == 1 and Engine(spark, root).pins[0][0].sha256 == "old"
    P.renew_pins(f"{root}/.quillon", pin_updates(docs, e.pins[0]))
    assert [x.code for x in Engine(spark, root).check().collect()] == ["E0060"]


def test_bold_columns_are_as_the_scan(spark):
    from quillon.functions import text as X

    texts = ["**a** b **c", "****x****", "** **", "a **b\nc** **d**", "***e***", "**" + "é" * 30 + "** **" + "é" * 31 + "**", "", "**", "*" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", X.bold_spans(F.col("text")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [[t for _, t in markup.bold_spans(x)] for x in texts]


def test_links_are_refused_and_dead_globs_follow_the_walk(spark, tmp_path):
    routes = """
routes:
- {files: 'docs/*.md', governed_by: link/rules.md, citations: true, links: true, marker_rules: [{pattern: 'By: (.*)', element: heading, target_doc: out.md}]}
"""
    pins = "pins:\n- {governing: g, file: out.md, sha256: x}\n"
    files = {"docs/sub/a.md": "---\nk: 1\n---\n", "docs/b.md": "See out.md:1 and [x](../out.md) and [y](../out.md#z).\nBy: Ann\n", "real/rules.md": "# R\n", "secret.txt": "s\n"}
    root = project(tmp_path, files, {"routes.yaml": routes, "pins.yaml": pins, "config.yaml": "file_globs: ['docs/*.md', 'other/*.md']\nrequire_frontmatter: ['docs/*.md']\n"})
    os.symlink("../secret.txt", tmp_path / "docs/link.md")
    os.symlink("secret.txt", tmp_path / "out.md")
    os.symlink("real", tmp_path / "link")
    os.symlink("../docs", tmp_path / "docs/loop")
    got = [(x.code, x.file, x.line) for x in Engine(spark, root).check().collect()]
    assert sorted(got) == sorted(
        [("E0012", "docs/link.md", 1), ("E0030", "docs/sub/a.md", 1)][:1]
        + [("E0012", "docs/b.md", 1)] * 3  # cited, and linked twice
        + [("E0012", "routes.yaml", 1)] * 2  # governing document, marker's target
        + [("E0012", "pins.yaml", 1), ("W0040", "docs/b.md", 1), ("W0046", "config.yaml", 1)]
    )
    (tmp_path / "docs/b.md").unlink()
    (tmp_path / "docs/link.md").unlink()
    dead = [x.quoted[0].content for x in Engine(spark, root).check().where("code = 'W0046'").collect()]
    assert sorted(dead) == ["docs/*.md", "other/*.md"]  # docs/sub/a.md is below docs/*.md


def test_scoped_runs(spark, tmp_path):
    """What can't be resolved means everything; else the scope's findings, with stale pins, and no others."""
    root = rule_project(tmp_path)
    (tmp_path / ".quillon/pins.yaml").write_text("pins:\n- {governing: g, file: docs/p1.md, sha256: x}\n- {governing: g, file: docs/gone.md, sha256: x}\n")
    (tmp_path / "docs/free.md").write_text("---\nschema_class: lost\n---\n")
    (tmp_path / ".quillon/config.yaml").write_text("file_globs: ['docs/*.md', 'none/*.md']\n")
    e = Engine(spark, root)
    show = lambda df: [(x.code, x.file, x.message) for x in df.collect()]
    whole = show(e.check())
    assert {c for c, *_ in whole} == {"R-E0100", "R-E0101", "E0061", "E0062", "W0045", "W0046"}
    for path in ("docs/typo.md", ".quillon/config.yaml", "people/x.json", "../x", "/etc/hostname"):
        assert show(e.check_changed([path])) == whole, path
    assert show(e.check_changed(["docs/free.md", "docs/typo.md"])) == whole
    free = [x for x in whole if x[1] == "docs/free.md"]
    assert show(e.check_changed(["docs/free.md"])) == free == show(e.check_changed([f"{root}/docs/free.md"]))
    scope = {"docs/p1.md", "docs/p2.md", "docs/q3.md"}
    assert show(e.check_changed(["docs/p2.md"])) == [x for x in whole if x[1] in scope]
    report = json.loads(e.report(["docs/free.md"]))
    assert report["summary"]["files_checked"] == 1 and report["families"]["rules"] == "active" and report["families"]["routes"] == "not-configured"


def test_scoped_is_filtered_whole_on_random_projects(spark, tmp_path):
    import random

    for seed in range(3):
        r = random.Random(seed)
        names = [f"docs/d{i}.md" for i in range(8)]
        body = lambda: " ".join(r.choice(["docs/d1.md:9", "[x](d2.md#no)", "**new**", "[y](nope.md)", "text"]) for _ in range(4))
        files = {n: f"---\nschema_class: {r.choice('ab')}\nphase: {r.choice(['one', 'two'])}\n---\n{body()}\n" for n in names}
        conf = {
            "routes.yaml": "routes:\n" + "".join(f"- {{files: {n}, governed_by: {r.choice(names)}, links: true, citations: true}}\n" for n in names[:5]),
            "vocabulary.yaml": "terms: [{term: old, status: registered}]\n", "schemas/a.json": '{"properties": {"phase": {"const": "one"}}}',
        }
        root = project(tmp_path / str(seed), files, conf)
        e = Engine(spark, root)
        whole = [(x.code, x.file, x.line, str(x.quoted)) for x in e.check().collect()]
        start = r.choice(names)
        reach = incremental.closure(e.edges(), spark.createDataFrame([(start,)], "node string"))
        scope = {x.node for x in reach.collect()} | {start}
        assert [(x.code, x.file, x.line, str(x.quoted)) for x in e.check_changed([start]).collect()] == [x for x in whole if x[1] in scope]


def test_limits_degraded_sources_and_inert_vocabulary(spark, tmp_path, monkeypatch):
    files = {"docs/a.md": "See [big](../big.md#top), [big](../big.md) and big.md:3.\n", "big.md": "# top\n" + "x" * 500, "registry.yaml": b"\xff\xfe", "people/x.json": "{}"}
    rules = RULES.replace("select: $.list", "select: $").replace("'people/*.json'", "gone.yaml")
    vocab = {"vocabulary.yaml": "terms: [{term: T, status: registered}]\n", "config.yaml": "file_globs: ['docs/*.md']\nvocabulary_globs: ['none/*.md']\n"}
    root = project(tmp_path, files, {"patterns/p.yaml": rules, "routes.yaml": "routes:\n- {files: 'docs/*.md', governed_by: big.md, links: true, citations: true}\n", **vocab})
    e = Engine(spark, root)
    assert sorted(x.code for x in e.check().collect()) == ["E0101", "W0043", "W0049", "W0049"] and e.families["vocabulary"] == "inert"
    assert sorted(x.code for x in e.check(limit=200).collect()) == ["W0043", "W0048", "W0048", "W0049", "W0049"]  # big.md is left unread
    with pytest.raises(corpus.BoundExceeded):
        e.check(limit=20)
    monkeypatch.setattr(corpus, "FILE_BYTES", 400)
    assert sorted(x.code for x in Engine(spark, root).check().collect()) == ["W0043", "W0048", "W0048", "W0049", "W0049"]


def test_sections_of_a_file(spark):
    from quillon.operators import documents

    text = "# A\nx\n## B\n### C\ny\n## D\n# E\n"
    docs = spark.createDataFrame([("p", text, 1)], "path string, text string, body_from int")
    got = {(x.title, x.line_no, x.last) for x in documents.sections(documents.lines(docs)).collect()}
    assert got == {("A", 1, 6), ("B", 3, 5), ("C", 4, 5), ("D", 6, 6), ("E", 7, 8)}


def test_table_schemas_with_other_keywords(spark):
    from quillon.operators import schema

    df = spark.createDataFrame([(1, [1, 1], 4.0, "x"), (2, [1, 2], 5.0, None)], "id int, l array<int>, n double, s string")
    codes = lambda s: sorted((x.file, x.quoted[0].content, x.message.split(":")[0]) for x in schema.table_findings(df, s, F.col("id")).collect())
    s = {"properties": {"l": {"uniqueItems": True, "items": {"maximum": 1}}, "n": {"multipleOf": 2}}, "anyOf": [{"required": ["s"]}]}
    assert codes(s) == [("1", "/l", "uniqueItems"), ("2", "", "anyOf"), ("2", "/l/1", "maximum"), ("2", "/n", "multipleOf")]
    assert codes({}) == codes({"properties": {}}) == [] and codes({"minProperties": 4}) == [("2", "", "minProperties")]
    with pytest.raises(ValueError):
        codes({"dependentRequired": {}})
    u = {"allOf": [{"properties": {"a": {}}}], "properties": {"b": {}}, "unevaluatedProperties": False}
    assert list(schema.errors({"a": 1, "b": 2}, u)) == [] and [p for p, *_ in schema.errors({"c": 1}, u)] == ["/c"]
    assert [p for p, *_ in schema.errors({"a": 1, "b": 2}, {**u, "additionalProperties": {}})] == []


def test_large_indexes_are_joined(spark, monkeypatch):
    """Rules see the same whether an index is a map beside all rows or joined for each."""
    from quillon.operators import rules
    from quillon.plans.rules import Rule

    rows = [(i, f"k{i % 7}", [f"k{j}" for j in range(i % 4)], None if i % 5 == 0 else f"m{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a string, l array<string>, m string")
    first = spark.createDataFrame([(f"k{i}", (f"m{i % 3}", i)) for i in range(6)], "key string, value struct<next:string,n:long>")
    second = spark.createDataFrame([("m0", "x"), ("m2", None)], "key string, value string")
    given = [
        Rule.of("one", 'defined(key("first", $self.a))', "{{$self.a}}"),
        Rule.of("every", 'every(p in $self.l, key("first", p).n == 1 or defined(key("second", key("first", p).next)))'),
        Rule.of("chain", 'key("second", $next) == "x"', "{{$next}}", let={"start": 'key("first", $self.a)', "next": "$start.next"}),
        Rule.of("null", '$self.m == null or key("second", $self.m) == "x"'),
    ]
    run = lambda: sorted((x.rule_id, x.file, str(x.quoted), str(x.error)) for x in rules.evaluated(df, given, "t", F.col("id"), {"first": first, "second": second}).collect())
    want = run()
    assert len(want) > 20
    for most in (0, 3):
        monkeypatch.setattr(rules, "MAP_ROWS", most)
        assert run() == want


def test_command_line_reports(spark, tmp_path, capsys):
    from quillon.__main__ import main

    root = rule_project(tmp_path)
    assert main(["verify", "--root", root, "--format", "json"]) == 1
    report = json.loads(capsys.readouterr().out)
    assert report["version"] == findings.VERSION and report["status"] == "findings" and report["summary"] == {"errors": 2, "warnings": 0, "lints": 0, "files_checked": 3}
    assert report["families"] == {"routes": "not-configured", "vocabulary": "not-configured", "catalogs": "not-configured", "schemas": "active", "rules": "active", "pins": "not-configured"}
    assert [f["code"] for f in report["findings"]] == ["R-E0100", "R-E0101"] and not any("explain_ref" in f for f in report["findings"])
    assert main(["verify", "--root", root, "--format", "compact"]) == 1
    assert [x.split()[0] for x in capsys.readouterr().out.splitlines()] == ["docs/p2.md:1", "docs/p2.md:1"]
    assert main(["verify", "--root", root, "--changed", "docs/p1.md"]) == 1 and "error[R-E0100]" in capsys.readouterr().out
    assert main(["verify", "--root", f"{tmp_path}/nowhere"]) == 2 and '"E0070"' in capsys.readouterr().err
    (tmp_path / ".quillon/config.yaml").unlink()
    assert main(["verify", "--root", root]) == 2 and '"E0080"' in capsys.readouterr().err
