"""The whole check of a corpus: ``Engine(spark, root).check()``.

A project keeps its configuration in a folder of its root: config.yaml, routes.yaml, pins.yaml, vocabulary.yaml, catalogs.yaml,
schemas/, patterns/.  A family without its file is inactive.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.globs import match_regex, walk_regex
from .operators import catalog, documents, findings, index, schema
from .operators.rules import applies
from .plans.analysis import analyse
from .plans.interpreter import EvalError, evaluate, shown
from .plans.rules import Pattern, Rule
from .sources import config, corpus, frontmatter, project
from .streaming.incremental import checkpointed, closure, governance_edges, in_scope, indexes_of, rule_edges, scoped, shared_key_edges

FOLDER = ".quillon"


def rule_findings(docs: DataFrame, rules: list[Rule], indexes: dict[str, dict[str, object]], strict: bool = True) -> DataFrame:
    """Findings of rules over documents of any shape: the interpreter, in Arrow batches."""
    import re

    def matches(r: Rule, cls, path) -> bool:
        if r.context.schema_class is not None and cls != r.context.schema_class:
            return False
        try:
            return r.context.path is None or re.match(match_regex(r.context.path), path) is not None
        except (ValueError, re.error):
            return False

    shared = docs.sparkSession.sparkContext.broadcast(indexes)  # made of configuration files, bounded by the corpus limits

    def run(batches):
        for b in batches:
            out = []
            for path, fm, cls in zip(*(b.column(c).to_pylist() for c in ("path", "fm", "schema_class"))):
                me = frontmatter.rules_value(json.loads(fm))
                for r in rules:
                    if not matches(r, cls, path):
                        continue
                    env = {"self": me, "file": {"path": path}, "project": None}
                    try:
                        for name, e in r.lets:
                            env[name] = evaluate(e, env, shared.value)
                        if evaluate(r.test, env, shared.value) is True:
                            continue
                        quoted = [{"label": k, "content": shown(evaluate(e, env, shared.value))} for k, e in r.message.slots]
                        out.append((path, r.id, r.code, r.message.text, quoted))
                    except EvalError as e:
                        if strict:
                            raise EvalError(f"{path}: rule {r.id}: {e}") from None
                        out.append((path, r.id, "E0080", str(e), []))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("label", pa.string()), ("content", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "rule_id", "code", "message", "quoted"])

    rows = docs.where("fm is not null").select("path", "fm", "schema_class").mapInArrow(run, "file string, rule_id string, code string, message string, quoted array<struct<label:string,content:string>>")
    return rows.select("code", F.lit("error").alias("severity"), F.col("rule_id").alias("summary"), "message", F.lit(None).cast("string").alias("help"), "file", F.lit(1).alias("line"), F.lit(0).alias("column"), F.col("code").alias("explain_ref"), "quoted", F.lit("rules").alias("family"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, folder: str = FOLDER):
        self.spark, self.root, at = spark, root, os.path.join(root, folder)
        y = lambda name: config.read_yaml(os.path.join(at, name))
        cfg = y("config.yaml")
        if cfg is None:
            raise config.ConfigError(f"{at}/config.yaml is absent")
        self.globs: list[str] = cfg.get("file_globs", ["**/*.md"])
        self.required: list[str] = cfg.get("require_frontmatter", [])
        self.vocabulary_globs: list[str] | None = cfg.get("vocabulary_globs")
        self.routes = None if (r := y("routes.yaml")) is None else config.routes(r)
        self.pins = None if (p := y("pins.yaml")) is None else config.pins(p)
        self.vocabulary = None if (v := y("vocabulary.yaml")) is None else config.vocabulary(v)
        self.catalogs = None if (c := y("catalogs.yaml")) is None else config.catalogs(c)
        self.has_schemas = os.path.isdir(os.path.join(at, "schemas"))
        self.schemas = config.schemas(os.path.join(at, "schemas"))
        for name, s in self.schemas.items():
            if bad := schema.unknown_keywords(s):
                raise config.ConfigError(f"schema {name}: {', '.join(bad)} isn't supported")
        self.patterns: list[Pattern] = config.patterns(os.path.join(at, "patterns"))
        self.rules = [r for p in self.patterns for r in p.rules]
        self.keys = [k for p in self.patterns for k in p.keys]
        self.folder = folder
        self.all_files = corpus.read_files(spark, root).where(~F.col("path").startswith(folder + "/"))
        wanted = F.lit(False)
        for g in self.globs:
            wanted |= F.col("path").rlike(walk_regex(g))
        self.files = self.all_files.where(wanted)

    def indexes(self) -> dict[str, dict[str, object]]:
        """Indexes by name."""
        return index.registry(self.sources(), self.keys)

    def sources(self) -> dict[str, list[tuple[str, object]]]:
        """(path, value) of each declared source, which is configuration: read on the driver, confined and bounded.

        A source that is missing, unreadable or not UTF-8 adds nothing and is noted in ``degraded``; a symbolic link, or one over the limit, stops the run.
        """
        sources: dict[str, list[tuple[str, object]]] = {}
        self.degraded = []
        for k in self.keys:
            paths = corpus.walk(self.root, k.source) if any(c in k.source for c in "*?[") else [corpus.confined(k.source)]
            for p in paths:
                try:
                    data = corpus.open_no_follow(self.root, p)
                    text = data.decode()
                except (OSError, UnicodeDecodeError) as e:
                    self.degraded.append((k.name, p, e.strerror if isinstance(e, OSError) and e.strerror else "not valid UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)))
                    continue
                if len(data) > corpus.FILE_BYTES:
                    raise corpus.BoundExceeded(f"{p} has over {corpus.FILE_BYTES} bytes")
                if p not in {q for q, _ in sources.get(k.source, ())}:
                    sources.setdefault(k.source, []).append((p, index.load(p, text)))
        return sources

    def edges(self) -> DataFrame:
        """``(a, b)``: files and their governing documents, files that give entries to one index key, files and the index sources their rules read."""
        docs = frontmatter.documents(self.files.where("state = 'ok'")).select("path", "schema_class")
        out = [self.spark.createDataFrame([], "a string, b string")]
        for r in self.routes or ():
            out.append(governance_edges(self.files.where("state = 'ok'").where(F.col("path").rlike(match_regex(r.files))).select("path", F.lit(r.governed_by).alias("governed_by"))))
        sources = self.sources()
        shared = [(f"{k.name}\0{key}", p) for k in self.keys for p, v in sources.get(k.source, ()) for key, _ in index.entries(v, k)]
        if shared:
            out.append(shared_key_edges(self.spark.createDataFrame(shared, "k string, n string").distinct(), "k", "n"))
        for p in self.patterns:
            for r, names in ((r, indexes_of(p)[r.id]) for r in p.rules):
                reads = sorted({path for k in self.keys if names is None or k.name in names for path, _ in sources.get(k.source, ())})
                if reads:
                    mine = docs.where(applies(r, F.col("schema_class"), F.col("path"))).select(F.lit(r.id).alias("rule"), "path")
                    out.append(rule_edges(mine, self.spark.createDataFrame([(r.id, s) for s in reads], "rule string, source string")))
        return rules_union(out)

    def static_findings(self) -> DataFrame | None:
        rows = [(i.code, i.rule, i.path, i.detail) for r in self.rules for i in analyse(r, self.schemas)]
        if not rows:
            return None
        df = self.spark.createDataFrame(rows, "code string, rule string, path string, detail string")
        return rules_union([findings.finding(df.where(F.col("code") == c), c, "static", "rule doesn't fit its schema", F.col("detail"), F.lit("patterns"), quoted=[("rule", F.col("rule")), ("field", F.col("path"))]) for c in ("E0021", "E0022", "W0050")])

    def check(self, strict: bool = True, limit: int | None = None) -> DataFrame:
        """All findings, in order.  ``limit`` bounds the bytes read in all, see :func:`corpus.within_budget`."""
        return findings.ordered(self._run(None, strict, limit))

    def check_changed(self, changed: list[str], edges: DataFrame | None = None, strict: bool = True, limit: int | None = None) -> DataFrame:
        """Findings in what the changed files can reach, checked alone; equal to the whole check's findings there.

        A path that is no governed file (a typo, a deleted file, configuration) means everything.
        """
        paths = [self.governed_path(c) for c in changed]
        if not paths or None in paths:
            return self.check(strict, limit)
        start = self.spark.createDataFrame([(p,) for p in paths], "node string")
        scope = closure(self.edges() if edges is None else edges, start).unionByName(start).distinct()
        return findings.ordered(self._run(scope, strict, limit))

    def governed_path(self, path: str) -> str | None:
        """The governed file that a path means, given from the root or absolutely, links of the root resolved; None if there is none."""
        if os.path.isabs(path):
            rel = os.path.relpath(os.path.realpath(path), os.path.realpath(self.root))
        else:
            rel = path
        try:
            rel = corpus.confined(rel)
        except corpus.ConfinementError:
            return None
        return None if self.files.where(F.col("path") == rel).isEmpty() else rel

    def _run(self, scope: DataFrame | None, strict: bool, limit: int | None) -> DataFrame:
        """Findings of all families; with a scope (column node) of its files only, without what is found in the configuration alone."""
        all_files, wanted = self.all_files, F.lit(False)
        for g in self.globs:
            wanted |= F.col("path").rlike(walk_regex(g))
        if limit is not None:
            all_files = corpus.within_budget(all_files, wanted, limit)
        files = all_files.where(wanted)
        if scope is not None:
            files = scoped(files, scope)
        self.families: dict[str, str] = {}
        on = lambda family, state: self.families.__setitem__(family, "active" if state else "not-configured")
        everything = frontmatter.documents(files.where("state = 'ok'"))
        docs = everything.where("fm_error is null")
        others = all_files.select("path", "state", "text")  # a file that can't be read exists all the same
        out = [corpus.unreadable(files), frontmatter.problems(everything, self.required)]
        if scope is None:
            out += [corpus.dead_globs(files, self.globs), self.static_findings()]
            if os.path.exists(os.path.join(self.root, self.folder, project.MANIFEST)):
                out.append(project.drift(self.spark, self.root, self.folder))
        marked = self.catalogs is not None or self.vocabulary is not None or any(r.marker_rules or r.section_rules for r in self.routes or ())
        parsed = checkpointed(documents.lines(docs)) if marked else None  # several families read them
        on("routes", self.routes is not None)
        if self.routes is not None:
            c = documents.claims(docs, self.routes)
            cited = docs.join(c.where("citations"), "path", "left_semi")
            linked = docs.join(c.where("links").select("path", "link_root"), "path")
            out += [documents.route_findings(files, self.routes), documents.citation_findings(cited, others), documents.link_findings(linked, others, F.col("link_root"))]
            if marked:
                out += [documents.marker_findings(parsed, others, self.routes), documents.section_findings(docs, self.routes, parsed)]
            if scope is None:
                out.append(documents.governing_findings(all_files, self.routes))
        on("vocabulary", self.vocabulary is not None)
        if self.vocabulary is not None:
            inside = F.lit(self.vocabulary_globs is None)
            for g in self.vocabulary_globs or ():
                inside |= F.col("path").rlike(match_regex(g))
            out.append(documents.vocabulary_findings(docs.where(inside), self.vocabulary, parsed.where(inside)))
            if self.vocabulary_globs is not None and scope is None and files.where(inside).isEmpty():
                self.families["vocabulary"] = "inert"
                one = self.spark.createDataFrame([(0,)], "n int")
                out.append(findings.finding(one, "W0043", "vocabulary", "vocabulary is in scope of no file", F.lit("no file matches the vocabulary's globs"), F.lit("config.yaml")))
        on("catalogs", self.catalogs is not None)
        if self.catalogs is not None:
            out.append(documents.catalog_findings(parsed, self.catalogs))
        on("schemas", bool(self.schemas))
        if self.schemas:
            out.append(schema.document_findings(docs, self.schemas))
        on("rules", bool(self.rules))
        if self.rules:
            out.append(rule_findings(docs, self.rules, self.indexes(), strict))
            if self.degraded and scope is None:
                lost = self.spark.createDataFrame(self.degraded, "name string, source string, reason string")
                out.append(findings.finding(lost, "W0049", "rules", "index source was left out", F.lit("an index source can't be read; its keys are missing"), F.lit("patterns"), quoted=[("index", F.col("name")), ("source", F.col("source")), ("reason", F.col("reason"))]))
        out.append(unrouted_classes(docs, self.schemas, self.rules, self.has_schemas))
        found = rules_union([x for x in out if x is not None])
        if scope is not None:
            found = in_scope(found, scope)
        on("pins", self.pins is not None)
        if self.pins is not None:
            pins, lifted = self.pins
            if scope is not None:  # a pin is about the pinned file, wherever its finding stands
                names = {r.node for r in scope.where(F.col("node").isin(sorted({p.file for p in (*pins, *lifted)}))).collect()}  # of the configuration's pins
                pins, lifted = [p for p in pins if p.file in names], [t for t in lifted if t.file in names]
            found = found.unionByName(documents.pin_findings(frontmatter.documents(others.where("text is not null")), pins, lifted, others.where("state = 'link'")))
        self.files_checked = files.where("state = 'ok'")
        return found

    def report(self, changed: list[str] = ()) -> str:
        """The findings as one JSON document, with the state of each family and the number of files whose content was checked."""
        f = self.check_changed(list(changed)) if changed else self.check()
        return findings.envelope(findings.known_refs(f, catalog.table(self.spark)), self.files_checked.count(), self.families).first().report


def unrouted_classes(docs: DataFrame, schemas: dict[str, dict], rules: list[Rule], has_schemas: bool = True) -> DataFrame:
    """Documents whose class has neither schema nor rule (W0045); one finding for all of them if there is no schema folder (W0047)."""
    known = sorted({*schemas, *(r.context.schema_class for r in rules if r.context.schema_class)})
    lost = docs.where(F.col("schema_class").isNotNull() & ~F.col("schema_class").isin(known))
    for r in rules:
        if r.context.path and not r.context.schema_class:
            lost = lost.where(~F.col("path").rlike(match_regex(r.context.path)))
    if not has_schemas:
        lost = lost.agg(F.count("*").alias("n")).where("n > 0")
        return findings.finding(lost, "W0047", "schema", "no schema folder", F.concat(F.col("n"), F.lit(" documents declare a class")), F.lit("schemas"))
    return findings.finding(lost, "W0045", "schema", "class without schema or rule", F.lit("nothing checks this class"), F.col("path"), quoted=[("class", F.col("schema_class"))])


def rules_union(parts: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)
