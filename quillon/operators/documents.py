"""Checks of document bodies: routes, pins, vocabulary, citations, links, markers, code catalogs, sections.

``docs`` are the rows of :func:`quillon.sources.frontmatter.documents`.  Configuration is a handful of lines kept on the driver; a
check joins documents with each other only by path, and keeps matches as rows until they are findings.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as X
from ..functions.globs import match_regex
from ..sources.config import Catalog, Pin, Route, Tombstone, Vocabulary
from ..sources.frontmatter import PIECE
from .findings import finding

ROWS = 4096
_LINE = "path string, line_no int, text string, body boolean, fenced boolean, level int, title string, bullet string"


def lines(docs: DataFrame) -> DataFrame:
    """One row for each line: ``(path, line_no, text, body, fenced, level, title, bullet)``; what is such a table already is handed on."""
    if "line_no" in docs.columns:
        return docs
    kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string())
    return _per_document(docs, lambda t, n: ((x.number, x.text, x.body, x.fenced, x.level, x.title, x.bullet) for x in markup.each_line(t, n)), _LINE, kinds)


def _per_document(docs: DataFrame, f, schema: str, kinds, flag: Column | None = None) -> DataFrame:
    """Rows ``(path, *f(text, body_from))`` of every document, and its boolean ``flag`` if there is one; ``PIECE`` documents and ``ROWS`` rows at a time are Python objects, whatever the batch."""
    more = [] if flag is None else [flag.alias("flag")]
    schema, kinds = schema + ", flag boolean" * len(more), (*kinds, *[pa.bool_()] * len(more))
    names = [c.strip().split()[0] for c in schema.split(",")]
    read = ["path", "text", "body_from", *["flag"] * len(more)]

    def run(batches):
        pieces = (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE))
        rows = ((p, *x, *own) for b in pieces for p, t, n, *own in zip(*(b.column(c).to_pylist() for c in read)) for x in f(t or "", n))
        while part := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

    return docs.select("path", "text", "body_from", *more).mapInArrow(run, schema)


def links(docs: DataFrame, flag: Column | None = None) -> DataFrame:
    """``(path, line_no, target)`` of every link in a body, and the document's flag."""
    return _per_document(docs, markup.links, "path string, line_no int, target string", (pa.string(), pa.int32(), pa.string()), flag)


def citations(docs: DataFrame) -> DataFrame:
    """``(path, line_no, cited, first, last)`` of every cited line or range; last is null for a line."""
    return _per_document(docs, markup.citations, "path string, line_no int, cited string, first int, last int", (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))


def bold_terms(docs: DataFrame) -> DataFrame:
    """``(path, line_no, term)`` of every bold span in a body."""
    return _per_document(docs, markup.bold_spans, "path string, line_no int, term string", (pa.string(), pa.int32(), pa.string()))


def heading_slugs(docs: DataFrame) -> DataFrame:
    """``(path, slug)`` of what a link can name in a document."""
    return _per_document(docs, lambda t, n: [(s,) for s in markup.heading_slugs(t, n)], "path string, slug string", (pa.string(), pa.string()))


# routes


def claims(files: DataFrame, routes: list[Route]) -> DataFrame:
    """``(path, n_routes, globs, citations, links, link_root, route_ids)``: which routes claim each file; a map over files, no join."""
    hit = [F.col("path").rlike(match_regex(r.files)) for r in routes]
    rows = F.filter(F.array(*(F.when(h, F.struct(F.lit(i).alias("id"), F.lit(r.files).alias("glob"), F.lit(r.citations).alias("c"), F.lit(r.links).alias("l"), F.lit(r.link_root).alias("lr"))) for i, (r, h) in enumerate(zip(routes, hit)))), lambda x: x.isNotNull())
    c = files.select("path", rows.alias("x"))
    return c.select("path", F.size("x").alias("n_routes"), F.col("x.glob").alias("globs"), F.exists("x", lambda x: x.c).alias("citations"), F.exists("x", lambda x: x.l).alias("links"), F.exists("x", lambda x: x.lr).alias("link_root"), F.col("x.id").alias("route_ids"))


def route_findings(files: DataFrame, routes: list[Route]) -> DataFrame:
    """Files no route claims (E0030), that two claim (E0032), or whose name breaks the only claiming route's grammar (W0041)."""
    c = claims(files, routes)
    none = finding(c.where("n_routes = 0"), "E0030", "route", "unrouted file", F.lit("no route claims this file"), F.col("path"))
    many = finding(c.where("n_routes > 1"), "E0032", "route", "conflicting routes", F.lit("several routes claim this file"), F.col("path"), quoted=[("routes", F.array_join("globs", ", "))])
    name = F.element_at(F.split("path", "/"), -1)
    out = none.unionByName(many)
    named = [(i, r.naming) for i, r in enumerate(routes) if r.naming]
    if named:
        bad = reduce(lambda a, b: a | b, ((F.col("route_ids")[0] == i) & ~name.rlike(f"^(?:{rx})$" if not rx.startswith("^") else rx) for i, rx in named))
        out = out.unionByName(finding(c.where((F.col("n_routes") == 1) & bad), "W0041", "route", "name breaks the grammar", F.lit("the file's name doesn't match its route's naming"), F.col("path"), quoted=[("name", name)]))
    return out


def _linked(files: DataFrame) -> Column:
    """Whether a file is a symbolic link, which isn't followed."""
    return F.col("state") == "link" if "state" in files.columns else F.lit(False)


def governing_findings(files: DataFrame, routes: list[Route]) -> DataFrame:
    """Routes whose governing document doesn't exist (E0031) or is a symbolic link, or behind one (E0012)."""
    spark = files.sparkSession
    want = spark.createDataFrame([(r.files, r.governed_by) for r in routes], "glob string, governed_by string")
    steps = F.split("governed_by", "/")
    at = want.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("at"))
    have = files.select(F.col("path").alias("at"), _linked(files).alias("link"))
    met = at.join(have, "at").where("link or at = governed_by").groupBy("governed_by", "glob").agg(F.max("link").alias("link"))
    quoted = [("governed_by", F.col("governed_by")), ("route", F.col("glob"))]
    gone = want.join(met, ["governed_by", "glob"], "left_anti")
    out = finding(gone, "E0031", "route", "governing document is absent", F.lit("a route names a document that doesn't exist"), F.lit("routes.yaml"), quoted=quoted)
    return out.unionByName(finding(met.where("link"), "E0012", "route", "symbolic link", F.lit("a route's governing document is a symbolic link"), F.lit("routes.yaml"), quoted=quoted))


# pins


def sections(all_lines: DataFrame) -> DataFrame:
    """Headings with the last line of their section: ``(path, line_no, level, title, last)``; the next heading of a level no deeper ends it.

    From a file's end upwards, the lowest line so far of a heading of level 1 to k, for each k: six running minima, linear in the headings.
    """
    below = W.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.array(*(F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(below) for k in range(1, 7)))
    heads = all_lines.where("level > 0").select("path", "line_no", "level", "title", F.element_at(nxt, F.col("level")).alias("nxt"))
    ends = all_lines.groupBy("path").agg(F.max("line_no").alias("n"))
    return heads.join(ends, "path").select("path", "line_no", "level", "title", F.coalesce(F.col("nxt") - 1, F.col("n")).alias("last"))


def section_text(all_lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of each span ``(path, line_no, last, ...)``, heading line included."""
    inside = all_lines.select("path", F.col("line_no").alias("k"), F.col("text").alias("t")).join(spans, "path").where("k between line_no and last")
    keys = spans.columns
    return inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x.t), "\n").alias("span_text"))


def pin_status(docs: DataFrame, pins: list[Pin] | DataFrame) -> DataFrame:
    """Each pin with the hash its file, or section, has now: ``(governing, file, section, sha256, present, section_found, actual)``.

    Pins are a list or, in any number, a table ``(pin, governing, file, section, sha256)`` with a number of its own for each.
    """
    spark = docs.sparkSession
    want = pins if isinstance(pins, DataFrame) else spark.createDataFrame([(i, p.governing, p.file, p.section, p.sha256) for i, p in enumerate(pins)], "pin int, governing string, file string, section string, sha256 string")
    have = docs.select(F.col("path").alias("file"), "text", "body_from")
    whole = want.join(have, "file", "left").withColumn("present", F.col("text").isNotNull())
    body = docs.join(want.where("section is not null").select(F.col("file").alias("path")).distinct(), "path", "left_semi").withColumn("body_from", F.lit(1))
    all_lines = lines(body)
    heading = F.regexp_extract("section", r"^(#{1,6})\s+(.*)$", 1)
    level, title = F.length(heading), F.when(heading != "", F.regexp_extract("section", r"^(#{1,6})\s+(.*)$", 2)).otherwise(F.col("section"))
    asked = want.where("section is not null").select("pin", F.col("file").alias("path"), level.alias("lv"), F.trim(title).alias("tt"))
    spans = sections(all_lines).join(asked, "path").where("title = tt and (lv = 0 or level = lv)").groupBy("pin", "path").agg(F.min(F.struct("line_no", "last")).alias("x")).select("pin", "path", "x.line_no", "x.last")
    hashed = section_text(all_lines, spans).select(F.col("pin").alias("p"), F.sha2("span_text", 256).alias("section_hash"))
    j = whole.join(hashed, F.col("pin") == F.col("p"), "left")
    actual = F.when(F.col("section").isNull(), F.sha2("text", 256)).otherwise(F.col("section_hash"))
    return j.select("governing", "file", "section", "sha256", "present", (F.col("section").isNull() | F.col("section_hash").isNotNull()).alias("section_found"), actual.alias("actual"))


def pin_findings(docs: DataFrame, pins: list[Pin] | DataFrame, tombstones: list[Tombstone] = (), refused: DataFrame | None = None) -> DataFrame:
    """Pins whose content changed (E0061), can't be read (E0062; E0012 for links, paths in ``refused``), or has no such section (E0063); lifted ones (L0001, W0042)."""
    s = pin_status(docs, pins)
    at = [("file", F.col("file")), ("governing", F.col("governing"))]
    first = []
    if refused is not None:
        links = refused.select(F.col("path").alias("file")).distinct()
        first = [finding(s.join(links, "file", "left_semi"), "E0012", "pin", "symbolic link", F.lit("a pinned file is a symbolic link"), F.lit("pins.yaml"), quoted=at)]
        s = s.join(links, "file", "left_anti")
    out = first + [
        finding(s.where("present and section_found and actual <> sha256"), "E0061", "pin", "pinned content changed", F.lit("the content no longer has the recorded hash"), F.col("file"), quoted=at),
        finding(s.where("not present"), "E0062", "pin", "pinned file is unreadable", F.lit("the pinned file is missing or can't be read"), F.lit("pins.yaml"), quoted=at),
        finding(s.where("present and not section_found"), "E0063", "pin", "pinned section is absent", F.lit("the pinned heading isn't in the file"), F.col("file"), quoted=[*at, ("section", F.col("section"))]),
    ]
    if tombstones:
        t = docs.sparkSession.createDataFrame([(x.file, x.governing, x.reason, x.owner) for x in tombstones], "file string, governing string, reason string, owner string")
        why = (F.trim("reason") != "") & (F.trim("owner") != "")
        out.append(finding(t.where(why), "L0001", "pin", "pin was lifted", F.lit("a pin was lifted, with a reason"), F.col("file"), quoted=[("reason", F.col("reason")), ("owner", F.col("owner"))]))
        out.append(finding(t.where(~why), "W0042", "pin", "pin was lifted without a reason", F.lit("a lifted pin needs a reason and an owner"), F.col("file")))
    return reduce(DataFrame.unionByName, out)


def pin_updates(docs: DataFrame, pins: list[Pin] | DataFrame) -> DataFrame:
    """What an update would record: pins whose hash differs."""
    return pin_status(docs, pins).where("present and section_found and actual <> sha256").select("governing", "file", "section", F.col("sha256").alias("recorded"), "actual")


# vocabulary


def term_status(v: Vocabulary) -> tuple[dict[str, str], list[str]]:
    """Each term's status, and the terms declared both registered and draft (which count as draft)."""
    seen: dict[str, list[str]] = {}
    for term, status, _ in v.terms:
        seen.setdefault(term, []).append(status)
    clash = [t for t, s in seen.items() if {"registered", "draft"} <= set(s)]
    return {t: "draft" if t in clash else s[0] for t, s in seen.items()}, clash


def vocabulary_findings(docs: DataFrame, v: Vocabulary, all_lines: DataFrame | None = None) -> DataFrame:
    status, clash = term_status(v)
    body = lines(docs if all_lines is None else all_lines).where("body")
    spark = docs.sparkSession
    out = [finding(spark.createDataFrame([(t,) for t in clash], "term string"), "W0044", "vocabulary", "conflicting term status", F.lit("a term is registered and draft"), F.lit("vocabulary.yaml"), quoted=[("term", F.col("term"))])]
    if status:
        bold = bold_terms(docs)
        known = spark.createDataFrame([(t,) for t in status], "term string")
        out.append(finding(bold.join(known, "term", "left_anti"), "E0090", "vocabulary", "unregistered term", F.lit("a bold term isn't in the vocabulary"), F.col("path"), F.col("line_no"), [("term", F.col("term"))]))
        reserved = [t for t, s in status.items() if s == "reserved"]
        if reserved:
            esc = lambda t: r"(?<![A-Za-z0-9_])\Q" + t + r"\E(?![A-Za-z0-9_])"
            hits = body.select("path", "line_no", F.explode(F.filter(F.array(*(F.when(F.col("text").rlike(esc(t)), F.lit(t)) for t in reserved)), lambda x: x.isNotNull())).alias("term"))
            first = hits.groupBy("path", "term").agg(F.min("line_no").alias("line_no"))
            out.append(finding(first, "E0092", "vocabulary", "reserved term", F.lit("a reserved term is used"), F.col("path"), F.col("line_no"), [("term", F.col("term"))]))
    code_free = F.regexp_replace("text", r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", " ")
    if v.labels is not None:
        fine = lambda x: reduce(lambda a, b: a | b, (x.rlike(rx) for rx in v.labels))
        odd = body.select("path", "line_no", F.explode(F.filter(X.labels(code_free), lambda x: ~fine(x))).alias("label"))
        out.append(finding(odd, "E0091", "vocabulary", "unknown label scheme", F.lit("a label fits no allowed scheme"), F.col("path"), F.col("line_no"), [("label", F.col("label"))]))
    for rx, register in v.anti_patterns:
        hits = body.select("path", "line_no", F.explode(F.regexp_extract_all(code_free, F.lit(f"({rx})"), 1)).alias("found"))
        out.append(finding(hits, "E0093", "vocabulary", "anti-pattern", F.lit("the text matches an anti-pattern"), F.col("path"), F.col("line_no"), [("match", F.col("found")), ("register", F.lit(register))]))
    for name in v.numeric:
        actual = F.coalesce(F.json_array_length(F.get_json_object("fm", f"$.{name}")), F.when(F.get_json_object("fm", f"$.{name}").rlike("^[0-9]{1,18}$"), F.get_json_object("fm", f"$.{name}").cast("long"))).cast("long")
        facts = docs.select(F.col("path").alias("p"), actual.alias("actual")).where("actual is not null")
        needle = F.when(F.contains("text", F.lit(name)), F.lit(name)).otherwise(F.lit(name.replace("_", " ")))
        said = body.select("path", "line_no", "text", X.claimed_number(F.col("text"), needle).alias("claim")).where("claim is not null")  # few lines have one
        j = said.join(facts, F.col("path") == F.col("p"))
        out.append(finding(j.where("claim <> actual"), "E0094", "vocabulary", "numeric claim drifted", F.concat(F.lit("the text says "), F.col("claim"), F.lit(", the field holds "), F.col("actual")), F.col("path"), F.col("line_no"), [("claim", F.trim("text")), ("field", F.lit(name))]))
    return reduce(DataFrame.unionByName, out)


# citations and links


def citation_findings(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Cited files that don't exist (E0100, or E0010 and E0011 where the path leaves the root), and lines that don't (E0101)."""
    c = citations(docs)
    token = F.concat("cited", F.lit(":"), F.col("first"), F.coalesce(F.concat(F.lit("-"), F.col("last")), F.lit("")))
    c = c.withColumn("token", token).withColumn("problem", X.confinement(F.col("cited"))).withColumn("target", X.normal_path(F.col("cited")))
    sized = files.select(F.col("path").alias("target"), X.line_count(F.col("text")).alias("n_lines"), F.lit(True).alias("there"), _linked(files).alias("link"))
    j = c.where("problem is null").join(sized, "target", "left")
    quoted = [("citation", F.col("token"))]
    last = F.coalesce("last", "first")
    bad = (F.col("first") == 0) | (last > F.col("n_lines")) | (F.col("first") > last)
    out = [finding(c.where(F.col("problem") == p), p, "citation", "path leaves the root", F.lit("a cited path isn't inside the root"), F.col("path"), F.col("line_no"), quoted) for p in ("E0010", "E0011")]
    out.append(finding(j.where("link"), "E0012", "citation", "symbolic link", F.lit("the cited file is a symbolic link"), F.col("path"), F.col("line_no"), quoted))
    out.append(finding(j.where("there and not link and n_lines is null"), "W0048", "citation", "cited file was not read", F.lit("only the file's existence was checked"), F.col("path"), F.col("line_no"), quoted))
    out.append(finding(j.where("there is null"), "E0100", "citation", "cited file is absent", F.lit("the cited file doesn't exist"), F.col("path"), F.col("line_no"), quoted))
    out.append(finding(j.where(F.col("n_lines").isNotNull() & bad), "E0101", "citation", "cited lines are absent", F.concat(F.lit("the file has "), F.col("n_lines"), F.lit(" lines")), F.col("path"), F.col("line_no"), quoted))
    return reduce(DataFrame.unionByName, out)


def link_findings(docs: DataFrame, files: DataFrame, link_root: Column | bool = False) -> DataFrame:
    """Links to files (E0110) or headings (E0111) that don't exist, out of the root (E0010, E0011), or to symbolic links (E0012); W0048 for a heading in a file that wasn't read."""
    from ..sources.frontmatter import documents

    l = links(docs, F.lit(link_root) if isinstance(link_root, bool) else link_root).where(~X.external(F.col("target")) & (F.col("target") != ""))
    name, frag = X.percent_decoded(X.without_fragment(F.col("target"))), X.fragment(F.col("target"))
    l = l.withColumn("frag", frag).withColumn("r", F.when(name == "", F.struct(F.col("path").alias("path"), F.lit(None).cast("string").alias("problem"))).otherwise(X.resolved(F.col("path"), name, F.col("flag"))))
    outside = F.concat(F.lit("\0"), "path")  # no place; keeps these links from meeting in one task
    l = l.select("path", "line_no", "target", "frag", F.col("r.problem").alias("problem"), F.when(F.col("r.problem").isNull(), F.col("r.path")).otherwise(outside).alias("to"))
    # each link meets its place once, and its heading once; all findings are made of that row
    parts = F.split("path", "/")
    own = F.struct(F.col("path").alias("to"), _linked(files).alias("linked"), F.col("text").isNotNull().alias("read"), (F.col("text").isNull() & ~_linked(files)).alias("unread"))
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("to"), F.lit(False).alias("linked"), F.lit(False).alias("read"), F.lit(False).alias("unread")))
    places = files.select(F.explode(F.concat(F.array(own), folders)).alias("x")).select("x.*").groupBy("to").agg(*(F.max(c).alias(c) for c in ("linked", "read", "unread")))
    slugs = heading_slugs(documents(files.where("text is not null and path like '%.md'"))).toDF("to", "frag").distinct().withColumn("met", F.lit(True))
    j = l.join(places, "to", "left").join(slugs, ["to", "frag"], "left")
    inside = F.col("problem").isNull()
    wanted = inside & F.col("frag").isNotNull() & (F.col("frag") != "") & F.col("to").like("%.md")
    cases = [
        *((F.col("problem") == p, p, "link leaves the root", "a link isn't inside the root") for p in ("E0010", "E0011")),
        (inside & F.col("linked"), "E0012", "symbolic link", "the linked file is a symbolic link"),
        (wanted & F.col("unread"), "W0048", "linked file was not read", "only the file's existence was checked"),
        (inside & F.col("linked").isNull(), "E0110", "dead link", "the linked file doesn't exist"),
        (wanted & F.col("read") & F.col("met").isNull(), "E0111", "dead anchor", "the linked heading doesn't exist"),
    ]
    made = F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(summary).alias("summary"), F.lit(said).alias("said"))) for c, code, summary, said in cases))
    rows = j.select("path", "line_no", "target", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return finding(rows, F.col("x.code"), "link", F.col("x.summary"), F.col("x.said"), F.col("path"), F.col("line_no"), [("link", F.col("target"))])


# markers, catalogs, sections


def _name(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(c), r"\.+$", ""))


def marker_findings(docs: DataFrame, files: DataFrame, routes: list[Route]) -> DataFrame | None:
    """Names captured by a marker pattern that no element of the target document, or section, has (E0112); a target that is a symbolic link is E0012.

    ``docs`` may be their :func:`lines`, here and below.
    """
    from ..sources.frontmatter import documents

    out = []
    body = lines(docs).where("body and not fenced")
    for r in routes:
        for m in r.marker_rules:
            used = body.where(F.col("path").rlike(match_regex(r.files))).select("path", "line_no", F.explode(F.regexp_extract_all("text", F.lit(m.pattern), 1)).alias("raw"))
            used = used.withColumn("name", _name(F.col("raw")))
            target = lines(documents(files.where((F.col("path") == m.target_doc) & ~_linked(files)))).where("not fenced")
            out.append(finding(files.where((F.col("path") == m.target_doc) & _linked(files)), "E0012", "marker", "symbolic link", F.lit("a marker's target document is a symbolic link"), F.lit("routes.yaml"), quoted=[("target", F.lit(m.target_doc))]))
            if m.target_section:
                s = sections(target).where(_name(F.col("title")) == m.target_section.lstrip("# ").rstrip(" .")).groupBy("path").agg(F.min(F.struct("line_no", "last")).alias("s"))
                target = target.join(s, "path").where("line_no > s.line_no and line_no <= s.last")
            element = F.col("title") if m.element == "heading" else F.col("bullet")
            have = target.where(element.isNotNull()).select(_name(element).alias("name")).distinct()
            there = files.where((F.col("path") == m.target_doc) & _linked(files)).select(F.lit(True).alias("link")).limit(1)
            used = used.join(F.broadcast(there), F.lit(True), "left_anti")
            out.append(finding(used.join(have, "name", "left_anti"), "E0112", "marker", "unknown name", F.lit("a marked name isn't in the target document"), F.col("path"), F.col("line_no"), [("name", F.col("raw")), ("target", F.lit(m.target_doc))]))
    return reduce(DataFrame.unionByName, out) if out else None


def catalog_findings(docs: DataFrame, catalogs: list[Catalog]) -> DataFrame | None:
    """Codes of a comprehensive namespace that its catalog lacks (E0113)."""
    body = lines(docs).where("body and not fenced")
    spark = docs.sparkSession
    out = []
    for c in catalogs:
        if not c.comprehensive:
            continue
        used = body.select("path", "line_no", F.explode(X.namespace_tokens(F.col("text"), c.namespace)).alias("token"))
        known = spark.createDataFrame([(x if x.startswith(c.namespace) else c.namespace + x,) for x in c.codes], "token string")
        out.append(finding(used.join(known, "token", "left_anti"), "E0113", "catalog", "orphan code", F.lit("a code isn't in its catalog"), F.col("path"), F.col("line_no"), [("code", F.col("token"))]))
    return reduce(DataFrame.unionByName, out) if out else None


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _span(all_lines: DataFrame, section: str) -> DataFrame:
    """Lines of the first section with this heading, the heading's own included."""
    mark = section.lstrip()
    level = len(mark) - len(mark.lstrip("#"))
    title = mark.lstrip("#").strip()
    s = sections(all_lines).where((F.col("title") == title) & ((F.col("level") == level) if level else F.lit(True))).groupBy("path").agg(F.min(F.struct("line_no", "last")).alias("s"))
    return all_lines.join(s, "path").where("line_no between s.line_no and s.last")


def section_findings(docs: DataFrame, routes: list[Route], all_lines: DataFrame | None = None) -> DataFrame | None:
    """Sections with a wrong number of headings (E0120), and pairs of sections that share an id (E0121)."""
    out = []
    body = lines(docs if all_lines is None else all_lines).where("body")
    for r in routes:
        mine = body.where(F.col("path").rlike(match_regex(r.files)))
        governed = docs.where(F.col("path").rlike(match_regex(r.files))).select("path")
        for s in r.section_rules:
            if s.count is not None:
                op, n = s.predicate()
                hits = _span(mine, s.section).where((F.col("level") == int(s.element[1:])) & F.col("title").rlike(s.match)).groupBy("path").agg(F.count("*").alias("n"))
                c = governed.join(hits, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                out.append(finding(c.where(~_COMPARE[op](F.col("n"), F.lit(n))), "E0120", "section", "wrong count", F.concat(F.lit("found "), F.col("n"), F.lit(f", wanted {op} {n}")), F.col("path"), quoted=[("section", F.lit(s.section))]))
            else:
                ids = []
                for side in s.disjoint:
                    span = _span(mine, side.section)
                    source = F.when(F.col("level") == 3, F.col("title")) if side.id_from == "h3-heading" else F.col("bullet")
                    ids.append(span.where(source.isNotNull()).select("path", F.regexp_extract(source, side.id_pattern if "(" in side.id_pattern else f"({side.id_pattern})", 1).alias("id")).where("id <> ''").distinct())
                both = ids[0].join(ids[1], ["path", "id"]).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))
                out.append(finding(both, "E0121", "section", "sections overlap", F.lit("two sections share an id"), F.col("path"), quoted=[("ids", F.col("ids"))]))
    return reduce(DataFrame.unionByName, out) if out else None


def slug_numbers(headings: DataFrame) -> DataFrame:
    """Slugs of ``(path, line_no, title)`` with ``-N`` on repeats within a path; a title without a slug has none."""
    s = headings.withColumn("base", X.slug(F.col("title")))
    n = F.row_number().over(W.partitionBy("path", "base").orderBy("line_no")) - 1
    return s.where("base <> ''").withColumn("slug", F.when(n > 0, F.concat("base", F.lit("-"), n)).otherwise(F.col("base")))
