"""The one shape of findings, and what is made of them: order, counts, envelope, texts, exit status."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "code string, severity string, summary string, message string, help string, file string, line int, column int, explain_ref string, "
    "quoted array<struct<label:string,content:string>>, family string"
)
VERSION = "1.0.0"
COMPACT_BYTES = 512


def severity(code: Column) -> Column:
    letter = F.substring(F.element_at(F.split(code, "-"), -1), 1, 1)
    return F.when(letter == "W", "warning").when(letter == "L", "lint").otherwise("error")


def finding(df: DataFrame, code: str | Column, family: str, summary: str | Column, message: Column, file: Column, line: Column | int = 1, quoted: list[tuple[str, Column]] | Column = (), help: str | None = None, level: str | None = None) -> DataFrame:
    """One finding for each row of ``df``."""
    if not isinstance(quoted, Column):
        quoted = F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(v.cast("string"), F.lit("null")).alias("content")) for k, v in quoted)).cast("array<struct<label:string,content:string>>")
    c = F.lit(code)
    return df.select(
        c.alias("code"), (F.lit(level) if level else severity(c)).alias("severity"), F.lit(summary).alias("summary"), message.alias("message"), F.lit(help).cast("string").alias("help"), file.cast("string").alias("file"),
        (F.lit(line) if isinstance(line, int) else line).cast("int").alias("line"), F.lit(0).alias("column"), c.alias("explain_ref"), quoted.alias("quoted"), F.lit(family).alias("family"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """By path components, code, then place and text, so that equal input gives equal order."""
    return findings.orderBy(F.split("file", "/"), "code", "line", "message", F.to_json("quoted"))


def summary(findings: DataFrame) -> DataFrame:
    """``(errors, warnings, lints)``, one row also for no finding."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("lint").alias("lints"))


def exit_status(errors: int, warnings: int, deny_warnings: bool = False, failed: bool = False) -> int:
    return 2 if failed else 1 if errors or (deny_warnings and warnings) else 0


def envelope(findings: DataFrame, files_checked: int, families: dict[str, str] | None = None) -> DataFrame:
    """One row with the whole report as JSON; for reports that are meant to be read as one document."""
    cols = [c for c in findings.columns if c != "family"]
    keyed = F.struct(F.split("file", "/").alias("p"), "code", "line", "message", F.struct(*cols).alias("f"))
    listed = findings.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x.f).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "lint")))
    body = F.struct(
        F.lit(VERSION).alias("version"), F.when(F.col("error") > 0, "findings").otherwise("clean").alias("status"),
        F.struct(F.col("error").alias("errors"), F.col("warning").alias("warnings"), F.col("lint").alias("lints"), F.lit(files_checked).alias("files_checked")).alias("summary"),
        F.from_json(F.lit(json.dumps(families or {})), "map<string,string>").alias("families"), "findings",
    )
    return listed.select(F.to_json(body).alias("report"))


_BREAKS = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


def quoted_lines(content: str) -> list[str]:
    """Adopter text, line by line behind a mark, controls escaped, so that it can't pass for the report's own."""
    return ["| " + "".join(c if c >= " " and c != "\x7f" else f"\\x{ord(c):02x}" for c in line) for line in _BREAKS.split(content)]


def text_form(row) -> str:
    out = [f"{row['severity']}[{row['code']}]: {row['summary']}", f"  --> {row['file']}:{row['line']}:{row['column']}", f"  note: {row['message']}"]
    for q in row["quoted"] or ():
        out.append(f"  {q['label']}:")
        out += ["    " + x for x in quoted_lines(q["content"])]
    if row["help"]:
        out.append(f"  help: {row['help']}")
    if row["explain_ref"]:
        out.append(f"  see: explain {row['explain_ref']}")
    return "\n".join(out)


def _cut(text: str, room: int) -> str:
    """At most ``room`` bytes, ending at a word where there is one, with a mark of the cut."""
    if len(text.encode()) <= room:
        return text
    if room < 3:
        return ""
    part = text.encode()[: room - 3].decode(errors="ignore")
    return (part.rsplit(" ", 1)[0] if " " in part else part) + "…"


def compact_form(row, limit: int = COMPACT_BYTES) -> str:
    """One finding in at most ``limit`` bytes: place and code whole, then quoted values, then prose."""
    head = _cut(f"{row['file']}:{row['line']} {row['code']}", limit)
    values = " ".join(f"{q['label']}={_BREAKS.sub(' ', q['content'])}" for q in row["quoted"] or ())
    for extra in (values, row["message"]):
        room = limit - len(head.encode()) - 1
        if extra and room > 0 and (part := _cut(extra, room)):
            head += " " + part
    return head


def report_lines(findings: DataFrame, form: str = "text") -> DataFrame:
    """``(file, line, code, report)``: each finding in its text, compact or json form, made where it is; for findings of any number."""
    if form == "json":
        cols = [c for c in findings.columns if c != "family"]
        return findings.select("file", "line", "code", F.to_json(F.struct(*cols)).alias("report"))
    make = {"text": text_form, "compact": compact_form}[form]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "line", "code")), pa.array(map(make, b.to_pylist()), pa.string())], ["file", "line", "code", "report"])

    return findings.mapInArrow(run, "file string, line int, code string, report string")


def known_refs(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings whose explain_ref is null unless the catalog (code, title) has it."""
    c = F.broadcast(catalog.select(F.col("code").alias("known")))  # a table of the engine's own codes, fixed in size
    return findings.join(c, F.col("explain_ref") == F.col("known"), "left").withColumn("explain_ref", F.col("known")).drop("known")
