"""JSON Schema as predicates: the keywords that have a column become columns, all violations of a row at once.

``violations`` works on typed columns; documents, whose front-matter has any shape, use ``errors`` on values, in
Arrow batches, which knows ``$ref``, combinators and nesting too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.interpreter import same
from .findings import finding

KNOWN = {
    "$schema", "$id", "$defs", "$ref", "$comment", "title", "description", "default", "examples", "type", "enum", "const", "properties", "required", "additionalProperties", "unevaluatedProperties", "patternProperties",
    "minProperties", "maxProperties", "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "contains", "pattern", "minLength", "maxLength", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "definitions",
}
#: What a table's schema, and a column's, may have to become columns; a schema with anything else is judged row by row.
_TABLE = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "type", "properties", "required", "additionalProperties"}
_COLUMN = {"$comment", "title", "description", "default", "examples", "type", "enum", "const", "pattern", "minLength", "maxLength", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems"}
_FORMATS = {"date": r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$", "date-time": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$", "email": r"^[^@\s]+@[^@\s]+$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$", "uuid": r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"}


def unknown_keywords(schema) -> list[str]:
    """Keywords that aren't implemented; a schema with any is refused when it is loaded."""
    out: list[str] = []

    def visit(s, names: bool) -> None:
        if isinstance(s, dict):
            for k, v in s.items():
                if not names and k not in KNOWN:
                    out.append(k)
                if names or k not in ("enum", "const", "default", "examples"):
                    visit(v, not names and k in ("properties", "patternProperties", "$defs", "definitions"))
        elif isinstance(s, list):
            for x in s:
                visit(x, False)

    visit(schema, False)
    return sorted(set(out))


def _type_is(v, t: str) -> bool:
    match t:
        case "null":
            return v is None
        case "boolean":
            return isinstance(v, bool)
        case "integer":
            return (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer())
        case "number":
            return isinstance(v, (int, float)) and not isinstance(v, bool)
        case "string":
            return isinstance(v, str)
        case "array":
            return isinstance(v, list)
    return isinstance(v, dict)


def _plain(part: str) -> str:
    """One step of a JSON pointer without its escapes."""
    return re.sub("~[01]", lambda m: "~/"[int(m[0][1])], part)


def _target(schema: dict, root):
    at = root
    for part in schema["$ref"].removeprefix("#").strip("/").split("/") if schema["$ref"] != "#" else ():
        at = at[_plain(part)]
    return at


def _extra(x, name: str, word: str, schema: dict, root, here: str):
    """What ``word`` says of a property that nothing else does."""
    if schema.get(word) is False:
        yield here, word, f"{name} isn't allowed"
    elif isinstance(schema.get(word), dict):
        yield from errors(x, schema[word], root, here)


def evaluated(v: dict, schema, root, own: bool = True) -> set[str]:
    """The properties of an object that a schema, or one that it applies to the same object and that fits, speaks of."""
    if not isinstance(schema, dict):
        return set()
    out = {k for k in v if k in schema.get("properties", {}) or any(re.search(p, k) for p in schema.get("patternProperties", {}))}
    if "additionalProperties" in schema or (not own and "unevaluatedProperties" in schema):
        out = set(v)
    fits = lambda s: next(errors(v, s, root), None) is None
    inner = [*schema.get("allOf", ()), *(s for w in ("anyOf", "oneOf") for s in schema.get(w, ()) if fits(s))]
    if "$ref" in schema:
        inner.append(_target(schema, root))
    if "if" in schema:
        inner += [schema["if"], schema.get("then", True)] if fits(schema["if"]) else [schema.get("else", True)]
    for s in inner:
        out |= evaluated(v, s, root, False)
    return out


def errors(v, schema, root=None, at: str = "") -> Iterator[tuple[str, str, str]]:
    """(pointer, keyword, what is wrong) of every violation."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return
    if schema is False:
        yield at, "false", "nothing is allowed here"
        return
    if "$ref" in schema:
        yield from errors(v, _target(schema, root), root, at)
    ok = lambda s: next(errors(v, s, root, at), None) is None
    if (t := schema.get("type")) is not None and not any(_type_is(v, x) for x in ([t] if isinstance(t, str) else t)):
        yield at, "type", f"expected {t if isinstance(t, str) else ' or '.join(t)}"
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        yield at, "enum", "not one of " + json.dumps(schema["enum"], ensure_ascii=False)
    if "const" in schema and not same(v, schema["const"]):
        yield at, "const", "not " + json.dumps(schema["const"], ensure_ascii=False)
    if isinstance(v, str):
        if len(v) < schema.get("minLength", 0):
            yield at, "minLength", f"shorter than {schema['minLength']}"
        if len(v) > schema.get("maxLength", len(v)):
            yield at, "maxLength", f"longer than {schema['maxLength']}"
        if "pattern" in schema and not re.search(schema["pattern"], v):
            yield at, "pattern", f"doesn't match {schema['pattern']}"
        if schema.get("format") in _FORMATS and not re.match(_FORMATS[schema["format"]], v):
            yield at, "format", f"not a {schema['format']}"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        for k, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b), ("multipleOf", lambda a, b: a % b != 0)):
            if k in schema and bad(v, schema[k]):
                yield at, k, f"{k} is {schema[k]}"
    if isinstance(v, list):
        if len(v) < schema.get("minItems", 0):
            yield at, "minItems", f"fewer than {schema['minItems']}"
        if len(v) > schema.get("maxItems", len(v)):
            yield at, "maxItems", f"more than {schema['maxItems']}"
        if schema.get("uniqueItems") and any(same(v[i], v[j]) for i in range(len(v)) for j in range(i)):
            yield at, "uniqueItems", "items repeat"
        first = schema.get("prefixItems", [])
        for i, x in enumerate(v):
            s = first[i] if i < len(first) else schema.get("items", True)
            yield from errors(x, s, root, f"{at}/{i}")
        if "contains" in schema and not any(next(errors(x, schema["contains"], root, at), None) is None for x in v):
            yield at, "contains", "no item is as wanted"
    if isinstance(v, dict):
        for k in schema.get("required", ()):
            if k not in v:
                yield at, "required", f"{k} is missing"
        if len(v) < schema.get("minProperties", 0):
            yield at, "minProperties", f"fewer than {schema['minProperties']}"
        if len(v) > schema.get("maxProperties", len(v)):
            yield at, "maxProperties", f"more than {schema['maxProperties']}"
        known = schema.get("properties", {})
        for k, x in v.items():
            here = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
            matched = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            for s in ([known[k]] if k in known else []) + matched:
                yield from errors(x, s, root, here)
            if k not in known and not matched:
                yield from _extra(x, k, "additionalProperties", schema, root, here)
        if "unevaluatedProperties" in schema:
            seen = evaluated(v, schema, root)
            for k, x in v.items():
                if k not in seen:
                    yield from _extra(x, k, "unevaluatedProperties", schema, root, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    for s in schema.get("allOf", ()):
        yield from errors(v, s, root, at)
    if "anyOf" in schema and not any(map(ok, schema["anyOf"])):
        yield at, "anyOf", "no alternative fits"
    if "oneOf" in schema and sum(map(ok, schema["oneOf"])) != 1:
        yield at, "oneOf", "not exactly one alternative fits"
    if "not" in schema and ok(schema["not"]):
        yield at, "not", "fits what is excluded"
    if "if" in schema:
        branch = schema.get("then" if ok(schema["if"]) else "else")
        if branch is not None:
            yield from errors(v, branch, root, at)


def _column(c: Column, t: T.DataType, s: dict, at: str) -> list[Column]:
    """Violations of one column, each null on rows without it."""
    out = []

    def bad(keyword: str, wrong: Column, message: str) -> None:
        out.append(F.when(c.isNotNull() & wrong, F.struct(F.lit(at).alias("pointer"), F.lit(keyword).alias("keyword"), F.lit(message).alias("problem"))))

    if "enum" in s:
        bad("enum", ~c.isin([x for x in s["enum"] if x is not None]), "not one of " + json.dumps(s["enum"], ensure_ascii=False))
    if "const" in s:
        bad("const", c != F.lit(s["const"]), "not " + json.dumps(s["const"], ensure_ascii=False))
    if isinstance(t, T.StringType):
        if "minLength" in s:
            bad("minLength", F.length(c) < s["minLength"], f"shorter than {s['minLength']}")
        if "maxLength" in s:
            bad("maxLength", F.length(c) > s["maxLength"], f"longer than {s['maxLength']}")
        if "pattern" in s:
            bad("pattern", ~c.rlike(s["pattern"]), f"doesn't match {s['pattern']}")
        if s.get("format") in _FORMATS:
            bad("format", ~c.rlike(_FORMATS[s["format"]]), f"not a {s['format']}")
    elif isinstance(t, T.NumericType):
        for k, wrong in (("minimum", lambda a: c < a), ("maximum", lambda a: c > a), ("exclusiveMinimum", lambda a: c <= a), ("exclusiveMaximum", lambda a: c >= a)):
            if k in s:
                bad(k, wrong(s[k]), f"{k} is {s[k]}")
    elif isinstance(t, T.ArrayType):
        if "minItems" in s:
            bad("minItems", F.size(c) < s["minItems"], f"fewer than {s['minItems']}")
        if "maxItems" in s:
            bad("maxItems", F.size(c) > s["maxItems"], f"more than {s['maxItems']}")
    want = s.get("type")
    fits = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}
    if isinstance(want, str) and want in fits and not isinstance(t, fits[want]):
        bad("type", F.lit(True), f"expected {want}")
    return out


def violations(df: DataFrame, schema: dict) -> Column:
    """All violations of a row as an array of (pointer, keyword, problem); a null column counts as absent."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [F.when(F.col(k).isNull() if k in types else F.lit(True), F.struct(F.lit("").alias("pointer"), F.lit("required").alias("keyword"), F.lit(f"{k} is missing").alias("problem"))) for k in schema.get("required", ())]
    for k, s in schema.get("properties", {}).items():
        if k in types:
            out += _column(F.col(k), types[k], s, f"/{k}")
    if schema.get("additionalProperties") is False:
        out += [F.when(F.col(k).isNotNull(), F.struct(F.lit(f"/{k}").alias("pointer"), F.lit("additionalProperties").alias("keyword"), F.lit(f"{k} isn't allowed").alias("problem"))) for k in types if k not in schema.get("properties", {})]
    return F.filter(F.array(*out).cast("array<struct<pointer:string,keyword:string,problem:string>>"), lambda x: x.isNotNull())


def has_columns(schema) -> bool:
    """Whether :func:`violations` knows everything in a table's schema."""
    inner = schema.get("properties", {}).values() if isinstance(schema, dict) else ()
    fine = lambda s: isinstance(s, dict) and s.keys() <= _COLUMN and isinstance(s.get("type", ""), str)
    return isinstance(schema, dict) and schema.keys() <= _TABLE and schema.get("type", "object") == "object" and isinstance(schema.get("additionalProperties", True), bool) and all(map(fine, inner))


def row_violations(df: DataFrame, schema: dict, file: Column) -> DataFrame:
    """``(file, v)`` as :func:`violations` gives them, for a schema of any keywords: rows as objects, without their nulls, in Arrow batches."""

    def run(batches):
        for b in batches:
            out = [(f, p, k, m) for f, x in zip(b.column("file").to_pylist(), b.column("row").to_pylist()) for p, k, m in errors(json.loads(x), schema)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out)) or [()] * 4)], ["file", "pointer", "keyword", "problem"])

    made = df.select(file.cast("string").alias("file"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row")).mapInArrow(run, "file string, pointer string, keyword string, problem string")
    return made.select("file", F.struct("pointer", "keyword", "problem").alias("v"))


def table_findings(df: DataFrame, schema: dict, file: Column) -> DataFrame:
    """Violations of a table's rows (E0050): columns where the schema allows it, else row by row; a keyword that isn't known is refused."""
    if bad := unknown_keywords(schema):
        raise ValueError(f"{', '.join(bad)} isn't supported")
    rows = df.select(file.cast("string").alias("file"), F.explode(violations(df, schema)).alias("v")) if has_columns(schema) else row_violations(df, schema, file)
    return finding(rows, "E0050", "schema", "schema violation", F.concat("v.keyword", F.lit(": "), "v.problem"), F.col("file"), quoted=[("pointer", F.col("v.pointer"))])


def _line_of(block: str, pointer: str, keyword: str, first: int) -> int:
    """Line of the node at a pointer; 1 where it can't be found."""
    import yaml

    try:
        node = yaml.compose(block, yaml.SafeLoader)
    except yaml.YAMLError:
        return 1
    line = None
    for part in map(_plain, pointer.split("/")[1:]):
        if isinstance(node, yaml.MappingNode):
            pair = next(((k, v) for k, v in node.value if k.value == part), None)
            if pair is None:
                return 1
            line, node = (pair[0] if keyword.endswith("Properties") else pair[1]).start_mark.line, pair[1]
        elif isinstance(node, yaml.SequenceNode) and part.isdigit() and int(part) < len(node.value):
            node = node.value[int(part)]
            line = node.start_mark.line
        else:
            return 1
    return 1 if line is None else first + line


def document_findings(docs: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Violations of each document's class schema, at the line of the offending node (E0050)."""

    def run(batches):
        from ..sources.frontmatter import split

        for b in batches:
            out = []
            for path, text, fm, cls in zip(*(b.column(c).to_pylist() for c in ("path", "text", "fm", "schema_class"))):
                if fm is None or cls not in schemas:
                    continue
                block = split(text)[0]
                out += [(path, _line_of(block, p, k, 2), p, k, m) for p, k, m in errors(json.loads(fm), schemas[cls])]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["path", "line", "pointer", "keyword", "problem"])

    rows = docs.select("path", "text", "fm", "schema_class").where("fm is not null").mapInArrow(run, "path string, line int, pointer string, keyword string, problem string")
    return finding(rows, "E0050", "schema", "schema violation", F.concat("keyword", F.lit(": "), "problem"), F.col("path"), F.col("line"), [("pointer", F.col("pointer"))])
