"""Front-matter: the fence split, and YAML with the core scalars only.

Dates stay strings, booleans are ``true`` and ``false``, a repeated key is an error, nesting and aliases are bounded.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_ALIASES = 256, 100
PIECE = 256  # rows of an Arrow batch that are Python objects at a time


class _Loader(yaml.SafeLoader):
    """YAML's core scalars instead of PyYAML's."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _rx, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_rx), [c if c != "\0" else "" for c in _first])


def _int(loader, node) -> int:
    s = node.value
    return int(s, 0) if s.startswith("0x") or s.startswith("0o") else int(s)


def _map(loader, node, deep=False):
    out = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if not isinstance(key, str):
            continue  # only string keys are fields
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key!r}", k.start_mark)
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:map", _map)


def _deep(text: str) -> bool:
    depth = most = 0
    for c in text:
        depth += (c in "[{") - (c in "]}" and depth > 0)
        most = max(most, depth)
    return most > MAX_DEPTH


def load_yaml(text: str):
    if _deep(text):
        raise yaml.YAMLError("flow nesting is too deep")
    if len(re.findall(r"(?:^|[\s,\[])\*[\w-]+", text)) > MAX_ALIASES:
        raise yaml.YAMLError("too many aliases")
    return yaml.load(text, _Loader)  # noqa: S506 - a safe loader


def split(text: str) -> tuple[str | None, str, int]:
    """(front-matter, body, first line of the body); no front-matter is None, an empty block is ``{}``."""
    source = text.removeprefix("﻿")
    m = re.match(r"---\r?\n", source)
    if not m:
        return None, source, 1
    at = m.end()
    for line in re.finditer(r"^---\r?(?:\n|\Z)", source[at:], re.M):
        block, body = source[at : at + line.start()], source[at + line.end() :]
        return block if block.strip() else "{}", body, source[: at + line.end()].count("\n") + 1
    return None, source, 1


def rules_value(v):
    """What a rule sees of a YAML value: floats, and integers beyond 64 bits, are null."""
    if isinstance(v, dict):
        return {k: rules_value(x) for k, x in v.items()}
    if isinstance(v, list):
        return [rules_value(x) for x in v]
    if isinstance(v, float) or (isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63):
        return None
    return v


_HEAD = r"(?s)\A\uFEFF?---\r?\n(?:.*?\n)??---\r?(?:\n|\z)"  # all that split() looks at of a text with front-matter, and nothing of others


_ENTRY = re.compile(r"([A-Za-z_][A-Za-z0-9_]{0,99}): ([A-Za-z0-9_]+(?:[ ./-][A-Za-z0-9_]+)*)\n")


def _scalar(s: str):
    """The string, null, boolean or integer that YAML reads in a plain word; ValueError for what is left to it."""
    for tag, rx in _Loader.yaml_implicit_resolvers.get(s[0], ()):
        if rx.match(s):
            kind = tag.rsplit(":", 1)[1]
            if kind == "float" or len(s) > 18:
                raise ValueError
            return None if kind == "null" else s.lower() == "true" if kind == "bool" else int(s, 0) if s[:2] in ("0x", "0o") else int(s)
    return s


def _entries(block: str) -> dict | None:
    """What YAML makes of a block that is nothing but lines ``name: plain words``; None for any other, a name twice included."""
    out, at = {}, 0
    try:
        while at < len(block):
            m = _ENTRY.match(block, at)
            if not m or m[1] in out or not isinstance(_scalar(m[1]), str):
                return None
            out[m[1]], at = _scalar(m[2]), m.end()
    except ValueError:
        return None
    return out or None


def parsed(block: str) -> tuple[str | None, str | None, str | None]:
    """(JSON, error, schema_class) of a front-matter block."""
    return _kept(block) if len(block) <= 1000 else _parsed(block)


def _parsed(block: str) -> tuple[str | None, str | None, str | None]:
    fm = error = cls = None
    try:
        if (v := _entries(block)) is None:
            v = load_yaml(block)
        v = {} if v is None else v
        if not isinstance(v, dict):
            raise yaml.YAMLError("front-matter is not a mapping")
        fm, cls = json.dumps(v, ensure_ascii=False, sort_keys=True), v.get("schema_class")
        cls = cls if isinstance(cls, str) else None
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        error = str(e).split("\n")[0]
    return fm, error, cls


_kept = functools.lru_cache(2048)(_parsed)  # blocks of a corpus are often alike; at most some MB


def _judged(heads: pa.Array) -> pa.Array:
    out = [parsed(block) if (block := split(t or "")[0]) is not None else (None, None, None) for at in range(0, len(heads), PIECE) for t in heads.slice(at, PIECE).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] or [pa.array([], pa.string())] * 3, ["fm", "fm_error", "schema_class"])


def documents(files: DataFrame) -> DataFrame:
    """``(path, text, fm, fm_error, body_from, schema_class)`` of files ``(path, text)``; fm is JSON.

    Python gets the front-matter alone, and only where one of its columns is used: the body's first line is a column expression.
    The function counts as non-deterministic so that no filter on what it finds runs it twice.
    """
    head = F.regexp_extract(F.coalesce("text", F.lit("")), _HEAD, 0)
    start = (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("int")
    judge = F.arrow_udf(_judged, "fm string, fm_error string, schema_class string").asNondeterministic()
    return files.select("path", "text", start.alias("body_from"), judge(head).alias("x")).select("path", "text", "x.fm", "x.fm_error", "body_from", "x.schema_class")


def problems(docs: DataFrame, globs: list[str]) -> DataFrame:
    """Front-matter that can't be read (E0001) or, in files of ``globs``, is missing (W0040); the documents are read once for both."""
    from ..functions.globs import match_regex
    from ..operators.findings import finding

    wanted = F.lit(False)
    for g in globs:
        wanted |= F.col("path").rlike(match_regex(g))
    bad = F.col("fm_error").isNotNull()
    either = lambda x, y: F.when(bad, F.lit(x)).otherwise(F.lit(y))
    quoted = F.filter(F.array(F.struct(F.lit("error").alias("label"), F.col("fm_error").alias("content"))), lambda q: q.content.isNotNull())
    message = either("the YAML block doesn't parse", "this document needs a front-matter block")
    return finding(docs.where(bad | (F.col("fm").isNull() & wanted)), either("E0001", "W0040"), "frontmatter", either("front-matter can't be read", "front-matter is missing"), message, F.col("path"), quoted=quoted)
