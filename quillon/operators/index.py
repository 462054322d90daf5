"""Indexes: named lookups built from selected parts of source documents or tables; the last entry for a key wins."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.interpreter import EvalError
from ..plans.rules import Key


def select_path(v, path: str):
    """``$`` or ``$.a.b`` of a value; a field that an object lacks is an error, null stays null."""
    if path != "$" and not path.startswith("$."):
        raise EvalError(f"select {path!r}")
    for name in path.split(".")[1:]:
        if v is None:
            return None
        if not isinstance(v, dict) or name not in v:
            raise EvalError(f"select {path!r}: no field {name!r}")
        v = v[name]
    return v


def entries(v, key: Key) -> list[tuple[str, object]]:
    """(key, value) of a selection: one for each element of an array, or for an object itself or each of its fields (``$key``)."""
    got = select_path(v, key.select)
    if got is None:
        return []
    if isinstance(got, dict) and key.indexed_by == "$key":
        return list(got.items())
    out = []
    for x in got if isinstance(got, list) else [got]:
        k = select_path(x, key.indexed_by)
        if not isinstance(k, str):
            raise EvalError(f"index {key.name}: a key that isn't a string")
        out.append((k, x))
    return out


def load(path: str, text: str):
    """The value of a source: YAML or JSON by its name's end, or markdown's front-matter as ``{frontmatter: ...}``."""
    from ..sources import frontmatter

    if path.endswith((".yaml", ".yml")):
        v = frontmatter.load_yaml(text)
    elif path.endswith(".json"):
        v = json.loads(text)
    elif path.endswith(".md"):
        block = frontmatter.split(text)[0]
        v = {"frontmatter": frontmatter.load_yaml(block) if block is not None else None}
    else:
        raise EvalError(f"{path}: an index source is YAML, JSON or markdown")
    return frontmatter.rules_value(v)


def table_entries(sources: DataFrame, key: Key) -> DataFrame:
    """``(key, value, path, place)`` of an index's entries in sources ``(path, text)`` of any number, parsed where they are; value is JSON."""

    def run(batches):
        for b in batches:
            rows = [(k, json.dumps(x, sort_keys=True, ensure_ascii=False), p, i) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist()) for i, (k, x) in enumerate(entries(load(p, t), key))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["key", "value", "path", "place"])

    return sources.select("path", "text").mapInArrow(run, "key string, value string, path string, place int")


def registry(sources: dict[str, list[tuple[str, object]]], keys: list[Key]) -> dict[str, dict[str, object]]:
    """Indexes by name from (path, value) sources by declared source; paths in component order, later ones win; a name declared again replaces the earlier."""
    out: dict[str, dict[str, object]] = {}
    for k in keys:
        made: dict[str, object] = {}
        for _, v in sorted(sources.get(k.source, ()), key=lambda pv: pv[0].split("/")):
            made.update(entries(v, k))
        out[k.name] = made
    return out


def last_wins(rows: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """``(key, value)`` with the value that comes last in ``order`` for each key; an aggregation with map-side combine."""
    return rows.select(key.cast("string").alias("key"), value.alias("value"), order.alias("ord")).groupBy("key").agg(F.max_by("value", "ord").alias("value"))
