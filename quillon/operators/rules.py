"""Rules over a DataFrame: each row is ``$self``; a row fails a rule unless its test is true."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import match_regex
from ..plans.ast import Call, Lit, walk
from ..plans.compiler import Compiler, Value, _first, family, shown
from ..plans.interpreter import EvalError
from ..plans.rules import Rule
from ..streaming.incremental import checkpointed

#: Rows of an index that are put beside every row as one map; of a larger one each row gets the entries it asks for.
MAP_ROWS = 50_000


def _names(df: DataFrame, file: Column) -> dict[str, Value]:
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return {"self": Value(row, df.schema, never_null=True), "file": Value(F.struct(file.alias("path")), T.StructType([T.StructField("path", T.StringType())]), never_null=True), "project": Value(F.lit(None), T.NullType())}


def used_indexes(rules: list[Rule]) -> set[str]:
    return {n.args[0].value for r in rules for e in (r.test, *(x for _, x in r.lets), *(x for _, x in r.message.slots)) for n in walk(e) if isinstance(n, Call) and n.name == "key" and n.args and isinstance(n.args[0], Lit)}


def _with_maps(df: DataFrame, rules: list[Rule], indexes: dict[str, DataFrame], file: Column) -> tuple[DataFrame, dict[str, Value], Column]:
    """``df`` with a map column for each index that the rules use, and ``file`` for it; ``indexes`` are (key string, value) tables with distinct keys.

    A small index is one map beside all rows.  Of a larger one each row has the entries of the keys it can ask for: these are exploded, joined
    with the index, and collected for the row again.  A key that is itself looked up waits for the index it comes from.
    """
    maps: dict[str, Value] = {}
    used = used_indexes(rules) & indexes.keys()
    large = {}
    for name in sorted(used):
        table = indexes[name].select(F.col("key").cast("string"), "value")
        if table.limit(MAP_ROWS + 1).count() > MAP_ROWS:
            large[name] = table
            continue
        c = f"index_{name}"
        one = table.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(c))
        df = df.crossJoin(F.broadcast(one))
        maps[name] = Value(F.col(c), T.MapType(T.StringType(), table.schema["value"].dataType), never_null=True)
    if large:
        names = df.columns
        df = checkpointed(df.withColumn("index_file", file).withColumn("index_row", F.monotonically_increasing_id()))
        file = F.col("index_file")
        todo = dict(large)
        while todo:
            compiler = Compiler(_names(df.select(*(f"`{c}`" for c in names)), file), maps)
            asks = {name: keys for name, keys in compiler.wanted_keys(rules).items() if name in todo}
            ready = {name: keys for name, keys in asks.items() if keys is not None}
            if not ready:
                raise EvalError(f"index {sorted(todo)[0]} is looked up by its own values")
            for name, keys in sorted(ready.items()):
                table, c = todo.pop(name), f"index_{name}"
                asked = df.select("index_row", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
                got = asked.join(table, "key").groupBy("index_row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(c))
                df = df.join(got, "index_row", "left")
                kind = T.MapType(T.StringType(), table.schema["value"].dataType)
                maps[name] = Value(F.coalesce(F.col(c), F.create_map().cast(kind)), kind, never_null=True)
    return df, maps, file


def lookup(df: DataFrame, index: DataFrame, key: Column, into: str) -> DataFrame:
    """``df`` with the index's value for ``key`` in the column ``into``: the keyed lookup as a left join, for an index of any size."""
    found = index.select(F.col("key").cast("string").alias("lookup_key"), F.col("value").alias(into))
    return df.join(found, key.cast("string") == F.col("lookup_key"), "left").drop("lookup_key")


def unresolved(df: DataFrame, index: DataFrame, key: Column) -> DataFrame:
    """Rows of ``df`` whose ``key`` no entry of the index has: a reference that leads nowhere; for an index of any size."""
    return df.join(index.select(F.col("key").alias("lookup_key")), key == F.col("lookup_key"), "left_anti")


def applies(rule: Rule, schema_class: Column, path: Column) -> Column:
    c = F.lit(True)
    if rule.context.schema_class is not None:
        c &= schema_class.eqNullSafe(F.lit(rule.context.schema_class))
    if rule.context.path is not None:
        try:
            c &= path.rlike(match_regex(rule.context.path))
        except ValueError:
            c = F.lit(False)
    return c


def evaluated(df: DataFrame, rules: list[Rule], schema_class: Column | str, file: Column, indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(rule_id, code, file, message, quoted, error)`` of every row that fails, or can't be judged by, a rule; one pass for all rules."""
    cls = F.lit(schema_class) if isinstance(schema_class, str) else schema_class
    columns = df.columns
    wide, maps, file = _with_maps(df, rules, indexes or {}, file)
    compiler = Compiler(_names(wide.select(*(f"`{c}`" for c in columns)), file), maps)
    made = []
    for r in rules:
        env = dict(compiler.names)
        err = None
        for name, e in r.lets:
            env[name] = compiler.compile(e, env)
            err = _first(err, env[name].err)
        test = compiler.compile(r.test, env)
        err = _first(err, test.err)
        ok = F.coalesce(test.col, F.lit(False)) if family(test.type) == "bool" else F.lit(False)
        bad = applies(r, cls, file) & (~ok if err is None else (err.isNotNull() | ~ok))
        slots = [(label, compiler.compile(e, env)) for label, e in r.message.slots]
        quoted = F.array(*(F.struct(F.lit(k).alias("label"), shown(v).alias("content")) for k, v in slots)).cast("array<struct<label:string,content:string>>")
        made.append(F.when(bad, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.code).alias("code"), F.lit(r.message.text).alias("message"), quoted.alias("quoted"), (F.lit(None).cast("string") if err is None else err).alias("error"))))
    hit = wide.select(file.cast("string").alias("file"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return hit.select("x.rule_id", "x.code", "file", "x.message", "x.quoted", "x.error")


def check(df: DataFrame, rules: list[Rule], schema_class: Column | str, file: Column, indexes: dict[str, DataFrame] | None = None, strict: bool = True) -> DataFrame:
    """Findings of all rules.  An evaluation error stops the job with its text, or with ``strict=False`` is a finding like any other."""
    e = evaluated(df, rules, schema_class, file, indexes)
    message = F.coalesce(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("rule_id"), F.lit(": "), F.col("error")))) if strict else F.col("error"), F.col("message"))
    return e.select(
        "code", F.lit("error").alias("severity"), F.col("rule_id").alias("summary"), message.alias("message"), F.lit(None).cast("string").alias("help"), "file", F.lit(1).alias("line"), F.lit(0).alias("column"), F.col("code").alias("explain_ref"), "quoted", F.lit("rules").alias("family")
    )


def union(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)
