"""Incremental runs: which documents a change can reach, and checks of tables as they arrive.

``closure`` finds what is connected with some start, round by round; each round is written to the folder in
``spark.checkpoint.dir`` by ``checkpoint()``, so that a lost executor costs a re-read and not the rounds before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Call, Lit, walk
from ..plans.rules import Pattern


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage; uses the session's checkpoint folder, and sets one only in a local session without."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def shared_key_edges(rows: DataFrame, key: str, node: str) -> DataFrame:
    """``(a, b)``: each node with the lowest node that has the same key; connects the same nodes as all pairs, with a row for each node only."""
    low = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(low, key).where(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))


def governance_edges(claimed: DataFrame) -> DataFrame:
    """``(a, b)`` of each file and its governing document, from ``(path, governed_by)``."""
    return claimed.where("path <> governed_by").select(F.col("path").alias("a"), F.col("governed_by").alias("b")).distinct()


def indexes_of(pattern: Pattern) -> dict[str, set[str] | None]:
    """Index names each rule reads, messages included; None where a name is computed, which means all of them."""
    out: dict[str, set[str] | None] = {}
    for r in pattern.rules:
        calls = [n for e in (r.test, *(x for _, x in r.lets), *(x for _, x in r.message.slots)) for n in walk(e) if isinstance(n, Call) and n.name == "key"]
        out[r.id] = None if any(not isinstance(c.args[0], Lit) for c in calls) else {c.args[0].value for c in calls}
    return out


def rule_edges(context_files: DataFrame, sources: DataFrame) -> DataFrame:
    """``(a, b)`` of the files a rule is for ``(rule, path)`` and the sources of the indexes it reads ``(rule, source)``."""
    return context_files.join(sources, "rule").where("path <> source").select(F.col("path").alias("a"), F.col("source").alias("b")).distinct()


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node)``: everything connected with ``start`` (column node) by undirected edges (a, b)."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = frontier = checkpointed(start.select("node").distinct())
    while not frontier.isEmpty():
        found = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(found.join(seen, "node", "left_anti"))
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def scoped(files: DataFrame, scope: DataFrame, column: str = "path") -> DataFrame:
    """The files (or rows) of a scope (column node): what a scoped run checks."""
    return files.join(scope.select(F.col("node").alias(column)).distinct(), column, "left_semi")


def in_scope(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """The findings located in the scope's files (column node)."""
    return findings.join(scope.select(F.col("node").cast("string").alias("file")).distinct(), "file", "left_semi").select(findings.columns)


def check_stream(arriving: DataFrame, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run a check on every micro-batch of a streaming DataFrame and append its findings, as Parquet, to ``sink``; starts the query."""

    def batch(df: DataFrame, epoch: int) -> None:
        check(df).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # a repeated epoch replaces itself

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
