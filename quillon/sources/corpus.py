"""A corpus of files as a DataFrame: listing, confinement, capture limits, decoding."""

from __future__ import annotations

import os
import re
import stat
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import walk_regex
from ..operators.findings import finding

FILE_BYTES, TOTAL_BYTES, DEPTH, ENTRIES = 8 << 20, 64 << 20, 64, 100_000


class BoundExceeded(ValueError):
    """The input is beyond a limit that the run was given."""


class ConfinementError(ValueError):
    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def confined(path: str) -> str:
    """A relative path inside the root, decided by its text alone."""
    if path.startswith("/"):
        raise ConfinementError("E0010", path)
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ConfinementError("E0011", path)
    return "/".join(parts)


def open_no_follow(root: str, path: str) -> bytes:
    """A regular file's bytes, refusing a symbolic link anywhere on the way (E0012)."""
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        parts = confined(path).split("/")
        for i, p in enumerate(parts):
            last = i == len(parts) - 1
            mode = os.stat(p, dir_fd=at, follow_symlinks=False).st_mode
            if stat.S_ISLNK(mode):
                raise ConfinementError("E0012", path)
            if last and not stat.S_ISREG(mode):
                raise OSError(f"{path} is not a regular file")
            new = os.open(p, os.O_RDONLY | os.O_NOFOLLOW | (0 if last else os.O_DIRECTORY), dir_fd=at)
            os.close(at)
            at = new
        with os.fdopen(os.dup(at), "rb") as f:
            return f.read()
    finally:
        os.close(at)


def walk(root: str, pattern: str) -> list[str]:
    """Files under ``root`` that match a glob, sorted by component; links aren't followed; depth and entries are bounded."""
    want = re.compile(walk_regex(confined(pattern)))
    out, seen, todo = [], 0, [("", 0)]
    while todo:
        folder, depth = todo.pop()
        if depth > DEPTH:
            raise OSError(f"{folder} is nested too deeply")
        with os.scandir(os.path.join(root, folder)) as it:
            for e in it:
                seen += 1
                if seen > ENTRIES:
                    raise OSError(f"more than {ENTRIES} entries")
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    todo.append((rel, depth + 1))
                elif e.is_file(follow_symlinks=False) and want.match(rel):
                    out.append(rel)
    return sorted(out, key=lambda p: PurePosixPath(p).parts)


def links(root: str) -> list[str]:
    """Paths of the symbolic links under a local root, which are never read or walked through; other file systems have none."""
    if not os.path.isdir(root):
        return []
    out, todo = [], [""]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as it:
            for e in it:
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink():
                    out.append(rel)
                elif e.is_dir(follow_symlinks=False):
                    todo.append(rel)
    return sorted(out)


def _around(root: str, refused: list[str]) -> list[str]:
    """Folders and files that together are everything under ``root`` but the links, so that nothing lists what lies behind one."""
    if not refused:
        return [""]
    above = {str(q) for p in refused for q in PurePosixPath(p).parents}
    out, todo = [], ["."]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as it:
            for e in it:
                rel = str(PurePosixPath(folder) / e.name)
                if not e.is_symlink():
                    (todo if rel in above else out).append(rel)
    return sorted(out)


def captured(raw: DataFrame, refused: list[str] = ()) -> DataFrame:
    """``(path, size, state, text)`` of ``(path, size, content)``: state is ok, too_large, not_utf8, or link.

    What lies behind a link of ``refused`` is one file, the link itself, without a text.
    """
    state = F.when(F.col("size") > FILE_BYTES, "too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8").otherwise("ok")
    files = raw.select("path", "size", state.alias("state"), F.when(state == "ok", F.col("content").cast("string")).alias("text"))
    if not refused:
        return files
    spark = raw.sparkSession
    gone = spark.createDataFrame([(x,) for x in refused], "link string")
    inside = F.expr("path = link or startswith(path, concat(link, '/'))")
    named = gone.select(F.col("link").alias("path"), F.lit(0).cast("long").alias("size"), F.lit("link").alias("state"), F.lit(None).cast("string").alias("text"))
    return files.join(F.broadcast(gone), inside, "left_anti").unionByName(named)  # the links of one project, walked on the driver


def read_files(spark: SparkSession, root: str, globs: list[str] | None = None) -> DataFrame:
    """:func:`captured` files under ``root``, read by the executors."""
    refused = links(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([re.sub(r"([{}\[\]*?\\])", r"\\\1", os.path.join(root, p)) for p in _around(root, refused)])
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z0-9]+:(//[^/]*)?", ""), F.concat(F.lit("^\\Q"), base, F.lit("\\E")), F.lit(""))
    files = raw.select(rel.alias("path"), F.col("length").alias("size"), "content")
    if globs:
        wanted = F.lit(False)
        for g in globs:
            wanted |= F.col("path").rlike(walk_regex(g))
        files = files.where(wanted)
    return captured(files, refused if not globs else [p for p in refused if any(re.match(walk_regex(g), p) for g in globs)])


def unreadable(files: DataFrame) -> DataFrame:
    """Files that can't be read (E0003), and links in their place (E0012)."""
    bad = finding(files.where("state not in ('ok', 'link')"), "E0003", "corpus", "file can't be read", F.concat(F.lit("state: "), F.col("state")), F.col("path"))
    return bad.unionByName(finding(files.where("state = 'link'"), "E0012", "corpus", "symbolic link", F.lit("a file is a symbolic link, which isn't followed"), F.col("path"), quoted=[("component", F.col("path"))]))


def within_budget(files: DataFrame, governed: Column, limit: int = TOTAL_BYTES) -> DataFrame:
    """``files`` within ``limit`` bytes in all: too many of the governed ones stop the run; of the others, in order of paths, those beyond it are too_large.

    The limit is an option: a corpus of any size can be checked without it.
    """
    own, all_ = files.where("text is not null").agg(F.coalesce(F.sum(F.when(governed, F.col("size"))), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if own > limit:
        raise BoundExceeded(f"the governed files have {own} bytes; the limit is {limit}")
    if all_ <= limit:
        return files
    upto = F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))  # of paths and sizes only
    late = files.where(~governed & F.col("text").isNotNull()).select("path", "size").withColumn("upto", upto).where(F.col("upto") > limit - own).select("path", F.lit(True).alias("late"))
    j = files.join(late, "path", "left")
    return j.select("path", "size", F.when(F.col("late"), "too_large").otherwise(F.col("state")).alias("state"), F.when(F.col("late").isNull(), F.col("text")).alias("text"))


def dead_globs(files: DataFrame, globs: list[str]) -> DataFrame:
    """Globs that match no file, by the dialect that chooses files (W0046)."""
    hits = files.agg(*(F.count_if(F.col("path").rlike(walk_regex(g))).alias(f"g{i}") for i, g in enumerate(globs)))
    rows = hits.select(F.explode(F.array(*(F.struct(F.lit(g).alias("glob"), F.col(f"g{i}").alias("n")) for i, g in enumerate(globs)))).alias("x")).where("x.n = 0")
    return finding(rows, "W0046", "corpus", "glob matches nothing", F.lit("no file matches this glob"), F.lit("config.yaml"), quoted=[("glob", F.col("x.glob"))])
