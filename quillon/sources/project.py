"""Project files that the engine writes: the deployed skeleton with its manifest, and renewed pins.  Driver-side, like all configuration."""

from __future__ import annotations

import hashlib
import os
import tempfile

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import finding
from . import corpus
from .config import ConfigError, read_yaml

MANIFEST = "manifest.yaml"
SKELETON = {
    "config.yaml": "file_globs: ['docs/**/*.md']\nrequire_frontmatter: []\n",
    "schemas/note.json": '{"required": ["title"], "properties": {"title": {"minLength": 1}}}\n',
    "patterns/example.yaml": "version: 1\npattern:\n  id: example\n  rules: []\n",
}


def write_atomic(path: str, data: bytes) -> None:
    """The whole of ``data`` or the file as it was: written beside it, then renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".new-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read_manifest(folder: str) -> tuple[dict[str, str], dict[str, dict]]:
    """(path -> recorded hash of managed files, path -> tombstone of files taken over by the project)."""
    m = read_yaml(os.path.join(folder, MANIFEST)) or {}
    if m and m.get("version") != 1:
        raise ConfigError(f"{MANIFEST}: version {m.get('version')} isn't supported")
    return {e["path"]: e["sha256"] for e in m.get("managed", ())}, {e["path"]: e for e in m.get("demoted", ())}


def init(root: str, folder: str, skeleton: dict[str, str] | None = None) -> list[str]:
    """Deploy the skeleton; returns the paths written.  Files that were edited, and demoted ones, are left as they are."""
    at, wrote = os.path.join(root, folder), []
    managed, demoted = read_manifest(at)
    for path, text in (SKELETON if skeleton is None else skeleton).items():
        corpus.confined(path)
        full = os.path.join(at, path)
        if path in demoted:
            continue
        if os.path.exists(full):
            with open(full, "rb") as f:
                now = sha256(f.read())
            if now != managed.get(path) or now == sha256(text.encode()):
                managed.setdefault(path, sha256(text.encode()))
                continue
        write_atomic(full, text.encode())
        managed[path] = sha256(text.encode())
        wrote.append(path)
    body = {"version": 1, "managed": [{"path": p, "sha256": h} for p, h in sorted(managed.items())], "demoted": [demoted[p] for p in sorted(demoted)]}
    write_atomic(os.path.join(at, MANIFEST), yaml.safe_dump(body, sort_keys=False).encode())
    return wrote


def drift(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Managed files that are gone or no longer have the recorded hash (E0060)."""
    at = os.path.join(root, folder)
    managed, demoted = read_manifest(at)
    rows = []
    for path, want in sorted(managed.items()):
        if path in demoted:
            continue
        full = os.path.join(at, corpus.confined(path))
        now = None
        if os.path.isfile(full):
            with open(full, "rb") as f:
                now = sha256(f.read())
        if now != want:
            rows.append((f"{folder}/{path}", want, now))
    df = spark.createDataFrame(rows, "path string, recorded string, actual string")
    return finding(df, "E0060", "manifest", "deployed file was changed", F.lit("the file no longer has its recorded hash"), F.col("path"), quoted=[("recorded", F.col("recorded")), ("actual", F.col("actual"))])


def renew_pins(folder: str, updates: DataFrame, dry_run: bool = False) -> list[tuple]:
    """Record the present hashes of stale pins in pins.yaml; returns (governing, file, section, recorded, actual) of each, written or not."""
    rows = sorted((tuple(r) for r in updates.collect()), key=repr)  # one row for each stale pin of a configuration file
    if rows and not dry_run:
        path = os.path.join(folder, "pins.yaml")
        data = read_yaml(path)
        new = {(g, f, s): a for g, f, s, _, a in rows}
        for p in data["pins"]:
            p["sha256"] = new.get((p["governing"], corpus.confined(p["file"]), p.get("section")), p["sha256"])
        write_atomic(path, yaml.safe_dump(data, sort_keys=False, allow_unicode=True).encode())
    return rows
