"""Configuration files: strict readers of routes, pins, vocabulary, code catalogs, patterns, schemas."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from ..plans.rules import Pattern
from .corpus import confined
from .frontmatter import load_yaml

FORMAT = 1


class ConfigError(ValueError):
    pass


def _strict(cls, data: dict, where: str, **convert):
    names = {f.name for f in fields(cls)}
    unknown = sorted(set(data) - names)
    if unknown:
        raise ConfigError(f"{where}: unknown field {', '.join(unknown)}")
    try:
        return cls(**{k: convert[k](v) if k in convert else v for k, v in data.items()})
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from None


def _regex(text: str, where: str) -> str:
    if re.search(r"\(\?[=!<]|\\[1-9]", text):
        raise ConfigError(f"{where}: look-around and back-references aren't supported")
    try:
        re.compile(text)
    except re.error as e:
        raise ConfigError(f"{where}: {e}") from None
    return text


@dataclass(frozen=True)
class MarkerRule:
    pattern: str
    element: str
    target_doc: str
    target_section: str | None = None


@dataclass(frozen=True)
class Side:
    section: str
    id_from: str
    id_pattern: str


@dataclass(frozen=True)
class SectionRule:
    """A count (``section``, ``element``, ``match``, ``count``) or two disjoint sides."""

    section: str | None = None
    element: str | None = None
    match: str | None = None
    count: str | None = None
    disjoint: tuple[Side, ...] = ()

    def predicate(self) -> tuple[str, int]:
        m = re.fullmatch(r"\s*(==|!=|<=|>=|<|>)\s*(\d+)\s*", self.count or "")
        if not m:
            raise ConfigError(f"count {self.count!r}")
        return m[1], int(m[2])


@dataclass(frozen=True)
class Route:
    files: str
    governed_by: str
    naming: str | None = None
    citations: bool = False
    links: bool = False
    link_root: bool = False
    marker_rules: tuple[MarkerRule, ...] = ()
    section_rules: tuple[SectionRule, ...] = ()


@dataclass(frozen=True)
class Pin:
    governing: str
    file: str
    sha256: str
    section: str | None = None


@dataclass(frozen=True)
class Tombstone:
    file: str
    governing: str
    reason: str = ""
    owner: str = ""


@dataclass(frozen=True)
class Vocabulary:
    terms: tuple[tuple[str, str, str], ...] = ()  # term, status, sense
    labels: tuple[str, ...] | None = None  # allowed label patterns; None switches the check off
    anti_patterns: tuple[tuple[str, str], ...] = ()  # pattern, register
    numeric: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    namespace: str
    comprehensive: bool
    codes: tuple[str, ...] = field(default_factory=tuple)


DEFAULT_LABELS = (r"^(?:RFC|ISO|CVE|GH|PR)-?[0-9]+$", r"^[A-Z]+-[0-9]+$", r"^H[1-6]$", r"^[A-Z][0-9]{1,4}$", r"^[A-Z]{2,5}[0-9]{1,4}$")


def read_yaml(path: str) -> dict | None:
    """The mapping in a file; None if there is none."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        v = load_yaml(f.read())
    if v is None:
        return {}
    if not isinstance(v, dict):
        raise ConfigError(f"{path}: not a mapping")
    return v


def _version(data: dict, where: str, required: bool) -> None:
    v = data.pop("version", None)
    if v is None and required:
        raise ConfigError(f"{where}: version is required")
    if v is not None and v != FORMAT:
        raise ConfigError(f"{where}: version {v} isn't supported")


def _only(data: dict, names: set[str], where: str) -> None:
    if extra := sorted(set(data) - names):
        raise ConfigError(f"{where}: unknown field {', '.join(extra)}")


def routes(data: dict) -> list[Route]:
    data = dict(data)
    _version(data, "routes", False)
    _only(data, {"routes"}, "routes")
    side = lambda d: _strict(Side, d, "disjoint", id_pattern=lambda p: _regex(p, "id_pattern"))
    section = lambda d: _strict(SectionRule, d, "section_rules", disjoint=lambda x: tuple(map(side, x)), match=lambda p: _regex(p, "match"))
    marker = lambda d: _strict(MarkerRule, d, "marker_rules", pattern=lambda p: _regex(p, "pattern"), target_doc=confined)
    out = [_strict(Route, r, "routes", governed_by=confined, naming=lambda p: _regex(p, "naming"), marker_rules=lambda x: tuple(map(marker, x)), section_rules=lambda x: tuple(map(section, x))) for r in data.get("routes", ())]
    for r in out:
        if r.link_root and not r.links:
            raise ConfigError("link_root needs links")
        for s in r.section_rules:
            if s.count is not None:
                s.predicate()
            elif len(s.disjoint) != 2:
                raise ConfigError("a section rule counts, or names two disjoint sides")
    return out


def pins(data: dict) -> tuple[list[Pin], list[Tombstone]]:
    data = dict(data)
    _version(data, "pins", False)
    _only(data, {"pins", "unpinned"}, "pins")
    return [_strict(Pin, p, "pins", file=confined) for p in data.get("pins", ())], [_strict(Tombstone, p, "unpinned") for p in data.get("unpinned", ())]


def vocabulary(data: dict) -> Vocabulary:
    data = dict(data)
    _version(data, "vocabulary", False)
    _only(data, {"terms", "label_schemes", "anti_patterns", "numeric_claims"}, "vocabulary")
    terms = tuple((t["term"], t["status"], t.get("sense", "")) for t in data.get("terms", ()))
    if bad := [s for _, s, _ in terms if s not in ("registered", "draft", "reserved")]:
        raise ConfigError(f"vocabulary: status {bad[0]}")
    schemes = data.get("label_schemes")
    labels = None if schemes is None else (*DEFAULT_LABELS, *(_regex(x, "allow") for x in schemes.get("allow", ())))
    return Vocabulary(terms, labels, tuple((_regex(a["pattern"], "anti_patterns"), a.get("register", "")) for a in data.get("anti_patterns", ())), tuple(n["field"] for n in data.get("numeric_claims", ())))


def catalogs(data: dict) -> list[Catalog]:
    data = dict(data)
    _version(data, "catalogs", True)
    _only(data, {"catalogs"}, "catalogs")
    return [_strict(Catalog, c, "catalogs", codes=tuple) for c in data.get("catalogs", ())]


def patterns(folder: str) -> list[Pattern]:
    names = sorted(n for n in os.listdir(folder) if n.endswith((".yaml", ".yml"))) if os.path.isdir(folder) else []
    return [Pattern.of(read_yaml(os.path.join(folder, n))) for n in names]


def schemas(folder: str) -> dict[str, dict]:
    names = sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
    out = {}
    for n in names:
        with open(os.path.join(folder, n), encoding="utf-8") as f:
            out[n.removesuffix(".json").removesuffix(".schema")] = json.load(f)
    return out
