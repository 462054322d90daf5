"""Rules, key declarations and message templates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .ast import Expr
from .parser import parse

_SLOT = re.compile(r"\{\{(.*?)\}\}", re.S)


@dataclass(frozen=True)
class Context:
    """Which documents a rule is for: a class, a path glob, or both; none of them is every document."""

    schema_class: str | None = None
    path: str | None = None

    @classmethod
    def of(cls, given: str | dict | None) -> Context:
        if given is None:
            return cls()
        if isinstance(given, dict):
            return cls(given.get("schema_class"), given.get("path"))
        return cls(path=given) if any(c in given for c in "*?/") else cls(schema_class=given)


@dataclass(frozen=True)
class Message:
    """A message with its slots taken out: text for the finding, and (label, expression) for the quoted blocks."""

    text: str
    slots: tuple[tuple[str, Expr], ...]

    @classmethod
    def of(cls, template: str) -> Message:
        slots: list[tuple[str, Expr]] = []

        def put(m: re.Match) -> str:
            source = m.group(1).strip()
            base = source.removeprefix("$self.")
            label, n = base, 2
            while any(label == have for have, _ in slots):
                label, n = f"{base} [{n}]", n + 1
            slots.append((label, parse(source)))
            return f"[see: {label}]"

        return cls(_SLOT.sub(put, template), tuple(slots))


@dataclass(frozen=True)
class Rule:
    id: str
    code: str
    test: Expr
    message: Message
    context: Context = Context()
    lets: tuple[tuple[str, Expr], ...] = ()

    @classmethod
    def of(cls, id: str, assertion: str, message: str = "", code: str = "R0001", context=None, let: dict[str, str] | None = None) -> Rule:
        return cls(id, code, parse(assertion), Message.of(message), Context.of(context), tuple((k, parse(v)) for k, v in (let or {}).items()))


@dataclass(frozen=True)
class Key:
    """An index: what ``select`` finds in the sources, by the string at ``indexed_by``."""

    name: str
    source: str
    select: str = "$"
    indexed_by: str = "$key"


@dataclass(frozen=True)
class Pattern:
    id: str
    rules: tuple[Rule, ...]
    keys: tuple[Key, ...] = ()
    description: str = ""
    phases: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, data: dict) -> Pattern:
        p = data["pattern"]
        rules = tuple(Rule.of(r["id"], r["assert"], r.get("message", ""), r.get("code", "R0001"), r.get("context"), r.get("let")) for r in p.get("rules", ()))
        keys = tuple(Key(k["name"], k["source"], k.get("select", "$"), k.get("indexed_by", "$key")) for k in p.get("keys", ()))
        return cls(p["id"], rules, keys, p.get("description", ""), tuple(p.get("phases", ())))
