"""Syntax trees of the rule language."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """A node; the subclasses are all there are."""


@dataclass(frozen=True)
class Lit(Expr):
    value: object  # None, bool, int, str, or a tuple of such


@dataclass(frozen=True)
class Var(Expr):
    name: str
    sigil: bool = False  # written with a dollar sign


@dataclass(frozen=True)
class Get(Expr):
    base: Expr
    field: str


@dataclass(frozen=True)
class Same(Expr):
    left: Expr
    right: Expr
    negated: bool


@dataclass(frozen=True)
class Both(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Either(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Member(Expr):
    needle: Expr
    hay: Expr
    negated: bool


@dataclass(frozen=True)
class Over(Expr):
    kind: str  # every, some, filter
    var: str
    items: Expr
    test: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Get(b, _):
            return (b,)
        case Same(a, b, _) | Both(a, b) | Either(a, b) | Member(a, b, _):
            return (a, b)
        case Not(a):
            return (a,)
        case Over(_, _, c, p):
            return (c, p)
        case Call(_, args):
            return args
    return ()


def walk(e: Expr):
    yield e
    for c in children(e):
        yield from walk(c)


#: name -> number of arguments
FUNCTIONS = {"count": 1, "len": 1, "defined": 1, "union": 2, "intersect": 2, "difference": 2, "concat": 2, "join": 2, "key": 2}
