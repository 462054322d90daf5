"""Evaluation of rule expressions over Python values.

Documents whose front-matter has no common shape are checked with this, in Arrow batches; tables with a schema
are checked with :mod:`compiler`.  Values are None, bool, int, str, list and dict.
"""

from __future__ import annotations

from collections.abc import Mapping

from .ast import FUNCTIONS, Both, Call, Either, Expr, Get, Lit, Member, Not, Over, Same, Var


class EvalError(ValueError):
    """An expression that has no value: wrong type, unknown name, wrong number of arguments."""


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, (list, tuple)) else "object"


def same(a, b) -> bool:
    """Deep equality without coercion; null equals null."""
    if kind(a) != kind(b):
        return False
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def member(needle, hay) -> bool:
    match kind(hay):
        case "array":
            return any(same(needle, x) for x in hay)
        case "null":
            return False
        case "string" | "object" as k:
            if not isinstance(needle, str):
                raise EvalError(f"{k} haystack needs a string, got {kind(needle)}")
            return needle in hay
        case k:
            raise EvalError(f"membership in {k}")


def debug(v) -> str:
    """How ``join`` shows what isn't a string."""
    match kind(v):
        case "null":
            return "Null"
        case "bool":
            return f"Bool({str(v).lower()})"
        case "int":
            return f"Int({v})"
        case "string":
            return 'Str("' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '")'
        case "array":
            return "Array([" + ", ".join(map(debug, v)) + "])"
    return "Object({" + ", ".join(f'"{k}": {debug(v[k])}' for k in sorted(v)) + "})"


def shown(v) -> str:
    """How a message shows a value."""
    match kind(v):
        case "null":
            return "null"
        case "bool":
            return str(v).lower()
        case "array":
            return ", ".join(map(shown, v))
        case "object":
            return debug(v)
    return str(v)


def _want(v, what: str):
    if kind(v) != what:
        raise EvalError(f"expected {what}, got {kind(v)}")
    return v


def evaluate(e: Expr, env: Mapping[str, object], indexes: Mapping[str, Mapping[str, object]] | None = None):
    """The value of ``e``; ``env`` maps names (self, file, project, bindings) to values."""
    go = lambda x: evaluate(x, env, indexes)
    match e:
        case Lit(v):
            return list(v) if isinstance(v, tuple) else v
        case Var(name):
            if name not in env:
                raise EvalError(f"undefined name {name}")
            return env[name]
        case Get(base, field):
            v = go(base)
            if v is None:
                return None
            return _want(v, "object").get(field)
        case Same(a, b, negated):
            return same(go(a), go(b)) != negated
        case Both(a, b):
            return _want(go(a), "bool") and _want(go(b), "bool")
        case Either(a, b):
            return _want(go(a), "bool") or _want(go(b), "bool")
        case Not(a):
            return not _want(go(a), "bool")
        case Member(a, b, negated):
            n, h = go(a), go(b)
            return member(n, h) != negated
        case Over(how, var, items, test):
            xs = go(items)
            xs = [] if xs is None else _want(xs, "array")
            hold = lambda x: _want(evaluate(test, {**env, var: x}, indexes), "bool")
            return all(map(hold, xs)) if how == "every" else any(map(hold, xs)) if how == "some" else [x for x in xs if hold(x)]
        case Call(name, args):
            return _call(name, args, go, indexes)
    raise TypeError(e)


def _call(name: str, args, go, indexes):
    if name not in FUNCTIONS:
        raise EvalError(f"unknown function {name}")
    if len(args) != FUNCTIONS[name]:
        raise EvalError(f"{name} takes {FUNCTIONS[name]} arguments, got {len(args)}")
    v = [go(a) for a in args]
    match name:
        case "count":
            return len(_want(v[0], "array"))
        case "len":
            if kind(v[0]) not in ("string", "array"):
                raise EvalError(f"len of {kind(v[0])}")
            return len(v[0])
        case "defined":
            return v[0] is not None
        case "concat":
            return _want(v[0], "string") + _want(v[1], "string")
        case "join":
            return _want(v[1], "string").join(x if isinstance(x, str) else debug(x) for x in _want(v[0], "array"))
        case "key":
            _want(v[0], "string"), _want(v[1], "string")
            if indexes is None:
                raise EvalError("no index registry")
            return indexes.get(v[0], {}).get(v[1])
    a, b = _want(v[0], "array"), _want(v[1], "array")
    if name == "union":
        out = list(a)
        for x in b:
            if not member(x, out):
                out.append(x)
        return out
    return [x for x in a if member(x, b) == (name == "intersect")]
