"""Rule expressions to Spark columns.

An expression over typed columns becomes a value column and, only where it can fail, an error column: a string
that is null on rows without an error.  Errors follow the language's left-to-right short circuits, so an operand that
would not be reached adds none.  Types are known when compiling: comparing values of different types gives a constant, and
what can never have a value raises :class:`EvalError` at once.

``key(index, k)`` becomes a lookup in a map column that :mod:`quillon.operators.rules` puts beside the row: of the whole index, or of the keys
that :meth:`Compiler.wanted_keys` says the row may ask for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import FUNCTIONS, Both, Call, Either, Expr, Get, Lit, Member, Not, Over, Same, Var, children, walk
from .interpreter import EvalError

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTS, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    err: Column | None = None
    never_null: bool = False


def family(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, _NUMBERS):
        return "int"
    if isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "string" if isinstance(t, T.StringType) else "time"
    return "array" if isinstance(t, T.ArrayType) else "object"


def _first(*errs: Column | None) -> Column | None:
    errs = [e for e in errs if e is not None]
    return F.coalesce(*errs) if len(errs) > 1 else errs[0] if errs else None


def _when(cond: Column, err: Column | None) -> Column | None:
    return None if err is None else F.when(cond, err)


def _literal(v) -> Value:
    if v is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(v, tuple):
        items = [_literal(x) for x in v]
        kinds = {family(i.type) for i in items} - {"null"}
        if len(kinds) > 1:
            raise EvalError("an array literal of several types has no column")
        t = next((i.type for i in items if family(i.type) != "null"), T.StringType())
        return Value(F.array(*(i.col for i in items)).cast(T.ArrayType(t)), T.ArrayType(t), never_null=True)
    t = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.StringType()
    return Value(F.lit(v), t, never_null=True)


def equal(a: Value, b: Value) -> Column:
    """Deep equality; a constant, or a null test, where the types can't be equal."""
    fa, fb = family(a.type), family(b.type)
    if "null" in (fa, fb):
        return F.lit(True) if fa == fb else (b if fa == "null" else a).col.isNull()
    if fa != fb:
        return a.col.isNull() & b.col.isNull()
    if fa == "array" and family(a.type.elementType) != family(b.type.elementType):
        return (a.col.isNull() & b.col.isNull()) | (F.coalesce(F.size(a.col) == 0, F.lit(False)) & F.coalesce(F.size(b.col) == 0, F.lit(False)))
    if fa == "object" and a.type != b.type:
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    return a.col.eqNullSafe(b.col)


def _bool(v: Value) -> Value:
    """``v`` as a strict boolean: a null one is an error."""
    if family(v.type) != "bool":
        raise EvalError(f"expected bool, got {family(v.type)}")
    if v.never_null:
        return v
    missing = F.when(v.col.isNull(), F.lit("expected bool, got null"))
    return replace(v, err=_first(v.err, missing))


def _array(v: Value, null_is_empty: bool = False) -> Value:
    if family(v.type) == "null" and null_is_empty:
        return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()), v.err, True)
    if family(v.type) != "array":
        raise EvalError(f"expected array, got {family(v.type)}")
    if v.never_null:
        return v
    if null_is_empty:
        return Value(F.coalesce(v.col, F.array().cast(v.type)), v.type, v.err, True)
    return replace(v, err=_first(v.err, F.when(v.col.isNull(), F.lit("expected array, got null"))))


def _string(v: Value) -> Value:
    if family(v.type) != "string":
        raise EvalError(f"expected string, got {family(v.type)}")
    return v if v.never_null else replace(v, err=_first(v.err, F.when(v.col.isNull(), F.lit("expected string, got null"))))


def _merge(into: dict[str, Column | None], more: dict[str, Column | None]) -> None:
    """Join arrays of keys by index; None stays."""
    for name, c in more.items():
        if name not in into:
            into[name] = c
        else:
            into[name] = None if c is None or into[name] is None else F.concat(into[name], c)


class Compiler:
    def __init__(self, names: dict[str, Value], maps: dict[str, Value] | None = None):
        self.names, self.maps, self.n = names, maps or {}, 0

    def wanted_keys(self, rules) -> dict[str, Column | None]:
        """By index, the array of all keys that the rules may look up in a row; None while such a key depends on an index without a map."""
        found: dict[str, Column | None] = {}
        for r in rules:
            env, late = dict(self.names), frozenset()
            for name, e in r.lets:
                _merge(found, self._keys_of(e, env, late))
                late = late | {name} if self._late(e, late) else late - {name}
                env[name] = self.compile(e, env)
            for e in (r.test, *(x for _, x in r.message.slots)):
                _merge(found, self._keys_of(e, env, late))
        return found

    def _late(self, e: Expr, late: frozenset[str]) -> bool:
        """Whether a value depends on an index that has no map yet."""
        return any((isinstance(n, Var) and n.name in late) or (isinstance(n, Call) and n.name == "key" and n.args[0].value not in self.maps) for n in walk(e))

    def _keys_of(self, e: Expr, env: dict[str, Value], late: frozenset[str]) -> dict[str, Column | None]:
        out: dict[str, Column | None] = {}
        if isinstance(e, Over):
            _merge(out, self._keys_of(e.items, env, late))
            items = _array(self.compile(e.items, env), null_is_empty=True)
            below = late | {e.var} if self._late(e.items, late) else late - {e.var}
            of = lambda x: self._keys_of(e.test, {**env, e.var: Value(x, items.type.elementType)}, below)
            each = lambda name: F.flatten(F.transform(items.col, lambda x: of(x)[name]))
            _merge(out, {name: None if c is None else each(name) for name, c in of(F.col("probe")).items()})
            return out
        for child in children(e):
            _merge(out, self._keys_of(child, env, late))
        if isinstance(e, Call) and e.name == "key" and isinstance(e.args[0], Lit):
            _merge(out, {e.args[0].value: None if self._late(e.args[1], late) else F.array(self.compile(e.args[1], env).col.cast("string"))})
        return out

    def compile(self, e: Expr, env: dict[str, Value] | None = None) -> Value:
        env = self.names if env is None else env
        match e:
            case Lit(v):
                return _literal(v)
            case Var(name):
                if name not in env:
                    raise EvalError(f"undefined name {name}")
                return env[name]
            case Get(base, field):
                return self._get(self.compile(base, env), field)
            case Same(a, b, negated):
                x, y = self.compile(a, env), self.compile(b, env)
                c = equal(x, y)
                return Value(~c if negated else c, T.BooleanType(), _first(x.err, y.err), True)
            case Both(a, b) | Either(a, b):
                x, y = _bool(self.compile(a, env)), _bool(self.compile(b, env))
                going = F.coalesce(x.col, F.lit(False)) if isinstance(e, Both) else ~F.coalesce(x.col, F.lit(False))
                c = x.col & y.col if isinstance(e, Both) else x.col | y.col
                return Value(F.coalesce(c, F.lit(False)), T.BooleanType(), _first(x.err, _when(going, y.err)), True)
            case Not(a):
                x = _bool(self.compile(a, env))
                return Value(~F.coalesce(x.col, F.lit(False)), T.BooleanType(), x.err, True)
            case Member(a, b, negated):
                v = self._member(self.compile(a, env), self.compile(b, env))
                return replace(v, col=~v.col) if negated else v
            case Over():
                return self._over(e, env)
            case Call(name, args):
                return self._call(name, args, env)
        raise TypeError(e)

    def _get(self, base: Value, field: str) -> Value:
        match family(base.type):
            case "null":
                return base
            case "object":
                if isinstance(base.type, T.MapType):
                    return Value(F.try_element_at(base.col, F.lit(field)), base.type.valueType, base.err)
                if isinstance(base.type, T.StructType) and field in base.type.fieldNames():
                    return Value(base.col.getField(field), base.type[field].dataType, base.err)
                return Value(F.lit(None), T.NullType(), base.err)
        return Value(F.lit(None), T.NullType(), _first(base.err, F.when(base.col.isNotNull(), F.lit(f"expected object, got {family(base.type)}"))))

    def _member(self, n: Value, h: Value) -> Value:
        err = _first(n.err, h.err)
        match family(h.type):
            case "null":
                return Value(F.lit(False), T.BooleanType(), err, True)
            case "array":
                t = h.type.elementType
                c = F.exists(h.col, lambda x: equal(Value(x, t), n))
                return Value(F.coalesce(c, F.lit(False)), T.BooleanType(), err, True)
            case "string" | "object" as k:
                bad = F.when(h.col.isNotNull() & n.col.isNull(), F.lit(f"{k} haystack needs a string, got null"))
                if family(n.type) != "string":
                    always = F.when(h.col.isNotNull(), F.lit(f"{k} haystack needs a string, got {family(n.type)}"))
                    return Value(F.lit(False), T.BooleanType(), _first(err, always), True)
                if k == "string":
                    c = F.contains(h.col, n.col)
                elif isinstance(h.type, T.MapType):
                    c = F.map_contains_key(h.col, n.col)
                else:
                    c = h.col.isNotNull() & n.col.isin(h.type.fieldNames())
                return Value(F.coalesce(c, F.lit(False)), T.BooleanType(), _first(err, None if n.never_null else bad), True)
        return Value(F.lit(False), T.BooleanType(), _first(err, F.when(h.col.isNotNull(), F.lit(f"membership in {family(h.type)}"))), True)

    def _over(self, e: Over, env: dict[str, Value]) -> Value:
        items = _array(self.compile(e.items, env), null_is_empty=True)
        t = items.type.elementType
        test = lambda x: _bool(self.compile(e.test, {**env, e.var: Value(x, t)}))
        probe = test(F.col("probe"))  # what the test is like: its type, and whether it can fail
        hold = lambda x: F.coalesce(test(x).col, F.lit(False))
        err = items.err
        if probe.err is not None:
            stop = {"every": lambda x: ~hold(x), "some": hold, "filter": lambda x: F.lit(False)}[e.kind]
            seen = F.filter(F.transform(items.col, lambda x: F.struct(test(x).err.alias("e"), stop(x).alias("s"))), lambda s: s.e.isNotNull() | s.s)
            err = _first(err, F.try_element_at(seen, F.lit(1)).e)
        if e.kind == "filter":
            return Value(F.filter(items.col, hold), items.type, err, True)
        return Value((F.forall if e.kind == "every" else F.exists)(items.col, hold), T.BooleanType(), err, True)

    def _call(self, name: str, args, env) -> Value:
        if name not in FUNCTIONS:
            raise EvalError(f"unknown function {name}")
        if len(args) != FUNCTIONS[name]:
            raise EvalError(f"{name} takes {FUNCTIONS[name]} arguments, got {len(args)}")
        if name == "key":
            return self._key(args, env)
        v = [self.compile(a, env) for a in args]
        match name:
            case "count":
                a = _array(v[0])
                return Value(F.size(a.col).cast("long"), T.LongType(), a.err, a.never_null)
            case "len":
                if family(v[0].type) == "string":
                    s = _string(v[0])
                    return Value(F.length(s.col).cast("long"), T.LongType(), s.err, s.never_null)
                a = _array(v[0])
                return Value(F.size(a.col).cast("long"), T.LongType(), a.err, a.never_null)
            case "defined":
                return Value(v[0].col.isNotNull() if family(v[0].type) != "null" else F.lit(False), T.BooleanType(), v[0].err, True)
            case "concat":
                a, b = _string(v[0]), _string(v[1])
                return Value(F.concat(a.col, b.col), T.StringType(), _first(a.err, b.err), a.never_null and b.never_null)
            case "join":
                a, s = _array(v[0]), _string(v[1])
                t = a.type.elementType
                parts = F.transform(a.col, lambda x: _debug(Value(x, t)))
                return Value(F.call_function("array_join", parts, s.col), T.StringType(), _first(a.err, s.err), a.never_null and s.never_null)
        a, b = _array(v[0]), _array(v[1])
        err, ta, tb = _first(a.err, b.err), a.type.elementType, b.type.elementType
        among = lambda x, tx, ys, ty: F.exists(ys, lambda y: equal(Value(x, tx), Value(y, ty)))
        if name == "union":
            if family(ta) != family(tb):
                raise EvalError("union of arrays of different types has no column")
            new = F.filter(F.array_distinct(b.col), lambda x: ~among(x, tb, a.col, ta))
            return Value(F.concat(a.col, new), a.type, err, a.never_null and b.never_null)
        inside = lambda x: among(x, ta, b.col, tb)
        return Value(F.filter(a.col, inside if name == "intersect" else lambda x: ~inside(x)), a.type, err, a.never_null and b.never_null)

    def _key(self, args, env) -> Value:
        if not isinstance(args[0], Lit) or not isinstance(args[0].value, str):
            raise EvalError("a table rule names its index by a literal")
        k = self.compile(args[1], env)
        if family(k.type) == "int":
            raise EvalError("expected string, got int")
        k = _string(k)
        m = self.maps.get(args[0].value)
        if m is None:
            return Value(F.lit(None), T.NullType(), k.err)
        return Value(F.try_element_at(m.col, k.col), m.type.valueType, k.err)


def _debug(v: Value) -> Column:
    match family(v.type):
        case "string":
            return F.coalesce(v.col, F.lit("Null"))
        case "int":
            return F.coalesce(F.concat(F.lit("Int("), v.col.cast("string"), F.lit(")")), F.lit("Null"))
        case "bool":
            return F.coalesce(F.concat(F.lit("Bool("), v.col.cast("string"), F.lit(")")), F.lit("Null"))
        case "null":
            return F.lit("Null")
    return F.coalesce(F.to_json(v.col), F.lit("Null"))


def shown(v: Value) -> Column:
    """A value as a message's quoted block shows it."""
    match family(v.type):
        case "null":
            return F.lit("null")
        case "array":
            t = v.type.elementType
            return F.coalesce(F.array_join(F.transform(v.col, lambda x: shown(Value(x, t))), ", "), F.lit("null"))
        case "object":
            return F.coalesce(F.to_json(v.col), F.lit("null"))
    return F.coalesce(v.col.cast("string"), F.lit("null"))
