"""The rule language: parser, interpreter, compiler, and that the last two agree."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import rules
from quillon.plans import ast
from quillon.plans.compiler import Compiler
from quillon.plans.interpreter import EvalError, debug, evaluate, shown
from quillon.plans.parser import ParseError, parse
from quillon.plans.rules import Context, Message, Rule

SELF = {"s": "abc", "n": 3, "b": True, "z": None, "xs": ["a", "b", "a"], "ys": ["b", "c"], "o": {"k": "v", "deep": {"x": 1}}, "ms": [{"kind": "p"}, {"kind": "q"}], "e": []}


def value(text, **more):
    return evaluate(parse(text), {"self": SELF, "file": {"path": "d/f.md"}, "project": None, **more}, {"i": {"k1": {"r": ["a"]}}})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 == 1", True), ('1 == "1"', False), ("null == $self.z", True), ("$self.missing == null", True), ("$self.z.deeper == null", True), ("[1, 2] == [1, 2]", True), ("$self.o.deep.x == 1", True),
        ("true or $self.n", True), ("false and $self.n", False), ("not false and true", True), ("not (true and false) or false", True), ('"b" in $self.xs', True), ('"bc" in $self.s', True), ('"k" in $self.o', True), ('"x" in $self.z', False), ('"x" not_in $self.z', True),
        ("every(x in $self.z, false)", True), ("some(x in $self.z, true)", False), ("filter(x in $self.z, true) == []", True), ('every(x in $self.xs, x in ["a", "b"])', True), ('count(filter(m in $self.ms, m.kind == "p")) == 1', True), ("every(x in [], y)", True),
        ("count($self.xs)", 3), ("len($self.s)", 3), ("len($self.e)", 0), ('len("é😀")', 2), ("defined($self.e)", True), ("defined($self.z)", False), ("union($self.xs, $self.ys)", ["a", "b", "a", "c"]), ("union([], [1, 1])", [1]), ("intersect($self.xs, $self.ys)", ["b"]),
        ("difference($self.xs, $self.ys)", ["a", "a"]), ('concat("a", $self.s)', "aabc"), ('join($self.xs, "-")', "a-b-a"), ('join([1, true, null, "x"], ",")', "Int(1),Bool(true),Null,x"), ('key("i", "k1").r', ["a"]), ('key("i", "no")', None), ('key("no", "k1")', None), ("$project", None),
        ("$file.path", "d/f.md"), (r'"a\"b\\c\n\t"', 'a"b\\c\n\t'), ("-5", -5),
    ],
)
def test_values(text, want):
    assert value(text) == want and type(value(text)) is type(want)


@pytest.mark.parametrize("text", ["$self.n and true", "true and $self.z", "not 1", "count($self.z)", "len(3)", "count(1, 2)", "nope(1)", "$nope", "$self.s.x", "$self.xs.x", "1 in 2", '1 in "a"', 'key("i", 3)', 'concat("a", 1)', "every(x in 3, true)", "filter(x in [1], x)", "union($self.z, [])"])
def test_evaluation_errors(text):
    with pytest.raises(EvalError):
        value(text)


@pytest.mark.parametrize("text", ["", "1 ==", "1 == 2 == 3", "a in b in c", '"open', "and", "every(x, y)", "every(1 in y, z)", "(1", "[1, $self.x]", "1 2", "$self.", "99999999999999999999", r'"\q"', "a = b", "(" * 300 + "1" + ")" * 300])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_precedence():
    assert parse("a or b and not c in d") == ast.Either(ast.Var("a"), ast.Both(ast.Var("b"), ast.Not(ast.Member(ast.Var("c"), ast.Var("d"), False))))
    assert parse("a.b == c.d in e") == ast.Member(ast.Same(ast.Get(ast.Var("a"), "b"), ast.Get(ast.Var("c"), "d"), False), ast.Var("e"), False)


def test_messages_and_contexts():
    m = Message.of("has {{ $self.a }} and {{$self.a}}, {{count(x)}}")
    assert m.text == "has [see: a] and [see: a [2]], [see: count(x)]" and [k for k, _ in m.slots] == ["a", "a [2]", "count(x)"]
    assert Context.of("post") == Context("post", None) and Context.of("docs/*.md") == Context(None, "docs/*.md") and Context.of({"schema_class": "c"}) == Context("c", None)
    assert shown(["a", 1, None]) == "a, 1, null" and debug({"b": 1, "a": "x"}) == 'Object({"a": Str("x"), "b": Int(1)})'


ROWS = [(1, "abc", 3, True, ["a", "b", "a"], ["b"], ("v", 1)), (2, None, None, None, None, None, None), (3, "", 0, False, [], ["a", None], (None, None)), (4, "b", -1, True, [None, "b"], [], ("b", 3)), (5, "a", 7, None, ["c"], None, ("a", None))]
SCHEMA = "id long, s string, n long, b boolean, xs array<string>, ys array<string>, o struct<k:string,m:long>"


def random_expr(r, depth, var=None):
    scalar = ["$self.s", "$self.n", "$self.b", "$self.o.k", "$self.o.m", "$self.nope", '"a"', "3", "null", "true"] + ([var] * 3 if var else [])
    if depth == 0:
        return r.choice(["true", "false", "$self.b", "defined($self.s)", f"{r.choice(scalar)} == {r.choice(scalar)}"])
    k = r.randrange(9)
    sub = lambda: random_expr(r, depth - 1, var)
    arr = r.choice(["$self.xs", "$self.ys", '["a", "b"]', "union($self.xs, $self.ys)", "intersect($self.xs, $self.ys)", "difference($self.xs, $self.ys)"])
    match k:
        case 0:
            return f"({sub()} and {sub()})"
        case 1:
            return f"({sub()} or {sub()})"
        case 2:
            return f"not {sub()}"
        case 3:
            return f"{r.choice(scalar)} {r.choice(['==', '!='])} {r.choice(scalar)}"
        case 4:
            return f"{r.choice(['$self.s', var or '$self.o.k', 'null'])} {r.choice(['in', 'not_in'])} {arr}"
        case 5:
            return f"{r.choice(['every', 'some'])}(x{depth} in {arr}, {random_expr(r, depth - 1, f'x{depth}')})"
        case 6:
            return f"count(filter(x{depth} in {arr}, {random_expr(r, depth - 1, f'x{depth}')})) == {r.randrange(3)}"
        case 7:
            return f"len({r.choice(['$self.s', arr])}) == {r.randrange(4)}"
    return f'join({arr}, "-") == "a-b"'


def test_compiled_agrees_with_interpreter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(1)
    names = rules._names(df, F.lit("f"))
    r = random.Random(20)
    texts, cols = [], []
    while len(texts) < 150:
        t = random_expr(r, r.randrange(1, 4))
        try:
            v = Compiler(names).compile(parse(t))
        except EvalError:
            continue  # has no value on any row; the interpreter says so row by row
        texts.append(t)
        cols.append(F.struct(v.col.cast("string").alias("v"), (v.err if v.err is not None else F.lit(None).cast("string")).alias("e")).alias(f"c{len(cols)}"))
    got = {}
    for i in range(0, len(cols), 30):
        for row in df.select("id", *cols[i : i + 30]).collect():
            got.update({(row.id, k): row[f"c{k}"] for k in range(i, min(i + 30, len(cols)))})
    for row in ROWS:
        me = dict(zip(("id", "s", "n", "b", "xs", "ys"), row[:6]))
        me["o"] = None if row[6] is None else dict(zip(("k", "m"), row[6]))
        for k, t in enumerate(texts):
            x = got[row[0], k]
            try:
                want = evaluate(parse(t), {"self": me, "file": {"path": "f"}, "project": None})
            except EvalError:
                assert x.e is not None, (t, row, x)
            else:
                assert x.e is None and x.v == (None if want is None else str(want).lower() if isinstance(want, bool) else str(want)), (t, row, x, want)


def test_check_raises_or_reports(spark):
    df = spark.createDataFrame([("a", None), ("b", True)], "id string, flag boolean")
    bad = Rule.of("strict", "$self.flag and true", "m")
    with pytest.raises(Exception, match="expected bool, got null"):
        rules.check(df, [bad], "t", F.col("id")).collect()
    assert [(x.file, x.message) for x in rules.check(df, [bad], "t", F.col("id"), strict=False).collect()] == [("a", "expected bool, got null")]


def test_rules_in_one_pass_and_large_index(spark, monkeypatch):
    df = spark.createDataFrame([("a", "k1"), ("b", "k9"), ("c", None)], "id string, k string")
    index = spark.createDataFrame([("k1", "one"), ("k2", "two")], "key string, value string")
    r = Rule.of("known", 'defined(key("i", $self.k))', "{{$self.k}}")
    got = rules.evaluated(df, [r, Rule.of("never", "true")], "t", F.col("id"), {"i": index}).collect()
    assert sorted((x.file, x.rule_id, x.error is None) for x in got) == [("b", "known", True), ("c", "known", False)]
    monkeypatch.setattr(rules, "MAP_ROWS", 1)
    again = rules.evaluated(df, [r, Rule.of("never", "true")], "t", F.col("id"), {"i": index}).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sorted(tuple(x) for x in rules.lookup(df, index, F.col("k"), "v").select("id", "v").collect()) == [("a", "one"), ("b", None), ("c", None)]
