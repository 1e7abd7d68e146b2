"""Expressions to columns: a syntax tree and the types of its variables give a Value or a View."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.builtins import FUNCTIONS, METHODS
from ..operators import values as V
from ..operators import views as W
from ..operators.values import ARGUMENT, BOOL, VOID, Value, either
from ..operators.views import Path, View
from .parser import parse_expression
from .tree import Node


class Scope:
    """Variables by name; `_` and `#` inside a lambda; functions of the user."""

    def __init__(self, variables: Mapping[str, Value], functions: Mapping | None = None, methods: Mapping | None = None, strict: bool = False):
        self.variables, self.functions, self.methods, self.strict = variables, functions or {}, methods or {}, strict
        self.element: Value | None = None
        self.index: Value | Path | None = None

    def inside(self, element: Value, index: Value | Path) -> Scope:
        out = Scope(self.variables, self.functions, self.methods, self.strict)
        out.element, out.index = element, index
        return out

    def read(self, name: str) -> Value:
        if name in self.variables:
            return self.variables[name]
        if self.strict and name[:1] in "@$":
            return V.failure(VOID, V.MISSING)
        if self.strict:
            raise KeyError(f"unknown variable {name}")
        return Value(F.lit(None), VOID)


def scope_of(df: DataFrame, prefix: str = "@", **more) -> Scope:
    """The columns of a DataFrame as `@name`, and all of them as `@`."""
    return Scope(variables_of(df, prefix), **more)


def variables_of(df: DataFrame, prefix: str = "@") -> dict[str, Value]:
    out = {prefix + f.name: V.of_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    return out | {"@": V.make_dict([(f.name, out[prefix + f.name]) for f in df.schema])} if prefix == "@" else out


def constant(node: Node | None):
    """The value of a literal node, else None."""
    return node.args[0] if node is not None and node.op == "lit" else None


def folded(x: Value | View | Path) -> Value:
    return W.fold(x) if isinstance(x, View) else x.value() if isinstance(x, Path) else x


def evaluate(node: Node, scope: Scope) -> Value:
    """A whole expression: what is left of a view is folded."""
    return folded(compile_node(node, scope))


def compile_node(node: Node, scope: Scope) -> Value | View | Path:
    op, args = node.op, node.args
    one = lambda n: evaluate(n, scope)
    if op == "lit":
        return V.literal(args[0])
    if op == "ref":
        return scope.read(args[0])
    if op == "element":
        return scope.element if scope.element is not None else Value(F.lit(None), VOID)
    if op == "index":
        return scope.index if scope.index is not None else Value(F.lit(None), VOID)
    if op == "list":
        return V.make_list([one(n) for n in args[0]])
    if op == "dict":
        return V.make_dict([(k, one(n)) for k, n in args[0]])
    if op in ("and", "or"):
        return _logic(op, one(args[0]), one(args[1]))
    if op == "not":
        v = one(args[0])
        return Value(~V.truthy(v), BOOL, v.err)
    if op in ("in", "not in"):
        out = V.contains(one(args[0]), one(args[1]))
        return Value(~out.col, BOOL, out.err) if op == "not in" else out
    if op == "compare":
        return V.compare(args[0], one(args[1]), one(args[2]))
    if op == "arith":
        left, right = compile_node(args[1], scope), compile_node(args[2], scope)
        if args[0] == "+" and isinstance(left, View) and isinstance(right, View):
            return W.merge(left, right)
        return V.arithmetic(args[0], folded(left), folded(right))
    if op == "minus":
        return V.negate(one(args[0]))
    if op == "call":
        return _call(args[0], scope.functions, FUNCTIONS, [one(n) for n in args[1]], args[1])
    if op == "apply":
        return _call(args[0], scope.methods, METHODS, [one(args[1]), *(one(n) for n in args[2])], (args[1], *args[2]))
    source = compile_node(args[1] if op == "transform" else args[0], scope)
    return _navigate(op, args, source, scope)


def _logic(op: str, a: Value, b: Value) -> Value:
    """Short circuit: the right side's failure counts only where it is evaluated."""
    left, right = V.truthy(a), V.truthy(b)
    out = F.when(left, right).otherwise(F.lit(False)) if op == "and" else F.when(left, F.lit(True)).otherwise(right)
    err = b.err if b.err is None else F.when(left if op == "and" else ~left, b.err)
    return Value(out, BOOL, either(a.err, err))


def _call(name: str, own: Mapping, built_in: Mapping, values: list[Value], nodes) -> Value:
    f = built_in.get(name) or own.get(name)  # a user's function replaces no built-in one
    if f is None:
        return V.failure(V.TEXT, "NotImplementedError").with_err(either(*(v.err for v in values)))
    more = {}
    if name in built_in:
        if name == "sort_by_key":
            more = {"name": constant(nodes[1])}
        elif name == "at_or_else":
            more = {"constant": constant(nodes[1])}
        elif name == "delete" and nodes[1].op == "list":
            more = {"names": [constant(n) for n in nodes[1].args[0]]}
    try:
        return f(*values, **more)
    except TypeError as e:
        if "positional argument" in str(e):
            return V.failure(V.TEXT, ARGUMENT)
        raise


def _navigate(op: str, args: tuple, source: Value | View | Path, scope: Scope) -> Value | View:
    one = lambda n: evaluate(n, scope)
    if isinstance(source, Path):
        if op == "at" and isinstance(constant(args[1]), int):
            return source.at(constant(args[1]))
        source = source.value()
    lambda_of = lambda body: lambda v, path: evaluate(body, scope.inside(v, path))
    is_view = isinstance(source, View)
    if op in ("visit", "search", "visit all", "search all"):
        step = {"visit": lambda v: W.visit(v, args[1]), "search": lambda v: W.search(v, args[1]), "visit all": W.visit_all, "search all": W.search_all}[op]
        return W.map_records(source, lambda v, _: step(v), drop_null=True) if is_view else step(source)
    if op == "at":
        return W.at(source, one(args[1]), constant(args[1])) if is_view else W.element(source, one(args[1]), constant(args[1]))
    if op == "select all":
        return W.select_all(source)
    if op == "select":
        return W.select(source, [one(n) for n in args[1]], [constant(n) for n in args[1]])
    if op == "slice":
        begin, end = (None if n is None else one(n) for n in args[1:])
        return W.slice_view(source, begin, end, (constant(args[1]), constant(args[2])))
    if op == "query":
        test = lambda_of(args[1])
        return W.query(source, lambda v, p: (lambda r: Value(V.truthy(r), BOOL, r.err))(test(v, p)))
    if op == "project":
        return W.project(source, lambda_of(args[1]))
    if op == "expand":
        view = source if is_view else W.select_all(source)
        return W.expand(view, lambda_of(args[1]))
    if op == "transpose":
        return W.transpose(source) if is_view else V.failure(V.TEXT, ARGUMENT).with_err(source.err)
    if op == "fold":
        return W.fold(source) if is_view else V.failure(V.TEXT, ARGUMENT).with_err(source.err)
    if op == "transform":
        return _transform(args[0], source, scope)
    raise ValueError(f"unknown operator {op}")


def _transform(body: Node, source: Value | View, scope: Scope) -> Value | View:
    """`[body <- source]`: lists stay lists, dicts keep their keys, views their indices."""
    if isinstance(source, View):
        return W.map_records(source, lambda v, p: evaluate(body, scope.inside(v, p)))
    t = source.type
    if isinstance(t, T.StructType):
        return V.make_dict([(f.name, evaluate(body, scope.inside(Value(source.col[f.name], f.dataType), V.literal(f.name)))) for f in t]).with_err(source.err)
    if isinstance(t, T.MapType):
        one = lambda k, x: evaluate(body, scope.inside(Value(x, t.valueType), Value(k, V.TEXT)))
        probe = one(F.lit(None).cast("string"), F.lit(None).cast(t.valueType))
        errors = None if probe.err is None else F.get(F.filter(F.transform(F.map_entries(source.col), lambda e: one(e["key"], e["value"]).err), lambda e: e.isNotNull()), F.lit(0))
        return Value(F.transform_values(source.col, lambda k, x: one(k, x).col), T.MapType(V.TEXT, probe.type), either(source.err, errors))
    if not V.is_list(t):
        return V.failure(V.TEXT, ARGUMENT).with_err(source.err)
    one = lambda x, i: evaluate(body, scope.inside(Value(x, t.elementType), Value(i.cast("bigint"), V.LONG)))
    probe = one(F.lit(None).cast(t.elementType), F.lit(0))
    kind = probe.type if probe.type != VOID else V.TEXT
    errors = None if probe.err is None else F.get(F.filter(F.transform(source.col, lambda x, i: one(x, i).err), lambda e: e.isNotNull()), F.lit(0))
    return Value(F.transform(source.col, lambda x, i: one(x, i).col if probe.type != VOID else F.lit(None).cast("string")), T.ArrayType(kind), either(source.err, errors, V.failing(source.col.isNull(), ARGUMENT)))


def compiled(df: DataFrame, text: str, **more) -> Value:
    """An expression over the columns of a DataFrame (`@name`)."""
    return evaluate(parse_expression(text), scope_of(df, **more))


def select(df: DataFrame, keep: list[str], **expressions: str) -> DataFrame:
    """`keep` and a column for each expression; where an expression fails its column is null."""
    out: list[Column] = [F.col(k) for k in keep]
    for name, text in expressions.items():
        v = compiled(df, text)
        col = v.col.cast("string") if v.type == VOID else v.col
        out.append((F.when(v.err.isNull(), col) if v.err is not None else col).alias(name))
    return df.select(*out)
