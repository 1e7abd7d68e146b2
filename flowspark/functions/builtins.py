"""Built-in functions and methods of expressions, each a composition of Spark's own functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.values import ARGUMENT, BOOL, BOUNDS, DOUBLE, LONG, TEXT, VARIANT, VOID, Value, cast_to, common, either, equal, failing, failure, is_dict, is_list, is_number, let, numeric, union

FUNCTIONS: dict[str, Callable[..., Value]] = {}
METHODS: dict[str, Callable[..., Value]] = {}


def function(name: str):
    return lambda f: FUNCTIONS.setdefault(name, f)


def method(name: str):
    return lambda f: METHODS.setdefault(name, f)


def _errors(*values: Value) -> Column | None:
    return either(*(v.err for v in values))


def _needs(v: Value, test: bool) -> Value | None:
    """A failure if a value is of the wrong kind."""
    return None if test else failure(TEXT, ARGUMENT).with_err(v.err)


def _number(v: Value, op: Callable[[Column], Column]) -> Value:
    v = numeric(v)
    if not is_number(v.type):
        return failure(DOUBLE, ARGUMENT).with_err(v.err)
    return Value(v.col if v.type == LONG else op(v.col).cast(LONG), LONG, either(v.err, failing(v.col.isNull(), ARGUMENT)))


@function("round")
def round_(v: Value) -> Value:
    """Half away from zero."""
    return _number(v, lambda c: F.round(c, 0))


@function("ceil")
def ceil(v: Value) -> Value:
    return _number(v, F.ceil)


@function("floor")
def floor(v: Value) -> Value:
    return _number(v, F.floor)


@function("substr")
def substr(s: Value, low: Value, high: Value) -> Value:
    """From `low` to before `high`, counted from 0; outside the text it fails."""
    inside = F.coalesce((low.col >= 0) & (low.col <= high.col) & (high.col <= F.length(s.col)), F.lit(False))
    return Value(F.substring(s.col, (low.col + 1).cast("int"), (high.col - low.col).cast("int")), TEXT, either(_errors(s, low, high), failing(~inside, BOUNDS)))


@method("length")
def length(v: Value) -> Value:
    if v.type == TEXT:
        return Value(F.length(v.col).cast(LONG), LONG, either(v.err, failing(v.col.isNull(), ARGUMENT)))
    if isinstance(v.type, T.StructType):
        return Value(F.lit(len(v.type)).cast(LONG), LONG, v.err)
    if is_list(v.type) or is_dict(v.type):
        return Value(F.size(v.col).cast(LONG), LONG, either(v.err, failing(v.col.isNull(), ARGUMENT)))
    return failure(LONG, ARGUMENT).with_err(v.err)


def _whole_list(v: Value, numbers: bool) -> Column | None:
    """Whether a list has elements, and none that is null; None if its kind rules that out."""
    if not is_list(v.type) or not (is_number(v.type.elementType) or not numbers and v.type.elementType == TEXT):
        return None
    return (F.size(v.col) > 0) & ~F.exists(v.col, lambda x: x.isNull())


def _aggregate(v: Value, op: Callable[[Column], Column], numbers: bool) -> Value:
    guard = _whole_list(v, numbers)
    if guard is None:
        return Value(F.lit(None), VOID, v.err) if is_list(v.type) else failure(DOUBLE, ARGUMENT).with_err(v.err)
    return Value(F.when(guard, op(v.col)), v.type.elementType, either(v.err, failing(v.col.isNull(), ARGUMENT)))


@method("max")
def max_(v: Value) -> Value:
    """Of all numbers or all texts; null if the list is empty or has anything else."""
    return _aggregate(v, F.array_max, False)


@method("min")
def min_(v: Value) -> Value:
    return _aggregate(v, F.array_min, False)


@method("sum")
def sum_(v: Value) -> Value:
    if not is_list(v.type) or not is_number(v.type.elementType):
        return _aggregate(v, lambda c: c, True)
    kind = LONG if isinstance(v.type.elementType, T.IntegralType) else DOUBLE
    wide = Value(v.col.cast(T.ArrayType(kind)), T.ArrayType(kind), v.err)
    return _aggregate(wide, lambda c: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x), True)


def _set(test: Callable[[Column, Callable[[Column], Column]], Column]):
    def run(a: Value, b: Value) -> Value:
        if not (is_list(a.type) and is_list(b.type)):
            return failure(BOOL, ARGUMENT).with_err(_errors(a, b))
        there = lambda x: F.exists(b.col, lambda y: equal(Value(y, b.type.elementType), Value(x, a.type.elementType)))
        return Value(F.coalesce(test(a.col, there), F.lit(False)), BOOL, either(_errors(a, b), failing(a.col.isNull() | b.col.isNull(), ARGUMENT)))

    return run


METHODS["subsetof"] = _set(lambda a, there: F.forall(a, there))
METHODS["anyof"] = _set(lambda a, there: F.exists(a, there))
METHODS["noneof"] = _set(lambda a, there: ~F.exists(a, there))


@function("parse_json")
def parse_json(s: Value) -> Value:
    """An object's text as a dynamic value; anything else fails."""
    out = F.try_parse_json(s.col)
    return Value(out, VARIANT, either(s.err, failing(out.isNull() | ~F.coalesce(F.schema_of_variant(out).startswith("OBJECT"), F.lit(False)), ARGUMENT)))


@function("split")
@method("split_by")
def split(s: Value, pattern: Value) -> Value:
    """By a regular expression; empty texts at the end go, but a text that is empty stays."""
    parts = F.split(s.col, pattern.col)
    kept = let(parts, lambda p: F.slice(p, F.lit(1), F.aggregate(F.transform(p, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))))
    return Value(F.when(s.col == "", F.array(F.lit(""))).otherwise(kept), T.ArrayType(TEXT), either(_errors(s, pattern), failing(s.col.isNull(), ARGUMENT)))


@function("mk_string")
def mk_string(v: Value, separator: Value) -> Value:
    if not is_list(v.type):
        return failure(TEXT, ARGUMENT).with_err(_errors(v, separator))
    return Value(F.call_function("array_join", v.col.cast("array<string>"), separator.col, F.lit("null")), TEXT, either(_errors(v, separator), failing(v.col.isNull(), ARGUMENT)))


@method("distinct")
def distinct(v: Value) -> Value:
    """In the order of first occurrence."""
    return _needs(v, is_list(v.type)) or Value(F.array_distinct(v.col), v.type, v.err)


@method("flatten")
def flatten(v: Value) -> Value:
    return _needs(v, is_list(v.type) and is_list(v.type.elementType)) or Value(F.flatten(v.col), v.type.elementType, either(v.err, failing(F.exists(v.col, lambda x: x.isNull()), ARGUMENT)))


FUNCTIONS["flatten"] = flatten


@method("zip")
def zip_(a: Value, b: Value) -> Value:
    """Two equally long lists of dicts, element by element merged; the right keys win."""
    if not (is_list(a.type) and is_list(b.type) and isinstance(a.type.elementType, T.StructType) and isinstance(b.type.elementType, T.StructType)):
        return failure(TEXT, ARGUMENT).with_err(_errors(a, b))
    left, right = a.type.elementType, b.type.elementType
    fields = [f for f in left if f.name not in right.fieldNames()]
    merged = F.zip_with(a.col, b.col, lambda x, y: F.struct(*(x[f.name].alias(f.name) for f in fields), *(y[f.name].alias(f.name) for f in right)))
    return Value(merged, T.ArrayType(T.StructType([*fields, *right])), either(_errors(a, b), failing(F.size(a.col) != F.size(b.col), ARGUMENT)))


@method("sort_by_key")
def sort_by_key(v: Value, key: Value, name: str | None = None) -> Value:
    """Stable, ascending by a number cut to a whole one."""
    t = v.type
    if not (is_list(t) and isinstance(t.elementType, T.StructType) and name in t.elementType.fieldNames() and is_number(t.elementType[name].dataType)):
        return failure(TEXT, ARGUMENT).with_err(_errors(v, key))
    keyed = F.transform(v.col, lambda x, i: F.struct(x[name].cast(LONG).alias("k"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]))
    return Value(F.transform(ordered, lambda x: x["x"]), t, either(v.err, failing(F.exists(v.col, lambda x: x[name].isNull()), ARGUMENT)))


@method("to_long")
def to_long(v: Value) -> Value:
    if v.type == VOID:
        return Value(F.lit(0).cast(LONG), LONG, v.err)
    if v.type == VARIANT:
        v = numeric(v)
    if is_number(v.type):
        return Value(F.coalesce(v.col.try_cast("bigint"), F.lit(0).cast(LONG)), LONG, v.err)
    if v.type == TEXT:
        fits = F.coalesce(v.col.rlike(r"^[+-]?[0-9]+$") & v.col.try_cast("bigint").isNotNull(), v.col.isNull())
        return Value(F.when(v.col.isNull(), F.lit(0).cast(LONG)).otherwise(v.col.try_cast("bigint")), LONG, either(v.err, failing(~fits, ARGUMENT)))
    return failure(LONG, ARGUMENT).with_err(v.err)


@method("to_double")
def to_double(v: Value) -> Value:
    if v.type == VOID:
        return Value(F.lit(0.0), DOUBLE, v.err)
    if v.type == VARIANT:
        v = numeric(v)
    if is_number(v.type) or v.type == TEXT:
        out = v.col.try_cast("double")
        return Value(F.when(v.col.isNull(), F.lit(0.0)).otherwise(out), DOUBLE, either(v.err, failing(v.col.isNotNull() & out.isNull(), ARGUMENT)))
    return failure(DOUBLE, ARGUMENT).with_err(v.err)


@method("to_string")
def to_string(v: Value) -> Value:
    if v.type == VOID:
        return Value(F.lit("null"), TEXT, v.err)
    if is_number(v.type) or v.type in (TEXT, BOOL):
        return Value(F.coalesce(v.col.cast(TEXT), F.lit("null")), TEXT, v.err)
    if v.type == VARIANT:
        return Value(F.coalesce(F.try_variant_get(v.col, "$", "string"), F.lit("null")), TEXT, v.err)
    return failure(TEXT, ARGUMENT).with_err(v.err)


@method("to_json")
def to_json(v: Value) -> Value:
    """A dict's text, nulls kept."""
    if v.type == VARIANT:
        return Value(F.to_json(v.col), TEXT, v.err)
    return _needs(v, is_dict(v.type)) or Value(F.to_json(v.col, {"ignoreNullFields": "false"}), TEXT, v.err)


@function("merge_dict")
def merge_dict(source: Value, target: Value) -> Value:
    """Deep merge; the source wins, and a side that is no dict is left out."""
    errors = _errors(source, target)
    if not isinstance(source.type, T.StructType) or not isinstance(target.type, T.StructType):
        if isinstance(source.type, T.MapType) and isinstance(target.type, T.MapType):
            kind = common([source.type, target.type])
            kept = F.map_filter(target.col, lambda k, _: ~F.map_contains_key(source.col, k))
            return Value(F.map_concat(kept, source.col), kind, errors)
        some = [x for x in (source, target) if is_dict(x.type)]
        return some[0].with_err(errors) if some else Value(F.lit(None), VOID, errors)
    own = source.type.fieldNames()
    names = [*(n for n in target.type.fieldNames()), *(n for n in own if n not in target.type.fieldNames())]
    parts = []
    for n in names:
        s = Value(source.col[n], source.type[n].dataType) if n in own else None
        t = Value(target.col[n], target.type[n].dataType) if n in target.type.fieldNames() else None
        both = s is not None and t is not None and isinstance(s.type, T.StructType) and isinstance(t.type, T.StructType)
        parts.append((n, merge_dict(s, t) if both else s if s is not None else t))
    kind = T.StructType([T.StructField(n, v.type) for n, v in parts])
    return Value(F.struct(*(v.col.alias(n) for n, v in parts)), kind, errors)


@method("delete")
def delete(v: Value, keys: Value, names: list | None = None) -> Value:
    """The dict without the listed keys."""
    errors = _errors(v, keys)
    if isinstance(v.type, T.MapType):
        return Value(F.map_filter(v.col, lambda k, _: ~F.array_contains(keys.col, k)), v.type, errors)
    if not isinstance(v.type, T.StructType) or names is None:
        return failure(TEXT, ARGUMENT).with_err(errors)
    fields = [f for f in v.type if f.name not in names]
    if not fields:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(TEXT, TEXT), errors)
    return Value(F.struct(*(v.col[f.name].alias(f.name) for f in fields)), T.StructType(fields), errors)


@method("get_or_else")
def get_or_else(v: Value, other: Value) -> Value:
    t = common([v.type, other.type])
    return Value(F.coalesce(cast_to(v, t), cast_to(other, t)) if v.type != VOID else other.col, t if v.type != VOID else other.type, _errors(v, other))


@method("at_or_else")
def at_or_else(v: Value, index: Value, other: Value, constant=None) -> Value:
    """The element if it is there (even if null), else the other value."""
    errors = _errors(v, index, other)
    if isinstance(v.type, T.StructType):
        return Value(v.col[constant], v.type[constant].dataType, errors) if constant in v.type.fieldNames() else other.with_err(errors)
    if isinstance(v.type, T.MapType) and index.type == TEXT:
        t = common([v.type.valueType, other.type])
        return Value(F.when(F.coalesce(F.map_contains_key(v.col, index.col), F.lit(False)), cast_to(Value(F.try_element_at(v.col, index.col), v.type.valueType), t)).otherwise(cast_to(other, t)), t, errors)
    if is_list(v.type) and is_number(index.type):
        t = common([v.type.elementType, other.type])
        at = F.when(index.col < 0, F.size(v.col) + index.col).otherwise(index.col)
        there = F.coalesce((at >= 0) & (at < F.size(v.col)), F.lit(False))
        return Value(F.when(there, cast_to(Value(F.get(v.col, at.cast("int")), v.type.elementType), t)).otherwise(cast_to(other, t)), t, errors)
    return failure(TEXT, ARGUMENT).with_err(errors) if is_list(v.type) or is_dict(v.type) else other.with_err(errors)


@function("concat")
def concat(a: Value, b: Value) -> Value:
    """The lists among both, one after the other; null if neither is one."""
    some = [x for x in (a, b) if is_list(x.type)]
    if not some:
        return Value(F.lit(None), VOID, _errors(a, b))
    return union(*some) if len(some) == 2 else some[0].with_err(_errors(a, b))


@function("uuid")
def uuid() -> Value:
    return Value(F.replace(F.uuid(), F.lit("-"), F.lit("")), TEXT)


def _camel(name: str) -> str:
    return re.sub(r"_+([a-zA-Z0-9])", lambda m: m[1].upper(), name)


def _snake(name: str) -> str:
    return re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)


def _renamed(t: T.DataType, rename: Callable[[str], str]) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(rename(f.name), _renamed(f.dataType, rename)) for f in t])
    if is_list(t):
        return T.ArrayType(_renamed(t.elementType, rename))
    return t


def _keys(rename: Callable[[str], str], column: Callable[[Column], Column]):
    def run(v: Value) -> Value:
        if isinstance(v.type, T.MapType):
            return Value(F.transform_keys(v.col, lambda k, _: column(k)), v.type, v.err)
        if not isinstance(v.type, T.StructType) and not is_list(v.type):
            return failure(TEXT, ARGUMENT).with_err(v.err)
        kind = _renamed(v.type, rename)
        return Value(v.col.cast(kind), kind, v.err)

    return run


METHODS["to_lower_camel"] = _keys(_camel, lambda k: F.concat(F.lower(F.substring(k, 1, 1)), F.substring(F.replace(F.initcap(F.replace(k, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), 2, 10_000)))
METHODS["to_under_score"] = _keys(_snake, lambda k: F.lower(F.regexp_replace(k, "([A-Z])", "_$1")))
