"""Values of expressions: a column, its type, and why it failed.

A value never lets an exception reach Spark: `err` is null where the value is
valid, else the class of the failure.  `err is None` says at compile time that it
can't fail, so nothing is emitted for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARGUMENT, BOUNDS, ARITHMETIC, MISSING = "IllegalArgumentException", "IndexOutOfBoundsException", "ArithmeticException", "UninitializedFieldError"
LONG, DOUBLE, TEXT, BOOL, VOID, VARIANT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType(), T.VariantType()


@dataclass
class Value:
    col: Column
    type: T.DataType
    err: Column | None = None

    def with_err(self, err: Column | None) -> Value:
        return Value(self.col, self.type, either(self.err, err))


def either(*errors: Column | None) -> Column | None:
    """The first failure of several."""
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def failing(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name))


def failure(kind: T.DataType, name: str) -> Value:
    """A value that always fails."""
    return Value(F.lit(None).cast(kind if kind != VOID else TEXT), kind, F.lit(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(x)` with x bound to `value` once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_dict(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.MapType))


def of_column(col: Column, t: T.DataType) -> Value:
    """A column as a value: whole numbers are LONG, others DOUBLE, times epoch milliseconds."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return Value(col.cast(LONG), LONG)
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return Value(col.cast(DOUBLE), DOUBLE)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.unix_millis(col.cast("timestamp")), LONG)
    if isinstance(t, (T.CharType, T.VarcharType)):
        return Value(col.cast(TEXT), TEXT)
    return Value(col, t)


def literal(value) -> Value:
    if value is None:
        return Value(F.lit(None), VOID)
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL)
    if isinstance(value, int):
        return Value(F.lit(value).cast(LONG), LONG)
    return Value(F.lit(value), DOUBLE if isinstance(value, float) else TEXT)


def common(types: list[T.DataType]) -> T.DataType:
    """The type that holds values of all these types; VARIANT if nothing narrower does."""
    some = [t for t in types if t != VOID]
    if not some:
        return VOID
    first = some[0]
    for t in some[1:]:
        first = _pair(first, t)
    return first


def _pair(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if is_number(a) and is_number(b):
        return LONG if _whole(a) and _whole(b) else DOUBLE
    if a == VOID or b == VOID:
        return a if b == VOID else b
    if is_list(a) and is_list(b):
        return T.ArrayType(_pair(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(TEXT, _pair(a.valueType, b.valueType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.fieldNames() == b.fieldNames():
        return T.StructType([T.StructField(x.name, _pair(x.dataType, y.dataType)) for x, y in zip(a, b)])
    return VARIANT


def _whole(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def cast_to(v: Value, t: T.DataType) -> Column:
    """The column as type t (which `common` gave)."""
    if v.type == t:
        return v.col
    if t == VARIANT:
        if v.type == VOID:
            return F.parse_json(F.lit("null"))
        return F.to_variant_object(v.col) if is_list(v.type) or is_dict(v.type) else v.col.cast(VARIANT)
    return v.col.cast(t if t != VOID else TEXT)


def from_variant(v: Value, t: T.DataType) -> Column:
    """A VARIANT's value as type t, null if it is another type."""
    return F.try_variant_get(v.col, "$", {LONG: "bigint", DOUBLE: "double", TEXT: "string", BOOL: "boolean"}[t])


def truthy(v: Value) -> Column:
    """Null, 0, "" and empty documents are false, all else true."""
    t = v.type
    if t == VOID:
        return F.lit(False)
    if t == BOOL:
        return F.coalesce(v.col, F.lit(False))
    if is_number(t):
        return F.coalesce(v.col != 0, F.lit(False))
    if t == TEXT:
        return F.coalesce(v.col != "", F.lit(False))
    if is_list(t) or isinstance(t, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if t == VARIANT:
        text = F.to_json(v.col)
        return F.coalesce(~text.isin("null", "0", "false", '""', "[]", "{}"), F.lit(False))
    return v.col.isNotNull()


def comparable(v: Value) -> Column:
    """A column whose <=> is the language's equality: maps become sorted entries, variants canonical JSON."""
    if isinstance(v.type, T.MapType):
        return F.array_sort(F.map_entries(v.col))
    if v.type == VARIANT:
        return F.when(~F.is_variant_null(v.col), F.to_json(v.col))
    return v.col


def equal(a: Value, b: Value) -> Column:
    """Structural and null-safe: null equals null, numbers compare by value, other kinds differ."""
    if a.type == VOID or b.type == VOID:
        return a.col.isNull() & b.col.isNull() if VARIANT not in (a.type, b.type) else comparable(a).isNull() & comparable(b).isNull()
    if a.type == VARIANT or b.type == VARIANT:
        left, right = (Value(cast_to(x, VARIANT), VARIANT) for x in (a, b))
        return F.coalesce(comparable(left).eqNullSafe(comparable(right)), F.lit(False))
    t = common([a.type, b.type])
    if t == VARIANT:
        return a.col.isNull() & b.col.isNull()
    return comparable(Value(cast_to(a, t), t)).eqNullSafe(comparable(Value(cast_to(b, t), t)))


def compare(op: str, a: Value, b: Value) -> Value:
    """`==` and `!=` are null-safe; an order with a null is false, of unlike kinds a failure."""
    errors = either(a.err, b.err)
    if op in ("==", "!="):
        same = equal(a, b)
        return Value(same if op == "==" else ~same, BOOL, errors)
    if a.type == VOID or b.type == VOID:
        return Value(F.lit(False), BOOL, errors)
    if VARIANT in (a.type, b.type):
        kind = next((t for t in (a.type, b.type) if t != VARIANT), DOUBLE)
        kind = DOUBLE if is_number(kind) else kind
        a, b = (Value(from_variant(x, kind), kind) if x.type == VARIANT else x for x in (a, b))
    if not (is_number(a.type) and is_number(b.type) or a.type == b.type == TEXT):
        return Value(F.lit(False), BOOL, either(errors, failing(a.col.isNotNull() & b.col.isNotNull(), ARGUMENT)))
    test = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    return Value(F.coalesce(test, F.lit(False)), BOOL, errors)


def contains(item: Value, container: Value) -> Value:
    """Whether a list has an equal element, or a dict the key."""
    errors, t = either(item.err, container.err), container.type
    if is_list(t):
        found = F.exists(container.col, lambda x: equal(Value(x, t.elementType), item)) if t.elementType != VOID else F.lit(False) & item.col.isNull()
        return Value(F.coalesce(found, F.lit(False)), BOOL, either(errors, failing(container.col.isNull(), ARGUMENT)))
    if isinstance(t, T.MapType):
        return Value(F.coalesce(F.map_contains_key(container.col, item.col), F.lit(False)), BOOL, either(errors, failing(container.col.isNull(), ARGUMENT)))
    if isinstance(t, T.StructType):
        return Value(F.coalesce(item.col.isin(*t.fieldNames()), F.lit(False)), BOOL, errors)
    return failure(BOOL, ARGUMENT).with_err(errors)


def to_text(v: Value) -> Column:
    return v.col.cast(TEXT)


def numeric(v: Value) -> Value:
    return Value(from_variant(v, DOUBLE), DOUBLE, v.err) if v.type == VARIANT else v


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """`+ - * / %` of numbers, and their meanings for texts and lists."""
    errors = either(a.err, b.err)
    if op in "+-" and a.type == VOID and b.type == VOID:
        return Value(a.col, VOID, errors)
    if op in "+-" and (is_list(a.type) or is_list(b.type)) and all(is_list(x.type) or x.type == VOID for x in (a, b)):
        return (union if op == "+" else subtract)(a, b)
    if op == "+" and TEXT in (a.type, b.type) and all(x.type == TEXT or is_number(x.type) for x in (a, b)):
        return Value(F.concat(to_text(a), to_text(b)), TEXT, either(errors, failing(a.col.isNull() != b.col.isNull(), ARGUMENT)))
    if op in "+-" and VOID in (a.type, b.type):
        other = a if b.type == VOID else b
        return Value(F.lit(None).cast(other.type), other.type, either(errors, failing(other.col.isNotNull(), ARGUMENT)))
    if op == "*" and a.type == TEXT and is_number(b.type):
        return Value(F.repeat(a.col, b.col.cast("int")), TEXT, either(errors, failing(a.col.isNull() | b.col.isNull() | (b.col != F.floor(b.col)), ARGUMENT)))
    a, b = numeric(a), numeric(b)
    if not (is_number(a.type) and is_number(b.type)):
        return failure(DOUBLE, ARGUMENT).with_err(errors)
    one = a.col.isNull() != b.col.isNull() if op in "+-" else a.col.isNull() | b.col.isNull()  # null + null is null
    errors = either(errors, failing(one, ARGUMENT))
    if op == "/":
        return Value(F.try_divide(a.col.cast(DOUBLE), b.col.cast(DOUBLE)), DOUBLE, either(errors, failing(b.col == 0, ARITHMETIC)))
    whole = _whole(a.type) and _whole(b.type)
    if op == "%":
        if whole:
            return Value(F.try_mod(a.col, b.col), LONG, either(errors, failing(b.col == 0, ARITHMETIC)))
        left, right = (x.col.try_cast("decimal(30,12)") for x in (a, b))  # a double's own remainder shows its binary digits
        rest = F.try_mod(left, right).cast(DOUBLE)
        return Value(rest, DOUBLE, either(errors, failing(b.col == 0, ARITHMETIC)))
    if whole:
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col)
        return Value(out, LONG, either(errors, failing(out.isNull() & a.col.isNotNull() & b.col.isNotNull(), ARITHMETIC)))
    left, right = a.col.cast(DOUBLE), b.col.cast(DOUBLE)
    return Value({"+": left + right, "-": left - right, "*": left * right}[op], DOUBLE, errors)


def negate(v: Value) -> Value:
    v = numeric(v)
    if not is_number(v.type):
        return failure(DOUBLE, ARGUMENT).with_err(v.err)
    return Value(-v.col, v.type, either(v.err, failing(v.col.isNull(), ARGUMENT)))


def union(a: Value, b: Value) -> Value:
    """All elements of both lists; null counts as an empty one beside a list."""
    t = common([x.type.elementType for x in (a, b) if is_list(x.type)])
    kind = T.ArrayType(t if t != VOID else TEXT)

    def own(x: Value) -> Column:
        empty = F.array().cast(kind) if kind.elementType != VARIANT else F.filter(F.array(F.parse_json(F.lit("1"))), lambda e: F.lit(False))
        if x.type.elementType == VOID:
            return empty
        return F.coalesce(x.col if x.type == kind else F.transform(x.col, lambda e: cast_to(Value(e, x.type.elementType), kind.elementType)), empty)

    both = F.concat(*(own(x) for x in (a, b) if is_list(x.type)))
    some = F.lit(False)
    for x in (a, b):
        if is_list(x.type):
            some = some | x.col.isNotNull()
    return Value(F.when(some, both), kind, either(a.err, b.err))


def subtract(a: Value, b: Value) -> Value:
    """The left elements that the right doesn't have, repeats kept."""
    if not is_list(a.type):
        return Value(F.when(b.col.isNotNull(), F.array().cast(b.type)), b.type, either(a.err, b.err))
    if not is_list(b.type):
        return a.with_err(b.err)
    left, right = a.type.elementType, b.type.elementType
    if VOID in (left, right):
        return a.with_err(b.err)
    own = F.coalesce(a.col, F.when(b.col.isNotNull(), F.array().cast(a.type)))
    kept = F.filter(own, lambda x: ~F.exists(F.coalesce(b.col, F.array().cast(b.type)), lambda y: equal(Value(y, right), Value(x, left))))
    return Value(kept, a.type, either(a.err, b.err))


def make_list(items: list[Value]) -> Value:
    t = common([v.type for v in items])
    kind = t if t != VOID else TEXT
    return Value(F.array(*(cast_to(v, kind) for v in items)).cast(T.ArrayType(kind)) if not items or kind != VARIANT else F.array(*(cast_to(v, kind) for v in items)), T.ArrayType(kind), either(*(v.err for v in items)))


def make_dict(pairs: list[tuple[str, Value]]) -> Value:
    last = dict(pairs)
    if not last:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(TEXT, TEXT))
    fields = [T.StructField(k, v.type if v.type != VOID else TEXT) for k, v in last.items()]
    return Value(F.struct(*(v.col.cast(f.dataType).alias(k) if v.type == VOID else v.col.alias(k) for (k, v), f in zip(last.items(), fields))), T.StructType(fields), either(*(v.err for v in last.values())))
