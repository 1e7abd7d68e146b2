"""Table views: the relational algebra over nested documents, inside a row.

A view is an array of records (i, v): an index path and a value.  Every operator
is a higher-order function over that array, so a view needs no shuffle; `relation`
turns one into a DataFrame for joins and groupings across rows.  An index is
(k, p, n): a location in a list (k = 0), an anonymous one (1) or a field (2); the
order of this struct is the order in which records are folded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import ARGUMENT, BOUNDS, LONG, TEXT, VARIANT, VOID, Value, cast_to, common, either, failing, failure, is_dict, is_list, is_number, let, make_list, union

INDEX = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("p", LONG), T.StructField("n", TEXT)])
LOCATION, ANONYMOUS, FIELD = 0, 1, 2


def location(p: Column) -> Column:
    return F.struct(F.lit(LOCATION).alias("k"), p.cast("bigint").alias("p"), F.lit(None).cast("string").alias("n"))


def field(n: Column) -> Column:
    return F.struct(F.lit(FIELD).alias("k"), F.lit(None).cast("bigint").alias("p"), n.alias("n"))


def anonymous(p: Column) -> Column:
    return F.struct(F.lit(ANONYMOUS).alias("k"), p.cast("bigint").alias("p"), F.lit(None).cast("string").alias("n"))


@dataclass
class View:
    """records: array<struct<i: array<INDEX>, v>>; kinds: of each dimension; root: default of an empty fold.

    `ordered` and `unique` say what is known of the index paths, so that a fold
    needn't sort or look for repeats.
    """

    records: Column
    kinds: tuple[int, ...]
    type: T.DataType
    root: str
    err: Column | None = None
    ordered: bool = False
    unique: bool = True

    def with_err(self, err: Column | None) -> View:
        return replace(self, err=either(self.err, err))


@dataclass
class Path:
    """An index path as `#` gives it: a column of array<INDEX>, and the kinds of its places."""

    col: Column
    kinds: tuple[int, ...]

    def at(self, i: int) -> Value:
        if not -len(self.kinds) <= i < len(self.kinds):
            return failure(LONG, BOUNDS)
        i %= len(self.kinds)
        x = F.get(self.col, F.lit(i))
        return Value(x["n"], TEXT) if self.kinds[i] == FIELD else Value(x["p"], LONG)

    def value(self) -> Value:
        return make_list([self.at(i) for i in range(len(self.kinds))])


def pairs(v: Value) -> tuple[Column, int, T.DataType]:
    """(array<struct<x: INDEX, v>>, kind of index, type) of a document's elements, in its order."""
    t = v.type
    if is_list(t):
        return F.transform(v.col, lambda e, i: F.struct(location(i).alias("x"), e.alias("v"))), LOCATION, t.elementType
    if isinstance(t, T.MapType):
        return F.transform(F.map_entries(v.col), lambda e: F.struct(field(e["key"]).alias("x"), e["value"].alias("v"))), FIELD, t.valueType
    if t == VARIANT:  # a dynamic list
        return F.transform(F.try_variant_get(v.col, "$", "array<variant>"), lambda e, i: F.struct(location(i).alias("x"), e.alias("v"))), LOCATION, VARIANT
    if not isinstance(t, T.StructType):
        return F.array().cast(T.ArrayType(T.StructType([T.StructField("x", INDEX), T.StructField("v", TEXT)]))), LOCATION, TEXT
    return _fields(v, t.fieldNames())


def _fields(v: Value, names: list[str]) -> tuple[Column, int, T.DataType]:
    kind = common([v.type[n].dataType for n in names]) if names else TEXT
    items = [F.struct(field(F.lit(n)).alias("x"), cast_to(Value(v.col[n], v.type[n].dataType), kind).alias("v")) for n in names]
    if not items:
        return F.array().cast(T.ArrayType(T.StructType([T.StructField("x", INDEX), T.StructField("v", TEXT)]))), FIELD, TEXT
    # a struct has no missing keys, so null stands for them
    there = F.filter(F.array(*items), lambda e: e["v"].isNotNull() & (~F.is_variant_null(e["v"]) if kind == VARIANT else F.lit(True)))
    return F.when(v.col.isNotNull(), there), FIELD, kind


def _root(t: T.DataType) -> str:
    return "list" if is_list(t) else "dict"


def _extend(source: Value | View, elements: Callable[[Value], tuple[Column, int, T.DataType]], in_order: bool = True) -> View:
    """One more dimension: the elements of each value, their indices appended; lists give theirs in order."""
    if isinstance(source, Value):
        if not (is_list(source.type) or is_dict(source.type) or source.type == VARIANT):
            return View(F.array().cast(T.ArrayType(T.StructType([T.StructField("i", T.ArrayType(INDEX)), T.StructField("v", TEXT)]))), (LOCATION,), TEXT, "list", either(source.err, F.lit(ARGUMENT)))
        own, kind, t = elements(source)
        records = F.transform(F.coalesce(own, F.slice(own, 1, 0)), lambda e: F.struct(F.array(e["x"]).alias("i"), e["v"].alias("v")))
        return View(records, (kind,), t, _root(source.type), either(source.err, failing(source.col.isNull(), ARGUMENT)), in_order and kind == LOCATION)
    _, kind, t = elements(Value(F.lit(None), source.type))

    def more(r: Column) -> Column:
        own = elements(Value(r["v"], source.type))[0]
        return F.transform(F.coalesce(own, F.slice(own, 1, 0)), lambda e: F.struct(F.concat(r["i"], F.array(e["x"])).alias("i"), e["v"].alias("v")))

    nested = F.transform(F.filter(source.records, lambda r: r["v"].isNotNull()), more)
    return View(F.flatten(nested), (*source.kinds, kind), t, source.root, source.err, in_order and source.ordered and kind == LOCATION, source.unique)


def select_all(source: Value | View) -> View:
    return _extend(source, pairs)


def select(source: Value | View, indices: list[Value], constants: list) -> View:
    """The listed indices that exist; a negative one keeps its negative place."""

    def elements(v: Value):
        t = v.type
        if isinstance(t, T.StructType):
            return _fields(v, [c for c in constants if c in t.fieldNames()])
        if t == VARIANT:
            path = lambda c: f"$[{c}]" if isinstance(c, int) else f"$['{c}']"
            some = F.array(*(F.struct((location(F.lit(c)) if isinstance(c, int) else field(F.lit(c))).alias("x"), F.try_variant_get(v.col, path(c), "variant").alias("v")) for c in constants))
            return F.filter(some, lambda e: e["v"].isNotNull()), LOCATION if all(isinstance(c, int) for c in constants) else FIELD, VARIANT
        if isinstance(t, T.MapType):
            some = F.array(*(F.struct(field(i.col).alias("x"), F.try_element_at(v.col, i.col).alias("v")) for i in indices if i.type == TEXT))
            return F.filter(some, lambda e: F.map_contains_key(v.col, e["x"]["n"])), FIELD, t.valueType
        place = lambda i: F.when(i < 0, F.size(v.col) + i).otherwise(i)
        some = F.array(*(F.struct(location(i.col).alias("x"), F.get(v.col, place(i.col).cast("int")).alias("v")) for i in indices if is_number(i.type)))
        return F.filter(some, lambda e: (place(e["x"]["p"]) >= 0) & (place(e["x"]["p"]) < F.size(v.col))), LOCATION, t.elementType

    out = _extend(source, elements, in_order=False)
    return replace(out.with_err(either(*(i.err for i in indices))), unique=False)  # an index may be named twice


def slice_view(source: Value | View, begin: Value | None, end: Value | None, constants: tuple) -> View:
    """List: begin to before end, negatives from the end, each with its own place.  Dict: from a key through a key."""

    def elements(v: Value):
        t = v.type
        if isinstance(t, T.StructType):
            names = t.fieldNames()
            low = names.index(constants[0]) if constants[0] is not None else 0
            high = names.index(constants[1]) if constants[1] is not None else len(names) - 1
            return _fields(v, names[low : high + 1])
        own, kind, inner = pairs(v)
        if isinstance(t, T.MapType):
            n = F.size(own)
            where = lambda key: F.coalesce(F.array_position(F.transform(own, lambda e: e["x"]["n"]), key), n + 1)
            low = where(begin.col) if begin is not None else F.lit(1)
            high = where(end.col) if end is not None else n
            return F.slice(own, low.cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int")), kind, inner
        n = F.size(v.col)
        place = lambda x: F.when(x.col < 0, F.greatest(n + x.col, F.lit(0))).otherwise(F.least(x.col, n))
        low = place(begin) if begin is not None else F.lit(0)
        high = place(end) if end is not None else n
        return F.slice(own, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), kind, inner

    return _extend(source, elements).with_err(either(*(x.err for x in (begin, end) if x is not None)))


def query(source: Value | View, test: Callable[[Value, Path], Value]) -> View:
    """The elements that pass a test of `_` and `#`."""
    view = select_all(source)
    one = lambda r: test(Value(r["v"], view.type), Path(r["i"], view.kinds))
    probe = one(F.lit(None).cast(T.StructType([T.StructField("i", T.ArrayType(INDEX)), T.StructField("v", view.type)])))
    errors = None if probe.err is None else F.get(F.filter(F.transform(view.records, lambda r: one(r).err), lambda e: e.isNotNull()), F.lit(0))
    return replace(view, records=F.filter(view.records, lambda r: one(r).col)).with_err(errors)


def _index_of(key: Value, unique: Column) -> tuple[Column, int]:
    """The index that a key makes: text a field, a number a place (truncated), all else one of its own."""
    if key.type == TEXT:
        return F.when(key.col.isNotNull(), field(key.col)).otherwise(anonymous(unique)), FIELD
    if is_number(key.type):
        return F.when(key.col.isNotNull(), location(key.col)).otherwise(anonymous(unique)), LOCATION
    return anonymous(unique), ANONYMOUS


def expand(view: View, key: Callable[[Value, Path], Value]) -> View:
    """Each record with a computed index appended."""
    typed = T.StructType([T.StructField("i", T.ArrayType(INDEX)), T.StructField("v", view.type)])
    one = lambda r: key(Value(r["v"], view.type), Path(r["i"], view.kinds))
    probe = one(F.lit(None).cast(typed))
    records = F.transform(view.records, lambda r, j: F.struct(F.concat(r["i"], F.array(_index_of(one(r), j)[0])).alias("i"), r["v"].alias("v")))
    return View(records, (*view.kinds, _index_of(probe, F.lit(0))[1]), view.type, view.root, view.err, unique=view.unique)


def project(source: Value | View, key: Callable[[Value, Path], Value]) -> View:
    """GROUP BY: the elements of each record by key, as lists; a dict's elements are [key, value] pairs."""
    inner = select_all(source)
    outer = inner.kinds[:-1]
    typed = T.StructType([T.StructField("i", T.ArrayType(INDEX)), T.StructField("v", inner.type)])
    one = lambda r: key(Value(r["v"], inner.type), Path(r["i"], inner.kinds))
    kind = _index_of(one(F.lit(None).cast(typed)), F.lit(0))[1]
    keyed = F.transform(inner.records, lambda r, j: F.struct(F.concat(F.slice(r["i"], 1, len(outer)), F.array(_index_of(one(r), j)[0])).alias("i"), r["v"].alias("v")))
    order = lambda k: F.sort_array(F.transform(k, lambda r, j: F.struct(r["i"].alias("i"), j.alias("j"))))
    members = lambda k, s, run: F.transform(F.slice(s, run["at"] + 1, run["n"]), lambda x: F.get(k, x["j"])["v"])
    cut = lambda k, s: F.transform(_runs(s, lambda x: x["i"]), lambda run: F.struct(F.get(s, run["at"])["i"].alias("i"), members(k, s, run).alias("v")))
    groups = let(keyed, lambda k: let(order(k), lambda s: cut(k, s)))
    return View(groups, (*outer, kind), T.ArrayType(inner.type), inner.root, inner.err, True)


def _runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """array<struct<at, n>>: where runs of neighbours with equal keys begin, and how long they are."""
    starts = F.filter(F.transform(items, lambda x, p: F.when((p == 0) | ~key(F.get(items, p - 1)).eqNullSafe(key(x)), p)), lambda p: p.isNotNull())
    return let(starts, lambda s: F.transform(s, lambda p, q: F.struct(p.alias("at"), (F.coalesce(F.get(s, q + 1), F.size(items)) - p).alias("n"))))


def merge(a: View, b: View) -> View:
    """Full outer join on the index path; the right side wins."""
    errors = either(a.err, b.err)
    if len(a.kinds) != len(b.kinds):
        return a.with_err(either(errors, F.lit(ARGUMENT)))
    t = common([a.type, b.type])
    def widened(x: View) -> Column:
        return x.records if x.type == t else F.transform(x.records, lambda r: F.struct(r["i"].alias("i"), cast_to(Value(r["v"], x.type), t).alias("v")))

    left, right = widened(a), widened(b)
    if a.unique:  # sorted together, a left record with a right one of its index stands just before it
        tagged = lambda x, side: F.transform(x, lambda r, j: F.struct(r["i"].alias("i"), F.lit(side).alias("side"), j.alias("j")))
        kept = lambda s: F.filter(s, lambda x, p: (x["side"] == 1) | ~F.coalesce(F.get(s, p + 1)["i"] == x["i"], F.lit(False)))
        pick = lambda m, n: F.transform(let(F.sort_array(F.concat(tagged(m, 0), tagged(n, 1))), kept), lambda x: F.when(x["side"] == 1, F.get(n, x["j"])).otherwise(F.get(m, x["j"])))
        both = let(left, lambda m: let(right, lambda n: pick(m, n)))
        if b.unique:
            return View(both, a.kinds, t, a.root, errors, True, True)
    else:
        both = let(right, lambda s: F.concat(F.filter(left, lambda r: ~F.exists(s, lambda q: q["i"] == r["i"])), s))
    return View(_sorted(both, t), a.kinds, t, a.root, errors, True, a.unique and b.unique)


def _sorted(records: Column, t: T.DataType) -> Column:
    """By index path; values of kinds without an order stay out of the comparison."""
    if _orderable(t):
        return F.sort_array(records)
    return F.array_sort(records, lambda x, y: F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0))


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t)
    return _orderable(t.elementType) if is_list(t) else t != VARIANT and not isinstance(t, T.MapType)


def transpose(view: View) -> View:
    """The index paths reversed."""
    records = F.transform(view.records, lambda r: F.struct(F.reverse(r["i"]).alias("i"), r["v"].alias("v")))
    return View(records, view.kinds[::-1], view.type, view.root, view.err, view.ordered and len(view.kinds) == 1, view.unique)


def map_records(view: View, body: Callable[[Value, Path], Value], drop_null: bool = False) -> View:
    """Each value replaced by an expression of `_` and `#`."""
    typed = T.StructType([T.StructField("i", T.ArrayType(INDEX)), T.StructField("v", view.type)])
    one = lambda r: body(Value(r["v"], view.type), Path(r["i"], view.kinds))
    probe = one(F.lit(None).cast(typed))
    kind = probe.type if probe.type != VOID else TEXT
    records = F.transform(view.records, lambda r: F.struct(r["i"].alias("i"), one(r).col.cast(kind).alias("v") if probe.type == VOID else one(r).col.alias("v")))
    errors = None if probe.err is None else F.get(F.filter(F.transform(view.records, lambda r: one(r).err), lambda e: e.isNotNull()), F.lit(0))
    if drop_null:
        records = F.filter(records, lambda r: r["v"].isNotNull())
    return View(records, view.kinds, kind, view.root, either(view.err, errors), view.ordered, view.unique)


def at(view: View, index: Value, constant) -> View:
    """`t[i]`: the element of each record that has it."""
    chosen = select(view, [index], [constant])
    records = F.transform(chosen.records, lambda r: F.struct(F.slice(r["i"], 1, len(view.kinds)).alias("i"), r["v"].alias("v")))
    return View(records, view.kinds, chosen.type, view.root, chosen.err, view.ordered, view.unique)


def fold(view: View) -> Value:
    """Records back to a nested value, sorted by index; a dimension with fields is a dict, else a list."""

    def level(records: Column, kinds: tuple[int, ...]) -> tuple[Column, T.DataType]:
        if not kinds:
            return F.get(records, F.lit(0))["v"], view.type
        _, inner = level(F.array(F.struct(F.array().cast(T.ArrayType(INDEX)).alias("i"), F.lit(None).alias("v"))), kinds[1:])
        head = lambda r: F.get(r["i"], F.lit(0))
        named = lambda h: F.coalesce(h["n"], h["p"].cast("string"))
        if len(kinds) == 1 and view.unique:
            if kinds[0] != FIELD:
                return F.transform(records, lambda r: r["v"]), T.ArrayType(inner)
            return F.map_from_entries(F.transform(records, lambda r: F.struct(named(head(r)).alias("key"), r["v"].alias("value")))), T.MapType(TEXT, inner)

        def below(own: Column, run: Column) -> Column:
            if len(kinds) == 1:  # the last of equal indices
                return F.get(own, run["at"] + run["n"] - 1)["v"]
            part = F.transform(F.slice(own, run["at"] + 1, run["n"]), lambda r: F.struct(F.slice(r["i"], 2, F.size(r["i"])).alias("i"), r["v"].alias("v")))
            return let(part, lambda some: level(some, kinds[1:])[0])

        def build(own: Column) -> Column:
            runs = _runs(own, head)
            if kinds[0] == FIELD:
                return F.map_from_entries(F.transform(runs, lambda u: F.struct(named(head(F.get(own, u["at"]))).alias("key"), below(own, u).alias("value"))))
            return F.transform(runs, lambda u: below(own, u))

        return let(records, build), T.MapType(TEXT, inner) if kinds[0] == FIELD else T.ArrayType(inner)

    ordered = view.records if view.ordered else _sorted(view.records, view.type)
    kind = level(F.array(F.struct(F.array().cast(T.ArrayType(INDEX)).alias("i"), F.lit(None).alias("v"))), view.kinds)[1]
    if view.unique and view.kinds == (LOCATION,):
        return Value(level(ordered, view.kinds)[0], kind, view.err)
    return Value(let(ordered, lambda r: level(r, view.kinds)[0]), kind, view.err)


def relation(df: DataFrame, view: View, keys: list[str]) -> DataFrame:
    """A view as a DataFrame (keys, i0, i1, ..., v), for operations across rows."""
    rows = df.select(*keys, F.explode(view.records).alias("r"))
    places = [(F.col("r.i")[d]["n"] if k == FIELD else F.col("r.i")[d]["p"]).alias(f"i{d}") for d, k in enumerate(view.kinds)]
    return rows.select(*keys, *places, F.col("r.v").alias("v"))


def merge_relations(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The merge of two views as DataFrames: full outer join on keys and indices, the right side wins."""
    left, right = a.withColumnRenamed("v", "left_v"), b.withColumn("there", F.lit(True)).withColumnRenamed("v", "right_v")
    return left.join(right, on, "full_outer").select(*on, F.when(F.col("there"), F.col("right_v")).otherwise(F.col("left_v")).alias("v"))


def group_relation(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Grouping across rows: lists of v by `by`, in the order of the places i0, i1, ... that `relation` gave.

    Keys that are neither text nor number never group together.
    """
    t = rows.schema[by].dataType
    index = F.col(by).cast("int") if is_number(t) else F.col(by)
    if t != TEXT and not is_number(t):
        return rows.select(*keys, F.monotonically_increasing_id().alias(by), F.array("v").alias("v"))
    places = [c for c in rows.columns if c[:1] == "i" and c[1:].isdigit() and c not in (*keys, by)]
    row = F.struct(*places, "v") if places else F.struct("v")
    if _orderable(rows.schema["v"].dataType):
        lists = F.sort_array(F.collect_list(row)) if places else F.collect_list(row)
    else:
        place = lambda x: F.struct(*(x[c] for c in places))
        lists = F.array_sort(F.collect_list(row), lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)) if places else F.collect_list(row)
    return rows.withColumn(by, index).groupBy(*keys, by).agg(F.transform(lists, lambda x: x["v"]).alias("v"))


# -- navigation

def visit(v: Value, name: str) -> Value:
    """`doc.name`: null if there is none; of a list, the elements' values, lists among them spliced."""
    t = v.type
    if isinstance(t, T.StructType):
        return Value(v.col[name], t[name].dataType, v.err) if name in t.fieldNames() else Value(F.lit(None), VOID, v.err)
    if isinstance(t, T.MapType):
        return Value(F.try_element_at(v.col, F.lit(name)), t.valueType, v.err)
    if t == VARIANT:
        return Value(F.try_variant_get(v.col, "$." + name if name.isidentifier() else f"$['{name}']", "variant"), VARIANT, v.err)
    if is_list(t):
        inner = visit(Value(F.lit(None).cast(t.elementType) if t.elementType != VOID else F.lit(None), t.elementType), name) if not is_list(t.elementType) else Value(F.lit(None), VOID)
        if inner.type == VOID:
            return Value(F.lit(None), VOID, v.err)
        found = F.filter(F.transform(v.col, lambda e: visit(Value(e, t.elementType), name).col), lambda e: e.isNotNull())
        out = F.flatten(found) if is_list(inner.type) else found
        return Value(let(out, lambda x: F.when(F.size(x) > 0, x)), inner.type if is_list(inner.type) else T.ArrayType(inner.type), v.err)
    return Value(F.lit(None), VOID, v.err)


def children(v: Value) -> list[Value]:
    """`doc.*` as lists of one type each: values of a dict or list, lists among them spliced."""
    t = v.type
    if isinstance(t, T.StructType):
        out = []
        for f in t:
            x = Value(v.col[f.name], f.dataType)
            out.append(Value(F.coalesce(x.col, F.array().cast(f.dataType)), f.dataType) if is_list(f.dataType) else Value(F.filter(F.array(x.col), lambda e: e.isNotNull()), T.ArrayType(f.dataType)))
        return out
    if isinstance(t, T.MapType):
        return [Value(F.flatten(F.map_values(v.col)), t.valueType) if is_list(t.valueType) else Value(F.map_values(v.col), T.ArrayType(t.valueType))]
    if is_list(t):
        e = t.elementType
        if is_list(e):
            return [Value(F.flatten(v.col), e)]
        if is_dict(e):
            probe = children(Value(F.lit(None).cast(e), e))

            def nth(k: int) -> Column:
                return F.flatten(F.transform(v.col, lambda x: children(Value(x, e))[k].col))

            return [Value(nth(k), p.type) for k, p in enumerate(probe)]
    return []


def joined(parts: list[Value], err: Column | None = None) -> Value:
    """Lists one after the other; null if there is nothing at all."""
    if not parts:
        return Value(F.lit(None), VOID, err)
    out = parts[0]
    for p in parts[1:]:
        out = union(out, p)
    return Value(let(out.col, lambda x: F.when(F.size(x) > 0, x)), out.type, err)


def visit_all(v: Value) -> Value:
    return joined(children(v), v.err)


def search_all(v: Value) -> Value:
    """`doc..*`: level by level, each the children of the one before."""
    found, level = [], children(v)
    while level:
        found += level
        level = [c for part in level for c in children(part)]
    return joined(found, v.err)


def search(v: Value, name: str) -> Value:
    """`doc..name`: every descendant's `name`, a dict's own before those below it."""

    def within(x: Value) -> list[Value]:
        t, out = x.type, []
        if isinstance(t, T.StructType):
            if name in t.fieldNames():
                own = Value(x.col[name], t[name].dataType)
                out.append(Value(F.coalesce(own.col, F.array().cast(own.type)), own.type) if is_list(own.type) else Value(F.filter(F.array(own.col), lambda e: e.isNotNull()), T.ArrayType(own.type)))
            for f in t:
                out += within(Value(x.col[f.name], f.dataType))
        elif isinstance(t, T.MapType):
            out.append(Value(F.filter(F.array(F.try_element_at(x.col, F.lit(name))), lambda e: e.isNotNull()), T.ArrayType(t.valueType)))
            out += within(Value(F.map_values(x.col), T.ArrayType(t.valueType)))
        elif is_list(t) and (is_list(t.elementType) or is_dict(t.elementType)):
            probe = within(Value(F.lit(None).cast(t.elementType), t.elementType))
            if probe:  # element by element, so that the order is the document's
                whole = lambda e: joined(within(Value(e, t.elementType)))
                kind = joined(probe).type
                out.append(Value(F.flatten(F.transform(F.coalesce(x.col, F.array().cast(t)), lambda e: F.coalesce(whole(e).col, F.array().cast(kind)))), kind))
        return out

    return joined(within(v), v.err)


def element(v: Value, index: Value, constant) -> Value:
    """`doc[i]`: strict, a missing key or place is a failure."""
    t = v.type
    errors = either(v.err, index.err)
    if isinstance(t, T.StructType):
        if constant in t.fieldNames():
            return Value(v.col[constant], t[constant].dataType, either(errors, failing(v.col.isNull(), ARGUMENT)))
        return failure(TEXT, BOUNDS).with_err(errors)
    if isinstance(t, T.MapType) and index.type == TEXT:
        return Value(F.try_element_at(v.col, index.col), t.valueType, either(errors, failing(~F.coalesce(F.map_contains_key(v.col, index.col), F.lit(False)), BOUNDS)))
    if is_list(t) and is_number(index.type):
        i = index.col
        at = F.when(i < 0, F.size(v.col) + i).otherwise(i)
        return Value(F.get(v.col, at.try_cast("int")), t.elementType, either(errors, failing(i.isNull() | (i != F.floor(i)), ARGUMENT), failing(F.coalesce((at < 0) | (at >= F.size(v.col)), F.lit(True)), BOUNDS)))
    if t == VARIANT:
        path = f"$[{constant}]" if isinstance(constant, int) else f"$['{constant}']"
        out = F.try_variant_get(v.col, path, "variant")
        return Value(out, VARIANT, either(errors, failing(out.isNull(), BOUNDS)))
    return failure(TEXT, ARGUMENT).with_err(errors)
