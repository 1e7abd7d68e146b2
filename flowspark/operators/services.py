"""Services that flows call: tables, Python functions, templates of remote calls, sinks.

A service adds its answer to every row that a guard lets through.  A table is a
left join, whose strategy Spark picks from the table's measured size; a Python
function runs in Arrow batches, only over the rows that need it, and a call that
raises marks its own row alone.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TEXT, VARIANT, VOID, Value, either


class Service:
    """`apply` adds the columns `out` and `out`_err and says the answer's type."""

    def apply(self, df: DataFrame, args: dict[str, Value], out: str, guard: Column | None) -> tuple[DataFrame, T.DataType]:
        raise NotImplementedError


class TableService(Service):
    """Looks a row up by `key`; the answer is one column or a struct of several.

    No row gives null.  Of several rows with one key the answer is the least, so that
    no event is multiplied; `unique` says that there are none, and saves the
    aggregation.  `argument` is the name of the argument that holds the key.
    """

    def __init__(self, table: DataFrame, key: str, columns: str | list[str], argument: str | None = None, unique: bool = False):
        self.table, self.key, self.columns, self.argument, self.unique = table, key, columns, argument or key, unique

    def apply(self, df, args, out, guard):
        wanted = args[self.argument]
        answer = F.col(self.columns) if isinstance(self.columns, str) else F.struct(*self.columns)
        side = self.table.select(F.col(self.key).alias(f"{out}_key"), answer.alias(out))
        if isinstance(side.schema[out].dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            side = side.withColumn(out, F.col(out).cast("bigint"))
        if not self.unique:
            side = side.where(F.col(f"{out}_key").isNotNull()).groupBy(f"{out}_key").agg(F.min(out).alias(out))
        test = wanted.col == F.col(f"{out}_key")
        if guard is not None:
            test = test & guard
        joined = df.join(side, test, "left").drop(f"{out}_key")
        err = wanted.err
        return joined.withColumn(f"{out}_err", (err if guard is None or err is None else F.when(guard, err)) if err is not None else F.lit(None).cast("string")), side.schema[out].dataType


def _called(function: Callable, names: list[str], rows: pd.DataFrame, retries: int, wait: float, threads: int, ignored: tuple = ()) -> tuple[list, list]:
    """Answers and failures of a function over rows; each row is retried by itself, waiting twice as long each time.

    A failure whose `code` is among the ignored ones isn't tried again.
    """

    def one(values):
        for attempt in range(retries + 1):
            try:
                return function(**dict(zip(names, values))), None
            except Exception as e:
                if attempt == retries or getattr(e, "code", None) in ignored:
                    return None, type(e).__name__
                time.sleep(wait * 2**attempt)

    with ThreadPoolExecutor(threads) as pool:
        got = list(pool.map(one, rows.itertuples(index=False, name=None)))
    return [a for a, _ in got], [e for _, e in got]


class PythonService(Service):
    """Calls a Python function with the arguments by name."""

    def __init__(self, function: Callable, returns: T.DataType | str, retries: int = 0, wait: float = 0.5, threads: int = 8, ignored: tuple = ()):
        self.function, self.retries, self.wait, self.threads, self.ignored = function, retries, wait, threads, tuple(ignored)
        self.returns = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def apply(self, df, args, out, guard):
        names, function, retries, wait, threads, ignored = list(args), self.function, self.retries, self.wait, self.threads, self.ignored
        schema = T.StructType([T.StructField("answer", self.returns), T.StructField("err", TEXT)])

        @F.pandas_udf(schema)
        def call(rows: pd.DataFrame) -> pd.DataFrame:
            answers, errors = pd.Series([None] * len(rows), dtype=object), pd.Series([None] * len(rows), dtype=object)
            wanted = rows["_call"].fillna(False).astype(bool).to_numpy()
            if wanted.any():
                a, e = _called(function, names, rows.loc[wanted, names].astype(object), retries, wait, threads, ignored)
                answers[wanted], errors[wanted] = a, e
            return pd.DataFrame({"answer": answers, "err": errors})

        failed = either(*(v.err for v in args.values()))
        wanted = (guard if guard is not None else F.lit(True)) & (failed.isNull() if failed is not None else F.lit(True))
        fields = [(v.col.cast("string") if v.type == VOID else v.col).alias(k) for k, v in args.items()]
        rows = df.withColumn(f"{out}_called", call(F.struct(*fields, wanted.alias("_call"))))
        err = F.col(f"{out}_called.err")
        if failed is not None:
            err = F.coalesce(failed if guard is None else F.when(guard, failed), err)
        return rows.withColumn(out, F.col(f"{out}_called.answer")).withColumn(f"{out}_err", err).drop(f"{out}_called"), self.returns


def render(template: str, args: dict[str, Value]) -> Value:
    """A template with `${name}` replaced by URL-encoded arguments; one that is missing is a failure."""
    parts, err, at = [], None, 0
    for m in re.finditer(r"\$\{([^}]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        v = args.get(m[1])
        if v is None:
            err = either(err, F.lit("IllegalArgumentException"))
        else:
            parts.append(F.url_encode(v.col.cast("string")))
            err = either(err, v.err, F.when(v.col.isNull(), F.lit("IllegalArgumentException")))
        at = m.end()
    return Value(F.concat(*parts, F.lit(template[at:])), TEXT, err)


class RemoteService(Service):
    """`get url` or `post url` and an optional body line; `transport(method, url, body)` makes the call.

    Without a transport the answer is the rendered request, which is how plans are
    tested; with one the calls run in batches, with retries (but none after an error
    whose `code` is ignored).  An answer that is JSON is a document, if `json` says so;
    a text that isn't fails with the class ValueError.
    """

    def __init__(self, code: str, transport: Callable[[str, str, str | None], str] | None = None, retries: int = 2, wait: float = 0.5, ignored: tuple = (), json: bool = False):
        lines = [x.strip() for x in code.strip().splitlines() if x.strip()]
        self.method, self.url = lines[0].split(None, 1)
        self.body = lines[1] if len(lines) > 1 else None
        self.transport, self.retries, self.wait, self.ignored, self.json = transport, retries, wait, ignored, json

    def apply(self, df, args, out, guard):
        url = render(self.url, args)
        body = render(self.body, args) if self.body else Value(F.lit(None).cast("string"), TEXT)
        if self.transport is None:
            text = F.concat_ws(" ", F.lit(self.method), url.col, body.col)
            err = either(url.err, body.err)
            keep = (guard if guard is not None else F.lit(True)) & (err.isNull() if err is not None else F.lit(True))
            return df.withColumn(out, F.when(keep, text)).withColumn(f"{out}_err", err if err is not None else F.lit(None).cast("string")), TEXT
        transport, method = self.transport, self.method
        inner = PythonService(lambda url, body: transport(method, url, body), TEXT, self.retries, self.wait, ignored=self.ignored)
        rows, kind = inner.apply(df, {"url": url, "body": body}, out, guard)
        if not self.json:
            return rows, kind
        bad = F.col(out).isNotNull() & F.try_parse_json(out).isNull()
        return rows.withColumn(f"{out}_err", F.when(bad, "ValueError").otherwise(F.col(f"{out}_err"))).withColumn(out, F.try_parse_json(out)), VARIANT


class SinkService(Service):
    """Emits key and value (all arguments as JSON, unless there is a `value`) and answers true.

    The planner gathers what sinks emit; `Plan.emitted` has the rows.
    """

    def __init__(self, topic: str):
        self.topic = topic

    def message(self, args: dict[str, Value]) -> Column:
        key = args["key"].col.cast("string") if "key" in args else F.lit("0")
        value = args["value"] if "value" in args else None
        whole = F.struct(*(v.col.alias(k) for k, v in args.items()))
        body = whole if value is None else value.col
        nested = value is None or isinstance(value.type, (T.StructType, T.ArrayType, T.MapType))
        return F.struct(F.lit(self.topic).alias("topic"), key.alias("key"), (F.to_json(body, {"ignoreNullFields": "false"}) if nested else body.cast("string")).alias("value"))

    def apply(self, df, args, out, guard):
        err = either(*(v.err for v in args.values()))
        return df.withColumn(out, F.lit(True)).withColumn(f"{out}_err", err if err is not None else F.lit(None).cast("string")), T.BooleanType()
