"""Functions of the user: Python files by directory, visible in their directory and below it.

`functions/` and `methods/` directories hold one file for each function, named like
it; the longest directory that leads to a flow wins.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.values import LONG, TEXT, Value, either


def column_function(f: Callable) -> Callable[..., Value]:
    """A function of Values as it is (a macro of columns)."""
    return f


def python_function(f: Callable, returns: T.DataType | str = LONG) -> Callable[..., Value]:
    """A plain Python function over scalars, run in Arrow batches; an exception marks its own row."""
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def run(*args: Value) -> Value:
        schema = T.StructType([T.StructField("v", kind), T.StructField("e", TEXT)])

        @F.pandas_udf(schema)
        def call(rows: pd.DataFrame) -> pd.DataFrame:
            out, bad = [], []
            for row in rows.itertuples(index=False, name=None):
                try:
                    out.append(f(*(None if x is None or x != x else x for x in row)))
                    bad.append(None)
                except Exception as e:
                    out.append(None)
                    bad.append(type(e).__name__)
            return pd.DataFrame({"v": pd.Series(out, dtype=object), "e": pd.Series(bad, dtype=object)})

        got = call(F.struct(*(a.col.alias(f"a{i}") for i, a in enumerate(args))))
        return Value(got["v"], kind, either(*(a.err for a in args), got["e"]))

    return run


def load(root: str, kind: str = "functions", returns: T.DataType | str = LONG) -> dict[str, dict[str, Callable[..., Value]]]:
    """Functions by directory (as a flow path, `/` for the root) and name."""
    out: dict[str, dict[str, Callable[..., Value]]] = {}
    for file in sorted(Path(root).rglob(f"{kind}/*.py")):
        space: dict = {}
        exec(compile(file.read_text(), str(file), "exec"), space)
        where = "/" + file.parent.parent.relative_to(root).as_posix().strip(".").strip("/")
        out.setdefault(where, {})[file.stem] = python_function(space[file.stem], returns)
    return out


def visible(functions: dict[str, dict[str, Callable[..., Value]]], flow: str) -> dict[str, Callable[..., Value]]:
    """What a flow sees: the functions of the directories that lead to it, the nearest last."""
    out: dict[str, Callable[..., Value]] = {}
    for where in sorted(functions, key=len):
        if where == "/" or flow == where or flow.startswith(where + "/"):
            out |= functions[where]
    return out




def merged(*layers: dict[str, Callable[..., Value]]) -> dict[str, Callable[..., Value]]:
    """Functions of several origins by name, a later one in the place of an earlier one: files first, then extensions.

    The built-in ones come last of all: the compiler prefers them to any of these.
    """
    out: dict[str, Callable[..., Value]] = {}
    for layer in layers:
        out |= layer
    return out
