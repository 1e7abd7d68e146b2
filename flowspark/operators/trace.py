"""Trace variables in batch: updates that are folds become window functions.

`$s <- $s + e !! e0` is a running sum, `$m <- [$m, e].max() !! e0` (or min) a
running extreme, and `$x <- e` keeps the last value.  For these the state before
each event is a window over its trace in event order.  Any other update is run by
the interpreter, trace by trace (`stateful`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compiler import Scope, evaluate, variables_of
from ..plans.flow import Library, Plan, Planner, plan_flow
from ..plans.parser import parse_flow
from ..plans.tree import Assign, Flow, Node
from ..session import checkpointed
from . import values as V
from .values import Value


class NoFold(ValueError):
    """An update that is no recognised fold."""


def _reads(node: Node | None, names: set[str]) -> bool:
    return node is not None and any(r in names for r in node.references())


def recognise(flow: Flow) -> dict[str, tuple[str, Node, Node]]:
    """(kind, update, first) of every trace variable that the flow's own block updates."""
    updates: dict[str, Assign] = {}
    for s in flow.block:
        if isinstance(s, Assign) and s.name.startswith("$"):
            updates[s.name] = s
    local = {s.name: s for s in flow.block if isinstance(s, Assign) and not s.name.startswith("$")}
    out = {}
    for name, s in updates.items():
        main, other = _inlined(s.value.main, local), s.value.failover
        first = _inlined(other, local) if other else None
        if not _reads(main, {name}):
            kind, update = "last", main
            first = main
        elif main.op == "arith" and main.args[0] == "+" and main.args[1] == Node("ref", (name,)) and not _reads(main.args[2], {name}):
            kind, update = "sum", main.args[2]
        elif main.op == "apply" and main.args[0] in ("max", "min") and main.args[1].op == "list" and len(main.args[1].args[0]) == 2 and main.args[1].args[0][0] == Node("ref", (name,)):
            kind, update = main.args[0], main.args[1].args[0][1]
        else:
            raise NoFold(f"{flow.name}: {name}")
        if kind != "last" and first is None or any(r.startswith("$") for n in (update, first) for r in n.references()):
            raise NoFold(f"{flow.name}: {name}")
        out[name] = (kind, update, first)
    return out


def _inlined(node: Node, local: dict[str, Assign]) -> Node:
    """An expression with the flow's plain variables replaced by their definitions."""
    if node.op == "ref" and node.args[0] in local and local[node.args[0]].value.failover is None:
        return _inlined(local[node.args[0]].value.main, local)

    def inner(x):
        return _inlined(x, local) if isinstance(x, Node) else tuple(inner(y) for y in x) if isinstance(x, tuple) else x

    return Node(node.op, tuple(inner(a) for a in node.args))


def before_each(df: DataFrame, folds: dict[str, tuple[str, Node, Node]], trace: str, order: list[str], functions=None, methods=None) -> tuple[DataFrame, dict[str, Value]]:
    """Adds the state before each event; an event that fails to update leaves it as it was."""
    variables = variables_of(df)
    past = Window.partitionBy(trace).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(trace).orderBy(*order)
    state = {}
    for k, (name, (kind, update, first)) in enumerate(folds.items()):
        scope = Scope(variables, functions, methods, strict=True)
        v, v0 = evaluate(update, scope), evaluate(first, scope)
        t = V.common([v.type, v0.type])
        col = F.when(v.err.isNull(), V.cast_to(v, t)) if v.err is not None else V.cast_to(v, t)
        start = F.when(v0.err.isNull(), V.cast_to(v0, t)) if v0.err is not None else V.cast_to(v0, t)
        if kind != "last":  # the first event of a trace has no state, so its update is the failover
            df = df.withColumn(f"_s{k}_n", F.row_number().over(own))
            col = F.when(F.col(f"_s{k}_n") == 1, start).otherwise(col)
        df = df.withColumn(f"_s{k}_e", col)
        step = F.col(f"_s{k}_e")
        op = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c), "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        df = df.withColumn(f"_s{k}", op(step).over(past)).withColumn(f"_s{k}_err", F.when(F.count(step).over(past) == 0, F.lit(V.MISSING)))
        state[name] = Value(F.col(f"_s{k}"), t, F.col(f"_s{k}_err"))
    return df, state


def run_traces(df: DataFrame, flow: str, trace: str, order: list[str], library: Library | None = None) -> Plan:
    """Plan a flow with trace variables over all events of all traces."""
    library = library or Library()
    parsed = library.flows.get(parse_flow(flow).name) or library.add(flow)
    folds = recognise(parsed)
    events = df.columns
    staged, state = before_each(df, folds, trace, order, library.functions, library.methods)
    planner = Planner(library, staged, (), state)
    return planner.run(parsed.name, {k: v for k, v in variables_of(df).items() if k == "@" or k[1:] in events})


def iterate(df: DataFrame, flow: str, library: Library | None, keys: tuple[str, ...], out: dict[str, str], argument: str, most: int = 256, store=None) -> DataFrame:
    """A flow that includes itself: each round plans one execution and its include's rows are the next round's events.

    `argument` is the DDL of the arguments.  Gives `keys`, `depth` and the variables
    of every execution.  `store` cuts the lineage of a round (a checkpoint by
    default); the rows shrink from round to round, and more than `most` rounds fail.
    """
    library = library or Library()
    parsed = library.flows.get(parse_flow(flow).name) or library.add(flow)
    results, rows, depth = None, df, 0
    while True:
        if depth >= most:
            raise RecursionError(f"{parsed.name}: more than {most} executions")
        plan = plan_flow(rows, parsed, library, keys, deferred=(parsed.name,))
        got = plan.select(*keys, **out).withColumn("depth", F.lit(depth).cast("bigint"))
        results = got if results is None else results.unionByName(got)
        following = plan.schedule(*keys).select(*keys, F.from_json("argument", argument).alias("a")).select(*keys, "a.*")
        rows = (store or checkpointed)(following)
        depth += 1
        if rows.isEmpty():
            return results
