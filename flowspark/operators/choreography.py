"""Operators between flows: traffic buckets, subscriptions, experiments, callbacks, schedules, the flow graph."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, evaluate, variables_of
from ..plans.parser import parse_expression
from ..session import checkpointed
from . import values as V
from .values import Value, let


# -- buckets

def name_uuid(text: Column) -> Column:
    """The version-3 (MD5) UUID of a text's bytes."""

    def shape(h: Column) -> Column:
        variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    return let(F.md5(text.cast("binary")), shape)


def bucket(value: Column, kind: T.DataType = V.TEXT, suffix: str | None = None) -> Column:
    """0 to 99 from a text, or a number's text as a double; `suffix` separates independent divisions."""
    text = value.cast("double").cast("string") if V.is_number(kind) else value
    u = name_uuid(text)
    return F.crc32((F.concat(u, F.lit(f"Some({suffix})")) if suffix is not None else u).cast("binary")) % 100


def trace_id(trace: Column, event_id: Column) -> Column:
    """A trace's own name, or one made of its event's."""
    return F.coalesce(F.when(~trace.isin("", "-", "_"), trace), F.replace(name_uuid(event_id), F.lit("-"), F.lit("")))


# -- subscriptions

@dataclass(frozen=True)
class Subscription:
    """Rows of a publisher that a subscriber's flow also gets: `condition`, and `target`'s bucket in [low, high)."""

    name: str
    publisher: str
    subscriber: str
    buckets: tuple[int, int] = (0, 100)
    condition: str = "true"
    target: str | None = None
    arguments: tuple[tuple[str, str], ...] = ()


def _evaluate(text: str, variables: dict[str, Value]) -> Value:
    return evaluate(parse_expression(text), Scope(variables))


def subscribed(plan_df: DataFrame, variables: dict[str, Value], s: Subscription, event_id: str = "event_id") -> DataFrame:
    """The subscriber's events: the event id and its arguments."""
    test = _evaluate(s.condition, variables)
    target = _evaluate(s.target, variables) if s.target else V.of_column(F.col(event_id).cast("string"), V.TEXT)
    low, high = s.buckets
    passed = V.truthy(test) & (bucket(target.col, target.type) >= low) & (bucket(target.col, target.type) < high)
    if test.err is not None:
        passed = passed & test.err.isNull()
    return plan_df.where(passed).select(event_id, *(_evaluate(text, variables).col.alias(name) for name, text in s.arguments))


# -- experiments

@dataclass(frozen=True)
class Group:
    """A treatment: buckets [low, high) of its experiment, and the flows that it replaces, with their arguments."""

    name: str
    buckets: tuple[int, int]
    replacements: tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...] = ()


@dataclass(frozen=True)
class Experiment:
    name: str
    flow: str
    priority: int
    traffic: tuple[int, int]
    groups: tuple[Group, ...]
    condition: str = "true"
    target: str | None = None

    def dependencies(self) -> set[str]:
        """Names of the variables that condition, target and arguments read."""
        texts = [self.condition, *([self.target] if self.target else []), *(x for g in self.groups for _, _, args in g.replacements for _, x in args)]
        return set().union(*(parse_expression(t).references() for t in texts))


def assignments(experiments: list[Experiment], flow: str, value, own: Column) -> tuple[list[tuple[Column, Experiment, Group]], Column | None]:
    """(condition, experiment, group) of every treatment of a flow, no two at once, and the failure of an event that has none.

    `value` evaluates an expression's text; `own` is the event's id.  The first
    experiment by priority whose condition and traffic take the event wins; its group
    is the first whose buckets hold the target's.  A condition or target that fails,
    or a bucket that no group covers, fails the event.
    """
    if len({e.priority for e in experiments}) < len(experiments):
        raise ValueError("two experiments have one priority")
    out, free, failed = [], F.lit(True), None
    for e in sorted((e for e in experiments if e.flow == flow), key=lambda e: e.priority):
        test, b = value(e.condition), bucket(own)
        taken = free & F.coalesce(V.truthy(test) & (b >= e.traffic[0]) & (b < e.traffic[1]), F.lit(False))
        target = value(e.target) if e.target else Value(own, V.TEXT)
        place = bucket(target.col, target.type, e.name)
        bad = F.when(free & test.err.isNotNull(), test.err) if test.err is not None else F.lit(None).cast("string")
        taken = taken & bad.isNull()
        if target.err is not None:
            bad = F.when(taken & target.err.isNotNull(), target.err).otherwise(bad)
        covered = F.lit(False)
        for g in e.groups:
            inside = F.coalesce((place >= g.buckets[0]) & (place < g.buckets[1]), F.lit(False))
            out.append((taken & bad.isNull() & inside & ~covered, e, g))
            covered = covered | inside
        bad = F.when(bad.isNull() & taken & ~covered, F.lit(V.MISSING)).otherwise(bad)
        failed = bad if failed is None else F.coalesce(failed, bad)
        free = free & ~taken & bad.isNull()
    return out, failed


def with_plan(df: DataFrame, experiments: list[Experiment], flow: str, event_id: str = "event_id") -> DataFrame:
    """Adds `experiment`: struct<name, grp, flow, argument, error>, null outside all experiments.

    `flow` is the replacement of the given flow (itself if the group replaces
    nothing); `error` says why an event that an experiment takes has no group.
    """
    variables = variables_of(df)
    treatments, failed = assignments(experiments, flow, lambda text: _evaluate(text, variables), F.col(event_id).cast("string"))
    none = F.lit(None).cast("string")
    plan = None
    for test, e, g in treatments:
        new, args = next(((n, a) for o, n, a in g.replacements if o == flow), (flow, ()))
        argument = F.to_json(F.struct(*(_evaluate(x, variables).col.alias(k) for k, x in args))) if args else F.lit("{}")
        row = F.struct(F.lit(e.name).alias("name"), F.lit(g.name).alias("grp"), F.lit(new).alias("flow"), argument.alias("argument"), none.alias("error"))
        plan = F.when(test, row) if plan is None else plan.when(test, row)
    kind = "struct<name:string,grp:string,flow:string,argument:string,error:string>"
    if plan is None:
        return df.withColumn("experiment", F.lit(None).cast(kind))
    error = F.struct(none.alias("name"), none.alias("grp"), none.alias("flow"), none.alias("argument"), failed.alias("error"))
    return df.withColumn("experiment", plan.when(failed.isNotNull(), error).cast(kind))


def traffic_ranges(shares: list[int]) -> list[tuple[int, int]]:
    """Cumulative [low, high) ranges of shares in order."""
    out, at = [], 0
    for s in shares:
        out.append((at, at + s))
        at += s
    return out


# -- callbacks

def callbacks(registers: DataFrame, answers: DataFrame, timeout_ms: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each registration (trace, token, ts, event_id) with the first answer before its deadline, or its timeout.

    Both have (trace, token, ts, event_id), ts in milliseconds.  A registration
    waits until its deadline or until its token is registered again.  The token is
    used up by the first answer, so later ones find nothing.  One exchange on
    (trace, token) brings both sides together and a window does the rest: no pair
    of a registration and an answer is made.  A null token registers nothing.
    """
    left = registers.where("token IS NOT NULL").select("trace", "token", "ts", "event_id", F.lit(0).alias("kind"), *keep)
    right = answers.select("trace", "token", "ts", "event_id", F.lit(1).alias("kind"), *(F.lit(None).cast(registers.schema[k].dataType).alias(k) for k in keep))
    # from the end of time backwards, so that what follows is a running frame and costs one step a row
    later = Window.partitionBy("trace", "token").orderBy(F.desc("ts"), F.desc("kind"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    both = left.unionByName(right)
    following = F.last(F.when(F.col("kind") == 1, F.struct("ts", "event_id")), ignorenulls=True).over(later)
    again = F.last(F.when(F.col("kind") == 0, F.col("ts")), ignorenulls=True).over(later)
    rows = both.withColumn("answer", following).withColumn("again", again).where("kind = 0")
    deadline = F.least(F.col("ts") + timeout_ms, F.coalesce("again", F.col("ts") + timeout_ms))
    in_time = F.coalesce(F.col("answer.ts") <= deadline, F.lit(False)) & F.coalesce(F.col("answer.ts") < F.col("again"), F.lit(True))
    return rows.select(
        "trace", "token", "event_id", "ts", *keep, F.when(in_time, "callback").otherwise("timeout").alias("outcome"),
        F.when(in_time, F.col("answer.event_id")).alias("answer_id"), F.when(in_time, F.col("answer.ts")).otherwise(F.col("ts") + timeout_ms).alias("settled_ts"),
    )


@dataclass(frozen=True)
class Callback:
    """At the end of flow `register` a token is saved with arguments; the flow `answer` that loads it first gets them, or `late` does after the timeout."""

    register: str
    token: str
    answer: str
    late: str
    timeout_ms: int
    arguments: tuple[tuple[str, str], ...] = ()


def settled_events(settled: DataFrame, answers: DataFrame, arguments: str, event_id: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(answers with their token's arguments, timeouts as events), from what `callbacks` settled with `keep=("argument",)`.

    `arguments` is the DDL of the arguments.  An answer that found its token gets the
    arguments as `token_context`; one that came too late, or without a registration,
    has null there, which fails the include that loads it.  A timeout is an event at
    its deadline with the same arguments.
    """
    context = F.from_json("argument", arguments)
    won = settled.where("outcome = 'callback'").select(F.col("answer_id").alias(event_id), context.alias("token_context"))
    late = settled.where("outcome = 'timeout'").select(event_id, "trace", "token", F.col("settled_ts").alias("ts"), context.alias("token_context"))
    return answers.join(won, event_id, "left"), late


# -- schedules

def due(events: DataFrame, now_ms: Column | int, column: str = "scheduled_ts") -> DataFrame:
    """Scheduled events whose time has come; events at one time are all kept."""
    return events.where(F.col(column) < (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)))


def to_events(scheduled: DataFrame, event_id: str, trace: str, ts: str) -> DataFrame:
    """What a flow scheduled, as events: the parent's id and trace unless another was named."""
    return scheduled.select(
        F.col(event_id).cast("string").alias("parent_id"), F.coalesce(F.col("x_trace") if "x_trace" in scheduled.columns else F.col("trace"), F.col(trace).cast("string")).alias("trace_id"),
        "scope", "flow_name", (F.col(ts) + F.col("delay_ms")).alias("scheduled_ts"), "token", "argument",
    )


def drain(pending: DataFrame, library, now_ms: int, arguments: str, variables: dict[str, dict[str, str]], keys: tuple[str, ...] = ("event_id", "trace_id"), most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(executions, what is still to come): runs all scheduled events that are due, and what they schedule, until none is due.

    `pending` has `keys`, flow_name, scheduled_ts, path (the scopes that led there) and
    argument (JSON); `arguments` is the DDL of all flows' arguments and `variables` names
    what each flow's execution gives: (keys, flow_name, scheduled_ts, path, values as JSON).
    A round plans every flow of the library once over its due events and is written to
    the shared folder; more than `most` rounds fail.
    """
    from ..plans.flow import plan_flow

    columns = [*keys, "flow_name", "scheduled_ts", "path", "argument"]
    done, waiting = None, checkpointed(pending.select(*columns))
    for _ in range(most):
        now, later = due(waiting, now_ms, "scheduled_ts"), waiting.where(F.col("scheduled_ts") >= now_ms)
        names = [r[0] for r in now.select("flow_name").distinct().collect()]  # flows of the library
        if not names:
            if done is None:
                done = waiting.where("false").select(*keys, "flow_name", "scheduled_ts", "path", F.lit(None).cast("string").alias("values"))
            return done, waiting
        following = later
        for name in sorted(names):
            rows = now.where(F.col("flow_name") == name).select(*keys, "scheduled_ts", "path", F.from_json("argument", arguments).alias("a")).select(*keys, "scheduled_ts", "path", "a.*")
            plan = plan_flow(rows, library.flows[name], library, keys)
            out = variables.get(name, {})
            own = [(F.when(v.err.isNull(), v.col) if (v := plan.values[x]).err is not None else v.col).alias(k) for k, x in out.items()]
            values = F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if own else F.lit("{}")
            ran = plan.df.select(*keys, F.lit(name).alias("flow_name"), "scheduled_ts", "path", values.alias("values"))
            done = ran if done is None else done.unionByName(ran)
            if plan.scheduled:
                more = plan.schedule(*keys, "scheduled_ts", "path")
                following = following.unionByName(more.select(*keys, "flow_name", (F.col("scheduled_ts") + F.col("delay_ms")).alias("scheduled_ts"), F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "scope").alias("path"), "argument").select(*columns))
        done, waiting = checkpointed(done), checkpointed(following)
    raise RecursionError(f"more than {most} rounds of scheduled events")


# -- the flow graph

class FlowGraph:
    """Flows as vertices; includes, schedules, subscriptions and callbacks as edges.  Small, so it stays with the driver."""

    def __init__(self, edges: list[tuple[str, str, str]], duals: list[tuple[str, str]] = ()):
        self.edges = list(edges)
        self.duals = {**dict(duals), **{b: a for a, b in duals}}
        self.after: dict[str, list[tuple[str, str]]] = {}
        for a, b, kind in self.edges:
            self.after.setdefault(a, []).append((b, kind))

    @classmethod
    def of(cls, library, subscriptions: list[Subscription] = (), callbacks: list[tuple[str, str, str]] = ()) -> FlowGraph:
        """Of a library; callbacks are (register, callback, timeout) flows, whose last two are duals."""
        from ..plans.tree import Branch, Include
        from ..plans.tree import Schedule as Later

        edges = []

        def walk(name, block):
            for s in block:
                if isinstance(s, Include):
                    edges.append((name, s.flow, "include"))
                elif isinstance(s, Later):
                    edges.append((name, s.flow, "schedule"))
                elif isinstance(s, Branch):
                    for c in s.choices:
                        walk(name, c.block)

        for flow in library.flows.values():
            walk(flow.name, flow.block)
        edges += [(s.publisher, s.subscriber, "subscribe") for s in subscriptions]
        for register, answer, late in callbacks:
            edges += [(register, answer, "callback"), (register, late, "timeout")]
        return cls(edges, [(a, b) for _, a, b in callbacks])

    def path(self, start: str, end: str) -> list[str] | None:
        """A shortest path, both ends included."""
        before, queue = {start: None}, deque([start])
        while queue:
            v = queue.popleft()
            if v == end:
                out = []
                while v is not None:
                    out.append(v)
                    v = before[v]
                return out[::-1]
            for w, _ in self.after.get(v, ()):
                if w not in before:
                    before[w] = v
                    queue.append(w)
        return None

    def has_path(self, start: str, end: str) -> bool:
        return self.path(start, end) is not None

    def to_json(self) -> dict:
        vertices = sorted({x for a, b, _ in self.edges for x in (a, b)})
        return {"vertices": vertices, "edges": [{"from": a, "to": b, "kind": k} for a, b, k in sorted(self.edges)]}


def reachable(edges: DataFrame, start: str = "source", end: str = "target") -> DataFrame:
    """(start, end, hops): shortest distances between all vertices that a path joins, a vertex and itself among them if it is on a cycle.

    Distances double: what is 2 ** k + h hops apart (h at most 2 ** k) has a middle
    2 ** k hops from the start, so round k joins the pairs found last with all pairs.
    A round that finds nothing new ends it, after the logarithm of the longest
    distance.  Edges that miss an end, and repeated ones, count for nothing.
    """
    known = checkpointed(edges.select(F.col(start).alias("a"), F.col(end).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct().withColumn("hops", F.lit(1).cast("bigint")))
    reach = 1
    while True:
        far = known.where(F.col("hops") == reach).select("a", F.col("b").alias("middle"))
        near = known.select(F.col("a").alias("middle"), "b", "hops")
        found = far.join(near, "middle").groupBy("a", "b").agg((F.min("hops") + reach).alias("hops"))
        new = checkpointed(found.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known.select(F.col("a").alias(start), F.col("b").alias(end), "hops")
        known, reach = checkpointed(known.unionByName(new)), 2 * reach
