"""Flows to DataFrame plans.

Every event is a row and every variable a pair of columns: its value and, where it
can fail, why it failed.  Branches become CASE expressions and guards, lazy
variables are left out unless something eager needs them, includes are inlined, and
schedules and sinks become rows beside the result.  Nothing is executed here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import values as V
from ..operators.choreography import assignments
from ..operators.services import RemoteService, Service, SinkService
from ..operators.values import TEXT, VOID, Value
from .compiler import Scope, evaluate, variables_of
from .parser import parse_expression, parse_flow
from .tree import Assign, Branch, Composite, Evaluate, Flow, Include, Node, Schedule

#: Executions of flows in one event.
MOST_PROCEDURES = 256


class FlowError(ValueError):
    """A flow that can't be planned: an unknown name, flow or service, or one defined twice."""


class Library:
    """Flows by name, services and functions: what a flow may refer to."""

    def __init__(self, *flows: str | Flow, services: Mapping[str, Service] | None = None, functions: Mapping | None = None, methods: Mapping | None = None, transport=None, experiments: Sequence = (), callbacks: Sequence = ()):
        self.flows: dict[str, Flow] = {}
        self.experiments, self.callbacks = list(experiments), list(callbacks)
        self.services, self.functions, self.methods, self.transport = dict(services or {}), functions or {}, methods or {}, transport
        for f in flows:
            self.add(f)

    def add(self, flow: str | Flow) -> Flow:
        parsed = parse_flow(flow) if isinstance(flow, str) else flow
        if parsed.name in self.flows:
            raise FlowError(f"two flows are named {parsed.name}")
        self.flows[parsed.name] = parsed
        return parsed

    def service(self, flow: Flow, name: str) -> Service:
        if name in self.services:
            return self.services[name]
        code = flow.services.get(name, "")
        if code.split(None, 1)[:1] in (["get"], ["post"]):
            return RemoteService(code, self.transport)
        raise FlowError(f"{flow.name}: no service {name}")


def flow_id(text: str) -> str:
    return hashlib.md5(repr(parse_flow(text)).encode()).hexdigest()


@dataclass
class Procedure:
    """One execution of a flow, in the order of planning: when it runs, and what it read and made."""

    guard: Column | None
    flow: Flow
    scope: str
    arguments: dict[str, Value]
    plan: list
    assigned: list[tuple[str, Value]] = field(default_factory=list)
    composed: list[tuple[str, Value]] = field(default_factory=list)
    failed: list[tuple[str, Column, list[tuple[str, Column]]]] = field(default_factory=list)  # name, failure, failures that it read
    loaded: dict[str, Value] = field(default_factory=dict)
    scheduled: list[tuple[Column | None, str]] = field(default_factory=list)


def _nullable(t: T.DataType) -> T.DataType:
    """A type whose every part may be null, so that rows of several origins fit in one array."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType))
    return T.MapType(t.keyType, _nullable(t.valueType)) if isinstance(t, T.MapType) else t


def _texts(items: list[tuple[str, Value]]) -> Column:
    """map<string, string>: values as JSON texts (texts as they are); failed ones are left out."""
    if not items:
        return F.create_map().cast("map<string,string>")
    rows = F.array(*(F.struct(F.lit(k).alias("key"), _text(v).alias("value")) for k, v in items))
    return F.map_from_entries(F.filter(rows, lambda x: x["value"].isNotNull()))


def _text(v: Value) -> Column:
    nested = isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)) or v.type == V.VARIANT
    text = F.to_json(v.col, {"ignoreNullFields": "false"}) if nested else F.coalesce(v.col.cast("string"), F.lit("null"))
    return text if v.err is None else F.when(v.err.isNull(), text)


@dataclass
class Plan:
    """A planned flow: its rows, the values of its variables, and what it emits."""

    df: DataFrame
    values: dict[str, Value]
    choices: list[tuple[str, Column]] = field(default_factory=list)
    faults: list[tuple[str, Column]] = field(default_factory=list)
    scheduled: list[tuple[Column | None, Column]] = field(default_factory=list)
    messages: list[tuple[Column | None, Column]] = field(default_factory=list)
    procedures: list[Procedure] = field(default_factory=list)
    registered: list[tuple[Column | None, Column]] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)

    def select(self, *keep: str, **variables: str) -> DataFrame:
        """`keep` columns, and variables by new names; a failed variable is null."""
        out = [F.col(k) for k in keep]
        for name, variable in variables.items():
            v = self.values[variable]
            col = v.col.cast("string") if v.type == VOID else v.col
            out.append((F.when(v.err.isNull(), col) if v.err is not None else col).alias(name))
        return self.df.select(*out)

    def choice(self, scope: str = "") -> Column:
        """Names of the conditions that were taken, in source order."""
        own = [c for s, c in self.choices if s == scope]
        return F.filter(F.array(*own), lambda x: x.isNotNull()) if own else F.array().cast("array<string>")

    def fault(self) -> Column:
        """Failed variables with the class of each failure, as a map."""
        if not self.faults:
            return F.create_map().cast("map<string,string>")
        entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), e.alias("value")) for n, e in self.faults)), lambda x: x["value"].isNotNull())
        return F.map_from_entries(entries)

    def _rows(self, items, keep: tuple[str, ...]) -> DataFrame:
        if not items:
            raise FlowError("the flow emits nothing of this kind")
        types = T.ArrayType(_nullable(self.df.select(items[0][1].alias("x")).schema["x"].dataType))
        rows = F.array(*(F.when(g, x) if g is not None else x for g, x in items)).cast(types)
        return self.df.select(*keep, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select(*keep, "x.*")

    def schedule(self, *keep: str) -> DataFrame:
        """The events that the flow schedules: scope, flow_name, delay_ms, trace, token, argument (JSON) and experiment, the treatment they keep."""
        return self._rows(self.scheduled, keep)

    def emitted(self, *keep: str) -> DataFrame:
        """What sinks got: topic, key and value."""
        return self._rows(self.messages, keep)

    def fault_details(self) -> Column:
        """Failed variables with catalog and message, as a map; a message names the variables that had failed before."""
        items = []
        for p in self.procedures:
            for name, err, read in p.failed:
                before = F.array_join(F.filter(F.array(*(F.when(e.isNotNull(), F.lit(n)) for n, e in read)), lambda x: x.isNotNull()), ", ") if read else F.lit("")
                message = F.when((err == V.ARGUMENT) & (before != ""), F.concat(F.lit("failed before: "), before)).otherwise(F.concat(err, F.lit(f" in {name}")))
                path = f"{p.scope}/{name}" if p.scope else name
                items.append(F.struct(F.lit(path).alias("key"), F.when(err.isNotNull(), F.struct(err.alias("catalog"), message.alias("message"))).alias("value")))
        kind = "map<string,struct<catalog:string,message:string>>"
        if not items:
            return F.create_map().cast(kind)
        return F.map_from_entries(F.filter(F.array(*items), lambda x: x["value"].isNotNull())).cast(kind)

    def dead_letters(self, *keep: str, ignored: tuple[str, ...] = ()) -> DataFrame:
        """Events with a failure that isn't of the ignored classes, and their faults: what to look at, or to run again."""
        fault = self.fault()
        return self.df.select(*keep, F.map_filter(fault, lambda _, e: ~e.isin(*ignored) if ignored else F.lit(True)).alias("fault")).where(F.size("fault") > 0)

    def treatment(self, scope: str = "") -> Column:
        """struct<name, grp>: the experiment's treatment that the execution at a scope has."""
        own = [F.when(p.guard, _named(p.plan)) if p.guard is not None else _named(p.plan) for p in self.procedures if p.scope == scope]
        return F.coalesce(*own) if own else _named([])

    def registrations(self, *keep: str) -> DataFrame:
        """Tokens that wait for a callback: token, argument (JSON), answer, late and timeout_ms."""
        return self._rows(self.registered, keep)

    def procedure(self, *keep: str) -> DataFrame:
        """A row for each execution of a flow in an event: scope, seq (the order of execution), flow_name and choice."""
        items = [(p.guard, F.struct(F.lit(p.scope).alias("scope"), F.lit(i).cast("bigint").alias("seq"), F.lit(p.flow.name).alias("flow_name"), self.choice(p.scope).alias("choice"))) for i, p in enumerate(self.procedures)]
        return self._rows(items, keep)

    def procedure_log(self, *keep: str, detailed: bool = False) -> DataFrame:
        """As `procedure`, with argument, assign, composite, fault, load (maps of texts), schedule (flows) and experiment.

        Assigned variables are logged if the log is detailed or the flow's own
        configuration has `log = "enabled"`.
        """
        items = []
        for i, p in enumerate(self.procedures):
            logged = p.assigned if detailed or p.flow.config.get("log") == "enabled" else []
            faults = F.array(*(F.struct(F.lit(n).alias("key"), e.alias("value")) for n, e, _ in p.failed)) if p.failed else F.array().cast("array<struct<key:string,value:string>>")
            later = F.array(*(F.when(g, F.lit(n)) if g is not None else F.lit(n) for g, n in p.scheduled)) if p.scheduled else F.array().cast("array<string>")
            items.append((p.guard, F.struct(
                F.lit(p.scope).alias("scope"), F.lit(i).cast("bigint").alias("seq"), F.lit(p.flow.name).alias("flow_name"),
                _texts([(k[1:], v) for k, v in p.arguments.items() if len(k) > 1 and k[0] == "@" and k != "@#"]).alias("argument"), _texts(logged).alias("assign"),
                self.choice(p.scope).alias("choice"), _texts(p.composed).alias("composite"), F.map_from_entries(F.filter(faults, lambda x: x["value"].isNotNull())).alias("fault"),
                _texts(list(p.loaded.items())).alias("load"), F.filter(later, lambda x: x.isNotNull()).alias("schedule"), _named(p.plan).alias("experiment"),
            )))
        return self._rows(items, keep)


def _named(plan: list) -> Column:
    """struct<name, grp> of the treatment that a row has."""
    out = F.lit(None).cast("struct<name:string,grp:string>")
    for test, e, g in reversed(plan):
        out = F.when(test, F.struct(F.lit(e.name).alias("name"), F.lit(g.name).alias("grp"))).otherwise(out)
    return out


def delay_ms(text: str | None) -> int:
    """`10 minutes` in milliseconds; nothing is at once."""
    if not text:
        return 0
    number, unit = text.split()
    units = {"milli": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    for name, size in units.items():
        if unit.lower().startswith(name):
            return int(float(number) * size)
    raise FlowError(f"unknown delay {text!r}")


class Planner:
    """Plans one flow over a DataFrame of events; `keys` identify a row where a batch has to come back to it."""

    def __init__(self, library: Library, df: DataFrame, keys: tuple[str, ...] = (), trace: Mapping[str, Value] | None = None, deferred: tuple[str, ...] = (), experiment: str | None = None):
        self.library, self.keys, self.trace, self.deferred, self.experiment = library, keys, dict(trace or {}), deferred, experiment
        self.plan = Plan(df, {})
        self.columns = 0
        self.depth = 0

    # -- columns

    def keep(self, v: Value, guard: Column | None) -> Value:
        """A value as columns of its own, so that what refers to it doesn't repeat its expression."""
        self.columns += 1
        name = f"_v{self.columns}"
        col = v.col.cast("string") if v.type == VOID else v.col
        self.plan.df = self.plan.df.withColumn(name, F.when(guard, col) if guard is not None else col)
        err = None
        if v.err is not None:
            self.plan.df = self.plan.df.withColumn(f"{name}_err", F.when(guard, v.err) if guard is not None else v.err)
            err = F.col(f"{name}_err")
        return Value(F.col(name), v.type, err)

    def flag(self, c: Column) -> Column:
        self.columns += 1
        self.plan.df = self.plan.df.withColumn(f"_g{self.columns}", c)
        return F.col(f"_g{self.columns}")

    # -- blocks

    def run(self, name: str, arguments: Mapping[str, Value] | None = None) -> Plan:
        """Plan the flow for all events; `experiment` names a column with the treatment that scheduling gave an event, or null for none."""
        flow = self._flow(name)
        arguments = dict(arguments) if arguments is not None else variables_of(self.plan.df)
        caller = Frame(self, flow, arguments, "", None)
        given = []
        if self.experiment is not None:
            has = F.col(self.experiment)
            given = [(self.flag(F.coalesce((has["name"] == e.name) & (has["grp"] == g.name), F.lit(False))), e, g) for e in self.library.experiments for g in e.groups]
        values = self.enter(name, arguments, "", None, caller, given, self.experiment is not None)
        self.plan.values = {**{k: v for k, v in self.trace.items()}, **values}
        return self.plan

    def treatments(self, flow: str, caller: Frame, given: list) -> tuple[list, Column | None]:
        """(condition, experiment, group) of a flow's executions: the caller's treatment, or, without one, what the flow's experiments give."""
        if not any(e.flow == flow for e in self.library.experiments):
            return given, None
        free = F.lit(True)
        for test, _, _ in given:
            free = free & ~test
        value = lambda text: evaluate(parse_expression(text), Scope(_Lookup(caller), self.library.functions, self.library.methods, strict=True))
        own = caller.arguments.get("@event_id") or Value(F.col("event_id"), TEXT)
        found, failed = assignments(self.library.experiments, flow, value, own.col.cast("string"))
        return given + [(self.flag(free & test), e, g) for test, e, g in found], None if failed is None else F.when(free, failed)

    def enter(self, name: str, arguments: Mapping[str, Value], path: str, guard: Column | None, caller: Frame, given: list, assigned: bool = False) -> dict[str, Value]:
        """Execute a flow, or what its events' treatments put in its place; the values of its variables.

        If they are `assigned`, the given treatments are all there are.
        """
        plan, failed = (given, None) if assigned else self.treatments(name, caller, given)
        if failed is not None:  # such events fail here
            failed = self.keep(Value(failed if guard is None else F.when(guard, failed), TEXT), None).col
            self.plan.faults.append((f"{path}/experiment" if path else "experiment", failed))
            guard = self.flag(failed.isNull() if guard is None else guard & failed.isNull())
        routes: dict[tuple, list[Column]] = {}
        for test, _, g in plan:
            for original, new, more in g.replacements:
                if original == name:
                    routes.setdefault((new, more), []).append(test)
        if not routes:
            return self.execute(self._flow(name), dict(arguments), path, guard, plan)
        some, rest = [], F.lit(True) if guard is None else guard
        for (new, more), tests in routes.items():
            taken = tests[0]
            for t in tests[1:]:
                taken = taken | t
            own = self.flag(taken if guard is None else guard & taken)
            rest = rest & ~taken
            extra = {f"@{k}": self.keep(evaluate(parse_expression(x), Scope(_Lookup(caller), self.library.functions, self.library.methods, strict=True)), own) for k, x in more}
            some.append((own, self.execute(self._flow(new), {**arguments, **extra}, path, own, plan)))
        own = self.flag(rest)
        some.append((own, self.execute(self._flow(name), dict(arguments), path, own, plan)))
        names = list(dict.fromkeys(k for _, values in some for k in values))
        return {k: _switch([(g, values[k]) for g, values in some if k in values]) for k in names}

    def execute(self, flow: Flow, arguments: dict[str, Value], path: str, guard: Column | None, plan: list) -> dict[str, Value]:
        arguments["@"] = arguments.get("@") if not path else V.make_dict([(k[1:], v) for k, v in arguments.items() if len(k) > 1 and k != "@#"])
        procedure = Procedure(guard, flow, path, arguments, plan)
        self.plan.procedures.append(procedure)
        frame = Frame(self, flow, arguments, path, guard, procedure=procedure)
        frame.block(flow.block)
        if path:
            for name in list(frame.pending):
                if "->" not in name:
                    frame.define(frame.pending[name]) if name in frame.pending else None
        for c in self.library.callbacks:
            if c.register == flow.name:
                frame.register(c)
        return frame.values

    def _flow(self, name: str) -> Flow:
        if name not in self.library.flows:
            raise FlowError(f"no flow {name}")
        return self.library.flows[name]


def _defined(block) -> dict[str, list]:
    """Names that the statements of a block define, each with its statements."""
    out: dict[str, list] = {}
    for s in block:
        if isinstance(s, (Assign, Composite)):
            out.setdefault(s.name.lstrip("$"), []).append(s)
    return out


def _eager(block) -> bool:
    """Whether a block has anything that must run."""
    return any(not isinstance(s, (Assign, Composite)) and not (isinstance(s, Branch) and not any(_eager(c.block) for c in s.choices)) or isinstance(s, (Assign, Composite)) and s.mode == "eager" for s in block)


class Frame:
    """One execution of a flow (or a block of it) under a guard."""

    def __init__(self, planner: Planner, flow: Flow, arguments: Mapping[str, Value], scope: str, guard: Column | None, outer: Frame | None = None, procedure: Procedure | None = None):
        self.planner, self.flow, self.arguments, self.scope, self.guard, self.outer = planner, flow, arguments, scope, guard, outer
        self.procedure = procedure if procedure is not None or outer is None else outer.procedure
        self.values: dict[str, Value] = {}
        self.pending: dict[str, object] = {}

    def lookup(self, name: str) -> Value:
        """A variable for an expression: a failed one makes its dependents fail."""
        if name in self.pending:
            self.define(self.pending[name])
        frame: Frame | None = self
        while frame is not None:
            if name in frame.pending:
                frame.define(frame.pending[name])
            if name in frame.values:
                v = frame.values[name]
                return v if v.err is None else Value(v.col, v.type, F.when(v.err.isNotNull(), F.lit(V.ARGUMENT)))
            frame = frame.outer
        if name.startswith("@"):
            return self.arguments.get(name) or V.failure(VOID, V.MISSING)
        if name.startswith("$"):
            v = self.planner.trace.get(name) or V.failure(VOID, V.MISSING)
            if self.procedure is not None and name in self.planner.trace:
                self.procedure.loaded.setdefault(name, v)
            return v
        raise FlowError(f"{self.flow.name}: unknown variable {name}")

    def value(self, node: Node) -> Value:
        return evaluate(node, Scope(_Lookup(self), self.planner.library.functions, self.planner.library.methods, strict=True))

    def evaluated(self, e: Evaluate) -> Value:
        """The main value; where it fails (a null doesn't), the failover's."""
        main = self.value(e.main)
        if e.failover is None or main.err is None:
            return main
        other = self.value(e.failover)
        t = V.common([main.type, other.type])
        col = F.when(main.err.isNull(), V.cast_to(main, t)).otherwise(V.cast_to(other, t))
        return Value(col, t, None if other.err is None else F.when(main.err.isNotNull(), other.err))

    def block(self, statements) -> None:
        names = _defined(statements)
        for name, own in names.items():
            if len(own) > 1:
                raise FlowError(f"{self.flow.name}: {name} is defined twice")
        for s in statements:
            if isinstance(s, (Assign, Composite)):
                self.pending[s.name.lstrip("$")] = s
            elif isinstance(s, Branch):
                for name in {n for c in s.choices for n in self._inside(c.block)}:
                    self.pending[name] = s
            elif isinstance(s, Include):
                for v in self._exports(s.flow):
                    self.pending[f"{s.scope}->{v}"] = s
        for s in statements:
            if isinstance(s, (Assign, Composite)):
                if s.mode == "eager" or s.name.startswith("$"):
                    self.define(s)
            elif not isinstance(s, Branch) or any(_eager(c.block) for c in s.choices):
                self.define(s)

    def _inside(self, block) -> set[str]:
        """Names that a branch's block gives to the flow."""
        out = set(_defined(block))
        for s in block:
            if isinstance(s, Branch):
                out |= {n for c in s.choices for n in self._inside(c.block)}
            elif isinstance(s, Include) and s.flow not in self.planner.deferred and s.flow != self.flow.name:
                out |= {f"{s.scope}->{v}" for v in self._exports(s.flow) if "->" not in v}
        return out

    def _exports(self, name: str) -> set[str]:
        flow = self.planner.library.flows.get(name)
        return self._inside(flow.block) if flow else set()

    def define(self, s) -> None:
        """Run a statement once."""
        names = [k for k, p in self.pending.items() if p is s]
        for k in names:
            del self.pending[k]
        if isinstance(s, (Assign, Composite)) and s.name.lstrip("$") in self.values:
            return
        if isinstance(s, Assign):
            self.assign(s.name, self.evaluated(s.value), log=s.mode != "transient", read=s.value.references())
        elif isinstance(s, Composite):
            self.composite(s)
        elif isinstance(s, Branch):
            self.branch(s)
        elif isinstance(s, Include):
            self.include(s)
        elif isinstance(s, Schedule):
            self.schedule(s)

    def _failed_before(self, names) -> list[tuple[str, Column]]:
        """Variables among those that were read which can have failed."""
        out = []
        for n in sorted(names):
            frame: Frame | None = self
            while frame is not None and n not in frame.values:
                frame = frame.outer
            if frame is not None and frame.values[n].err is not None:
                out.append((n, frame.values[n].err))
        return out

    def assign(self, name: str, value: Value, log: bool = True, read=()) -> None:
        plain = name.lstrip("$")
        kept = self.planner.keep(value, self.guard)
        self.values[plain] = kept
        if name.startswith("$"):
            before = self.planner.trace.get(name)
            if self.guard is None or before is None:
                self.planner.trace[name] = kept
            else:
                t = V.common([kept.type, before.type])
                self.planner.trace[name] = self.planner.keep(Value(F.when(self.guard, V.cast_to(kept, t)).otherwise(V.cast_to(before, t)), t, _choose(self.guard, kept.err, before.err)), None)
        if log and self.procedure is not None:
            self.procedure.assigned.append((plain, kept))
        if kept.err is not None and log:
            self.planner.plan.faults.append((self._path(plain), kept.err))
            if self.procedure is not None:
                self.procedure.failed.append((plain, kept.err, self._failed_before(read)))

    def _path(self, name: str) -> str:
        return f"{self.scope}/{name}" if self.scope else name

    def composite(self, s: Composite) -> None:
        planner = self.planner
        service = planner.library.service(self.flow, s.service)
        planner.plan.calls.append(s.service)
        if s.over is not None:
            self.batch(s, service)
            return
        args = {k: planner.keep(self.value(n), self.guard) for k, n in s.arguments}
        planner.columns += 1
        out = f"_v{planner.columns}"
        planner.plan.df, t = service.apply(planner.plan.df, args, out, self.guard)
        if isinstance(service, SinkService):
            planner.plan.messages.append((self.guard, service.message(args)))
        self.composed(s, Value(F.col(out), t, F.col(f"{out}_err")))

    def composed(self, s: Composite, answer: Value) -> None:
        self.values[s.name.lstrip("$")] = answer
        self.planner.plan.faults.append((self._path(s.name), answer.err))
        if self.procedure is not None:
            self.procedure.composed.append((s.name, answer))
            self.procedure.failed.append((s.name, answer.err, self._failed_before({r for _, n in s.arguments for r in n.references()})))

    def batch(self, s: Composite, service: Service) -> None:
        """Each dict of a list goes to the service; the answers come back in place, or the whole batch fails."""
        planner = self.planner
        docs = planner.keep(self.value(s.over), self.guard)
        if not V.is_list(docs.type):
            raise FlowError(f"{self.flow.name}: {s.name} is no batch over a list")
        if not planner.keys:
            raise FlowError("a batch needs the keys of its rows")
        keys = list(planner.keys)
        rows = planner.plan.df.select(*keys, *(c for c in planner.plan.df.columns if c not in keys and c in self._read(s)), F.posexplode(docs.col).alias("_at", "_item"))
        item = Value(F.col("_item"), docs.type.elementType)
        scope = Scope(_Lookup(self), planner.library.functions, planner.library.methods, strict=True).inside(item, Value(F.col("_at").cast("bigint"), V.LONG))
        args = {f.name: Value(F.col(f"_item.{f.name}"), f.dataType) for f in item.type} if s.whole else {k: evaluate(n, scope) for k, n in s.arguments}
        answered, t = service.apply(rows, args, "_out", None)
        answers = answered.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_out"))), lambda x: x["_out"]).alias("_got"), F.min("_out_err").alias("_bad"))
        planner.columns += 1
        out = f"_v{planner.columns}"
        answers = answers.select(*(F.col(k).alias(f"{out}_{k}") for k in keys), F.col("_got").alias(out), F.col("_bad").alias(f"{out}_bad"))
        test = [F.col(k).eqNullSafe(F.col(f"{out}_{k}")) for k in keys]
        joined = planner.plan.df.join(answers, test, "left").drop(*(f"{out}_{k}" for k in keys))
        err = F.coalesce(docs.err, F.col(f"{out}_bad")) if docs.err is not None else F.col(f"{out}_bad")
        empty = F.when(docs.col.isNotNull() & (F.size(docs.col) == 0), F.array().cast(T.ArrayType(t)))
        planner.plan.df = joined.withColumn(out, F.coalesce(F.col(out), empty)).withColumn(f"{out}_err", err).drop(f"{out}_bad")
        self.composed(s, Value(F.col(out), T.ArrayType(t), F.col(f"{out}_err")))

    def _read(self, s: Composite) -> set[str]:
        """Columns that a batch's arguments may read besides the element."""
        names = {r for _, n in s.arguments for r in n.references()}
        out = set()
        for r in names:
            if r.startswith("@"):
                out |= {r[1:]} if len(r) > 1 else set(self.planner.plan.df.columns)
            else:
                v = self.lookup(r)
                out |= {c for c in self.planner.plan.df.columns if c in str(v.col)}
        return out

    def branch(self, s: Branch) -> None:
        planner = self.planner
        if not s.choices:
            return
        taken: Column | None = None
        for c in s.choices:
            for name, condition in c.conditions:
                v = self.evaluated(condition)
                test = V.truthy(v) if v.err is None else v.err.isNull() & V.truthy(v)
                taken = F.when(test, F.lit(name)) if taken is None else taken.when(test, F.lit(name))
        if self.guard is not None:
            taken = F.when(self.guard, taken)
        choice = planner.keep(Value(taken, TEXT), None).col
        planner.plan.choices.append((self.scope, choice))
        blocks = []
        for c in s.choices:
            guard = planner.flag(F.coalesce(choice.isin(*(n for n, _ in c.conditions)), F.lit(False)))
            frame = Frame(planner, self.flow, self.arguments, self.scope, guard, self)  # part of the same execution
            frame.block(c.block)
            blocks.append((guard, frame))
        for name in {n for c in s.choices for n in self._inside(c.block)}:
            some = []
            for guard, frame in blocks:
                if name in frame.pending:
                    frame.define(frame.pending[name])
                if name in frame.values:
                    some.append((guard, frame.values[name]))
            if some:
                self.values[name] = _switch(some)

    def include(self, s: Include) -> None:
        planner = self.planner
        path = f"{self.scope}/{s.scope}" if self.scope else s.scope
        arguments = {f"@{k}": planner.keep(self.evaluated(e), self.guard) for k, e in s.arguments}
        guard = self.guard
        if s.token is not None:
            token = self.evaluated(s.token)
            context = planner.trace.get("@#")
            arguments["@#"] = context if context is not None else V.failure(VOID, V.MISSING)
            test = token.col.isNotNull() if token.err is None else token.err.isNull() & token.col.isNotNull()
            guard = planner.flag(test if guard is None else guard & test)
        if s.flow in planner.deferred:
            planner.plan.scheduled.append((guard, self._event(s.scope, s.flow, arguments, 0, None, None)))
            return
        planner.depth += 1
        if planner.depth > MOST_PROCEDURES:
            raise FlowError(f"more than {MOST_PROCEDURES} executions of flows; plan a recursive flow with `iterate`")
        if "@event_id" in self.arguments:
            arguments.setdefault("@event_id", self.arguments["@event_id"])
        given = self.procedure.plan if self.procedure is not None else []
        for name, v in planner.enter(s.flow, arguments, path, guard, self, given).items():
            self.values[f"{s.scope}->{name}"] = v

    def register(self, c) -> None:
        """Save a token with its arguments, and schedule the timeout; a null token saves nothing."""
        planner = self.planner
        token = planner.keep(self.value(parse_expression(c.token)), self.guard)
        waits = token.col.isNotNull() if token.err is None else token.err.isNull() & token.col.isNotNull()
        guard = planner.flag(F.coalesce(waits if self.guard is None else self.guard & waits, F.lit(False)))
        arguments = {f"@{k}": planner.keep(self.value(parse_expression(x)), guard) for k, x in c.arguments}
        event = self._event(c.answer, c.late, arguments, c.timeout_ms, None, token)
        planner.plan.scheduled.append((guard, event))
        if self.procedure is not None:
            self.procedure.scheduled.append((guard, c.late))
        planner.plan.registered.append((guard, F.struct(token.col.cast("string").alias("token"), event["argument"].alias("argument"), F.lit(c.answer).alias("answer"), F.lit(c.late).alias("late"), F.lit(c.timeout_ms).cast("bigint").alias("timeout_ms"))))

    def _event(self, scope: str, flow: str, arguments: Mapping[str, Value], delay: int, trace: Value | None, token: Value | None) -> Column:
        own = [v.col.alias(k[1:]) for k, v in arguments.items() if k not in ("@", "@#")]
        return F.struct(
            F.lit(scope).alias("scope"), F.lit(flow).alias("flow_name"), F.lit(delay).cast("bigint").alias("delay_ms"),
            (trace.col.cast("string") if trace is not None else F.lit(None).cast("string")).alias("trace"),
            (token.col.cast("string") if token is not None else F.lit(None).cast("string")).alias("token"),
            (F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if own else F.lit("{}")).alias("argument"),
            _named(self.planner.treatments(flow, self, self.procedure.plan if self.procedure is not None else [])[0]).alias("experiment"),
        )

    def schedule(self, s: Schedule) -> None:
        arguments = {f"@{k}": self.planner.keep(self.evaluated(e), self.guard) for k, e in s.arguments}
        trace = self.evaluated(s.trace) if s.trace else None
        token = self.evaluated(s.token) if s.token else None
        self.planner.plan.scheduled.append((self.guard, self._event(s.scope, s.flow, arguments, delay_ms(s.delay), trace, token)))
        if self.procedure is not None:
            self.procedure.scheduled.append((self.guard, s.flow))


class _Lookup(Mapping):
    """A frame's variables for the compiler."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def __contains__(self, name) -> bool:
        return True

    def __getitem__(self, name: str) -> Value:
        return self.frame.lookup(name)

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0


def _choose(guard: Column, a: Column | None, b: Column | None) -> Column | None:
    none = F.lit(None).cast("string")
    return None if a is None and b is None else F.when(guard, none if a is None else a).otherwise(none if b is None else b)


def _switch(some: list[tuple[Column, Value]]) -> Value:
    """A variable of several blocks: the taken one's, else null."""
    t = V.common([v.type for _, v in some])
    col = err = None
    for guard, v in some:
        own = V.cast_to(v, t)
        col = F.when(guard, own) if col is None else col.when(guard, own)
    if any(v.err is not None for _, v in some):
        for guard, v in some:
            own = v.err if v.err is not None else F.lit(None).cast("string")
            err = F.when(guard, own) if err is None else err.when(guard, own)
    return Value(col, t, err)


def plan_flow(df: DataFrame, flow: str | Flow, library: Library | None = None, keys: tuple[str, ...] = (), **options) -> Plan:
    """Plan a flow (its text) over events; the other flows it names are in the library."""
    library = library or Library()
    parsed = parse_flow(flow) if isinstance(flow, str) else flow
    if parsed.name not in library.flows:
        library.add(parsed)
    return Planner(library, df, keys, **options).run(parsed.name)


def validate(library: Library) -> list[str]:
    """What is wrong with the flows of a library: flows that aren't there, names defined twice, references to nothing.

    Configured experiments, callbacks and their expressions are looked at too.
    """
    out = []

    def names(block) -> set[str]:
        own = set(_defined(block))
        for s in block:
            if isinstance(s, Branch):
                own |= {n for c in s.choices for n in names(c.block)}
            elif isinstance(s, Include):
                own |= {f"{s.scope}->{n}" for n in exported(s.flow)}
        return own

    def exported(name: str) -> set[str]:
        flow = library.flows.get(name)
        return set() if flow is None else {n for n in _names_of(flow.block)}

    def read(s) -> set[str]:
        if isinstance(s, Assign):
            return s.value.references()
        if isinstance(s, Composite):
            return {r for _, n in s.arguments for r in n.references()} | (s.over.references() if s.over is not None else set())
        if isinstance(s, Branch):
            return {r for c in s.choices for _, e in c.conditions for r in e.references()}
        if isinstance(s, (Include, Schedule)):
            more = [x for x in (s.token, getattr(s, "trace", None)) if x is not None]
            return {r for _, e in s.arguments for r in e.references()}.union(*(e.references() for e in more))
        return set()

    def references(flow: Flow, block, known: set[str]) -> None:
        for s in block:
            out.extend(f"{flow.name}: unknown variable {r}" for r in sorted(read(s)) if r[:1] not in "@$" and r not in known)
            if isinstance(s, Branch):
                for c in s.choices:
                    references(flow, c.block, known)

    def walk(flow: Flow, block) -> None:
        for name, own in _defined(block).items():
            if len(own) > 1:
                out.append(f"{flow.name}: {name} is defined twice")
        for s in block:
            if isinstance(s, (Include, Schedule)) and s.flow not in library.flows:
                out.append(f"{flow.name}: no flow {s.flow}")
            if isinstance(s, Branch):
                for c in s.choices:
                    walk(flow, c.block)

    for flow in library.flows.values():
        walk(flow, flow.block)
        references(flow, flow.block, names(flow.block))
    for e in library.experiments:
        flows = {e.flow} | {x for g in e.groups for original, new, _ in g.replacements for x in (original, new)}
        out += [f"{e.name}: no flow {f}" for f in sorted(flows - set(library.flows))]
    for c in library.callbacks:
        out += [f"callback of {c.register}: no flow {f}" for f in (c.register, c.answer, c.late) if f not in library.flows]
        own = library.flows.get(c.register)
        texts = [c.token, *(x for _, x in c.arguments)]
        known = names(own.block) if own else set()
        out += [f"callback of {c.register}: unknown variable {r}" for r in sorted({r for t in texts for r in parse_expression(t).references()}) if r[:1] not in "@$" and r not in known]
    return out


def _names_of(block) -> set[str]:
    """Plain names that a block and its branches define."""
    return set(_defined(block)).union(*(_names_of(c.block) for s in block if isinstance(s, Branch) for c in s.choices))
