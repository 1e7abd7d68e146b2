"""Analysis logs: one row for each execution of a topic's key flow, with fields gathered around it; and the procedure view.

Procedures are rows (event_id, scope, seq, flow_name, choice, values): scope is the path
of includes as an array, seq the order of execution, values a map of variables to texts.
Executions of scheduled and callback events belong to the event that began it all: they
have its id, their scope begins with the path that led to them, and a time orders them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A tag (whether a flow was executed), a choice (names hit) or a variable of a flow.

    Forward fields come from executions before the key flow (the longest scope, of these
    the last), backward ones from below it (the shortest scope, of these the first).
    """

    name: str
    kind: str
    flow: str
    forward: bool
    variable: str | None = None


@dataclass(frozen=True)
class Topic:
    name: str
    flow: str
    fields: tuple[Field, ...]

    def problems(self) -> list[str]:
        """What is wrong with the definition."""
        names = [f.name for f in self.fields]
        out = [f"{self.name}: field {n} is defined twice" for n in sorted({n for n in names if names.count(n) > 1})]
        tagged = {f.flow for f in self.fields if f.kind == "tag"}
        return out + [f"{self.name}: {f} has no tag" for f in sorted({f.flow for f in self.fields} - tagged - {self.flow})]


def topic_log(procedures: DataFrame, topic: Topic, event: str = "event_id", order: tuple[str, ...] = ("seq",), pending: DataFrame | None = None, graph=None, detail: bool = False) -> DataFrame:
    """(event, scope, a column for each field): nothing for events that never ran the key flow.

    `order` are the columns that tell what was executed before.  One join on the event
    brings the key's and the fields' executions together; an event has at most a few
    hundred of them.  With `pending` (event, path, flow_name: scheduled events that
    haven't run) and the flow graph, rows are held back whose backward fields such an
    event below the key's scope can still reach; of two dual flows (a callback and its
    timeout) either settles both.  `detail` adds the scope that each field came from.
    """
    flows = sorted({f.flow for f in topic.fields})
    when = F.struct(*order)
    keys = procedures.where(F.col("flow_name") == topic.flow).select(event, F.col("scope").alias("key_scope"), when.alias("key_when"))
    others = procedures.where(F.col("flow_name").isin(*flows)).select(event, "scope", "flow_name", "choice", "values", when.alias("when"))
    rows = keys.join(others, event, "left")
    depth = F.size("scope")
    below = F.slice("scope", F.lit(1), F.size("key_scope")) == F.col("key_scope")
    aggregates = []
    for f in topic.fields:
        own = F.col("flow_name") == f.flow
        here = own & (F.col("scope") == F.col("key_scope"))
        test = own & ~below & (F.col("when") < F.col("key_when")) | here if f.forward else own & below
        value = {"tag": F.lit(True), "choice": F.array_join("choice", ","), "variable": F.try_element_at("values", F.lit(f.variable or f.name))}[f.kind]
        pick = F.max_by if f.forward else F.min_by
        place = F.when(test, F.struct(depth, F.col("when"), F.col("scope")))
        if f.kind == "tag":
            aggregates.append(F.coalesce(F.bool_or(test), F.lit(False)).alias(f.name))
        else:
            aggregates.append(pick(F.when(test, value), place).alias(f.name))
        if detail:
            aggregates.append(pick(F.when(test, F.concat_ws("/", "scope")), place).alias(f"{f.name}_scope"))
    out = rows.groupBy(event, "key_scope").agg(*aggregates).withColumn("scope", F.concat_ws("/", "key_scope")).drop("key_scope")
    if pending is None:
        return out
    needed = {f.flow for f in topic.fields if not f.forward}
    reaching = sorted(f for f in {v for a, b, _ in graph.edges for v in (a, b)} | needed if any(f == n or graph.has_path(f, n) or (graph.duals.get(f) and graph.has_path(graph.duals[f], n)) for n in needed))
    waiting = pending.where(F.col("flow_name").isin(*reaching)).select(F.col(event).alias("pending_event"), "path")
    inside = (F.col("scope") == "") | (F.col("path") == F.col("scope")) | F.startswith(F.col("path"), F.concat("scope", F.lit("/")))
    return out.join(waiting, (F.col(event) == F.col("pending_event")) & inside, "left_anti")


def procedure_view(procedures: DataFrame, event: str = "event_id", trace: str = "trace_id") -> DataFrame:
    """Flat rows: id = /trace/event/scope, its ancestor, and the ids of its children (scheduled ones too, by their paths) in order."""
    ident = F.concat_ws("/", F.lit(""), F.col(trace).cast("string"), F.col(event).cast("string"), F.when(F.size("scope") > 0, F.concat_ws("/", "scope")))
    rows = procedures.withColumn("id", ident)
    parent = F.concat_ws("/", F.lit(""), F.col(trace).cast("string"), F.col(event).cast("string"), F.when(F.size("scope") > 1, F.concat_ws("/", F.slice("scope", F.lit(1), F.size("scope") - 1))))
    rows = rows.withColumn("ancestor", F.when(F.size("scope") > 0, parent))
    below = rows.where("ancestor IS NOT NULL").groupBy(F.col("ancestor").alias("above")).agg(F.sort_array(F.collect_set("id")).alias("descendants"))
    return rows.join(below, F.col("id") == F.col("above"), "left").drop("above").withColumn("descendants", F.coalesce("descendants", F.array().cast("array<string>")))
