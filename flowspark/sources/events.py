"""Sources: a registry of configured inputs, and the way from raw records to events."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import values as V
from ..operators.choreography import trace_id
from ..plans.compiler import Scope, evaluate
from ..plans.parser import parse_expression
from ..session import checkpointed


@dataclass
class SourceConfig:
    """A configured source: the factory that makes it, the flow its events start, its parameters."""

    name: str
    factory: str
    flow: str
    parameter: dict = field(default_factory=dict)


def _kafka(spark: SparkSession, p: dict, stream: bool) -> DataFrame:
    """Records of Kafka topics; offsets are committed by the query's checkpoint.  Needs Spark's Kafka package."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    options = {"kafka.bootstrap.servers": p["servers"], "subscribe": p["topics"], "startingOffsets": p.get("offset", "latest" if stream else "earliest")}
    if stream and "permits" in p:  # back-pressure
        options["maxOffsetsPerTrigger"] = str(p["permits"])
    rows = reader.options(**options).load()
    if "class-name" in p:  # needs Spark's protobuf package
        from pyspark.sql.protobuf.functions import from_protobuf

        return rows.select(from_protobuf("value", p["class-name"], p["descriptor"]).alias("document"))
    return rows.select(F.col("value").cast("string").alias("raw"))


def _files(spark: SparkSession, p: dict, stream: bool) -> DataFrame:
    if stream:
        reader = spark.readStream.schema(p["schema"])
        return (reader.option("maxFilesPerTrigger", p["permits"]) if "permits" in p else reader).format(p.get("format", "parquet")).load(p["path"])
    reader = spark.read.schema(p["schema"]) if "schema" in p else spark.read
    return reader.format(p.get("format", "parquet")).load(p["path"])


class Sources:
    """Factories by name, and the sources that a configuration lists."""

    def __init__(self):
        self.factories: dict[str, Callable[[SparkSession, dict, bool], DataFrame]] = {"kafka": _kafka, "files": _files}
        self.configs: dict[str, SourceConfig] = {}
        self.running: dict[str, object] = {}

    def register(self, factory: str, make: Callable[[SparkSession, dict, bool], DataFrame]) -> None:
        self.factories[factory] = make

    def configure(self, *configs: SourceConfig) -> None:
        for c in configs:
            if c.factory not in self.factories:
                raise ValueError(f"no source factory {c.factory}")
            self.configs[c.name] = c

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        c = self.configs[name]
        return self.factories[c.factory](spark, c.parameter, False)

    def start(self, spark: SparkSession, name: str, handle: Callable[[DataFrame, SourceConfig], object]) -> object:
        """Start a source as a stream; `handle` makes a query of its rows."""
        c = self.configs[name]
        self.running[name] = handle(self.factories[c.factory](spark, c.parameter, True), c)
        return self.running[name]

    def stop(self, name: str | None = None) -> None:
        """Stop one source, or all."""
        for n in [name] if name else list(self.running):
            query = self.running.pop(n, None)
            if hasattr(query, "stop"):
                query.stop()


def parsed(raw: DataFrame, schema: str | None = None, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(events with `document`, records that are no objects).

    With a schema the document is typed, else dynamic.  A record that isn't a JSON
    object is skipped, and kept apart.
    """
    anything = F.try_parse_json(column)
    whole = F.coalesce(F.schema_of_variant(anything).startswith("OBJECT"), F.lit(False))
    rows = raw.withColumn("_object", whole)
    document = F.from_json(column, schema) if schema else anything
    return rows.where("_object").drop("_object").withColumn("document", document), rows.where(~F.col("_object")).drop("_object")


def extracted(events: DataFrame, expressions: dict[str, str], document: str = "document") -> DataFrame:
    """Adds each expression over the document's fields (`@name`), and all of them as `argument` (JSON).

    If any fails, `extract_failed` is set, all are null, and `argument` is the document as it came.
    """
    t = events.schema[document].dataType
    root = V.of_column(F.col(document), t)
    names = t.fieldNames() if hasattr(t, "fieldNames") else []
    variables = {"@": root} | {f"@{n}": V.of_column(F.col(f"{document}.{n}"), t[n].dataType) for n in names}
    values = {k: evaluate(parse_expression(x), Scope(variables)) for k, x in expressions.items()}
    err = V.either(*(v.err for v in values.values()))
    out = events.withColumn("extract_failed", err.isNotNull() if err is not None else F.lit(False))
    own = {k: v.col.cast("string") if v.type == V.VOID else v.col for k, v in values.items()}
    whole = F.to_json(F.struct(*(c.alias(k) for k, c in own.items())), {"ignoreNullFields": "false"})
    return out.select("*", *(F.when(~F.col("extract_failed"), c).alias(k) for k, c in own.items()), F.when(F.col("extract_failed"), F.to_json(document)).otherwise(whole).alias("argument"))


def with_trace(events: DataFrame, event_id: str = "event_id", trace: str | None = None) -> DataFrame:
    """Adds `trace_id`: the column or expression `trace`, else a name made of the event id."""
    own = F.lit(None).cast("string")
    if trace is not None:
        own = F.col(trace).cast("string") if trace in events.columns else F.expr(trace).cast("string")
    return events.withColumn("trace_id", trace_id(own, F.col(event_id).cast("string")))


def with_event_id(events: DataFrame, column: str = "event_id") -> DataFrame:
    """Adds an id of 24 hexadecimal digits: seconds, the session and partition, a counter.

    The rows are computed once (a checkpoint), as their ids must not change.
    """
    session = F.lit(events.sparkSession.sparkContext.applicationId)
    number = F.monotonically_increasing_id()  # the partition above the counter's 33 bits
    high = F.shiftright(number, 24).cast("string")
    seconds = F.lpad(F.lower(F.hex(F.unix_timestamp())), 8, "0")
    return checkpointed(events.withColumn(column, F.concat(seconds, F.substring(F.md5(F.concat_ws(":", session, F.lit(uuid.uuid4().hex), high).cast("binary")), 1, 10), F.lpad(F.lower(F.hex(number.bitwiseAND(0xFFFFFF))), 6, "0"))))


class TimedOut(TimeoutError):
    """A job that didn't end in time and was cancelled."""


def within(df: DataFrame, seconds: float) -> list:
    """The collected rows of a small result; a job that takes longer is cancelled."""
    context = df.sparkSession.sparkContext
    tag = f"within-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def run_flow(spark: SparkSession, flow: str, event: dict, schema: str, library=None, seconds: float = 10.0) -> dict:
    """One event, run at once as a request would: its executions, faults and what it scheduled.

    An event without an id gets one, and without a trace one made of its id.
    """
    from ..plans.flow import plan_flow

    rows = push(spark, [event], schema)
    if "event_id" not in rows.columns:
        rows = with_event_id(rows)
    rows = rows if "trace_id" in rows.columns else with_trace(rows)
    plan = plan_flow(rows, flow, library)
    [log, fault] = within(plan.procedure_log("event_id", "trace_id", detailed=True), seconds), within(plan.df.select(plan.fault_details().alias("fault")), seconds)
    scheduled = within(plan.schedule(), seconds) if plan.scheduled else []
    return {"event_id": log[0].event_id, "trace_id": log[0].trace_id, "procedures": [r.asDict(True) for r in log], "fault": {k: v.asDict() for k, v in fault[0].fault.items()}, "scheduled": [r.asDict(True) for r in scheduled]}


def push(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Events handed in directly (as a request would), for a plan that is run at once."""
    return spark.createDataFrame(rows, schema)


def append(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Events handed in to be run later: files that a stream reads."""
    events.write.mode("append").format(fmt).save(path)


def files_of(root: str, extension: str) -> dict[str, str]:
    """Texts of all files with an extension below a directory, by path without it."""
    base = Path(root)
    return {"/" + p.relative_to(base).with_suffix("").as_posix(): p.read_text() for p in sorted(base.rglob(f"*{extension}"))}


def library_of(root: str, **options):
    """All `.flow` files below a directory as one library."""
    from ..plans.flow import Library

    return Library(*files_of(root, ".flow").values(), **options)


class Reloading:
    """A directory's library, read again when a file was changed; a state with problems leaves the last good one in use."""

    def __init__(self, root: str, **options):
        self.root, self.options, self.stamp, self.library, self.problems = root, options, None, None, []

    def current(self):
        from ..plans.flow import validate

        stamp = sorted((str(p), p.stat().st_mtime_ns) for p in Path(self.root).rglob("*.flow"))
        if stamp != self.stamp:
            self.stamp = stamp
            try:
                library = library_of(self.root, **self.options)
                self.problems = validate(library)
            except ValueError as e:
                library, self.problems = None, [str(e)]
            if not self.problems:
                self.library = library
        return self.library
