"""Sinks: rows to JSON messages, to files or Kafka, one or several at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message(*columns: str | Column, key: str | Column | None = None) -> list[Column]:
    """key (`0` if there is none) and value, a JSON object that keeps its nulls."""
    own = F.lit("0") if key is None else (F.col(key) if isinstance(key, str) else key).cast("string")
    return [own.alias("key"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")]


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    return df.select(*message(*df.columns, key=key))


def instance_log(plan, *keep: str, key: str = "event_id", detailed: bool = False) -> DataFrame:
    """What every event's executions did, as messages: one for each event, with its procedures in the order of execution."""
    rows = plan.procedure_log(*dict.fromkeys((key, *keep)), detailed=detailed)
    own = [c for c in rows.columns if c not in (key, *keep)]
    events = rows.groupBy(key, *(c for c in keep if c != key)).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*own).alias("p"))), lambda x, y: (x["seq"] - y["seq"]).cast("int")).alias("x"))
    return to_messages(events.select(key, *(c for c in keep if c != key), F.transform("x", lambda x: x["p"]).alias("procedure")), key)


def topic_messages(rows: DataFrame, topic: str, key: str = "event_id") -> DataFrame:
    """Rows of a topic's log as messages with the topic's name."""
    return to_messages(rows, key).withColumn("topic", F.lit(topic)).select("topic", "key", "value")


def to_files(path: str, fmt: str = "parquet", mode: str = "append") -> Callable[[DataFrame], None]:
    return lambda df: df.write.mode(mode).format(fmt).save(path)


def to_kafka(servers: str, topic: str) -> Callable[[DataFrame], None]:
    """Needs Spark's Kafka package."""
    return lambda df: df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def to_all(*sinks: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch that writes a micro-batch to several sinks, computing it once."""

    def write(df: DataFrame, _: int = 0) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df)
        finally:
            df.unpersist()

    return write
