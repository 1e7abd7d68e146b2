"""Trace state in streams: each trace's events in order, its variables kept between micro-batches.

Events of one trace meet in one task of a keyed stateful operator, are ordered by
`order`, and run through the flow's interpreter one after the other.  The state is
the trace's persisted variables as JSON; transient ones live only as long as the
micro-batch that holds them.  Offsets, state and output commit together, so a
restart repeats nothing.  `stateful` is the same in batch: sorted rows stream through
a task, which holds one batch of them and the state of one trace, however long that is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.services import PythonService
from ..plans.flow import Library
from ..plans.interpret import Execution
from ..plans.parser import parse_flow

#: What a column of outputs takes instead of a variable: the events that were scheduled, as JSON.
SCHEDULED = "+"


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v


class _Runner:
    """Runs the events of a trace in order: `start` with its persisted variables, then `one` for each event."""

    def __init__(self, flow: str, library: Library | None, out: dict[str, str], keep: list[str]):
        library = library or Library()
        self.flow = library.flows.get(parse_flow(flow).name) or library.add(flow)
        self.flows, self.out, self.keep = dict(library.flows), out, keep
        self.services = {k: s.function for k, s in library.services.items() if isinstance(s, PythonService)}
        self.start({})

    def start(self, state: dict) -> None:
        self.memory, self.saved = dict(state), dict(state)

    def one(self, row: dict) -> dict:
        done = Execution(self.flow, {k: _plain(v) for k, v in row.items()}, self.memory, self.flows, services=self.services).run()
        self.saved.update({k: self.memory[k] for k in done.updates})
        values = {name: json.dumps(done.scheduled) if v == SCHEDULED else done.values.get(v) for name, v in self.out.items()}
        return {**{k: row[k] for k in self.keep}, **values}


def stateful(events: DataFrame, flow: str, trace: str, order: list[str], out: dict[str, str], schema: str, keep: list[str], library: Library | None = None) -> DataFrame:
    """Batch: every trace's events through the interpreter, in order.

    For updates that no window expresses.  One exchange on the trace brings its events
    together, as they depend on each other; they needn't fit in memory.
    """
    runner, kind = _Runner(flow, library, out, keep), StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kind), events.columns
    at = names.index(trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = first = object()
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if current is first or row[at] != current:
                    current = row[at]
                    runner.start({})
                rows.append(runner.one(dict(zip(names, row))))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return events.repartition(trace).sortWithinPartitions(trace, *order).mapInArrow(run, kind)


def stream(events: DataFrame, flow: str, trace: str, order: list[str], out: dict[str, str], schema: str, keep: list[str], library: Library | None = None, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream; a micro-batch's events of a trace run in order.

    With `idle_ms` a trace that gets no event for so long is forgotten; Spark then
    keeps making micro-batches, so a stream that should end has none.
    """
    runner = _Runner(flow, library, out, keep)

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = json.loads(state.get[0]) if state.exists else {}
        runner.start(before)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        result = [runner.one(row) for row in rows.to_dict("records")]
        state.update((json.dumps(runner.saved),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(result, columns=[*keep, *out])

    return events.groupBy(trace).applyInPandasWithState(handle, schema, "variables string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
