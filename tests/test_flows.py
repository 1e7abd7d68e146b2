"""Flows, traces and the operators between flows."""

import json
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.operators.choreography import Callback, Experiment, FlowGraph, Group, Subscription, bucket, callbacks, reachable, traffic_ranges, with_plan
from flowspark.operators.services import PythonService, RemoteService, TableService
from flowspark.operators.topics import Field, Topic
from flowspark.operators.trace import NoFold, recognise, run_traces
from flowspark.operators.views import group_relation
from flowspark.plans.compiler import compiled, select
from flowspark.plans.flow import FlowError, Library, delay_ms, flow_id, plan_flow, validate
from flowspark.plans.interpret import Execution, Failure, Interpreter
from flowspark.plans.parser import parse_expression, parse_flow
from flowspark.queries import remote_transport
from flowspark.sources.events import Reloading, Sources, SourceConfig, TimedOut, parsed, run_flow, with_event_id, within
from flowspark.sources.sinks import to_all, to_files
from flowspark.streaming.trace import SCHEDULED, stateful, stream


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(i, "t", i % 4, float(i)) for i in range(8)], "event_id bigint, trace string, kind bigint, value double")


def flow(body, name="/f", head=""):
    return f"# {name}\n{head}***\n{body}\n***\n"


def test_buckets(spark):
    row = spark.range(1).select(bucket(F.lit("1")).alias("a"), bucket(F.lit("3")).alias("b")).first()
    assert (row.a, row.b) == (26, 87)


def test_lazy_calls_are_left_out(events):
    calls = {"Read": PythonService(lambda x: x + 1, "double"), "Boom": PythonService(lambda x: 1 // 0, "double")}
    p = plan_flow(events, flow("a <~ Read(x=@value)\nunused <~ Boom(x=@value)\nb <- a * 2"), Library(services=calls))
    assert p.calls == ["Read"]
    assert [r.b for r in p.select("event_id", b="b").orderBy("event_id").collect()] == [2 * (i + 1.0) for i in range(8)]


def test_failures_stay_with_their_row(events):
    def odd(x):
        if x % 2:
            raise KeyError(x)
        return x

    p = plan_flow(events, flow("a <- Odd(x=@value)\nb <- a + 1\nc <- b !! -1\nd <- 7"), Library(services={"Odd": PythonService(odd, "double")}))
    rows = p.df.select("event_id", p.fault().alias("f"), p.values["c"].col.alias("c"), p.values["d"].col.alias("d")).orderBy("event_id").collect()
    assert rows[1].f == {"a": "KeyError", "b": "IllegalArgumentException"} and rows[1].c == -1 and rows[1].d == 7
    assert rows[2].f == {} and rows[2].c == 3


def test_retries():
    from flowspark.operators.services import _called
    import pandas as pd

    seen = []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError
        return x

    assert _called(flaky, ["x"], pd.DataFrame({"x": [5]}), 2, 0.0, 1) == ([5], [None])


def test_guards_keep_services_from_running(events, spark):
    table = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "k bigint, name string")
    p = plan_flow(events, flow("<> {\n ? big = @value > 5\n => { n <- Name(key=@kind) }\n}"), Library(services={"Name": TableService(table, "k", "name", "key")}))
    assert {r.event_id: r.n for r in p.select("event_id", n="n").collect()} == {i: f"n{i % 4}" if i > 5 else None for i in range(8)}


def test_branches_and_failing_conditions(events):
    p = plan_flow(events, flow("<> {\n ? bad = 1 / 0 > 1\n => { x <- 1 }\n ? zero = @kind == 0\n | one = @kind == 1\n => { x <- 2 }\n}\ny <- x"))
    rows = p.df.select("kind", p.choice().alias("c"), p.values["y"].col.alias("y")).distinct().collect()
    assert {r.kind: (r.c, r.y) for r in rows} == {0: (["zero"], 2), 1: (["one"], 2), 2: ([], None), 3: ([], None)}


def test_errors_of_definitions(events):
    with pytest.raises(FlowError, match="twice"):
        plan_flow(events, flow("a <- 1\na <- 2"))
    with pytest.raises(FlowError, match="unknown"):
        plan_flow(events, flow("a <- nowhere"))
    with pytest.raises(FlowError, match="no flow"):
        plan_flow(events, flow("<s> => /missing"))
    with pytest.raises(FlowError, match="named"):
        Library(flow("a <- 1"), flow("b <- 1"))
    assert validate(Library(flow("<s> => /gone\na <- 1\na <- 2"))) == ["/f: a is defined twice", "/f: no flow /gone"]
    assert Topic("t", "/k", (Field("a", "tag", "/x", True), Field("a", "variable", "/y", True))).problems() == ["t: field a is defined twice", "t: /y has no tag"]
    assert delay_ms("10 minutes") == 600_000 and delay_ms(None) == 0
    assert flow_id(flow("a <- 1")) == flow_id(flow("a <-  1")) != flow_id(flow("a <- 2"))


def test_folds():
    kinds = {n: k for n, (k, *_) in recognise(parse_flow(flow("d <- @value\n$s <- $s + d !! d\n$m <- [$m, d].min() !! d\n$l <- d"))).items()}
    assert kinds == {"$s": "sum", "$m": "min", "$l": "last"}
    for body in ("$s <- $s * 2 !! 1", "$s <- $s + $t !! 1", "$s <- $s + 1"):
        with pytest.raises(NoFold):
            recognise(parse_flow(flow(body)))


def test_trace_windows_equal_the_interpreter(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 2, 3])) for i in range(60)]
    text = flow("before <- $last !! -1\n$count <- $count + @x !! @x\n$last <- @x * 2\nnow <- count !! -9")
    df = spark.createDataFrame(rows, "event_id bigint, trace string, x bigint")
    got = {r.event_id: (r.before, r.now) for r in run_traces(df, text, "trace", ["event_id"]).select("event_id", before="before", now="now").collect()}
    states, want = {"a": {}, "b": {}}, {}
    for i, t, x in rows:
        done = Execution(parse_flow(text), {"event_id": i, "x": x}, states[t]).run()
        want[i] = (done.values.get("before"), done.values.get("now"))
    first = {t: next(i for i, u, x in rows if u == t) for t in "ab"}
    if all(rows[i][2] is not None for i in first.values()):
        assert got == want
    else:  # a trace whose first event fails starts its sum later, which a window can't see
        assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}


def test_experiments(spark):
    df = spark.createDataFrame([(i,) for i in range(300)], "event_id bigint")
    first = Experiment("first", "/f", 1, (0, 50), (Group("g", (0, 100), (("/f", "/g", (("n", "@event_id"),)),)),), condition="@event_id > 10")
    second = Experiment("second", "/f", 2, (0, 100), (Group("h", (0, 40)), Group("i", (40, 100))))
    rows = with_plan(df, [second, first], "/f").withColumn("b", bucket(F.col("event_id").cast("string"))).collect()
    for r in rows:
        if r.event_id > 10 and r.b < 50:
            assert (r.experiment.name, r.experiment.flow, r.experiment.argument) == ("first", "/g", f'{{"n":{r.event_id}}}')
        else:
            assert r.experiment.name == "second" and r.experiment.flow == "/f" and r.experiment.grp in "hi"
    with pytest.raises(ValueError, match="priority"):
        with_plan(df, [first, first], "/f")
    assert traffic_ranges([20, 30]) == [(0, 20), (20, 50)]


def test_callbacks_against_plain_python(spark):
    rng = random.Random(9)
    registers = [("t" + str(rng.randint(0, 3)), rng.choice(["x", "y", None]), rng.randint(0, 400), i) for i in range(60)]
    answers = [("t" + str(rng.randint(0, 3)), rng.choice("xy"), rng.randint(0, 400), 100 + i) for i in range(60)]
    kind = "trace string, token string, ts bigint, event_id bigint"
    got = {r.event_id: (r.outcome, r.settled_ts) for r in callbacks(spark.createDataFrame(registers, kind), spark.createDataFrame(answers, kind), 50).collect()}
    want = {}
    for t, k, ts, i in registers:
        if k is None:
            continue
        later = sorted((x[2], x[3]) for x in registers if x[:2] == (t, k) and (x[2], x[3]) > (ts, i))
        again = later[0][0] if later else None
        hits = [x[2] for x in answers if x[:2] == (t, k) and x[2] >= ts and (again is None or x[2] < again)]
        want[i] = ("callback", min(hits)) if hits and min(hits) <= ts + 50 else ("timeout", ts + 50)
    assert got == want


def test_flow_graph():
    library = Library(flow("<s> => /b\n<t> + => /c", "/a"), flow("<> {\n ? x = true\n => { <s> => /c }\n}", "/b"), flow("a <- 1", "/c"))
    graph = FlowGraph.of(library, [Subscription("s", "/c", "/d")], [("/d", "/e", "/late")])
    assert graph.path("/a", "/e") == ["/a", "/c", "/d", "/e"] and not graph.has_path("/c", "/a") and graph.duals["/e"] == "/late"
    assert len(graph.to_json()["edges"]) == 6


def test_remote_calls_with_a_transport(spark):
    rows = remote_transport(spark, "/root/testdata/sf0.001", lambda method, url, body: f"{method}:{url}").collect()
    assert all(r.answer == f"get:http://svc/part/{r.p_partkey}" for r in rows)


def test_sources_and_sinks(spark, tmp_path):
    good, bad = parsed(spark.createDataFrame([('{"a": 1}',), ("[1]",), ("nope",), (None,)], "raw string"), "a bigint")
    assert [r.document.a for r in good.collect()] == [1] and bad.count() == 3
    sources = Sources()
    sources.register("numbers", lambda s, p, stream: s.range(p["n"]))
    sources.configure(SourceConfig("n", "numbers", "/f", {"n": 3}))
    assert sources.read(spark, "n").count() == 3
    with pytest.raises(ValueError, match="factory"):
        sources.configure(SourceConfig("x", "nothing", "/f"))
    to_all(to_files(f"{tmp_path}/a"), to_files(f"{tmp_path}/b", "json"))(spark.range(4))
    assert spark.read.parquet(f"{tmp_path}/a").count() == spark.read.json(f"{tmp_path}/b").count() == 4


_NUMBERS = st.sampled_from(["@a", "@b", "1", "2", "0", "2.5", "null"])
_EXPRESSIONS = st.recursive(_NUMBERS, lambda x: st.one_of(
    st.tuples(x, st.sampled_from(["+", "-", "*", "/"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
    st.tuples(x, st.sampled_from(["<", "<=", "==", "!=", "and", "or"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
    x.map(lambda t: f"(not {t})"),
), max_leaves=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_EXPRESSIONS, min_size=12, max_size=12))
def test_columns_equal_the_interpreter(spark, texts):
    df = spark.createDataFrame([(3, 4.5), (0, None), (-2, 0.0)], "a bigint, b double")
    values = [compiled(df, t) for t in texts]
    columns = [c for k, v in enumerate(values) for c in ((v.col.cast("string") if v.type.simpleString() == "void" else v.col).alias(f"v{k}"), (v.err if v.err is not None else F.lit(None).cast("string")).alias(f"e{k}"))]
    for row in df.select("a", "b", *columns).collect():
        for k, t in enumerate(texts):
            tool = Interpreter(lambda name, row=row: row[name[1:]])
            try:
                want = tool.value(parse_expression(t))
            except Failure:
                assert row[f"e{k}"] is not None, t
                continue
            assert row[f"e{k}"] is None, t
            got = row[f"v{k}"]
            assert got == want or (got is not None and want is not None and abs(got - want) < 1e-9 * max(1, abs(want))), (t, got, want)


def test_distances_on_long_chains_and_cycles(spark):
    chain = spark.range(1000).selectExpr("id AS source", "id + 1 AS target")
    got = reachable(chain)
    assert got.count() == 1000 * 1001 // 2 and got.where("hops <> target - source").count() == 0
    full = [(a, b) for a in range(6) for b in range(6) if a != b] + [(7, 7), (None, 1), (0, 1)]
    rows = {(r.source, r.target): r.hops for r in reachable(spark.createDataFrame(full, "source long, target long")).collect()}
    assert rows == {(a, b): 1 if a != b else 2 for a in range(6) for b in range(6)} | {(7, 7): 1}
    assert reachable(chain.where("false")).count() == 0


def test_many_callbacks_of_one_token(spark):
    n = 60_000
    both = spark.range(n).selectExpr("'t' AS trace", "'k' AS token", "id * 10 AS ts", "id AS event_id")
    began = time.monotonic()
    rows = callbacks(both.where("event_id % 2 = 0"), both.where("event_id % 2 = 1"), 50)
    assert rows.where("outcome = 'callback' AND settled_ts = ts + 10").count() == n // 2
    assert time.monotonic() - began < 20


def test_views_in_the_row_against_plain_python(spark):
    rng = random.Random(8)
    rows = [(k, [(rng.choice("abc"), rng.randint(0, 9), rng.choice([None, 1.5, 2.5])) for _ in range(rng.randint(0, 30))]) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, xs array<struct<g:string,n:long,d:double>>")
    texts = {"groups": "[_.n <- @xs[/(_.g)]]", "by_number": "[_.length() <- @xs[/(_.n / 4)]]", "merged": "@xs[?(_.n > 4)].n + [0 - _.n <- @xs[?(_.n < 7)]]", "nested": '@xs[*]["g", "n"]\'', "empty": '@xs[?(_.n > 99)]["g"]'}
    got = {r.k: r for r in select(df, ["k"], **texts).collect()}
    for k, xs in rows:
        want: dict = {}
        for g, n, _ in xs:
            want.setdefault(g, []).append(n)
        sizes: dict = {}
        for _, n, _ in xs:
            sizes[int(n / 4)] = sizes.get(int(n / 4), 0) + 1
        merged = {i: n for i, (_, n, _) in enumerate(xs) if n > 4} | {i: -n for i, (_, n, _) in enumerate(xs) if n < 7}
        assert got[k].groups == want
        assert got[k].by_number == [sizes[s] for s in sorted(sizes)]
        assert got[k].merged == [merged[i] for i in sorted(merged)]
        assert not xs or {c: [v.toPython() for v in vs] for c, vs in got[k].nested.items()} == {"g": [g for g, _, _ in xs], "n": [n for _, n, _ in xs]}


def test_grouped_relations_keep_their_order(spark):
    rows = spark.createDataFrame([(1, i, "a" if i % 2 else "b", 100 - i) for i in range(50)], "k long, i0 long, g string, v long").repartition(7)
    got = {r.g: r.v for r in group_relation(rows, ["k"], "g").collect()}
    assert got == {"a": [100 - i for i in range(1, 50, 2)], "b": [100 - i for i in range(0, 50, 2)]}


def test_repeated_keys_multiply_nothing(spark, events):
    table = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (None, "n")], "k bigint, name string")
    p = plan_flow(events, flow("n <- Name(key=@kind)"), Library(services={"Name": TableService(table, "k", "name", "key")}))
    assert sorted((r.event_id, r.n) for r in p.select("event_id", n="n").collect()) == [(i, {0: "x", 1: "z"}.get(i % 4)) for i in range(8)]


def test_one_event_at_once(spark):
    library = Library(flow("out <- 1 / @x", "/inner"))
    done = run_flow(spark, flow("<s> => /inner?x=@n\n<t> + \"1 minute\" => /inner?x=2\na <- @n * 2", "/outer"), {"n": 0}, "n bigint", library)
    assert len(done["event_id"]) == 24 and len(done["trace_id"]) == 32
    assert [p["flow_name"] for p in done["procedures"]] == ["/outer", "/inner"] and done["procedures"][0]["assign"] == {"a": "0"} and done["procedures"][0]["schedule"] == ["/inner"]
    assert done["fault"] == {"s/out": {"catalog": "ArithmeticException", "message": "ArithmeticException in out"}}
    assert [(s["flow_name"], s["delay_ms"]) for s in done["scheduled"]] == [("/inner", 60_000)]


def test_ids_of_events_are_distinct_and_stay(spark):
    rows = with_event_id(spark.range(0, 5000, 1, 8))
    first = sorted(r.event_id for r in rows.collect())
    assert len(set(first)) == 5000 and all(len(x) == 24 for x in first) and first == sorted(r.event_id for r in rows.collect())


def test_jobs_end_in_time(spark):
    slow = F.udf(lambda x: (time.sleep(3), x)[1], "long")
    with pytest.raises(TimedOut):
        within(spark.range(8).select(slow("id")), 1.0)
    assert len(within(spark.range(3), 30.0)) == 3


def test_libraries_are_read_again(tmp_path):
    (tmp_path / "a.flow").write_text(flow("x <- 1", "/a"))
    watched = Reloading(str(tmp_path))
    assert set(watched.current().flows) == {"/a"}
    (tmp_path / "b.flow").write_text(flow("x <- y", "/b"))
    assert set(watched.current().flows) == {"/a"} and watched.problems == ["/b: unknown variable y"]
    (tmp_path / "b.flow").write_text(flow("y <- 2\nx <- y", "/b"))
    assert set(watched.current().flows) == {"/a", "/b"} and watched.problems == []


def test_configurations_are_checked():
    library = Library(
        flow("s -> 1\n<i> => /b\nx <- i->out\nz <- i->none", "/a").replace("s -> 1", "s <- 1"), flow("out <- 1", "/b"),
        experiments=[Experiment("e", "/a", 1, (0, 10), (Group("g", (0, 100), (("/a", "/gone", ()),)),))], callbacks=[Callback("/a", "nothing", "/b", "/lost", 10, (("v", "x"),))],
    )
    assert validate(library) == ["/a: unknown variable i->none", "e: no flow /gone", "callback of /a: no flow /lost", "callback of /a: unknown variable nothing"]
    e = Experiment("e", "/f", 1, (0, 10), (Group("g", (0, 100), (("/f", "/g", (("n", "@a + b"),)),)),), condition="@c > 1", target="@d")
    assert e.dependencies() == {"@a", "b", "@c", "@d"}


def test_remote_answers_as_documents(spark, events):
    class Gone(Exception):
        code = 410

    calls = []

    def transport(method, url, body):
        if url.endswith("1"):
            raise Gone
        return '{"n": 7}' if url.endswith("2") else "no json"

    service = RemoteService("get http://s/${k}", transport, retries=0, json=True)
    p = plan_flow(events.where("event_id < 4"), flow("a <- Call(k=@kind)\nn <- a.n.to_long()"), Library(services={"Call": service}))
    rows = p.df.select("event_id", p.fault().alias("f"), p.values["n"].col.alias("n")).orderBy("event_id").collect()
    assert rows[2].n == 7 and rows[2].f == {} and rows[1].f["a"] == "Gone" and rows[0].f["a"] == "ValueError"

    def failing(x):
        calls.append(x)
        raise Gone

    from flowspark.operators.services import _called
    import pandas as pd

    assert _called(failing, ["x"], pd.DataFrame({"x": [1]}), 3, 0.0, 1, (410,)) == ([None], ["Gone"]) and len(calls) == 1


def test_services_and_schedules_in_traces(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(20)], "event_id bigint, trace string, x bigint")
    library = Library(services={"Twice": PythonService(lambda v: v * 2, "bigint")})
    text = flow('t <- Twice(v=@x)\n<> {\n ? big = t > 20\n => { $n <- $n + 1 !! 1\n <later> + "2 minutes" => /f?x=@x - 10 }\n}\nseen <- $n !! 0')
    got = {r.event_id: (r.seen, json.loads(r.later)) for r in stateful(rows, text, "trace", ["event_id"], {"seen": "seen", "later": SCHEDULED}, "event_id bigint, seen bigint, later string", ["event_id"], library).collect()}
    count = {"a": 0, "b": 0}
    for i in range(20):
        count["ab"[i % 2]] += 2 * i > 20
        assert got[i][0] == count["ab"[i % 2]]
        assert [s["argument"] for s in got[i][1]] == ([{"x": i - 10}] if 2 * i > 20 else [])


def test_a_trace_needn_t_fit_in_memory(spark):
    rows = spark.range(30_000).selectExpr("id AS event_id", "'t' AS trace")
    got = stateful(rows, flow("<> {\n ? yes = true\n => { $n <- $n + 1 !! 1 }\n}\nseen <- $n"), "trace", ["event_id"], {"seen": "seen"}, "event_id bigint, seen bigint", ["event_id"])
    assert got.where("seen = event_id + 1").count() == 30_000


def test_experiments_that_fail_or_cover_nothing(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "event_id bigint, x bigint")
    e = Experiment("e", "/f", 1, (0, 100), (Group("g", (0, 50)),), condition="6 / @x > 4")
    rows = with_plan(df, [e], "/f").withColumn("b", bucket(F.col("event_id").cast("string"), suffix="e")).collect()
    for r in rows:
        want = "ArithmeticException" if r.x == 0 else None if r.x == 2 else None if r.b < 50 else "UninitializedFieldError"
        assert (r.experiment.error if r.experiment else None) == want
        assert (r.experiment.grp if r.experiment else None) == ("g" if r.x == 1 and r.b < 50 else None)
    p = plan_flow(df, flow("out <- 1"), Library(experiments=[e]))
    faults = {r.event_id: r.f for r in p.df.select("event_id", p.fault().alias("f")).collect()}
    assert all(("experiment" in faults[r.event_id]) == (r.experiment is not None and r.experiment.error is not None) for r in rows)


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "event_id bigint, trace string").coalesce(1).write.mode("append").parquet(folder)


COUNT = "$n <- $n + 1 !! 1\nseen <- n"


def test_a_restarted_stream_keeps_its_state(spark, tmp_path):
    text, source, out = flow(COUNT), f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(2):
        _write(spark, source, [(10 * part + i, "ab"[i % 2]) for i in range(4)])
        rows = spark.readStream.schema("event_id bigint, trace string").parquet(source)
        done = stream(rows, text, "trace", ["event_id"], {"seen": "seen"}, "event_id bigint, seen bigint", ["event_id"])
        done.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    assert {r.event_id: r.seen for r in spark.read.parquet(out).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 10: 3, 11: 3, 12: 4, 13: 4}


def test_idle_traces_are_forgotten(spark, tmp_path):
    text, source = flow(COUNT), f"{tmp_path}/in"
    _write(spark, source, [(0, "a")])
    rows = spark.readStream.schema("event_id bigint, trace string").parquet(source)
    done = stream(rows, text, "trace", ["event_id"], {"seen": "seen"}, "event_id bigint, seen bigint", ["event_id"], idle_ms=1000)
    running = done.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()

    def seen(i):
        for _ in range(120):
            got = [r.seen for r in spark.sql("SELECT * FROM idle").collect() if r.event_id == i]
            if got:
                return got[0]
            time.sleep(0.25)
        raise TimeoutError

    try:
        assert seen(0) == 1
        time.sleep(6)
        _write(spark, source, [(1, "a")])
        assert seen(1) == 1
    finally:
        running.stop()


def test_a_source_gives_no_more_than_it_is_permitted(spark, tmp_path):
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sources, sizes = Sources(), []
    sources.configure(SourceConfig("f", "files", "/f", {"schema": "id long", "path": f"{tmp_path}/in", "permits": 1}))
    handle = lambda rows, c: rows.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    sources.start(spark, "f", handle).awaitTermination()
    assert [n for n in sizes if n] == [1, 1, 1]
    sources.stop()
    assert sources.running == {}
