"""The catalogue of queries over the test tables, each with its DuckDB statement.

Every query goes through the flow language: an expression or a flow's text, this
package's compiler, and Spark.  They run over whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.udfs import load, merged, python_function, visible
from .operators import values as V
from .operators import views as W
from .operators.choreography import Callback, Experiment, FlowGraph, Group, Subscription, bucket, callbacks, drain, reachable, settled_events, subscribed, trace_id, traffic_ranges, with_plan
from .operators.services import PythonService, RemoteService, SinkService, TableService
from .operators.topics import Field, Topic, procedure_view, topic_log
from .operators.trace import iterate, run_traces
from .plans.compiler import compile_node, compiled, scope_of, select, variables_of
from .plans.flow import Library, Planner, plan_flow
from .plans.parser import parse_expression
from .session import prepare, shared_folder
from .sources.events import SourceConfig, Sources, extracted, parsed, with_trace
from .sources.sinks import instance_log, to_messages, topic_messages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


ITEM = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")


def order_docs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Orders with items as nested documents: one exchange on the order key."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*ITEM).alias("i")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))
    if not extra:
        return items
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), *extra)
    return items.join(orders, "l_orderkey")


#: Line items with their places in the order's document.
LI = """WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS rn,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) """


# -- flows and expressions

TRIAGE = """# /triage
***
  level <- @value
  is_money <- @event_type == "purchase"
  <> {
    ? big = is_money and level >= 50
    => { tier <- "big" }
    ? small = is_money
    => { tier <- "small" }
    ? other = true
    => { tier <- "none" }
  }
***
"""


@query("SELECT event_id, CASE WHEN event_type='purchase' AND value>=50 THEN 'big' WHEN event_type='purchase' THEN 'small' ELSE 'none' END AS tier FROM events")
def flow_branch(spark, sf_dir):
    return plan_flow(table(spark, sf_dir, "events"), TRIAGE).select("event_id", tier="tier")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, l_quantity % 7 AS rest, l_extendedprice / l_quantity AS unit, -l_tax AS neg, (l_linenumber * 3 - 1)::BIGINT AS whole, l_linenumber / 4 AS part FROM lineitem""")
def expr_arith(spark, sf_dir):
    return select(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], revenue="@l_extendedprice * (1 - @l_discount)", rest="@l_quantity % 7", unit="@l_extendedprice / @l_quantity", neg="-@l_tax", whole="@l_linenumber * 3 - 1", part="@l_linenumber / 4")


@query("""SELECT c_custkey, coalesce(c_acctbal < s_acctbal, false) AS less, coalesce(c_acctbal >= s_acctbal, false) AS more, s_acctbal IS NOT DISTINCT FROM NULL AS none, c_acctbal IS NOT DISTINCT FROM s_acctbal AS same, c_nationkey = 3 AS three
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def expr_compare_null(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    df = c.join(s, c.c_custkey == s.s_suppkey, "left")
    return select(df, ["c_custkey"], less="@c_acctbal < @s_acctbal", more="@c_acctbal >= @s_acctbal", none="@s_acctbal == null", same="@c_acctbal == @s_acctbal", three="@c_nationkey == 3.0")


@query("""SELECT c_custkey, NOT (c_nationkey <> 0) AS no_nation, (c_nationkey <> 0 OR coalesce(s_name <> '', false)) AS some, (c_nationkey <> 0 AND coalesce(s_name <> '', false)) AS both_, NOT coalesce(s_name <> '', false) AS no_name
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def expr_truthy(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    df = c.join(s, c.c_custkey == s.s_suppkey, "left")
    return select(df, ["c_custkey"], no_nation="not @c_nationkey", some="@c_nationkey or @s_name", both_="@c_nationkey and @s_name", no_name="not @s_name")


@query("""SELECT p_partkey, p_brand || ':' || p_size AS tag, repeat('*', (p_size % 5)::INT) AS stars, p_size || p_name AS sized, p_name > p_brand AS later FROM part""")
def expr_text_ops(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), ["p_partkey"], tag='@p_brand + ":" + @p_size', stars='"*" * (@p_size % 5)', sized="@p_size + @p_name", later="@p_name > @p_brand")


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS known, o_orderstatus NOT IN ('F') AS not_f, o_custkey IN (1, 2, 3) AS early FROM orders""")
def expr_in(spark, sf_dir):
    return select(table(spark, sf_dir, "orders"), ["o_orderkey"], known='@o_orderstatus in ["F", "O"]', not_f='@o_orderstatus not in ["F"]', early="@o_custkey in [1, 2, 3]")


_AB = LI + ", ab AS (SELECT l_orderkey, l_partkey % 20 AS x, rn, CASE WHEN rn < 3 THEN 'a' ELSE 'b' END AS side FROM li) "


def _ab(spark, sf_dir) -> DataFrame:
    df = order_docs(spark, sf_dir)
    return select(df, ["l_orderkey"], a="[_.l_partkey % 20 <- @items[:3][-]]", b="[_.l_partkey % 20 <- @items[3:][-]]")


@query(_AB + """, firsts AS (SELECT l_orderkey, x, min(rn) AS rn FROM ab GROUP BY ALL)
SELECT l_orderkey, string_agg(x::VARCHAR, ',' ORDER BY rn) AS values_ FROM firsts GROUP BY l_orderkey""")
def list_union(spark, sf_dir):
    return select(_ab(spark, sf_dir), ["l_orderkey"], values_='mk_string((@a + @b).distinct(), ",")')


@query(_AB + """SELECT o.l_orderkey, coalesce(string_agg(a.x::VARCHAR, ',' ORDER BY a.rn), '') AS values_ FROM (SELECT DISTINCT l_orderkey FROM ab) o
LEFT JOIN ab a ON a.l_orderkey = o.l_orderkey AND a.side = 'a' AND NOT EXISTS (SELECT 1 FROM ab b WHERE b.l_orderkey = a.l_orderkey AND b.side = 'b' AND b.x = a.x) GROUP BY o.l_orderkey""")
def list_subtract(spark, sf_dir):
    return select(_ab(spark, sf_dir), ["l_orderkey"], values_='mk_string(@a - @b, ",")')


@query(_AB + """SELECT o.l_orderkey, coalesce(string_agg(a.x::VARCHAR, ',' ORDER BY a.rn), '') AS values_ FROM (SELECT DISTINCT l_orderkey FROM ab) o
LEFT JOIN ab a ON a.l_orderkey = o.l_orderkey AND a.side = 'a' AND EXISTS (SELECT 1 FROM ab b WHERE b.l_orderkey = a.l_orderkey AND b.side = 'b' AND b.x = a.x) GROUP BY o.l_orderkey""")
def list_intersect(spark, sf_dir):
    return select(_ab(spark, sf_dir), ["l_orderkey"], values_='mk_string(@a[?(_ in @b)][-], ",")')


# -- documents

@query(LI + "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS parts, count(*) AS n_items FROM li GROUP BY l_orderkey")
def doc_visit(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], parts='mk_string(@items.l_partkey, ",")', n_items="@items.l_partkey.length()")


@query(LI + """SELECT l_orderkey, max(CASE WHEN rn = 0 THEN l_partkey END) AS first_part, max(CASE WHEN rn = n - 1 THEN l_partkey END) AS last_part, max(CASE WHEN rn = 4 THEN l_partkey END) AS fifth, coalesce(max(CASE WHEN rn = 4 THEN l_partkey END), -1) AS fifth_or FROM li GROUP BY l_orderkey""")
def doc_at(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], first_part="@items[0].l_partkey", last_part="@items[-1].l_partkey", fifth="@items[4].l_partkey", fifth_or="[_.l_partkey <- @items].at_or_else(4, -1)")


@query("SELECT p_partkey, p_partkey::VARCHAR || ',' || p_size || ',' || (p_size + 1) AS all_ FROM part")
def doc_visit_all(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), ["p_partkey"], all_='mk_string({"k": @p_partkey, "s": [@p_size, @p_size + 1]}.*, ",")')


@query(LI + "SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY rn) AS supps, count(*) AS n FROM li GROUP BY l_orderkey")
def doc_search(spark, sf_dir):
    df = select(order_docs(spark, sf_dir), ["l_orderkey"], doc='{"order": {"items": @items, "key": @l_orderkey}}')
    return select(df, ["l_orderkey"], supps='mk_string(@doc..l_suppkey, ",")', n="(@doc..l_suppkey).length()")


@query("SELECT p_partkey, 5::BIGINT AS nodes, p_partkey::VARCHAR || ',' || p_size AS leaves FROM part")
def doc_search_all(spark, sf_dir):
    df = select(table(spark, sf_dir, "part"), ["p_partkey"], doc='{"a": {"k": @p_partkey}, "b": {"c": {"s": @p_size}}}')
    return select(df, ["p_partkey"], nodes="[1 <- @doc..*].length()", leaves='mk_string((@doc..k) + (@doc..s), ",")')


# -- table views

@query(LI + "SELECT l_orderkey, string_agg((l_tax * 100)::DECIMAL(9,0)::BIGINT::VARCHAR, ',' ORDER BY rn) AS taxes FROM li GROUP BY l_orderkey")
def view_select_all(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], taxes='mk_string([round(_ * 100) <- @items[*].l_tax], ",")')


@query(LI + """SELECT l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn IN (0, 2)), '') AS picked, string_agg(l_suppkey::VARCHAR || '/' || l_linenumber, ',' ORDER BY rn) AS both_ FROM li GROUP BY l_orderkey""")
def view_select(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], picked='mk_string([_.l_partkey <- @items[0, 2]], ",")', both_='mk_string([_["l_suppkey"].to_string() + "/" + _["l_linenumber"].to_string() <- @items[*]["l_suppkey", "l_linenumber"][-]], ",")')


@query(LI + """SELECT l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn BETWEEN 1 AND 2), '') AS middle, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn >= n - 2) AS tail, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn < 2) AS head FROM li GROUP BY l_orderkey""")
def view_slice(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], middle='mk_string(@items[1:3].l_partkey, ",")', tail='mk_string(@items[-2:].l_partkey, ",")', head='mk_string(@items[:2].l_partkey, ",")')


@query("SELECT p_partkey, p_brand || ',' || p_name || ',' || p_type AS texts, p_partkey AS k FROM part")
def view_slice_dict(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), ["p_partkey"], texts='[_["p_brand"] + "," + _["p_name"] + "," + _["p_type"] <- [@["p_name":"p_type"][-]]][0]', k='@["p_partkey"]')


@query(LI + """SELECT l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (l_quantity > 25), '') AS big, count(*) FILTER (l_quantity > o_custkey % 50) AS above FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def view_query(spark, sf_dir):
    df = select(order_docs(spark, sf_dir, "o_custkey"), ["l_orderkey", "items"], t="@o_custkey % 50")
    return select(df, ["l_orderkey"], big='mk_string([_.l_partkey <- @items[?(_.l_quantity > 25)]], ",")', above="[1 <- @items[?(_.l_quantity > @t)]].length()")


@query(LI + "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn < 2) AS firsts FROM li GROUP BY l_orderkey")
def view_query_index(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], firsts='mk_string(@items[?(#[0] < 2)].l_partkey, ",")')


@query(LI + """, g AS (SELECT l_orderkey, l_returnflag, count(*) AS c, sum(l_linenumber)::BIGINT AS s FROM li GROUP BY ALL)
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN c END) AS n_a, max(CASE WHEN l_returnflag = 'N' THEN c END) AS n_n, max(CASE WHEN l_returnflag = 'R' THEN s END) AS s_r, count(*) AS n_groups FROM g GROUP BY l_orderkey""")
def view_group(spark, sf_dir):
    df = select(order_docs(spark, sf_dir), ["l_orderkey"], g="[_.length() <- @items[/(_.l_returnflag)]]", s="[_.l_linenumber.sum() <- @items[/(_.l_returnflag)]]")
    return select(df, ["l_orderkey"], n_a="@g.A", n_n="@g.N", s_r="@s.R", n_groups="@g.length()")


@query(LI + """, g AS (SELECT l_orderkey, trunc(l_quantity / 10) AS k, count(*) AS c FROM li GROUP BY ALL) SELECT l_orderkey, string_agg(c::VARCHAR, ',' ORDER BY k) AS sizes FROM g GROUP BY l_orderkey""")
def view_group_num(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], sizes='mk_string([_.length() <- @items[/(_.l_quantity / 10)]][-], ",")')


@query("SELECT l_orderkey, count(*) AS n_groups FROM lineitem GROUP BY l_orderkey")
def view_group_anon(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], n_groups="(@items[/(_.l_quantity > 25)][-]).length()")


@query(LI + "SELECT l_orderkey, l_returnflag AS key, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS parts FROM li GROUP BY ALL")
def view_group_relation(spark, sf_dir):
    """The same grouping across rows: a view as a relation, grouped by an exchange; the lists keep the items' order."""
    df = order_docs(spark, sf_dir)
    view = compile_node(parse_expression("@items[*]"), scope_of(df))
    rows = W.relation(df, view, ["l_orderkey"]).select("l_orderkey", "i0", F.col("v.l_returnflag").alias("key"), F.col("v.l_partkey").alias("v"))
    return W.group_relation(rows, ["l_orderkey"], "key").select("l_orderkey", "key", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("parts"))


@query(LI + "SELECT l_orderkey, string_agg(l_suppkey::VARCHAR || (CASE WHEN l_quantity >= 25 THEN 'true' ELSE 'false' END), ',' ORDER BY rn) AS merged FROM li GROUP BY l_orderkey")
def view_expand_merge(spark, sf_dir):
    df = select(order_docs(spark, sf_dir), ["l_orderkey"], m='@items[*][, "l_suppkey"] + [(_.l_quantity >= 25).to_string() <- @items[*]][+ "is_big"]')
    return df.select("l_orderkey", F.array_join(F.transform("m", lambda x: F.concat(F.to_json(x["l_suppkey"]), F.try_variant_get(x["is_big"], "$", "string"))), ",").alias("merged"))


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.i, b.i) AS i0, CASE WHEN b.i IS NOT NULL THEN b.v ELSE a.v END AS v FROM
(SELECT l_orderkey, rn AS i, l_partkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS rn FROM lineitem) WHERE rn < 3) a FULL JOIN
(SELECT l_orderkey, rn AS i, -l_suppkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS rn FROM lineitem) WHERE rn >= 2) b ON a.l_orderkey = b.l_orderkey AND a.i = b.i""")
def view_merge_override(spark, sf_dir):
    df = order_docs(spark, sf_dir)
    scope = scope_of(df)
    left, right = (W.relation(df, compile_node(parse_expression(x), scope), ["l_orderkey"]) for x in ("@items[:3].l_partkey", "[-_.l_suppkey <- @items[2:]]"))
    return W.merge_relations(left, right, ["l_orderkey", "i0"])


@query(LI + "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) AS parts, string_agg(l_suppkey::VARCHAR, ',' ORDER BY rn) AS supps FROM li GROUP BY l_orderkey")
def view_transpose(spark, sf_dir):
    df = select(order_docs(spark, sf_dir), ["l_orderkey"], t='@items[*]["l_partkey", "l_suppkey"]\'')
    return select(df, ["l_orderkey"], parts='mk_string(@t.l_partkey, ",")', supps='mk_string(@t.l_suppkey, ",")')


@query(LI + "SELECT l_orderkey, string_agg(round(l_extendedprice)::BIGINT::VARCHAR, ',' ORDER BY rn) AS prices, sum(rn)::BIGINT AS places FROM li GROUP BY l_orderkey")
def map_transform(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], prices='mk_string([round(_.l_extendedprice) <- @items], ",")', places="[# <- @items].sum()")


# -- functions

@query("SELECT c_custkey, round(c_acctbal)::BIGINT AS r, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(-(c_custkey % 10) - 0.5)::BIGINT AS half FROM customer")
def fn_round_ceil_floor(spark, sf_dir):
    return select(table(spark, sf_dir, "customer"), ["c_custkey"], r="round(@c_acctbal)", c="ceil(@c_acctbal)", f="floor(@c_acctbal)", half="round(-(@c_custkey % 10) - 0.5)")


@query("SELECT c_custkey, substr(c_name, 1, 4) AS head, substr(c_name, 5, 3) AS mid, length(c_name) AS n, CASE WHEN length(c_mktsegment) >= 9 THEN substr(c_mktsegment, 1, 9) END AS nine FROM customer")
def fn_substr_length(spark, sf_dir):
    return select(table(spark, sf_dir, "customer"), ["c_custkey"], head="substr(@c_name, 0, 4)", mid="substr(@c_name, 4, 7)", n="@c_name.length()", nine="substr(@c_mktsegment, 0, 9)")


@query("SELECT l_orderkey, max(l_quantity) AS hi, min(l_partkey) AS lo, sum(l_linenumber)::BIGINT AS s, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey")
def fn_max_min_sum(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], hi="@items.l_quantity.max()", lo="@items.l_partkey.min()", s="@items.l_linenumber.sum()", flag="@items.l_returnflag.max()")


@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_quantity > 45) = 0 THEN max(l_partkey) END AS hi, CASE WHEN count(*) FILTER (l_quantity > 45) = 0 THEN sum(l_partkey)::BIGINT END AS s FROM lineitem GROUP BY l_orderkey")
def fn_max_with_null(spark, sf_dir):
    df = order_docs(spark, sf_dir).withColumn("xs", F.transform("items", lambda x: F.when(x["l_quantity"] <= 45, x["l_partkey"])))
    return select(df, ["l_orderkey"], hi="@xs.max()", s="@xs.sum()")


@query("SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'N')) AS sub, bool_or(l_returnflag IN ('A')) AS any_, NOT bool_or(l_returnflag IN ('R')) AS none FROM lineitem GROUP BY l_orderkey")
def fn_set_predicates(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], sub='@items.l_returnflag.subsetof(["A", "N"])', any_='@items.l_returnflag.anyof(["A"])', none='@items.l_returnflag.noneof(["R"])')


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS dashed, len(string_split(p_name, ' '))::BIGINT AS n, replace(p_name, ' ', '-') AS tail FROM part")
def fn_split_join(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), ["p_partkey"], dashed='mk_string(split(@p_name, " "), "-")', n='split(@p_name, " ").length()', tail='mk_string((@p_name + "   ").split_by(" "), "-")')


@query(LI + """, f AS (SELECT l_orderkey, l_returnflag AS x, min(rn) AS rn FROM li GROUP BY ALL), d AS (SELECT l_orderkey, string_agg(x, '' ORDER BY rn) AS flags FROM f GROUP BY l_orderkey),
p AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR || ',' || l_suppkey, ',' ORDER BY rn) AS flat FROM li GROUP BY l_orderkey) SELECT l_orderkey, flags, flat FROM d JOIN p USING (l_orderkey)""")
def fn_distinct_flatten(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], flags='mk_string(@items.l_returnflag.distinct(), "")', flat='mk_string([[_.l_partkey, _.l_suppkey] <- @items].flatten(), ",")')


@query("SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole, c_custkey::VARCHAR AS text, coalesce(s_name, 'null') AS name, coalesce(s_suppkey, 0)::DOUBLE AS d, regexp_extract(c_name, '[0-9]+')::BIGINT AS num, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -7 END AS guarded FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def fn_convert(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    df = c.join(s, c.c_custkey == s.s_suppkey, "left").withColumn("odd", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("1.0"))
    out = plan_flow(df, """# /convert
***
  whole <- @c_acctbal.to_long()
  text <- @c_custkey.to_string()
  name <- @s_name.to_string()
  d <- @s_suppkey.to_double()
  num <- split(@c_name, "#")[1].to_long()
  guarded <- @odd.to_long() !! -7
***
""")
    return out.select("c_custkey", whole="whole", text="text", name="name", d="d", num="num", guarded="guarded")


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, '{"id":' || event_id || ',"kind":"' || event_type || '","none":null}' AS json FROM events""")
def fn_json(spark, sf_dir):
    out = select(table(spark, sf_dir, "events"), ["event_id"], k="parse_json(@props).k.to_long()", json='{"id": @event_id, "kind": @event_type, "none": null}.to_json()')
    return out


@query("""SELECT p_partkey, '{"a":{"y":1,"x":' || p_size || '},"c":"' || p_brand || '","b":2}' AS merged, '{"p_size":' || p_size || '}' AS rest, '{"pSize":' || p_size || ',"pType":"' || p_type || '"}' AS camel, '{"p_size":' || p_size || '}' AS snake FROM part""")
def fn_dict(spark, sf_dir):
    return select(table(spark, sf_dir, "part"), ["p_partkey"], merged='merge_dict({"a": {"x": @p_size}, "b": 2}, {"a": {"y": 1, "x": 0}, "c": @p_brand}).to_json()', rest='{"p_size": @p_size, "p_type": @p_type}.delete(["p_type"]).to_json()', camel='{"p_size": @p_size, "p_type": @p_type}.to_lower_camel().to_json()', snake='{"pSize": @p_size}.to_under_score().to_json()')


@query(LI + "SELECT l_orderkey, string_agg((l_partkey + l_suppkey)::VARCHAR, ',' ORDER BY rn) AS sums FROM li GROUP BY l_orderkey")
def fn_zip(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], sums='mk_string([_.a + _.b <- [{"a": _.l_partkey, "b": 0} <- @items].zip([{"b": _.l_suppkey} <- @items])], ",")')


@query(LI + """, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY trunc(l_quantity / 10), rn) AS k FROM (SELECT *, l_quantity / 10 AS q FROM li)) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) FILTER (k <= 2) AS top FROM o GROUP BY l_orderkey""")
def fn_sort_by_key(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], top='mk_string([{"q": _.l_quantity / 10, "p": _.l_partkey} <- @items].sort_by_key("q")[:2].p, ",")')


@query("SELECT c_custkey, coalesce(s_name, 'none') AS name, coalesce(s_acctbal, 0.5) AS bal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def fn_defaults(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return select(c.join(s, c.c_custkey == s.s_suppkey, "left"), ["c_custkey"], name='@s_name.get_or_else("none")', bal="@s_acctbal.get_or_else(0.5)")


@query(LI + "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) || ',' || string_agg(l_suppkey::VARCHAR, ',' ORDER BY rn) AS both_, count(*) AS one FROM li GROUP BY l_orderkey")
def fn_concat(spark, sf_dir):
    return select(order_docs(spark, sf_dir), ["l_orderkey"], both_='mk_string(concat(@items.l_partkey, @items.l_suppkey), ",")', one="concat(@items.l_partkey, 1).length()")


@query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_formed FROM events")
def fn_uuid(spark, sf_dir):
    """Random names can't be compared; that there is one of the right form for every event, and no two are equal, can."""
    ids = select(table(spark, sf_dir, "events"), ["event_id"], id="uuid()")
    formed = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{32}$")
    return ids.agg(F.count("id").alias("n"), F.count_distinct("id").alias("n_distinct"), F.count_if(formed).alias("n_formed"))


# -- statements

@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value / (event_id % 7) END AS r, NULL::VARCHAR AS kept, CASE WHEN event_id % 7 = 0 THEN 'r0' ELSE 'ok' END AS tag FROM events")
def flow_failover(spark, sf_dir):
    return plan_flow(table(spark, sf_dir, "events"), """# /failover
***
  r0 <- @value / (@event_id % 7)
  r <- r0 !! -1.0
  kept <- null !! "never"
  fine <- r0 * 0 !! 1
  label <- ["ok", "r0"][fine] !! "ok"
***
""").select("event_id", r="r", kept="kept", tag="label")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'a=ArithmeticException,b=IllegalArgumentException,c=UninitializedFieldError' ELSE 'c=UninitializedFieldError' END AS faults, event_id * 2 AS good FROM events""")
def flow_fault_log(spark, sf_dir):
    p = plan_flow(table(spark, sf_dir, "events"), """# /faulty
***
  a <- @value / (@event_id % 5)
  b <- a + 1
  c <- @missing
  good <- @event_id * 2
***
""")
    entries = F.transform(F.array_sort(F.map_entries(p.fault())), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.df.select("event_id", F.array_join(entries, ",").alias("faults"), p.values["good"].col.alias("good"))


@query("SELECT event_id, value + 1 AS used, 1::BIGINT AS n_calls FROM events")
def flow_lazy(spark, sf_dir):
    library = Library(services={"Read": PythonService(lambda x: x + 1, "double"), "Never": PythonService(lambda x: x, "double")})
    p = plan_flow(table(spark, sf_dir, "events"), """# /lazy
***
  a <~ Read(x=@value)
  b <~~ a
  c <~ Never(x=@value)
  used <- b
  <> {
    ? unseen = c > 0
    => { d <~ c }
  }
***
""", library)
    return p.select("event_id", used="used").withColumn("n_calls", F.lit(len(p.calls)).cast("long"))


@query("""SELECT event_id, CASE WHEN value >= 30 THEN CASE WHEN event_type = 'purchase' THEN 'high,paid' ELSE 'high,free' END WHEN event_type IN ('view', 'click') THEN 'look' ELSE 'rest' END AS choices,
CASE WHEN value >= 30 THEN CASE WHEN event_type = 'purchase' THEN 3 ELSE 2 END WHEN event_type IN ('view', 'click') THEN 1 END::BIGINT AS score FROM events""")
def flow_nested_branch(spark, sf_dir):
    p = plan_flow(table(spark, sf_dir, "events"), """# /nested
***
  <> {
    ? high = @value >= 30
    => {
      base <- 2
      <> {
        ? paid = @event_type == "purchase"
        => { more <- 1 }
        ? free = true
        => { more <- 0 }
      }
      score <- base + more
    }
    ? look = @event_type == "view"
    | look_click = @event_type == "click"
    => { score <- 1 }
    ? rest = true
    => { nothing <~ 0 }
  }
***
""")
    choices = F.replace(F.array_join(p.choice(), ","), F.lit("look_click"), F.lit("look"))
    return p.df.select("event_id", choices.alias("choices"), p.values["score"].col.alias("score"))


@query("SELECT c_custkey, n_name AS nation, (n_regionkey * 10)::BIGINT AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0")
def flow_composite_lookup(spark, sf_dir):
    library = Library(services={"Nation": TableService(table(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"], "key", unique=True)})
    return plan_flow(table(spark, sf_dir, "customer"), """# /lookup
***
  <> {
    ? rich = @c_acctbal > 0
    => {
      n <- Nation(key=@c_nationkey)
      nation <- n.n_name
      region <- n.n_regionkey * 10
    }
  }
***
""", library).select("c_custkey", nation="nation", region="region")


@query(LI + "SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY rn) AS brands, count(*) AS batch_size FROM li LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(p_partkey) = count(*)")
def flow_batch_composite(spark, sf_dir):
    library = Library(services={"Part": TableService(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "key", unique=True)})
    p = plan_flow(order_docs(spark, sf_dir), """# /batch
***
  brands <- [Part(key=_.l_partkey) <- @items]
  text <- mk_string(brands, ",")
  batch_size <- brands.length()
***
""", library, keys=("l_orderkey",))
    return p.select("l_orderkey", brands="text", batch_size="batch_size")


@query("SELECT p_partkey, 'get http://svc/part/' || p_partkey || '?name=' || replace(p_name, ' ', '+') AS request FROM part")
def flow_restful_template(spark, sf_dir):
    return plan_flow(table(spark, sf_dir, "part"), """# /rest
* Fetch
```get http://svc/part/${key}?name=${name}```
***
  answer <- Fetch(key=@p_partkey, name=@p_name)
***
""").select("p_partkey", request="answer")


@query("SELECT event_id, value * 2 + 1 AS inner_, value * 2 + 1 + event_id AS total FROM events")
def flow_include(spark, sf_dir):
    library = Library("""# /double
***
  out <- @x * 2 + @one
***
""")
    return plan_flow(table(spark, sf_dir, "events"), """# /outer
***
  <s> => /double?x=@value&one=1
  inner <- s->out
  total <- inner + @event_id
***
""", library).select("event_id", inner_="inner", total="total")


@query("""WITH RECURSIVE r(event_id, n, acc, depth) AS (SELECT event_id, event_id % 6, 0::BIGINT, 0::BIGINT FROM events UNION ALL SELECT event_id, n - 1, acc + n, depth + 1 FROM r WHERE n > 0)
SELECT event_id, depth, acc AS total FROM r""")
def flow_recursion(spark, sf_dir):
    df = select(table(spark, sf_dir, "events"), ["event_id"], n="@event_id % 6", acc="0")
    return iterate(df, """# /sum_down
***
  total <- @acc
  <> {
    ? more = @n > 0
    => { <next> => /sum_down?n=@n - 1&acc=@acc + @n }
  }
***
""", None, ("event_id",), {"total": "total"}, "n bigint, acc bigint")


_UUID = "(substr(md5({x}),1,8)||'-'||substr(md5({x}),9,4)||'-3'||substr(md5({x}),14,3)||'-'||substr('89ab', (('0x'||substr(md5({x}),17,1))::BIGINT & 3)::INT + 1, 1)||substr(md5({x}),18,3)||'-'||substr(md5({x}),21,12))"
_CRC = """((4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end))) % 100)"""


def _bucket_sql(x: str, suffix: str | None = None) -> str:
    u = _UUID.format(x=x)
    return _CRC.format(s=f"({u} || 'Some({suffix})')" if suffix else u)


@query(f"SELECT event_id, {_bucket_sql('event_id::VARCHAR')}::BIGINT AS b, {_bucket_sql('event_id::VARCHAR', 'exp')}::BIGINT AS b2, replace({_UUID.format(x='event_id::VARCHAR')}, '-', '') AS trace_id FROM events")
def bucket_hash(spark, sf_dir):
    own = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", bucket(own).alias("b"), bucket(own, suffix="exp").alias("b2"), trace_id(F.lit("-"), own).alias("trace_id"))


@query(f"SELECT event_id, value * 3 AS triple FROM events WHERE event_type = 'purchase' AND {_bucket_sql('event_id::VARCHAR')} < 50")
def flow_subscribe(spark, sf_dir):
    p = plan_flow(table(spark, sf_dir, "events"), TRIAGE)
    s = Subscription("big_money", "/triage", "/follow", (0, 50), "is_money", None, (("level", "level"),))
    events = subscribed(p.df, p.values | variables_of(p.df), s)
    return plan_flow(events, """# /follow
***
  triple <- @level * 3
***
""").select("event_id", triple="triple")


@query("""SELECT event_id, 'later' AS scope, '/remind' AS flow_name, (epoch_us(ts) // 1000) + 600000 AS scheduled_ts, user_id::VARCHAR AS trace_id, '{"x":' || event_id || '}' AS argument FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'now', '/audit', (epoch_us(ts) // 1000), 'audit', '{}' FROM events""")
def flow_schedule(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    p = plan_flow(df, """# /plan
***
  <> {
    ? fresh = @event_type == "signup"
    => { <later> + "10 minutes" => /remind?x=@event_id }
  }
  <now> + => /audit#"audit"
***
""")
    return p.schedule("event_id", "user_id", "ms").select("event_id", "scope", "flow_name", (F.col("ms") + F.col("delay_ms")).alias("scheduled_ts"), F.coalesce("trace", F.col("user_id").cast("string")).alias("trace_id"), "argument")


@query(f"""WITH b AS (SELECT *, {_bucket_sql('event_id::VARCHAR')} AS b, {_bucket_sql('event_id::VARCHAR', 'price')} AS g1, {_bucket_sql('event_type', 'page')} AS g2 FROM events)
SELECT event_id, CASE WHEN event_type = 'purchase' AND b < 60 THEN 'price' WHEN b < 90 THEN 'page' END AS experiment,
 CASE WHEN event_type = 'purchase' AND b < 60 THEN CASE WHEN g1 < 50 THEN 'treat' ELSE 'control' END WHEN b < 90 THEN CASE WHEN g2 < 30 THEN 'a' ELSE 'b' END END AS grp,
 CASE WHEN event_type = 'purchase' AND b < 60 AND g1 < 50 THEN value * 0.5 WHEN NOT (event_type = 'purchase' AND b < 60) AND b < 90 AND g2 < 30 THEN value + 100 ELSE value END AS price FROM b""")
def ab_experiment(spark, sf_dir):
    """The planner puts a treatment's flow in the place of the included one."""
    p = plan_flow(table(spark, sf_dir, "events"), """# /entry
***
  <p> => /price?value=@value
  price <- p->out
***
""", _priced())
    own = p.treatment("p")
    return p.df.select("event_id", own["name"].alias("experiment"), own["grp"].alias("grp"), p.values["price"].col.alias("price"))


def _priced() -> Library:
    """Flows of prices with two experiments on the first of them."""
    return Library("""# /price
***
  out <- @value
***
""", """# /discount
***
  out <- @value * @rate
***
""", """# /surcharge
***
  out <- @value + @extra
***
""", experiments=[
        Experiment("page", "/price", 2, (0, 90), (Group("a", (0, 30), (("/price", "/surcharge", (("extra", "100"),)),)), Group("b", (30, 100))), target="@event_type"),
        Experiment("price", "/price", 1, (0, 60), (Group("treat", (0, 50), (("/price", "/discount", (("rate", "0.5"),)),)), Group("control", (50, 100))), condition='@event_type == "purchase"'),
    ])


@query(ORACLES["ab_experiment"])
def experiment_schedule(spark, sf_dir):
    """Scheduled events keep the treatment that their parent's event was given."""
    p = plan_flow(table(spark, sf_dir, "events"), """# /entry
***
  <p> + "1 hour" => /price?value=@value
***
""", _priced())
    later = p.schedule("event_id").select("event_id", "flow_name", "experiment", F.from_json("argument", "value double").alias("a")).select("event_id", "experiment", "a.*")
    done = Planner(_priced(), later, experiment="experiment").run("/price")
    return done.df.select("event_id", F.col("experiment.name").alias("experiment"), F.col("experiment.grp").alias("grp"), done.values["out"].col.alias("price"))


@query(f"""SELECT event_id, CASE WHEN {_bucket_sql('event_id::VARCHAR')} < 50 THEN CASE WHEN {_bucket_sql('event_id::VARCHAR', 'half')} < 40 THEN 'x' END END AS grp,
 CASE WHEN {_bucket_sql('event_id::VARCHAR')} < 50 AND {_bucket_sql('event_id::VARCHAR', 'half')} >= 40 THEN '{V.MISSING}' END AS error FROM events""")
def experiment_uncovered(spark, sf_dir):
    """An event that an experiment takes, in a bucket that no group covers, fails."""
    df = with_plan(table(spark, sf_dir, "events"), [Experiment("half", "/f", 1, (0, 50), (Group("x", (0, 40)),))], "/f")
    return df.select("event_id", "experiment.grp", "experiment.error")


# -- traces

COUNTING = """# /count
***
  delta <- @event_id % 10
  $count <- $count + delta !! delta
  result <- count
  $top <- [$top, @event_id % 97].max() !! @event_id % 97
  best <- top
***
"""


@query("SELECT event_id, sum(event_id % 10) OVER w::BIGINT AS result, max(event_id % 97) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def trace_running(spark, sf_dir):
    return run_traces(table(spark, sf_dir, "events"), COUNTING, "user_id", ["ts", "event_id"]).select("event_id", result="result", best="best")


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'first') AS previous FROM events")
def trace_last_seen(spark, sf_dir):
    return run_traces(table(spark, sf_dir, "events"), """# /seen
***
  previous <- $last_type !! "first"
  $last_type <- @event_type
***
""", "user_id", ["ts", "event_id"]).select("event_id", previous="previous")


@query("SELECT event_id, sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS result FROM events")
def trace_stream_equals_batch(spark, sf_dir):
    """The counting flow over a file stream; the events of all micro-batches, read from the sink."""
    from .streaming.trace import stream

    schema = table(spark, sf_dir, "events").schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    out = stream(rows.select("event_id", "ts", "user_id"), COUNTING, "user_id", ["ts", "event_id"], {"result": "result"}, "event_id bigint, result bigint", ["event_id"])
    done = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    done.awaitTermination()
    return spark.read.schema("event_id bigint, result bigint").parquet(f"{folder}/out")


@query("SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS paid FROM events")
def trace_stateful(spark, sf_dir):
    """An update inside a branch is no fold, so the interpreter runs it, trace by trace."""
    from .streaming.trace import stateful

    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return stateful(rows, """# /paid
***
  <> {
    ? pays = @event_type == "purchase"
    => { $paid <- $paid + 1 !! 1 }
  }
  now <- $paid !! 0
***
""", "user_id", ["ts", "event_id"], {"paid": "now"}, "event_id bigint, paid bigint", ["event_id"])


@query("""WITH r AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'view'),
a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.*, (SELECT min(a.t) FROM a WHERE a.user_id = r.user_id AND a.t > r.t) AS hit FROM r)
SELECT event_id, CASE WHEN hit <= t + 86400000 AND (again IS NULL OR hit < again) THEN 'callback' ELSE 'timeout' END AS outcome, CASE WHEN hit <= t + 86400000 AND (again IS NULL OR hit < again) THEN hit ELSE t + 86400000 END AS settled_ts FROM j""")
def callback_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.lit("pay").alias("token"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "event_type")
    return callbacks(ev.where("event_type = 'view'"), ev.where("event_type = 'purchase'"), 86_400_000).select("event_id", "outcome", "settled_ts")


@query("""WITH r AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'view'),
a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT r.*, (SELECT min(a.t) FROM a WHERE a.user_id = r.user_id AND a.t > r.t) AS hit FROM r),
o AS (SELECT event_id, t, again, CASE WHEN hit <= t + 86400000 AND (again IS NULL OR hit < again) THEN hit END AS won FROM j)
SELECT event_id, CASE WHEN won IS NULL THEN 'timeout' ELSE 'callback' END AS outcome, coalesce(won, t + 86400000) AS settled_ts FROM o
WHERE won IS NOT NULL OR again IS NOT NULL OR t + 86400000 < (SELECT max(epoch_us(ts) // 1000) FROM events WHERE event_type IN ('view', 'purchase'))
OR EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = (SELECT user_id FROM r WHERE r.event_id = o.event_id) AND epoch_us(e.ts) // 1000 > o.t + 86400000)""")
def callback_stream_settled(spark, sf_dir):
    """The same over a stream: what answers, later registrations and the watermark have settled."""
    from .streaming.callback import SCHEMA, callback_stream

    schema = table(spark, sf_dir, "events").schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").where("event_type IN ('view', 'purchase')")
    rows = rows.select(F.col("user_id").alias("trace"), F.lit("pay").alias("token"), "event_id", F.lit(None).cast("string").alias("argument"), F.col("ts").cast("timestamp").alias("time"), (F.col("event_type") == "purchase").cast("int").alias("kind"))
    done = callback_stream(rows, 86_400_000).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    done.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/out").select("event_id", "outcome", "settled_ts")


@query("""WITH r AS (SELECT event_id, user_id, value, (epoch_us(ts) // 1000) AS t, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'view'),
a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'purchase'),
h AS (SELECT r.event_id AS register, arg_min(a.event_id, (a.t, a.event_id)) AS hit, min(a.t) AS hit_t FROM r JOIN a ON a.user_id = r.user_id AND a.t > r.t GROUP BY r.event_id),
j AS (SELECT r.*, CASE WHEN hit_t <= t + 86400000 AND (again IS NULL OR hit_t < again) THEN hit END AS won FROM r LEFT JOIN h ON h.register = r.event_id)
SELECT a.event_id, j.value * 2 AS paid, CASE WHEN j.event_id IS NULL THEN 'MISSING' END AS failed FROM a LEFT JOIN j ON j.won = a.event_id
UNION ALL SELECT event_id, value * -1, NULL FROM j WHERE won IS NULL""".replace("'MISSING'", f"'{V.ARGUMENT}'"))
def callback_flow(spark, sf_dir):
    """A flow registers a callback; the answer that loads its token gets the arguments, later ones fail, and timeouts run by themselves."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("trace", F.col("user_id"))
    library = Library("""# /paid
***
  out <- @#.seen * 2
***
""", """# /late
***
  out <- @token_context.seen * -1
***
""", callbacks=[Callback("/watch", '"pay"', "/paid", "/late", 86_400_000, (("seen", "seen"),))])
    watch = plan_flow(ev.where("event_type = 'view'"), """# /watch
***
  seen <- @value
***
""", library)
    registers = watch.registrations("event_id", "trace", "ts")
    answers = ev.where("event_type = 'purchase'").withColumn("token", F.lit("pay"))
    settled = callbacks(registers, answers, 86_400_000, keep=("argument",))
    won, late = settled_events(settled, answers, "seen double")
    context = V.of_column(F.col("token_context"), won.schema["token_context"].dataType)
    paid = plan_flow(won, """# /answer
***
  <p> > @token => /paid
  out <- p->out
***
""", library, trace={"@#": context})
    missed = plan_flow(late, library.flows["/late"], library)
    out = paid.values["out"]
    return paid.df.select("event_id", F.when(out.err.isNull(), out.col).alias("paid"), out.err.alias("failed")).unionByName(missed.select("event_id", paid="out").withColumn("failed", F.lit(None).cast("string")))


@query("""WITH RECURSIVE r(event_id, n, due, path) AS (SELECT event_id, event_id % 5, (epoch_us(ts) // 1000), 'start' FROM events UNION ALL SELECT event_id, n - 1, due + 60000, path || '/again' FROM r WHERE n > 0)
SELECT event_id, due AS scheduled_ts, path, '{"left":' || n || '}' AS "values" FROM r""")
def schedule_loop(spark, sf_dir):
    """Scheduled events are run when they are due, and what they schedule after them, until nothing is left."""
    ev = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("scheduled_ts"), F.lit("/again").alias("flow_name"), F.lit("start").alias("path"), F.to_json(F.struct((F.col("event_id") % 5).alias("n"))).alias("argument"))
    library = Library("""# /again
***
  left <- @n
  <> {
    ? more = @n > 0
    => { <again> + "1 minute" => /again?n=@n - 1 }
  }
***
""")
    done, waiting = drain(ev, library, 4_102_444_800_000, "n bigint", {"/again": {"left": "left"}}, keys=("event_id",))
    return done.select("event_id", "scheduled_ts", "path", "values")


@query(f"""SELECT event_id, 'odd' AS name, CASE WHEN event_id % 3 = 0 THEN '{V.ARITHMETIC}' END AS catalog, '{V.ARITHMETIC} in odd' AS message FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'next', '{V.ARGUMENT}', 'failed before: odd' FROM events WHERE event_id % 3 = 0""")
def flow_fault_detail(spark, sf_dir):
    """Catalog and message of each fault; what fails for a failure before it names that."""
    p = plan_flow(table(spark, sf_dir, "events"), """# /f
***
  odd <- 1 / (@event_id % 3)
  next <- odd + 1
  fine <- next !! 0
***
""")
    return p.df.select("event_id", F.explode(p.fault_details()).alias("name", "f")).select("event_id", "name", "f.catalog", "f.message")


@query(f"SELECT event_id, 'a' AS names FROM events WHERE event_id % 4 = 0")
def dead_letter_rows(spark, sf_dir):
    """Events to look at again: those with a failure of a class that isn't ignored."""
    p = plan_flow(table(spark, sf_dir, "events"), """# /f
***
  a <- 1 / (@event_id % 4)
  b <- @event_type + null
***
""")
    ignored = (V.ARGUMENT,)
    return p.dead_letters("event_id", ignored=ignored).select("event_id", F.array_join(F.sort_array(F.map_keys("fault")), ",").alias("names"))


# -- analysis logs

_JOURNEY = ("""# /enter
***
  level <- @value >= 30
  <> {
    ? high = level
    => { <pay> => /pay?value=@value&kind=@event_type }
    ? low = true
    => { <rest> => /rest?value=@value }
  }
***
""", """# /pay
***
  fee <- round(@value * 10)
  <> {
    ? bought = @kind == "purchase"
    => { <ship> => /ship?fee=fee }
  }
***
""", """# /ship
***
  cost <- @fee + 1
***
""", """# /rest
***
  seen <- 1
***
""")


def _journey(spark, sf_dir) -> DataFrame:
    """Procedures of the journey: event_id, trace_id, scope (array), flow_name, choice, values."""
    p = plan_flow(table(spark, sf_dir, "events"), _JOURNEY[0], Library(*_JOURNEY[1:]))
    rows = p.procedure("event_id", "user_id", *(c for c in p.df.columns if c.startswith(("_v", "_g"))))
    values = {"/enter": {"level": "level"}, "/pay": {"fee": "pay->fee"}}
    texts = [F.when(F.col("flow_name") == flow, F.create_map(*(x for k, v in names.items() for x in (F.lit(k), p.values[v].col.cast("string"))))) for flow, names in values.items() if all(v in p.values for v in names.values())]
    return rows.select("event_id", F.col("user_id").alias("trace_id"), F.filter(F.split("scope", "/"), lambda x: x != "").alias("scope"), "seq", "flow_name", "choice", F.coalesce(*texts, F.create_map().cast("map<string,string>")).alias("values"))


@query("""SELECT event_id, 'pay' AS scope, true AS entered, 'high' AS entry_choice, round(value * 10)::BIGINT::VARCHAR AS fee, event_type = 'purchase' AS shipped, CASE WHEN event_type = 'purchase' THEN 'bought' ELSE '' END AS pay_choice FROM events WHERE value >= 30""")
def topic_log_fields(spark, sf_dir):
    topic = Topic("payments", "/pay", (
        Field("entered", "tag", "/enter", True), Field("entry_choice", "choice", "/enter", True),
        Field("fee", "variable", "/pay", False), Field("shipped", "tag", "/ship", False), Field("pay_choice", "choice", "/pay", False),
    ))
    return topic_log(_journey(spark, sf_dir), topic).select("event_id", "scope", "entered", "entry_choice", "fee", "shipped", "pay_choice")


@query("""SELECT event_id, '' AS scope, '/enter' AS flow_name, '' AS assign, CASE WHEN value >= 30 THEN 'high' ELSE 'low' END AS choice, '' AS argument, '' AS fault, '' AS composite FROM events
UNION ALL SELECT event_id, 'pay', '/pay', 'fee=' || round(value * 10)::BIGINT || ',near=' || CASE WHEN n_name IS NULL THEN 'null' ELSE n_name END, CASE WHEN event_type = 'purchase' THEN 'bought' ELSE '' END, 'kind=' || event_type, CASE WHEN event_id % 3 = 0 THEN 'bad=DIVISION' ELSE '' END, 'near=' || CASE WHEN n_name IS NULL THEN 'null' ELSE n_name END
FROM events LEFT JOIN nation ON n_nationkey = user_id % 30 WHERE value >= 30""".replace("DIVISION", V.ARITHMETIC))
def procedure_log_full(spark, sf_dir):
    """Argument, assigned variables (where the flow's log is enabled), choices, service answers and faults of every execution."""
    p = plan_flow(table(spark, sf_dir, "events"), """# /enter
***
  level <- @value >= 30
  <> {
    ? high = level
    => { <pay> => /pay?value=@value&kind=@event_type&user=@user_id }
    ? low = true
    => { other <- 1 }
  }
***
""", Library("""# /pay
* log = "enabled"
***
  fee <- round(@value * 10)
  near <- Nation(key=@user % 30)
  bad <- 1 / (@event_id % 3)
  <> {
    ? bought = @kind == "purchase"
    => { gift <- 1 }
  }
***
""", services={"Nation": TableService(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "key", unique=True)}))
    shown = lambda c, *names: F.array_join(F.transform(F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.try_element_at(c, F.lit(n)).alias("v")) for n in names)), lambda x: x["v"].isNotNull()), lambda x: F.concat_ws("=", x["n"], x["v"])), ",")
    rows = p.procedure_log("event_id", *(c for c in p.df.columns if c.startswith(("_v", "_g"))))
    near = shown("composite", "near")
    fee = shown("assign", "fee")
    return rows.select("event_id", "scope", "flow_name", F.concat_ws(",", *(F.when(x != "", x) for x in (fee, near))).alias("assign"), F.array_join("choice", ",").alias("choice"), shown("argument", "kind").alias("argument"), shown("fault", "bad").alias("fault"), near.alias("composite"))


_VISIT = ("""# /visit
***
  <> {
    ? buys = @event_type == "purchase"
    => { <later> + "10 minutes" => /ship?x=@event_id }
    ? looks = true
    => { <now> => /look }
  }
***
""", """# /ship
***
  cost <- @x + 1
***
""", """# /look
***
  seen <- 1
***
""")


def _visits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Procedures of visits and of the events they scheduled, as parts of the visit; and those scheduled events."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    library = Library(*_VISIT)
    none = F.create_map().cast("map<string,string>")
    first = plan_flow(ev, library.flows["/visit"], library)
    path = lambda *more: F.filter(F.split(F.concat_ws("/", *more, "scope"), "/"), lambda x: x != "").alias("scope")
    rows = first.procedure("event_id", "at").select("event_id", "at", "seq", path(), "flow_name", "choice", none.alias("values"))
    later = first.schedule("event_id", "at").select("event_id", F.col("scope").alias("path"), "flow_name", (F.col("at") + F.col("delay_ms")).alias("at"), F.from_json("argument", "x bigint").alias("a")).select("event_id", "path", "flow_name", "at", "a.*")
    second = plan_flow(later, library.flows["/ship"], library)
    cost = second.values["cost"]
    more = second.procedure("event_id", "at", "path", *(c for c in second.df.columns if c.startswith("_v"))).select("event_id", "at", "seq", path("path"), "flow_name", "choice", F.create_map(F.lit("cost"), cost.col.cast("string")).alias("values"))
    return rows.unionByName(more), later


@query("""WITH p AS (SELECT event_id, '/' || event_id || '/' || event_id AS root, event_type = 'purchase' AS buys FROM events)
SELECT event_id, root AS id, NULL AS ancestor, root || CASE WHEN buys THEN '/later' ELSE '/now' END AS descendants FROM p
UNION ALL SELECT event_id, root || CASE WHEN buys THEN '/later' ELSE '/now' END, root, '' FROM p""")
def procedure_view_scheduled(spark, sf_dir):
    """Scheduled executions are children of the one that scheduled them."""
    rows = _visits(spark, sf_dir)[0].withColumn("trace_id", F.col("event_id"))
    return procedure_view(rows).select("event_id", "id", "ancestor", F.array_join("descendants", ",").alias("descendants"))


@query("SELECT event_id, '' AS scope, CASE WHEN event_type = 'purchase' THEN 'buys' ELSE 'looks' END AS choice, event_type = 'purchase' AS shipped, CASE WHEN event_type = 'purchase' THEN (event_id + 1)::VARCHAR END AS cost, event_type <> 'purchase' AS looked FROM events")
def topic_log_two_events(spark, sf_dir):
    """Fields from the events that the key flow's event scheduled."""
    topic = Topic("visits", "/visit", (Field("choice", "choice", "/visit", False), Field("shipped", "tag", "/ship", False), Field("cost", "variable", "/ship", False), Field("looked", "tag", "/look", False)))
    return topic_log(_visits(spark, sf_dir)[0], topic, order=("at", "seq")).select("event_id", "scope", "choice", "shipped", "cost", "looked")


@query("SELECT event_id, false AS shipped FROM events WHERE event_type <> 'purchase' UNION ALL SELECT event_id, true FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0")
def topic_log_pending(spark, sf_dir):
    """Rows whose fields a scheduled event can still fill are held back."""
    procedures, later = _visits(spark, sf_dir)
    pending = later.where("event_id % 2 = 1")
    ran = procedures.join(pending.select("event_id", F.col("at").alias("at")), ["event_id", "at"], "left_anti")
    topic = Topic("visits", "/visit", (Field("seen", "tag", "/visit", False), Field("shipped", "tag", "/ship", False)))
    return topic_log(ran, topic, order=("at", "seq"), pending=pending, graph=FlowGraph.of(Library(*_VISIT))).select("event_id", "shipped")


@query("""SELECT event_id::VARCHAR AS key, '{"event_id":' || event_id || ',"procedure":[{"scope":"","flow":"/enter","choice":["' || CASE WHEN value >= 30 THEN 'high' ELSE 'low' END || '"]},' ||
CASE WHEN value >= 30 THEN '{"scope":"pay","flow":"/pay","choice":[' || CASE WHEN event_type = 'purchase' THEN '"bought"' ELSE '' END || ']}' || CASE WHEN event_type = 'purchase' THEN ',{"scope":"pay/ship","flow":"/ship","choice":[]}' ELSE '' END ELSE '{"scope":"rest","flow":"/rest","choice":[]}' END || ']}' AS value FROM events""")
def instance_messages(spark, sf_dir):
    """Executions of an event as one JSON message."""
    p = plan_flow(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _JOURNEY[0], Library(*_JOURNEY[1:]))
    document = F.from_json("value", "event_id bigint, procedure array<struct<scope:string,flow_name:string,choice:array<string>>>")
    rows = instance_log(p).select("key", document.alias("d"))
    short = F.struct("d.event_id", F.transform("d.procedure", lambda x: F.struct(x["scope"].alias("scope"), x["flow_name"].alias("flow"), x["choice"].alias("choice"))).alias("procedure"))
    return rows.select("key", F.to_json(short).alias("value"))


@query("SELECT 'visits' AS topic, event_id::VARCHAR AS key, '{\"event_id\":' || event_id || ',\"shipped\":' || CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END || '}' AS value FROM events")
def topic_log_messages(spark, sf_dir):
    topic = Topic("visits", "/visit", (Field("seen", "tag", "/visit", False), Field("shipped", "tag", "/ship", False)))
    return topic_messages(topic_log(_visits(spark, sf_dir)[0], topic, order=("at", "seq")).select("event_id", "shipped"), "visits")


@query(f"SELECT event_id, CASE WHEN {_bucket_sql('event_id::VARCHAR')} < 20 THEN 'a' WHEN {_bucket_sql('event_id::VARCHAR')} < 55 THEN 'b' END AS part FROM events")
def traffic_split(spark, sf_dir):
    """Shares of traffic one after the other, as ranges of buckets."""
    own = bucket(F.col("event_id").cast("string"))
    part = F.lit(None).cast("string")
    for name, (low, high) in zip("ab", traffic_ranges([20, 35])):
        part = F.when((own >= low) & (own < high), name).otherwise(part)
    return table(spark, sf_dir, "events").select("event_id", part.alias("part"))


@query("SELECT event_id, count(*) AS n_procedures, max(seq)::BIGINT AS last FROM (SELECT event_id, 0 AS seq FROM events UNION ALL SELECT event_id, CASE WHEN value >= 30 THEN 1 ELSE 3 END FROM events UNION ALL SELECT event_id, 2 FROM events WHERE value >= 30 AND event_type = 'purchase') GROUP BY event_id")
def procedure_count(spark, sf_dir):
    """How many flows an event executed, and the place of the last one."""
    return _journey(spark, sf_dir).groupBy("event_id").agg(F.count("*").alias("n_procedures"), F.max("seq").alias("last"))


@query("""WITH p AS (SELECT event_id, '/' || user_id || '/' || event_id AS root, value >= 30 AS hi, event_type = 'purchase' AS buys FROM events)
SELECT event_id, root AS id, NULL AS ancestor, root || CASE WHEN hi THEN '/pay' ELSE '/rest' END AS descendants FROM p
UNION ALL SELECT event_id, root || '/pay', root, CASE WHEN buys THEN root || '/pay/ship' ELSE '' END FROM p WHERE hi
UNION ALL SELECT event_id, root || '/pay/ship', root || '/pay', '' FROM p WHERE hi AND buys
UNION ALL SELECT event_id, root || '/rest', root, '' FROM p WHERE NOT hi""")
def procedure_view_rows(spark, sf_dir):
    return procedure_view(_journey(spark, sf_dir)).select("event_id", "id", "ancestor", F.array_join("descendants", ",").alias("descendants"))


@query("""WITH RECURSIVE e(source, target) AS (SELECT DISTINCT n_regionkey, n_nationkey FROM nation WHERE n_regionkey < n_nationkey),
p(source, target, hops) AS (SELECT source, target, 1 FROM e UNION ALL SELECT p.source, e.target, p.hops + 1 FROM p JOIN e ON p.target = e.source)
SELECT source, target, min(hops)::BIGINT AS hops FROM p GROUP BY ALL""")
def flow_graph_paths(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").where("n_regionkey < n_nationkey").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target"))
    return reachable(edges)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS source, (n_nationkey + 1) % 25 AS target FROM nation UNION SELECT n_nationkey, (3 * n_nationkey) % 25 FROM nation),
p(source, target, hops) AS (SELECT source, target, 1 FROM e UNION SELECT p.source, e.target, p.hops + 1 FROM p JOIN e ON p.target = e.source WHERE p.hops < 26)
SELECT source::INTEGER AS source, target::INTEGER AS target, min(hops)::BIGINT AS hops FROM p GROUP BY ALL""")
def flow_graph_cycles(spark, sf_dir):
    """Distances in a graph of rings and chords, where walks never end."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("source"))
    return reachable(n.withColumn("target", (F.col("source") + 1) % 25).union(n.withColumn("target", (F.col("source") * 3) % 25)))


# -- sources and sinks

@query("SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'k')::BIGINT * 2 AS doubled, user_id::VARCHAR AS trace_id FROM events WHERE event_id % 9 <> 0")
def extract_event(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 == 0, F.lit("[1]")).otherwise(F.col("props")).alias("raw"))
    events, _ = parsed(raw, "k bigint")
    out = extracted(with_trace(events, trace="user_id"), {"k": "@k", "doubled": "@.k * 2"})
    return out.select("event_id", "k", "doubled", "trace_id")


@query("SELECT event_id, round(value)::BIGINT AS built_in, event_id + 2 AS extension, event_id + 3 AS file FROM events")
def udf_merge_order(spark, sf_dir):
    """Functions from files, extensions over them, and built-in ones over both."""
    plus = lambda k: lambda v: V.arithmetic("+", v, V.literal(k))
    functions = merged({"round": plus(1), "near": plus(1), "far": plus(3)}, {"near": plus(2)})
    df = table(spark, sf_dir, "events")
    out = {"built_in": "round(@value)", "extension": "near(@event_id)", "file": "far(@event_id)"}
    return df.select("event_id", *(compiled(df, text, functions=functions).col.alias(name) for name, text in out.items()))


@query("SELECT event_id, 2.0::DOUBLE AS y, '' AS choice, CASE WHEN event_id % 5 = 0 THEN 7 ELSE NULL END AS z, CASE WHEN event_id % 5 = 0 THEN 'used' ELSE '' END AS used FROM events")
def flow_skipped_branch(spark, sf_dir):
    """A branch of lazy variables runs only if something eager reads them; transient ones are no faults."""
    events = table(spark, sf_dir, "events")
    skipped = plan_flow(events, """# /f
***
  <> {
    ? any = @value >= 0
    => { x <~ 1 / 0 }
  }
  hidden <~~ 1 / 0
  y <- hidden !! 2
***
""")
    used = plan_flow(events, """# /g
***
  <> {
    ? used = @event_id % 5 == 0
    => { x <~ 7 }
  }
  z <- x
***
""")
    left = skipped.df.select("event_id", skipped.values["y"].col.alias("y"), F.concat(F.array_join(skipped.choice(), ","), F.array_join(F.map_keys(F.map_filter(skipped.fault(), lambda k, _: k != "y")), ",")).alias("choice"))
    right = used.df.select("event_id", used.values["z"].col.alias("z"), F.array_join(used.choice(), ",").alias("used"))
    return left.join(right, "event_id")


@query("""SELECT event_id, CASE WHEN (props->>'k')::BIGINT % 3 = 0 THEN '{"k":' || (props->>'k') || '}' ELSE '{"k":' || (props->>'k') || ',"rest":' || 12 // ((props->>'k')::BIGINT % 3) || '}' END AS argument FROM events""")
def extract_fallback(spark, sf_dir):
    """Where an expression fails, the document stays as it came."""
    events, _ = parsed(table(spark, sf_dir, "events").withColumnRenamed("props", "raw"), "k bigint")
    return extracted(events, {"k": "@k", "rest": "floor(12 / (@k % 3))"}).select("event_id", "argument")


@query("SELECT range AS n, 'g' || (range % 2) AS grp, range * 2 AS twice FROM range(10)")
def source_registry(spark, sf_dir):
    """A configured source of a registered factory, read and run through the flow that its configuration names."""
    sources = Sources()
    sources.register("numbers", lambda s, p, stream: s.range(p["n"]).withColumnRenamed("id", "n"))
    sources.configure(SourceConfig("ten", "numbers", "/double", {"n": 10}))
    flows = Library("""# /double
***
  twice <- @n * 2
  grp <- "g" + (@n % 2).to_string()
***
""")
    config = sources.configs["ten"]
    return plan_flow(sources.read(prepare(spark), "ten"), flows.flows[config.flow], flows).select("n", grp="grp", twice="twice")


@query("SELECT event_id, event_id % 100 + 2 AS near, event_id % 100 + 3 AS far FROM events")
def udf_python(spark, sf_dir):
    """Two functions of one name in nested directories: the nearer one wins."""
    with tempfile.TemporaryDirectory() as root:
        for where, k in (("functions", 3), ("v2/functions", 2)):
            Path(root, where).mkdir(parents=True)
            Path(root, where, "plus.py").write_text(f"def plus(x):\n    return x + {k}\n")
        functions = load(root)
    df = table(spark, sf_dir, "events")
    near, far = (compiled(df, "plus(@event_id % 100)", functions=visible(functions, flow)) for flow in ("/v2/entry", "/v1"))
    return df.select("event_id", near.col.alias("near"), far.col.alias("far"))


@query("SELECT event_id, value * 1.5 AS scaled, ((event_id + 1) * 1.5)::DOUBLE AS shifted, value * 2.5 AS called FROM events")
def udf_macro(spark, sf_dir):
    """A macro of columns and a Python function under names of their own; each works on its argument."""
    df = table(spark, sf_dir, "events")
    more = {"scaled": lambda v: V.arithmetic("*", v, V.literal(1.5)), "python_scaled": python_function(lambda x: x * 2.5, "double")}
    out = {"scaled": "scaled(@value)", "shifted": "scaled(@event_id + 1)", "called": "python_scaled(@value)"}
    return df.select("event_id", *(compiled(df, text, functions=more).col.alias(name) for name, text in out.items()))


@query("SELECT event_id, event_id % 100 + 7 AS plus, (event_id % 100 + 7) * 2 AS chained FROM events")
def udf_method(spark, sf_dir):
    """A method from a directory: the value before the dot is its first argument."""
    with tempfile.TemporaryDirectory() as root:  # read here, on the driver; functions travel with the plan
        Path(root, "methods").mkdir()
        Path(root, "methods", "plus.py").write_text("def plus(x, y):\n    return x + y\n")
        methods = visible(load(root, "methods"), "/any")
    df = table(spark, sf_dir, "events")
    plus, chained = (compiled(df, text, methods=methods) for text in ("(@event_id % 100).plus(7)", "(@event_id % 100).plus(7) * 2"))
    return df.select("event_id", plus.col.alias("plus"), chained.col.alias("chained"))


@query("""SELECT 'paid' AS topic, event_id::VARCHAR AS key, '{"key":' || event_id || ',"kind":"' || event_type || '"}' AS value FROM events WHERE event_type = 'purchase'""")
def sink_messages(spark, sf_dir):
    library = Library(services={"Paid": SinkService("paid")})
    return plan_flow(table(spark, sf_dir, "events"), """# /emit
***
  <> {
    ? pays = @event_type == "purchase"
    => { done <- Paid(key=@event_id, kind=@event_type) }
  }
***
""", library).emitted().select("topic", "key", "value")


@query("SELECT event_id, event_type, value FROM events")
def sink_roundtrip(spark, sf_dir):
    messages = to_messages(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), key="event_id")
    back, _ = parsed(messages.withColumnRenamed("value", "raw"), "event_id bigint, event_type string, value double")
    return back.select("document.*")


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n, max(CASE WHEN event_type = 'view' THEN last END) AS last_view FROM g GROUP BY user_id""")
def group_events(spark, sf_dir):
    """Aggregation of a trace's events as one nested document: group, then map."""
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("events"))
    df = select(docs, ["user_id", "events"], g="[_.event_id.max() <- @events[/(_.event_type)]]")
    return select(df, ["user_id"], n="@events.length()", last_view="@g.view")


def remote_transport(spark: SparkSession, sf_dir: str, transport) -> DataFrame:
    """The template query with a transport that makes the calls (used by the tests)."""
    library = Library(services={"Fetch": RemoteService("get http://svc/part/${key}", transport)})
    return plan_flow(table(spark, sf_dir, "part"), """# /call
***
  answer <- Fetch(key=@p_partkey)
***
""", library).select("p_partkey", answer="answer")
