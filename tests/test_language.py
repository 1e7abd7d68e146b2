"""Lexer, parser and expressions against values stated by hand."""

import json

import pytest
from pyspark.sql import functions as F

from flowspark.plans.compiler import compiled
from flowspark.plans.lexer import FlowSyntaxError
from flowspark.plans.parser import parse_expression, parse_flow
from flowspark.plans.tree import Node

#: A delivery: a buyer, lines of goods and stops of a tour.
DELIVERY = {
    "buyer": {"name": "Ann", "city": "Oslo", "weight": 61.5},
    "lines": [
        {"sku": "k10", "kind": "tool", "qty": 3, "weight": 4.25, "note": "fragile"},
        {"sku": "k11", "kind": "paper", "qty": 10, "weight": 0.5},
        {"sku": "k12", "kind": "tool", "qty": 1, "weight": 99.0},
        {"sku": "k13", "kind": "paper", "qty": 4, "weight": 1.75, "note": "gift"},
        {"sku": "k14", "kind": "food", "qty": 2, "weight": 12.5},
    ],
    "stops": {"north": [4, 8], "south": [6]},
}
TYPE = """buyer struct<name:string,city:string,weight:double>,
lines array<struct<sku:string,kind:string,qty:bigint,weight:double,note:string>>, stops struct<north:array<bigint>,south:array<bigint>>"""
SKUS = ["k10", "k11", "k12", "k13", "k14"]

PATHS = [
    ("@d.buyer.city", "Oslo"), ("@d.lines.sku", SKUS), ("@d.lines[0].sku", "k10"), ("@d.lines[-2].kind", "paper"), ("@d.lines.note", ["fragile", "gift"]),
    ("@d.nowhere", None), ("@d..city", ["Oslo"]), ("@d..weight", [61.5, 4.25, 0.5, 99.0, 1.75, 12.5]), ("@d..price", None), ("@d.stops.north[1]", 8), ('@d["buyer"].name', "Ann"), ("@d.buyer.*", ["Ann", "Oslo", 61.5]),
]
VIEWS = [
    ("@d.lines[*].qty", [3, 10, 1, 4, 2]), ("@d.lines[1:3].sku", ["k11", "k12"]), ("@d.lines[-2:].sku", ["k13", "k14"]), ("@d.lines[:1].sku", ["k10"]), ("@d.lines[3:].qty", [4, 2]),
    ("@d.lines[?(_.qty > 2)].sku", ["k10", "k11", "k13"]), ("@d.lines[?(_.weight >= @limit)].sku", ["k12", "k14"]), ("@d.lines[?(#[0] > 2)].sku", ["k13", "k14"]), ('@d.lines[?(_.kind == "none")].sku', []),
    ("@d.lines[/(_.kind)][*].sku", {"food": ["k14"], "paper": ["k11", "k13"], "tool": ["k10", "k12"]}), ("[_.length() <- @d.lines[/(_.kind)]]", {"food": 1, "paper": 2, "tool": 2}),
    ("[_.qty.sum() <- @d.lines[/(_.qty / 4)]]", [6, 4, 10]), ('@d.lines[:2]["sku", "qty"]', [{"sku": "k10", "qty": 3}, {"sku": "k11", "qty": 10}]),
    ('@d.lines[:2]["sku", "qty"]\'', {"qty": [3, 10], "sku": ["k10", "k11"]}), ('@d.lines[:2][, "sku"] + [_.qty * 2 <- @d.lines[:2]][+ "twice"]', [{"sku": "k10", "twice": 6}, {"sku": "k11", "twice": 20}]),
    ('@d.buyer["name":"city"]', {"name": "Ann", "city": "Oslo"}), ("@d.stops[*][0]", {"north": 4, "south": 6}),
    ("[ceil(_.weight) <- @d.lines]", [5, 1, 99, 2, 13]), ("[# <- @d.lines]", [0, 1, 2, 3, 4]), ("[_ + 1 <- @d.stops.north]", [5, 9]), ('[_.length() <- @d.stops]', {"north": 2, "south": 1}),
]
OPERATORS = [
    ("7 - 2 * 3", 1), ("-(4 - 6) * 5", 10), ("9 / 4", 2.25), ("7.0 / 2", 3.5), ("7 % 4", 3), ("7.5 % 2", 1.5), ('"ab" * 2', "abab"), ('"n" + 7', "n7"), ('7 + "n"', "7n"),
    ("2 == 2.0", True), ('2 == "2"', False), ("null == null", True), ("null >= null", False), ("3 != 4", True), ('"b" > "a"', True), ("[1, 2] == [1, 2]", True),
    ('"" or 0', False), ('"x" and 5', True), ("not null", True), ("not [0]", False), ("4 in [4, 5]", True), ("6 in [4, 5]", False), ("6 not in [4, 5]", True), ("null in [null]", True), ('"k" in {"k": null}', True),
    ("[4, 5] - [5]", [4]), ("[4, 4, 5] - [5]", [4, 4]), ("null + [6]", [6]), ("2.5 + 1", 3.5), ("1 < 2.5", True),
]
FUNCTIONS = [
    ("round(4.5)", 5), ("round(-4.5)", -5), ("floor(-0.5)", -1), ("ceil(-0.5)", 0), ('substr("delivery", 2, 5)', "liv"), ("[7, 9, 8].max()", 9), ("[7, null].min()", None), ('["q", "p"].max()', "q"), ("[2, 3.5].sum()", 5.5), ("[].sum()", None),
    ("[4].subsetof([4, 5])", True), ("[4].anyof([5])", False), ("[4].noneof([5])", True), ('split("x;y;;", ";")', ["x", "y"]), ('split("", ";")', [""]), ('mk_string([4, null, "z"], "+")', "4+null+z"),
    ("[[4], [5, 6]].flatten()", [4, 5, 6]), ("[8, 4, 8].distinct()", [8, 4]), ('parse_json("{\\"q\\": [4, {\\"r\\": 5}]}").q[1].r', 5), ('{"p": null, "q": 4}.to_json()', '{"p":null,"q":4}'),
    ('[{"w": 4}, {"w": 1}].sort_by_key("w")', [{"w": 1}, {"w": 4}]), ('[{"p": 1}].zip([{"q": 2}])', [{"p": 1, "q": 2}]), ('merge_dict({"p": {"x": 7}}, {"p": {"x": 8, "y": 9}})', {"p": {"x": 7, "y": 9}}),
    ('{"two_words": {"in_side": 4}}.to_lower_camel()', {"twoWords": {"inSide": 4}}), ('{"twoWords": 4}.to_under_score()', {"two_words": 4}), ('{"p": 4, "q": 5}.delete(["q"])', {"p": 4}),
    ('"77".to_long()', 77), ("null.to_long()", 0), ('"0.25".to_double()', 0.25), ("12.to_string()", "12"), ("null.to_string()", "null"), ('null.get_or_else("other")', "other"), ("4.get_or_else(5)", 4),
    ('[4, 5].at_or_else(9, "none")', "none"), ("[4, 5].at_or_else(1, 0)", 5), ("concat([4], 5)", [4]), ("concat(4, 5)", None), ('"word".length()', 4), ('[_ * 3 <- {"p": 4}]', {"p": 12}),
]
CASES = [*PATHS, *VIEWS, *OPERATORS, *FUNCTIONS]
FAILURES = [
    ("@d.lines[7]", "IndexOutOfBoundsException"), ('@d["seller"]', "IndexOutOfBoundsException"), ("4 / 0", "ArithmeticException"), ("4 % 0", "ArithmeticException"), ('4 < "4"', "IllegalArgumentException"), ("4 - null", "IllegalArgumentException"),
    ('"4.5".to_long()', "IllegalArgumentException"), ('substr("word", 3, 8)', "IndexOutOfBoundsException"), ("unheard_of(4)", "NotImplementedError"), ('parse_json("[4]")', "IllegalArgumentException"), ("[8 / _ <- [4, 0]]", "ArithmeticException"), ("4[0]", "IllegalArgumentException"),
]


@pytest.fixture(scope="module")
def delivery(spark):
    return spark.createDataFrame([(json.dumps(DELIVERY), 12)], "s string, limit long").select(F.from_json("s", TYPE).alias("d"), "limit")


def test_values(delivery):
    """All cases in one job: a struct of each value as JSON, and its failure."""
    columns = []
    for k, (text, _) in enumerate(CASES):
        v = compiled(delivery, text)
        columns += [F.to_json(F.struct(v.col.alias("v"))).alias(f"v{k}"), (v.err if v.err is not None else F.lit(None).cast("string")).alias(f"e{k}")]
    row = delivery.select(*columns).first()
    wrong = [(text, want, row[f"e{k}"], row[f"v{k}"]) for k, (text, want) in enumerate(CASES) if row[f"e{k}"] is not None or json.loads(row[f"v{k}"]).get("v") != want]
    assert not wrong


def test_failures(delivery):
    values = [compiled(delivery, text) for text, _ in FAILURES]
    row = delivery.select(*(v.err.alias(f"e{k}") for k, v in enumerate(values)), *(F.to_json(F.struct(v.col.alias("v"))).alias(f"v{k}") for k, v in enumerate(values))).first()
    assert [row[f"e{k}"] for k in range(len(FAILURES))] == [e for _, e in FAILURES]


def test_lexical_rules():
    with pytest.raises(FlowSyntaxError):
        parse_expression("n-4")
    assert parse_expression("n - 4") == Node("arith", ("-", Node("ref", ("n",)), Node("lit", (4,))))
    assert parse_expression("not p and q or r") == Node("or", (Node("and", (Node("not", (Node("ref", ("p",)),)), Node("ref", ("q",)))), Node("ref", ("r",))))
    assert parse_expression("[4,\n 5]") == parse_expression("[4, 5]")
    for bad in ("4 *", "[4", '{"p" 4}', "p q", '"open'):
        with pytest.raises(FlowSyntaxError):
            parse_expression(bad)
    with pytest.raises(FlowSyntaxError, match="3:"):
        parse_flow("# /late\n***\n  when <-\n***\n")
