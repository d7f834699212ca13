"""The parser's vectors."""

import math

import pytest

from tidemark.sources.exposition import parse

NONE = None
VECTORS = [
    ("# HELP x y", NONE), ("", NONE), (" ", NONE), (" # c", NONE), ("up", NONE), ("up abc", NONE), ("up\t1", NONE), ("up 1", ("up", 1.0, None, {})), ("up 1 ", NONE), ("up  1", NONE),
    ("up 1 1700000000000", ("up", 1.0, 1700000000000, {})), ("up 1 1700000000000 x", ("up", 1.0, 1700000000000, {})), ("up 1 1.7", NONE), ("up 1 abc", NONE), ("up 1 +7", ("up", 1.0, 7, {})),
    ("up +Inf", NONE), ("up Inf", NONE), ("up nan", NONE), ("up NaN", ("up", math.nan, None, {})), ("up Infinity", ("up", math.inf, None, {})), ("up -Infinity", ("up", -math.inf, None, {})), ("up 1e3", ("up", 1000.0, None, {})),
    ('m{a="b"} 2', ("m", 2.0, None, {"a": "b"})), ('m{a="b"} 2 -5', ("m", 2.0, -5, {"a": "b"})), ('m{a="b",c="d"} 2', ("m", 2.0, None, {"a": "b", "c": "d"})), ('m{a="b",} 2', ("m", 2.0, None, {"a": "b"})),
    ("m{a=b} 2", ("m", 2.0, None, {"a": "b"})), ('m{a=""} 2', ("m", 2.0, None, {"a": ""})), ("m{} 2", ("m", 2.0, None, {})), ('{a="b"} 2', ("", 2.0, None, {"a": "b"})), ('m{a="b"}tail 2', ("m", 2.0, None, {"a": "b"})),
    ('m{a="b" 2', NONE), ("m}{ 2", NONE), ('m{a="x y"} 2', NONE), ('m{a="x,y"} 2', ("m", 2.0, None, {"a": "x"})), ('m{a="x=y"} 2', ("m", 2.0, None, {})), ('m{a="x}y"} 2', ("m", 2.0, None, {"a": "x}y"})),
    ('m{a="q\\"z"} 2', ("m", 2.0, None, {"a": 'q\\"z'})), ('m{a="1",a="2"} 2', ("m", 2.0, None, {"a": "2"})), ('m{agent_id="zzz"} 2', ("m", 2.0, None, {})),
]


def test_vectors(spark):
    rows = [(str(i), "A", line) for i, (line, _) in enumerate(VECTORS)]
    got = {}
    for r in parse(spark.createDataFrame(rows, "n string, agent_id string, body string")).selectExpr("n", "name", "value", "unix_millis(timestamp) as ms", "tags").collect():
        got.setdefault(int(r.n), []).append(r)
    for i, (line, want) in enumerate(VECTORS):
        if want is None:
            assert i not in got, line
            continue
        (r,) = got[i]
        name, value, ms, tags = want
        assert (r["name"], r.ms, r.tags) == (name, ms, tags | {"agent_id": "A"}), line
        assert r.value == value or (math.isnan(value) and math.isnan(r.value)), line


def test_lines_and_bad_lines_do_not_fail_a_body(spark):
    body = "# c\r\na 1\rb 2\n\nbad\nc 3 x\nd{x=\"1\"} 4 5"
    got = parse(spark.createDataFrame([("A", body), ("B", None), ("C", "")], "agent_id string, body string")).collect()
    assert sorted((r.agent_id, r["name"], r.value) for r in got) == [("A", "a", 1.0), ("A", "b", 2.0), ("A", "d", 4.0)]


@pytest.mark.parametrize("line,value", [("x 1d", 1.0), ("x 0x1p3", 8.0), ("x -1.5f", -1.5), ("x .5", 0.5)])
def test_java_doubles(spark, line, value):
    assert parse(spark.createDataFrame([("A", line)], "agent_id string, body string")).first().value == value
