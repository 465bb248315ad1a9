import json

import duckdb
from pyspark.sql import functions as F

from laminara.llm import tool_calls as t

CALLS = "conv_id long, turn long, pos int, call_id string, name string, arguments string, deps array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "mode": {"type": "string", "enum": ["x", "y"]}}, "required": ["a", "b"], "additionalProperties": False}}


def link(spark, calls, results):
    extra = {c: F.lit(1) for c in ("level", "status", "n_results", "r", "c")}
    out = t.link_calls(spark.createDataFrame(calls, CALLS).withColumns(extra), spark.createDataFrame(results, RESULTS).withColumns(extra), SCHEMAS).collect()
    return {(r.conv_id, r.turn, r.pos, r.call_id): r for r in out}


def test_same_rows_as_sql(spark, sf):
    duckdb.execute(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    cur = duckdb.execute(t.OP7_SQL)
    names = [d[0] for d in cur.description]
    got = sorted(map(repr, map(tuple, t.op7_tool_calls(spark, sf).select(*names).collect())))
    assert got == sorted(map(repr, cur.fetchall())) and got


def test_same_rows_as_sql_on_odd_turns(spark, tmp_path):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "x" * (7 * c + k)) for c in range(8) for k in range(9)]
    rows += [(3, 4, "user", None), (3, 4, "user", "xx"), (3, 5, "assistant", None), (4, 0, "assistant", ""), (5, 20, "user", "z" * 50_000), (6, 1, "tool", 'say "x"\n'), (6, 2, None, None), (None, 1, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.withColumns({c: F.lit(1) for c in ("pos", "level", "deps", "name")}).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cur = duckdb.execute(t.OP7_SQL)
    names = [d[0] for d in cur.description]
    got = sorted(map(repr, map(tuple, t.op7_tool_calls(spark, str(tmp_path)).select(*names).collect())))
    assert got == sorted(map(repr, cur.fetchall()))
    levels = {eval(x)[names.index("level")] for x in got}  # noqa: S307
    assert {0, 1, 2, 3, 4} <= levels


def test_links_validation_and_canonical_json(spark):
    calls = [
        (1, 1, 0, "a", "add", '{"b": 2.5, "a" :1}', None), (1, 1, 1, "b", "add", '{"a":"1","mode":"z","c":0}', ["a"]), (1, 3, 0, "c", "sub", "{}", ["b", "gone"]),
        (1, 4, 0, "a", "add", '{"a":1,"b":1}', []), (1, 5, 0, "d", "add", "not json", []), (2, 1, 0, "a", "add", "[1]", []), (2, 2, 0, "e", "add", None, []),
        (None, 1, 0, "x", "add", "{}", []), (3, 1, 0, None, "add", "{}", []),
    ]
    results = [(1, 2, "a", 'say "hé"\n'), (1, 2, "a", "second"), (1, 9, "zz", "lost"), (2, 0, "a", "too early"), (1, 6, "d", None)]
    got = link(spark, calls, results)
    assert len(got) == 8
    a = got[1, 1, 0, "a"]
    assert (a.status, a.n_results, a.problems) == ("linked", 2, [])
    assert a.json == '{"arguments":{"a":1,"b":2.5},"id":"a","name":"add","result":"say \\"hé\\"\\n","status":"linked"}'
    assert got[1, 1, 1, "b"].problems == ["a is not integer", "missing b", "mode is not allowed", "unexpected c"] or sorted(got[1, 1, 1, "b"].problems) == ["a is not integer", "missing b", "mode is not allowed", "unexpected c"]
    assert got[1, 3, 0, "c"].problems == ["unknown tool"] and got[1, 3, 0, "c"].status == "unanswered"
    assert got[1, 4, 0, "a"].status == "repeated" and got[1, 9, None, "zz"].status == "orphan"
    assert got[1, 5, 0, "d"].problems == ["not JSON"] and json.loads(got[1, 5, 0, "d"].json)["arguments"] == "not json"
    assert got[2, 1, 0, "a"].status == "unanswered" and got[2, 1, 0, "a"].problems == ["not an object"]
    assert json.loads(got[2, 2, 0, "e"].json)["arguments"] is None and got[2, 2, 0, "e"].problems == ["not JSON"]
    for r in got.values():
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_with_forward_references_and_cycles(spark):
    calls = [(1, k, 0, n, "add", "{}", d) for k, (n, d) in enumerate([("p", ["q"]), ("q", ["r"]), ("r", []), ("s", ["p", "r"])])]
    calls += [(2, 0, 0, "p", "add", "{}", ["q"]), (2, 1, 0, "q", "add", "{}", ["p"]), (2, 2, 0, "t", "add", "{}", ["q"]), (2, 3, 0, "u", "add", "{}", ["u"]), (2, 4, 0, "v", "add", "{}", [])]
    calls += [(3, k, 0, f"n{k}", "add", "{}", [f"n{k - 1}"]) for k in range(300)]
    calls += [(4, k, 0, f"n{k}", "add", "{}", [f"n{k + 1}"]) for k in range(300)] + [(5, 0, 0, "p", "add", "{}", ["q"]), (5, 1, 0, "q", "add", "{}", ["p"]), (5, 2, 0, "r", "add", "{}", ["q"])]
    level = {(r.conv_id, r.call_id): r.level for r in link(spark, calls, []).values()}
    assert all(level[4, f"n{k}"] == 299 - k for k in range(300)) and [level[5, n] for n in "pqr"] == [None] * 3
    assert [level[1, n] for n in "rqps"] == [0, 1, 2, 3]
    assert [level[2, n] for n in "pqtuv"] == [None, None, None, None, 0]
    assert all(level[3, f"n{k}"] == 0 for k in range(300))


def test_empty(spark):
    assert link(spark, [], []) == {}
