import json

from postmill.llm.chats import SCHEMAS as TOOLS
from postmill.llm.chats import format_chats, with_tool_calls

SCHEMAS = [("look", "q", "string", True), ("look", "n", "integer", None), ("sum", "x", "number", True), ("sum", "opt", "object", False), ("odd", "a", "nonsense", True)]
TABLE = "conv_id long, turn long, role string, text string"


def call(id, name="look", arguments=None, **more):
    return {"id": id, "name": name, "arguments": {"q": "a"} if arguments is None else arguments} | more


def calls(*listed, content="hm"):
    return json.dumps({"content": content, "tool_calls": list(listed)}, ensure_ascii=False)


def result(id, content):
    return json.dumps({"tool_call_id": id, "content": content}, ensure_ascii=False)


def run(spark, *rows, schema=TABLE):
    schemas = spark.createDataFrame(SCHEMAS, "name string, argument string, type string, required boolean")
    return format_chats(spark, spark.createDataFrame(list(rows), schema).repartition(2), schemas)


def called(spark, *rows):
    return {(r.turn, r.place): r for r in run(spark, *rows).where("kind = 'call'").collect()}


def test_links_and_canonical_json(spark):
    got = called(
        spark,
        (1, 0, "user", "hi"),
        (1, 1, "assistant", calls(call("a", arguments={"q": "zü\n\"x\"", "n": 3}), call("b", "sum", {"x": 1.5, "opt": {"z": [1, {"b": 1, "a": 2}], "k": None}}), call("c"))),
        (1, 2, "tool", result("b", {"y": 1, "x": [True, None]})), (1, 3, "tool", result("a", "text é")), (1, 4, "tool", result("a", "again")),
        (2, 2, "tool", result("c", "of another conversation")),
    )
    a, b, c = (got[1, i] for i in range(3))
    assert (a.status, a.n_results, a.valid) == ("answered", 2, True) and (b.status, b.valid) == ("answered", True) and c.status == "unanswered"
    for row, arguments, answer in ((a, {"n": 3, "q": "zü\n\"x\""}, "text é"), (b, {"opt": {"k": None, "z": [1, {"a": 2, "b": 1}]}, "x": 1.5}, {"x": [True, None], "y": 1})):
        want = {"arguments": arguments, "id": row.call_id, "name": row.name, "result": answer}
        assert row.json == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert c.json.endswith('"result":null}')


def test_order_of_calls(spark):
    got = called(
        spark,
        (1, 1, "assistant", calls(call("a", after=["b", "gone"]), call("b"), call("c", after=["a", "b"]), call("d", after=["a", "e"]), call("e", after=["d"]), call("f", after=["f"]))),
        (4, 9, "assistant", calls(*(call(f"k{i}", after=[f"k{i + 1}"] + ["k4"] * (i < 3)) for i in range(5)))),
        (3, 0, "assistant", calls(*(call(f"k{i}", after=[f"k{i - 1}"]) for i in range(6)))),
    )
    levels = {r.call_id: r.level for r in got.values() if r.conv_id == 1}
    assert levels == {"b": 0, "a": 1, "c": 2, "d": -1, "e": -1, "f": -1}
    assert [got[0, i].level for i in range(6)] == [0] * 6
    assert [got[9, i].level for i in range(5)] == [4, 3, 2, 1, 0]


def test_validation(spark):
    cases = [
        ({"q": "x"}, "look", True), ({"q": "x", "n": 2}, "look", True), ({"q": 5}, "look", False), ({"n": 2}, "look", False), ({"q": "x", "n": 2.5}, "look", False),
        ({"q": "x", "more": 1}, "look", False), ({}, "look", False), ([], "look", False), ("{\"q\": \"as text\"}", "look", True), ("not json", "look", False),
        ({"x": 1}, "sum", True), ({"x": 1.5, "opt": {}}, "sum", True), ({"x": "1"}, "sum", False), ({"x": 1, "opt": []}, "sum", False), ({"q": "x"}, "unknown", False), ({"a": 1}, "odd", False),
    ]
    got = called(spark, (1, 1, "assistant", calls(*(call(str(i), name, a) for i, (a, name, _) in enumerate(cases)))))
    assert [got[1, i].valid for i in range(len(cases))] == [v for *_, v in cases]


def test_any_rows(spark):
    rows = [
        (None, 1, "assistant", calls(call("a"))), (None, 2, "tool", result("a", 1)), (4, None, None, None), (4, 1, "assistant", "plain [1] text"), (4, 2, "tool", "no json"),
        (4, 3, "tool", result("lost", "x")), (5, 1, "assistant", calls(call("r"), call("r"), call(None))), (5, 1, "assistant", calls(call("r"), call("r"), call(None))),
        (6, 1, "user", calls(call("not mine"))), (7, 1, "assistant", '{"tool_calls": 5}'), (7, 2, "assistant", "w " * 100_000), (8, 1, "assistant", ""), (9, 1, "assistant", "12"),
    ]
    got = run(spark, *rows).collect()
    by = lambda conv: sorted((r.kind, r.status) for r in got if r.conv_id == conv)
    assert by(None) == [("call", "answered"), ("message", "message")]
    assert by(4) == [("message", "message")] * 3 + [("orphan", "orphan")]
    states = [s for k, s in by(5) if k == "call"]
    assert states.count("unlinked") == 2 and states.count("duplicate") == 2 and states.count("unanswered") == 2
    assert by(6) == by(8) == by(9) == [("message", "message")] and by(7) == [("message", "message")] * 2
    for r in got:
        json.loads(r.json)


def test_empty_table_and_other_columns(spark):
    assert run(spark, (1, 1, "user", "x")).limit(0).count() == 0
    assert run(spark, (1, 1, "user", "x")).where("false").union(run(spark, (1, 1, "user", "x"))).count() == 1
    wide = run(spark, (1, 0, "assistant", calls(call("a")), 1, 2, "x"), schema=TABLE + ", level int, conv int, name string")
    assert sorted(r.kind for r in wide.collect()) == ["call", "message"]
    none = spark.createDataFrame([], TABLE)
    assert format_chats(spark, none, spark.createDataFrame([], "name string, argument string, type string, required boolean")).count() == 0


def test_main_path_is_native(spark):
    frame = run(spark, (1, 1, "assistant", calls(call("a", after=["b"]), call("b"))))
    plan = frame._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_tool_calls_keep_every_message(spark):
    rows = [(c, t, r, x) for c in (1, None) for t in (0, 1, 2, None) for r in ("user", "assistant", "system", None) for x in ("some text", "", None)]
    made = with_tool_calls(spark.createDataFrame(rows, TABLE)).collect()
    of = lambda role: [r for r in made if r.role == role]
    assert len(of("assistant")) == 24 and all(len(json.loads(r.text)["tool_calls"]) == 2 for r in of("assistant"))
    assert len(of("system")) == len(of(None)) == 24 and len(of("user")) == 12
    answers = [json.loads(r.text) for r in of("tool")]
    assert sum(a["content"] is None for a in answers) == 8 and sum(a["content"] == "some text" for a in answers) == 4
    assert len(of("tool")) == 16 and {r.turn for r in of("tool")} == {1, 2}
    one = with_tool_calls(spark.createDataFrame([(1, 1, "assistant", None), (1, 2, "user", None), (1, 3, None, "x"), (2, None, "user", "y")], TABLE))
    got = format_chats(spark, one, spark.createDataFrame(TOOLS, "name string, argument string, type string, required boolean")).collect()
    assert sorted((r.conv_id, r.kind, r.status) for r in got) == [(1, "call", "answered"), (1, "call", "answered"), (1, "message", "message"), (1, "message", "message"), (2, "message", "message")]
    assert all(json.loads(r.json) for r in got)
