import json

from loomfield.llm import chat


def call(i, name, **args):
    return {"id": i, "name": name, "arguments": args}


def assistant(*calls, content=None):
    return json.dumps({"tool_calls": list(calls), "content": content}, indent=1)


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


TALK = [
    (1, 0, "user", 'Find "x"\nplease é'),
    (1, 1, "assistant", assistant(call("b", "fetch", url="${a}"), call("a", "search", query="x", limit=2), content="two calls")),
    (1, 2, "tool", result("a", {"z": 1, "b": [1, 2.5, None]})),
    (1, 3, "tool", result("b", "page")),
    (1, 4, "tool", result("b", "again")),
    (1, 5, "assistant", assistant(call("c", "search", limit="many", odd=1), call("d", "nosuch"), call("a", "search", query="y"))),
    (2, 0, "tool", result("q", "early")),
    (2, 1, "assistant", assistant(call("q", "calculate", expression="${r}"), call("r", "calculate", expression="${q}"), call("s", "calculate", expression="1"))),
    (2, 2, "assistant", '{"not": "calls"}'),
    (2, 3, "assistant", '{"broken'),
    (3, 0, None, None), (3, 0, "user", ""), (None, None, "user", "x"), (4, 0, "user", "w " * 100000), (5, 0, "user", "same"), (5, 0, "user", "same"),
]


def canon(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rows(spark, talk):
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' as call_id", "1 as part")
    return chat.format_chat(df).collect()


def test_links_levels_and_validation(spark):
    got = rows(spark, TALK)
    by = {(r.conv_id, r.turn, r.call_id): r for r in got}
    a, b = by[1, 1, "a"], by[1, 1, "b"]
    assert (a.status, a.level, a.valid, b.status, b.level) == ("linked", 0, True, "linked", 1) and a.part < b.part
    assert b.problems == [] and by[1, 3, "b"].level == 1 and by[1, 3, "b"].status == "linked" and by[1, 4, "b"].status == "repeated"
    c, d = by[1, 5, "c"], by[1, 5, "d"]
    assert sorted(c.problems) == ["limit isn't number", "odd is unknown", "query is missing"] and not c.valid and c.status == "unanswered"
    assert d.problems == ["unknown tool"] and by[1, 5, "a"].status == "repeated"
    assert by[2, 0, "q"].status == "orphan" and by[2, 1, "q"].status == by[2, 1, "r"].status == "cyclic" and by[2, 1, "s"].level == 0


def test_canonical_json(spark):
    got = rows(spark, TALK)
    by = {(r.conv_id, r.turn, r.call_id): r.json for r in got}
    assert by[1, 0, None] == canon({"role": "user", "content": 'Find "x"\nplease é'})
    assert by[1, 1, None] == canon({"role": "assistant", "content": "two calls"})
    assert by[1, 1, "a"] == canon(call("a", "search", query="x", limit=2))
    assert by[1, 2, "a"] == canon({"role": "tool", "tool_call_id": "a", "content": {"z": 1, "b": [1, 2.5, None]}})
    assert by[2, 2, None] == canon({"role": "assistant", "content": '{"not": "calls"}'}) and by[2, 3, None] == canon({"role": "assistant", "content": '{"broken'})
    assert {r.json for r in got if r.conv_id == 3} == {canon({"role": None, "content": None}), canon({"role": "user", "content": ""})}
    assert len(got) == len(TALK) + 8 and all(json.loads(r.json) is not None for r in got)


def test_empty_and_plain(spark):
    assert rows(spark, []) == []
    assert [r.status for r in rows(spark, TALK[:1])] == ["plain"]
    assert chat.format_chat(spark.createDataFrame(TALK[:1], "conv_id long, turn long, role string, text string")).columns == list(chat.COLUMNS)


def test_many_calls_and_doubled_keys(spark):
    many = [call(f"m{i}", "calculate", expression=f"${{m{i - 1}}}" if i % 50 else "1") for i in range(200)]
    talk = [(1, 0, "assistant", assistant(*many)), (1, 1, "assistant", '{"tool_calls": [], "tool_calls": [1], "content": 1}')]
    got = rows(spark, talk)
    parts = sorted((r.part, r.level, r.call_id) for r in got if r.call_id)
    assert [p for p, _, _ in parts] == list(range(1, 201)) and [x for _, x, _ in parts] == sorted(x for _, x, _ in parts) and parts[-1][1] == 49
    assert [r.status for r in got if r.turn == 1] == ["plain"]
