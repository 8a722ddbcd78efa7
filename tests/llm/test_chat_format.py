import json

from cohortspark.llm.chat_format import format_chats, tool_schemas

TOOLS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"]}, "ping": {}}


def call(*calls, content=None):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls], "content": content})


def rows(spark, data, tools=TOOLS):
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.turn): r for r in format_chats(frame, tool_schemas(spark, tools)).collect()}


def test_links_validates_and_orders(spark):
    data = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": [1, 2]}})),
        (1, 2, "assistant", call(("c1", "add", {"b": 2.5, "a": 1}), ("c2", "add", {"a": "x"}))),
        (1, 3, "assistant", call(("c3", "add", {"a": {"$ref": "c2"}}))),
        (1, 4, "tool", json.dumps({"tool_call_id": "c2", "content": "ok"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "nobody", "content": None})),
        (2, 0, "assistant", call(("c1", "nope", {}), ("c4", "ping", {}), ("c5", "add", {}), ("c6", "add", {"a": 1, "q": 1}))),
        (2, 1, "assistant", "{not json"),
        (2, 2, None, None),
        (2, 3, "user", ""),
    ]
    got = rows(spark, data)
    assert len(got) == len(data)
    assert got[1, 0].message == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert (got[1, 1].order_turn, got[1, 1].order_level, got[1, 1].n_linked) == (2, 1, 1)
    assert got[1, 1].message == '{"content":{"a":[1,2],"z":1},"linked":true,"role":"tool","tool_call_id":"c1"}'
    one = json.loads(got[1, 2].message)
    assert [c["valid"] for c in one["tool_calls"]] == [True, False]
    assert '"arguments":{"a":1,"b":2.5},"id":"c1","name":"add"' in got[1, 2].message
    assert (got[1, 2].n_calls, got[1, 2].n_linked, got[1, 2].n_invalid) == (2, 2, 1)
    # c3 waits for the result of c2, at turn 4
    assert (got[1, 3].order_turn, got[1, 3].order_level) == (4, 1)
    assert (got[1, 4].order_turn, got[1, 4].order_level) == (4, 0)
    assert got[1, 5].n_linked == 0 and '"linked":false' in got[1, 5].message
    assert (got[2, 0].n_calls, got[2, 0].n_invalid, got[2, 0].n_linked) == (4, 3, 0)
    assert got[2, 1].message == '{"content":"{not json","role":"assistant"}'
    assert got[2, 2].message == '{"content":null,"role":null}'
    assert got[2, 3].message == '{"content":"","role":"user"}'


def test_cycles_have_no_level(spark):
    data = [
        (1, 0, "assistant", call(("a", "add", {"a": {"$ref": "b"}}))),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
        (1, 2, "assistant", call(("b", "add", {"a": {"$ref": "a"}}))),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": 1})),
        (1, 4, "user", "x"),
    ]
    import cohortspark.llm.chat_format as module

    module.ROUNDS, kept = 6, module.ROUNDS
    try:
        got = rows(spark, data)
    finally:
        module.ROUNDS = kept
    assert got[1, 0].order_level is None and got[1, 4].order_level == 0


def test_deep_chain_keeps_its_order(spark):
    n = 28
    data = [(1, 1000, "assistant", call(("c0", "add", {"a": 1})))]
    for i in range(n):  # each call but the first refers to the previous result: 2 n - 1 edges
        data.append((1, 2 * i + 1, "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})))
        if i:
            data.append((1, 2 * i, "assistant", call((f"c{i}", "add", {"a": {"$ref": f"c{i - 1}"}}))))
    data += [(2, 0, "assistant", call(("a", "add", {"a": {"$ref": "b"}}))), (2, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1}))]
    data += [(2, 2, "assistant", call(("b", "add", {"a": {"$ref": "a"}}))), (2, 3, "tool", json.dumps({"tool_call_id": "b", "content": 1}))]
    data += [(2, 4, "assistant", call(("c", "add", {"a": {"$ref": "b"}})))]  # behind the cycle
    got = rows(spark, data)
    chain = [(1, 1000)] + [(1, t) for i in range(n) for t in ([2 * i, 2 * i + 1] if i else [1])]
    assert [(got[k].order_turn, got[k].order_level) for k in chain] == [(1000, level) for level in range(2 * n)]
    assert [got[2, t].order_level for t in range(5)] == [None] * 5 and got[2, 4].order_turn == 4


def test_repeated_rows_and_null_keys(spark):
    one = (1, 0, "assistant", call(("c1", "add", {"a": 1})))
    reply = (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": 1}))
    nowhere = [(None, 0, "assistant", call(("c1", "add", {"a": 1}))), (None, 1, "tool", json.dumps({"tool_call_id": "c1", "content": 1}))]
    untimed = [(2, None, "assistant", call(("c1", "ping", {}))), (2, None, "tool", json.dumps({"tool_call_id": "c1", "content": 1}))]
    same = [(3, 5, "tool", json.dumps({"tool_call_id": "c1", "content": 1})), (3, 5, "assistant", call(("c1", "ping", {})))]
    frame = spark.createDataFrame([one, one, reply, reply, *nowhere, *untimed, *same], "conv_id long, turn long, role string, text string")
    got = sorted(format_chats(frame, tool_schemas(spark, TOOLS)).collect(), key=lambda r: (r.conv_id or 0, r.turn or 0, r.role))
    assert [(r.n_calls, r.n_linked, r.n_invalid) for r in got] == [(1, 1, 0), (0, 1, 0), (1, 1, 0), (1, 1, 0), (0, 1, 0), (0, 1, 0), (1, 1, 0), (0, 1, 0), (1, 1, 0), (0, 1, 0)]
    assert all(len(json.loads(r.message)["tool_calls"]) == 1 for r in got if r.n_calls)
    assert [(r.order_turn, r.order_level) for r in got[-2:]] == [(5, 0), (5, 1)]
    assert [r.order_turn for r in got[6:8]] == [None, None]


def brute_force(data, tools):
    """Counts and order by the plainest means: a message waits until all that it waits for have come."""
    types = {"integer": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float), "string": lambda v: type(v) is str}
    out = {}
    for conv in {r[0] for r in data}:
        messages = sorted({r for r in data if r[0] == conv}, key=lambda r: r[1])
        read = {r[1]: json.loads(r[3]) for r in messages if r[2] in ("assistant", "tool") and (r[3] or "").startswith("{")}
        call_at, result_at = {}, {}
        for _, t, role, _ in messages:
            for c in read.get(t, {}).get("tool_calls", []) if role == "assistant" else []:
                call_at.setdefault(c["id"], t)
            if role == "tool" and t in read:
                result_at.setdefault(read[t]["tool_call_id"], t)
        waits = {t: set() for t in read}
        for _, t, role, _ in messages:
            if role == "tool" and t in read:
                waits[t] |= {call_at[read[t]["tool_call_id"]]} if read[t]["tool_call_id"] in call_at else set()
            for c in read.get(t, {}).get("tool_calls", []) if role == "assistant" else []:
                waits[t] |= {result_at[v["$ref"]] for v in c["arguments"].values() if isinstance(v, dict) and v["$ref"] in result_at}
        place, left = {}, set(waits)
        while ready := [t for t in left if waits[t] <= set(place)]:
            for t in ready:
                m = max([place[w] for w in waits[t]], default=(-1, 0))
                place[t] = (m[0], m[1] + 1) if m[0] >= t else (t, 0)
            left -= set(ready)
        for _, t, role, _ in messages:
            calls = read.get(t, {}).get("tool_calls", []) if role == "assistant" else []
            bad = 0
            for c in calls:
                spec = tools.get(c["name"])
                given = c["arguments"]
                bad += spec is None or any(x not in given for x in spec.get("required", [])) or any(k not in spec.get("properties", {}) or not types[spec["properties"][k]["type"]](v) for k, v in given.items())
            linked = sum(c["id"] in result_at for c in calls) if calls else int(role == "tool" and read[t]["tool_call_id"] in call_at)
            out[conv, t] = (len(calls), linked, bad, None if t in left else place.get(t, (t, 0)))
    return out


def test_generated_conversations_equal_brute_force(spark):
    import random

    rng, data = random.Random(8), []
    for conv in range(40):
        n = rng.randint(1, 14)
        turns = rng.sample(range(60), 2 * n)
        for i in range(n):
            calls = [(f"k{rng.randint(0, n)}", rng.choice(["add", "add", "ping", "nope"]), {k: rng.choice([1, 2.5, "x", {"$ref": f"k{rng.randint(0, n)}"}]) for k in rng.sample("abq", rng.randint(0, 2))}) for _ in range(rng.randint(1, 3))]
            data.append((conv, turns[i], "assistant", call(*calls)))
            data.append((conv, turns[n + i], "tool", json.dumps({"tool_call_id": f"k{rng.randint(0, n)}", "content": i})))
    data += rng.sample(data, 50)  # rows that repeat
    rng.shuffle(data)
    want, got = brute_force(data, TOOLS), rows(spark, data)
    assert set(want) == set(got) and any(x[3] is None for x in want.values())
    for k, (n_calls, n_linked, n_invalid, place) in want.items():
        r = got[k]
        assert (r.n_calls, r.n_linked, r.n_invalid) == (n_calls, n_linked, n_invalid), k
        assert (r.order_level is None) if place is None else ((r.order_turn, r.order_level) == place), k


def test_empty_and_extra_columns(spark):
    assert rows(spark, []) == {}
    frame = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], "conv_id long, turn long, role string, text string, payload int, message string")
    assert format_chats(frame, tool_schemas(spark, TOOLS)).first().message == '{"content":"x","role":"user"}'


def test_no_schemas_is_not_invalid(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", call(("c1", "add", {"a": "x"})))], "conv_id long, turn long, role string, text string")
    row = format_chats(frame, None).first()
    assert (row.n_calls, row.n_invalid) == (1, 0) and json.loads(row.message)["tool_calls"] == [{"arguments": {"a": "x"}, "id": "c1", "name": "add"}]
    assert format_chats(frame, tool_schemas(spark, {})).first().n_invalid == 1


def test_the_query_validates_by_what_calls_show(spark, tmp_path):
    from cohortspark.llm.chat_format import op9_chat_format

    given = [("add", {"a": i, "b": i / 2, "c": "x"}) for i in range(18)] + [("add", {"a": 1, "b": 2}), ("add", {"a": "one", "b": 1}), ("add", {"b": 1}), ("add", {"a": 1, "b": 1, "stray": 1})]
    given += [("ping", {}), ("once", {"q": "x"}), ("deep", {"v": 1}), ("deep", {"v": {"$ref": "c0"}}), (None, {"a": 1}), ("flat", [1])]
    data = [(i, 0, "assistant", call((f"c{i}", name, a))) for i, (name, a) in enumerate(given)] + [(99, 0, "user", "x"), (99, 1, "assistant", None)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.n_invalid for r in op9_chat_format(spark, str(tmp_path)).where("turn = 0").collect()}
    # another type, a missing argument, one of a single call, a call without a name and arguments that are no object
    assert {i for i, n in got.items() if n} == {19, 20, 21, 26, 27} and len(got) == len(given) + 1
