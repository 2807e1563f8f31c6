import json
import random

from scorewright.llm import tool_calls as op

SCHEMA = "conv_id long, turn long, role string, text string, call_id string"
TOOLS = {"add": (("a", "number", True, None, None), ("note", "string", False, 1, 5)), "assistant": (("text", "string", True, 1, 20),)}


def linked(spark, rows, schemas=TOOLS):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(op.link(*op.parsed(df), schemas).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.seq))


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_validates_and_orders(spark):
    rows = [
        (1, 0, "system", "s"),
        (1, 1, "assistant", call(("c1", "add", {"note": "hi", "a": 2}), ("c2", "add", {"a": "two", "note": "too long"}))),
        (1, 2, "tool", result("c2", 'no "é"\n')),
        (1, 3, "tool", result("c1", "ok")),
        (1, 4, "tool", result("zz", "lost")),
        (2, 5, "tool", result("e", "early")),
        (2, 6, "assistant", call(("e", "add", {}), ("f", "nothing", {}))),
    ]
    out = {(r.conv_id, r.call_id): r for r in linked(spark, rows)}
    assert [r.seq for r in linked(spark, rows)] == [0, 1, 2, 0, 1]
    a, b = out[1, "c1"], out[1, "c2"]
    assert (a.status, a.call_turn, a.result_turn, a.n_errors) == ("linked", 1, 3, 0)
    assert a.canonical == '{"arguments":{"a":2,"note":"hi"},"errors":[],"id":"c1","name":"add","result":"ok","status":"linked"}'
    assert b.n_errors == 2 and json.loads(b.canonical)["errors"] == ["a: not a number", "note: length"]
    assert json.loads(b.canonical)["result"] == 'no "é"\n'
    assert out[1, "zz"].status == "no call" and out[2, "e"].status == "early result" and out[2, "f"].status == "no result"
    assert json.loads(out[2, "e"].canonical)["errors"] == ["a: missing"] and json.loads(out[2, "f"].canonical)["errors"] == ["unknown tool"]


def test_plain_turns(spark):
    out = linked(spark, [(1, 0, "user", "ask"), (1, 1, "assistant", "say"), (1, 2, "user", "x" * 21), (1, 4, "assistant", None)])
    assert [(r.call_id, r.status, r.n_errors) for r in out] == [("turn-0", "linked", 0), ("turn-2", "no result", 1), ("turn-3", "no call", 0)]
    assert out[0].canonical == '{"arguments":{"text":"ask"},"errors":[],"id":"turn-0","name":"assistant","result":"say","status":"linked"}'


def test_edges(spark):
    assert linked(spark, []) == []
    rows = [(None, None, "user", None), (None, 0, "user", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 0, None, "q"), (5, 0, "assistant", "{not json"), (5, 2, "tool", "{bad")]
    out = linked(spark, rows)
    assert [r.status for r in out if r.conv_id == 3] == ["linked", "linked"] and [r.seq for r in out if r.conv_id == 3] == [0, 1]
    alone = [r for r in out if r.conv_id is None]
    assert len(alone) == 2 and all(r.n_errors == 1 and r.seq == 0 and r.status == "no result" for r in alone)
    assert [(r.call_id, r.status) for r in out if r.conv_id == 5] == [("turn--1", "no call"), (None, "no call")]


def test_every_tool_message_shows(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[]}'), (1, 1, "tool", "plain"), (1, 2, "tool", "[1]"), (1, 3, "tool", ' {"tool_call_id":"a","content":"c"}'), (1, 4, "tool", None)]
    rows += [(1, 5, "assistant", " " + call(("a", "add", {"a": 1}), (None, "add", {"a": 1})))]
    out = linked(spark, rows)
    assert sorted((str(r.call_id), r.status) for r in out) == [("None", "no call")] * 3 + [("None", "no result"), ("a", "early result"), ("turn--1", "no call")]


def slow_order(rows):
    """(turn, id) of explicit calls, topologically ordered by repeated raising; and which can't be ordered."""
    calls = {c["id"]: (t, c["arguments"]) for _, t, role, text in rows if role == "assistant" for c in json.loads(text)["tool_calls"]}
    uses = {i: {v.lstrip("$") for v in a.values() if isinstance(v, str)} & set(calls) for i, (_, a) in calls.items()}

    def needs(i, path=()):
        return i in path or any(needs(j, (*path, i)) for j in uses[i])

    bad = {i for i in calls if needs(i)}

    def place(i):
        own = (calls[i][0], 0)
        under = max((place(j) for j in uses[i]), default=None) if i not in bad else None
        return (under[0], under[1] + 1) if under and under >= own else own

    return sorted(calls, key=lambda i: (*place(i), calls[i][0], i)), bad


def test_topological_order(spark):
    r = random.Random(8)
    rows = []
    for conv in range(40):
        ids = [f"c{k}" for k in range(r.randint(1, 7))]
        for k, i in enumerate(ids):
            used = [("$" if r.random() < 0.5 else "") + r.choice(ids if conv % 4 == 0 else [x for x in ids if x < i] or ["none"]) for _ in range(r.randint(0, 2))]
            rows.append((conv, r.randint(0, 6), "assistant", call((i, "add", {"a": 1, **{f"x{n}": v for n, v in enumerate(used)}}))))
    out = linked(spark, rows)
    for conv in range(40):
        own = [x for x in out if x.conv_id == conv]
        want, bad = slow_order([x for x in rows if x[0] == conv])
        assert [x.call_id for x in own] == want, conv
        assert {x.call_id for x in own if "circular reference" in x.canonical} == bad, conv
        assert [x.seq for x in own] == list(range(len(own)))


def test_links_by_hash_join(spark, capsys):
    rows = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x")], SCHEMA)
    op.link(*op.parsed(rows)).explain()
    assert "ShuffledHashJoin [conv_id" in capsys.readouterr().out


def test_generated_calls_match_plain_loops(spark):
    r = random.Random(4)
    rows, want = [], []
    for conv in range(60):
        turn = 0
        for k in range(r.randint(0, 5)):
            args = {x: r.choice([3, 2.5, "t", "long string", None, True, {"z": 1, "b": [1, "ü"]}]) for x in r.sample(["a", "note", "zz"], r.randint(0, 3))}
            rows.append((conv, turn, "assistant", call((f"id{k}", "add", args))))
            told = r.choice([None, 1, -1])
            if told:
                rows.append((conv, turn + told, "tool", result(f"id{k}", f"r{k}")))
            wrong = []
            if args.get("a") is None:
                wrong.append("a: missing")
            elif isinstance(args["a"], bool) or not isinstance(args["a"], int | float):
                wrong.append("a: not a number")
            if args.get("note") is not None:
                if not isinstance(args["note"], str):
                    wrong.append("note: not a string")
                elif not 1 <= len(args["note"]) <= 5:
                    wrong.append("note: length")
            status = {None: "no result", 1: "linked", -1: "early result"}[told]
            body = {"arguments": args, "errors": wrong, "id": f"id{k}", "name": "add", **({"result": f"r{k}"} if told else {}), "status": status}
            want.append((conv, k, f"id{k}", turn, turn + told if told else None, status, len(wrong), json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
            turn += 3
    assert [tuple(x) for x in linked(spark, rows)] == want


def test_long_conversation_has_gapless_places(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"m{t}") for t in range(4200)]
    out = linked(spark, rows)
    assert [r.seq for r in out] == list(range(2100)) and [r.call_turn for r in out] == list(range(0, 4200, 2))
