import json

from lexweave.llm import chat


def turns(spark, *records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "conv_id long, record string")
    return sorted(((r.conv_id, r.turn, r.role, r.text, r.layout, r.status) for r in chat.canonical(df).collect()), key=str)


def test_layouts(spark):
    got = turns(
        spark,
        json.dumps({"prompt": "p", "completion": "c"}),
        json.dumps({"instruction": "do", "input": "this", "output": "done", "id": 3}),
        json.dumps({"messages": [{"role": "Human", "content": "hi"}, {"role": "gpt", "content": "yo"}], "system": "s"}),
        json.dumps({"data": {"chat": {"turns": [{"speaker": "USER", "text": "a"}, {"speaker": "critic", "text": "b"}]}}}),
        json.dumps({"history": [["q1", "a1"]], "prompt": "q2", "response": "a2"}),
    )
    assert got == sorted([
        (0, 0, "user", "p", "prompt_completion", "ok"), (0, 1, "assistant", "c", "prompt_completion", "ok"),
        (1, 0, "user", "do\n\nthis", "instruction", "ok"), (1, 1, "assistant", "done", "instruction", "ok"),
        (2, 0, "system", "s", "messages", "ok"), (2, 1, "user", "hi", "messages", "ok"), (2, 2, "assistant", "yo", "messages", "ok"),
        (3, 0, "user", "a", "nested_chat", "ok"), (3, 1, "critic", "b", "nested_chat", "ok"),
        (4, 0, "user", "q1", "history", "ok"), (4, 1, "assistant", "a1", "history", "ok"), (4, 2, "user", "q2", "history", "ok"), (4, 3, "assistant", "a2", "history", "ok"),
    ], key=str)


def test_edges(spark):
    deep = "[" * 900 + "]" * 900
    records = [None, "", "[1]", "not json", '{"a": 1}', '{"prompt": "", "completion": null}', '{"prompt": "\\ud800x"}', '{"prompt": ' + deep + "}", "{" + '"a":{' * 5000 + "}" * 5001, '{"prompt": "' + "y" * 1_000_000 + '"}']
    got = turns(spark, *records)
    status = {r[0]: r[5] for r in got}
    assert [status[i] for i in range(8)] == ["invalid"] * 4 + ["unknown", "empty", "ok", "unknown"]
    assert (status[8], status[9]) == ("invalid", "ok") and max(len(r[3] or "") for r in got if r[0] == 9) == 1_000_000
    assert {r[3] for r in got if r[0] == 6} == {"?x"}
    empty = spark.createDataFrame([], "conv_id long, record string, turn int")
    assert chat.canonical(empty).count() == 0
    twice = spark.createDataFrame([(None, '{"prompt": "p"}', 1)] * 2, "conv_id long, record string, turn int")
    assert chat.canonical(twice).count() == 2


def test_fingerprint_ignores_order_and_values():
    a, b = {"x": [{"k": 1}, {"k": 2}], "y": {"z": "s"}}, {"y": {"z": "other"}, "x": [{"k": 5}]}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b))
    assert chat.paths(a) == {"x[].k:number", "y.z:string"}
    assert chat.fingerprint(chat.paths({"x": "s"})) != chat.fingerprint(chat.paths({"x": 1}))


def test_round_trip_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text <> ''").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role.lower(), r.text))
    got = {}
    for r in sorted(chat.query(spark, sf_dir).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == by


def test_fields_that_are_no_content_lose_no_text(spark):
    chat_ = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    records = {
        "messages": [{"messages": chat_, "model": "m", "created": 5}, {"messages": [{**m, "weight": 1} for m in chat_]}, {"messages": [{**m, "tool_calls": [], "name": None} for m in chat_], "usage": {"tokens": 3}}],
        "message_parts": [{"messages": [{"role": m["role"], "content": [{"type": "text", "text": m["content"]}]} for m in chat_], "id": [1]}],
        "instruction_response": [{"instruction": "q", "response": "a"}, {"instruction": "q", "context": "", "response": "a", "category": "open_qa"}],
        "preference": [{"prompt": "q", "chosen": "a", "rejected": "b", "margin": 0.5}],
        "chosen_messages": [{"chosen": chat_, "rejected": chat_[:1]}],
        "prompt_completion": [{"prompt": "q", "completion": "a", "meta": {"deep": [{"er": 1}]}}],
        "question_answer": [{"question": "q", "answer": "a", "choices": ["a", "b"]}],
        "dialog": [{"dialog": ["q", "a"]}],
        "inputs_targets": [{"inputs": "q", "targets": "a", "task": "t"}],
    }
    for layout, some in records.items():
        got = turns(spark, *map(json.dumps, some))
        assert got == sorted([(i, n, r, t, layout, "ok") for i in range(len(some)) for n, (r, t) in enumerate([("user", "q"), ("assistant", "a")])], key=str)
    got = turns(spark, json.dumps({"messages": [chat_[0], {"role": "assistant", "content": [{"text": "a"}, {"text": "b"}]}]}), json.dumps({"question": "7 x 6", "answer": 42, "x": 1}), json.dumps({"context": "c", "question": "q", "answer": False}))
    assert [r[3] for r in got] == ["q", "a\nb", "7 x 6", "42", "c\n\nq", "false"]


def test_the_query_renders_every_kind_of_layout(spark, sf_dir):
    df = chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    layouts = {r.layout for r in chat.canonical(df).select("layout").distinct().collect()}
    assert None not in layouts and len(layouts) >= 6
