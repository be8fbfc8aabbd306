"""Prompts, request bodies, replies, generated documents."""

import json

from pyspark.sql import functions as F

from scribeloom import schemas
from scribeloom.functions import fixed, templates, text
from scribeloom.operators import generate, prompt, reply, request
from scribeloom.options import PromptOptions, RequestOptions

ENTRY = "class_fqn string, method string, context string"


def test_prompts(spark):
    df = spark.createDataFrame([("c.A", "getX(int)", "ctx ${ENTRY_METHOD} $1 \\")], ENTRY)
    default = prompt.render_prompts(df).first()["prompt"]
    assert default == templates.INTERFACE_TEMPLATE.replace("${CONTEXT}", "ctx ${ENTRY_METHOD} $1 \\")
    custom = "${ENTRY_CLASS_FQN}|${ENTRY_METHOD}|${ENTRY_METHOD_BASE}|${HTTP_METHOD}|${CONTEXT}|${OTHER}"
    made = prompt.render_prompts(df, PromptOptions(True, custom)).first()["prompt"]
    assert made == "c.A|getX(int)|getX|GET|ctx ${ENTRY_METHOD} $1 \\|${OTHER}"
    assert prompt.render_prompts(df, PromptOptions(True, "  ")).first()["prompt"] == default
    assert prompt.render_prompts(df, PromptOptions(False, custom)).first()["prompt"] == default
    # A class name that holds a placeholder is filled by the steps after it.
    odd = spark.createDataFrame([("${CONTEXT}", "m()", "z")], ENTRY)
    assert prompt.render_prompts(odd, PromptOptions(True, "${ENTRY_CLASS_FQN}")).first()["prompt"] == "z"


def test_templates_by_name(spark):
    own = spark.createDataFrame([(templates.REVIEW_NAME, "mine ${CONTEXT}"), ("x", "x ${ENTRY_METHOD}")], schemas.TEMPLATES)
    found = {r["name"]: r["template"] for r in prompt.all_templates(spark, own).collect()}
    assert found == {templates.INTERFACE_NAME: templates.INTERFACE_TEMPLATE, templates.REVIEW_NAME: "mine ${CONTEXT}", "x": "x ${ENTRY_METHOD}"}
    assert prompt.all_templates(spark).count() == 2


def test_request_bodies(spark):
    text_ = 'say "hi"\n\t\\ \u0001 é'
    rows = [
        ("OPENAI", "http://h/v1", "m", text_), ("OPENAI", "http://h:11434/x", "m", text_), ("OLLAMA", "http://api.deepseek.com", "m", text_),
        ("DEEPSEEK", "http://h", "other", text_), ("X", "https://api.deepseek.com/v1", "my-chat", text_), ("X", "http://h/api/chat", "m", text_),
    ]
    df = spark.createDataFrame(rows, "provider_setting string, endpoint string, model string, prompt string")
    got = request.request_rows(df, RequestOptions(temperature=0.25, top_p=1.0, max_tokens=7)).collect()
    assert [r["provider"] for r in got] == ["OPENAI", "OLLAMA", "OLLAMA", "DEEPSEEK", "DEEPSEEK", "OLLAMA"]
    assert [r["model"] for r in got] == ["m", "m", "m", "deepseek-chat", "my-chat", "m"]
    user = {"role": "user", "content": text_}
    system = {"role": "system", "content": fixed.SYSTEM_MESSAGE}
    assert json.loads(got[0]["body"]) == {"model": "m", "messages": [system, user], "stream": False, "max_tokens": 7, "temperature": 0.25, "top_p": 1}
    assert json.loads(got[1]["body"]) == {"model": "m", "messages": [user], "stream": False}
    assert json.loads(got[3]["body"]) == {"model": "deepseek-chat", "messages": [system, user], "stream": False, "temperature": 0.25, "top_p": 1}
    assert '"top_p":1}' in got[0]["body"]


def test_numbers():
    got = [str(request.number(v)) for v in (0.7, 1.0, 0.0, 100.0, 0.12345, 0.00004, 0.0001)]
    assert got == ["0.7", "1", "0", "100", "0.1235", "0", "0.0001"]


def test_model_names(spark):
    names = ["deepseek-chat", "deepseek-reasoner", "chat", "reasoner", "Qwen-32B"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    got = [r[0] for r in df.select(request.model_of(F.lit("DEEPSEEK"), F.col("m"))).collect()]
    assert got == ["deepseek-chat", "deepseek-reasoner", "chat", "reasoner", "deepseek-chat"]


def test_replies(spark):
    chat = json.dumps({"id": "content", "choices": [{"message": {"content": 'a "b"\n&amp;lt; &lt;x&gt;'}}]})
    plain = json.dumps({"message": {"role": "assistant", "content": "é\\u003cq"}})
    rows = [("1", 200, chat), ("2", 299, plain), ("3", 500, "e" * 300), ("4", 200, "no json &gt;"), ("5", 199, "x"), ("6", 200, '{"other": 1}')]
    df = spark.createDataFrame(rows, schemas.REPLIES)
    got = {r["task_id"]: r for r in reply.read_replies(df).collect()}
    assert got["1"]["content"] == 'a "b"\n&lt; <x>'
    assert got["2"]["content"] == "é<q"
    assert got["3"]["content"] is None and got["3"]["error_message"] == "HTTP 500 — " + "e" * 240
    assert got["4"]["content"] == "no json >"
    assert got["5"]["error_type"] == "RuntimeException"
    assert got["6"]["content"] == '{"other": 1}'


def test_cleaning(spark):
    cases = {
        "<think>a\nb</think>x": "x", "< THINK >a</ think >x<think>b</think> ": "x", "<think>open x": "<think>open x",
        "```markdown\na\nb \n```": "a\nb", "﻿\n```\r\na\rb\r\n``` \n": "a\nb", "```\n```": "", "```JSON\n{}\n\n\n```": "{}",
        "```java\nx\n```": "```java\nx\n```", "```md\nx": "```md\nx", "```": "```", "a\n```\nb\n```": "a\n```\nb\n```",
        " plain  ": "plain", "```html \nx\n```y\n```": "x\n```y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r["content"]: r["markdown"] for r in reply.clean_replies(df).collect()}
    assert got == cases


def test_fence_leaves_other_texts_as_they_are(spark):
    df = spark.createDataFrame([(" a ",)], "t string")
    assert df.select(text.unwrap_fence(F.col("t"))).first()[0] == " a "


def test_placeholder_document(spark):
    df = spark.createDataFrame([("c.A", "delX(int)")], "class_fqn string, method string")
    made = generate.stub_documents(df).first()["markdown"]
    assert made.startswith("接口名称：c.A.delX（推断）\n接口说明：示例占位，由 Stub 生成（推断）\n请求方式：DELETE（推断）\n\n输入参数：\n\n|参数名|")
    assert made.endswith("|message|String|是|提示信息|\n")


def test_given_function(spark):
    def answer(body):
        if body == "7":
            raise TimeoutError("request timed out")
        return body * 2

    df = spark.range(500).select(F.col("id").alias("task_id"), F.col("id").cast("string").alias("body"))
    made = generate.generate(df, answer, max_concurrent=3)
    assert made.rdd.getNumPartitions() == 3
    got = {r["task_id"]: r for r in made.collect()}
    assert len(got) == 500
    assert got[12]["reply"] == "1212" and got[12]["status"] == "SUCCEEDED" and got[12]["error_type"] is None
    assert (got[7]["status"], got[7]["error_type"], got[7]["error_message"]) == ("FAILED", "TimeoutError", "request timed out")


def test_rounds_go_on_where_they_stopped(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("task_id"), F.col("id").cast("string").alias("body"))
    out, calls = str(tmp_path / "replies"), tmp_path / "calls"
    calls.write_text("")
    log = str(calls)

    def answer(body):
        with open(log, "a") as f:
            f.write(body + "\n")
        return body

    generate.generate_in_rounds(df, answer, out, 4).collect()
    assert sorted(calls.read_text().split(), key=int) == [str(i) for i in range(200)]
    again = generate.generate_in_rounds(df, answer, out, 4).collect()
    assert sorted(int(r["reply"]) for r in again) == list(range(200))
    assert len(calls.read_text().split()) == 200


def test_equal_requests_are_asked_once_and_rounds_read_their_own(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 10 == 0 else f"q{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "task_id long, body string")
    out, calls, read = str(tmp_path / "replies"), tmp_path / "calls", []
    calls.write_text("")
    log = str(calls)

    def answer(body):
        with open(log, "a") as f:
            f.write(f"{body}\n")
        if body == "q3":
            raise TimeoutError("late")
        return f"<{body}>"

    real = generate.generate
    monkeypatch.setattr(generate, "generate", lambda part, *a, **k: read.append(part.inputFiles()) or real(part, *a, **k))
    got = {r["task_id"]: r for r in generate.generate_in_rounds(df, answer, out, 3).collect()}
    assert len(got) == 60 and all(got[i]["reply"] == (None if b == "q3" else f"<{b}>") for i, b in rows)
    assert sorted(calls.read_text().split()) == sorted(["None", *(f"q{i}" for i in range(7))])
    assert read and all(len({f.split("round=")[1][0] for f in files}) == 1 for files in read)
    more = df.unionByName(spark.createDataFrame([(100, "new")], df.schema))
    assert generate.generate_in_rounds(more, answer, out, 3).count() == 61
    assert calls.read_text().split()[8:] == ["new"]
    again = generate.generate_in_rounds(df, answer, out, 3, ask_failed=True)
    assert calls.read_text().split()[9:] == ["q3"] and again.where("status = 'FAILED'").count() == sum(b == "q3" for _, b in rows)


def test_entries_are_not_shuffled_by_template_name(spark):
    from scribeloom import schemas
    from scribeloom.operators import prompt

    own = spark.createDataFrame([("mine", "a ${CONTEXT}"), ("mine", "b")], schemas.TEMPLATES)
    entries = spark.range(100).selectExpr("CASE WHEN id < 90 THEN 'mine' ELSE 'other' END AS template_name", "'C' AS class_fqn", "'f()' AS method", "string(id) AS context")
    found = prompt.render_by_name(entries, prompt.all_templates(spark, own))
    assert {r["prompt"] for r in found.where("template_name = 'mine'").collect()} == {f"a {i}" for i in range(90)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
