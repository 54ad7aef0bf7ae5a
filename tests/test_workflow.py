import pytest
from pyspark.sql import functions as F

from sparkwell.functions.models import fixed
from sparkwell.operators.workflow import Event, Tool, Workflow, chained, conditional, filtered, reason, retried
from sparkwell.plans.engines import rewritten, routed, sub_questions


def test_steps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, text string")
    out = chained(conditional(F.col("id") == 1, lambda d: d.withColumn("text", F.upper("text"))), filtered(F.col("text") != "b"))(df)
    assert sorted(r.text for r in out.collect()) == ["A", "c"]


def test_retries():
    calls = []

    def odd():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("again")
        return "ok"

    assert retried(odd, 3, 0)() == "ok"
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, 2, 0)()


def test_reasoning_loop():
    def complete(prompt):
        if "Observation: 5" in prompt:
            return "Thought: done\nAnswer: five"
        return "Thought: add\nAction: add\nAction Input: {'a': 2, 'b': 3}\n"

    assert reason("2+3?", [Tool("add", "adds", lambda a, b: a + b)], complete) == ("five", [("add", "5")])
    with pytest.raises(RuntimeError):
        reason("?", [], lambda p: "Action: x\nAction Input: {}\n", 2)


def test_workflow():
    w = Workflow()
    w.on("start", lambda e: [Event("work", e.data + 1), Event("other")])
    w.on("work", lambda e: [Event("stop", e.data * 2)])
    assert w.run(Event("start", 1)) == 4
    assert w.run(Event("unknown")) is None
    loop = Workflow(capacity=10)
    loop.on("a", lambda e: [Event("a"), Event("a")])
    with pytest.raises(OverflowError):
        loop.run(Event("a"))


def test_engines(spark):
    q = spark.createDataFrame([(1, "why"), (2, "how")], "query_id long, query_str string")
    one = lambda df: df.select("query_id", F.concat(F.lit("one:"), "query_str").alias("response"))
    two = lambda df: df.select("query_id", F.lit("two").alias("response"))
    got = {r.query_id: r.response for r in routed({"a": one, "b": two}, q, fixed("both"), F.when(F.col("query_id") == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).collect()}
    assert got == {1: "one:why", 2: "both"}
    got = {r.query_id: r.response for r in sub_questions({"a": one}, q, fixed("[a] sub?\n[zz] no"), lambda p: p).collect()}
    assert "Sub question: sub?\nResponse: one:sub?" in got[1]
    assert {r.response for r in rewritten(one, F.upper)(q).collect()} == {"one:WHY", "one:HOW"}
