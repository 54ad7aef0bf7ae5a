import math

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import filters, parsers, pii, recency, text, vectors


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not hasattr(v, "_jc") else v.alias(k) for k, v in values.items()] or ["id"])
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    r = one(
        spark,
        vectors.cosine(arr(1, 0), arr(1, 0)),
        vectors.cosine(arr(1, 0), arr(0, 1)),
        vectors.cosine(arr(1, 0), arr(-1, 0)),
        vectors.dot(arr(1, 2, 3), arr(4, 5, 6)),
        vectors.euclidean_distance(arr(0, 0), arr(3, 4)),
        vectors.normalize(arr(3, 4)),
        vectors.cosine(arr(0, 0), arr(1, 1)),
        vectors.cosine_strict(arr(0, 0), arr(1, 1)),
        vectors.cosine(arr(1), arr(1, 1)),
        vectors.negative_distance(arr(1), arr(1, 1)),
        vectors.scale(arr(1, 2), 3),
    )
    assert list(r)[:5] == [1.0, 0.0, -1.0, 32.0, 5.0]
    assert r[5] == pytest.approx([0.6, 0.8])
    assert r[6] == 0.0 and r[7] is None and r[8] == 0.0 and r[9] == -math.inf and r[10] == [3.0, 6.0]


def test_sparse(spark):
    a, b = vectors.to_sparse(arr(0, 2, 0, 3)), vectors.to_sparse(arr(1, 4, 0, 0))
    r = one(
        spark, vectors.sparse_dot(a, b), vectors.to_dense(vectors.sparse_add(a, b)), vectors.sparse_get(a, F.lit(3)), vectors.sparse_get(a, F.lit(2)),
        vectors.to_dense(vectors.sparse_normalize(a)), vectors.hybrid_similarity(arr(1, 0), arr(1, 0), a, a, 0.25),
        vectors.sparse_cosine(vectors.to_sparse(arr(0, 0)), a),
    )
    assert r[0] == 8 and r[1] == [1, 6, 0, 3] and r[2] == 3 and r[3] == 0 and r[5] == pytest.approx(1.0) and r[6] == 0
    assert r[4] == pytest.approx([0, 2 / math.sqrt(13), 0, 3 / math.sqrt(13)])


def test_text(spark):
    meta = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    r = one(
        spark,
        text.metadata_text(meta),
        text.content(F.lit("  t "), meta, "embed", F.array(F.lit("a"))),
        text.content(F.lit(" t "), meta, "none"),
        text.head_bytes(F.lit("aéb"), 2, "..."),
        text.head_bytes(F.lit("aé"), 3, "..."),
        text.format_prompt("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit("x")}),
        text.numbered(F.array(F.lit("x"), F.lit("yy")), 1),
        text.trimmed(F.lit("  x　")),
        text.compressed(F.lit("The  cat is. on the mat here"), False, 14),
        text.joined_hash(F.lit(""), F.lit(None).cast("string")),
        text.content(F.lit(" t "), F.create_map().cast("map<string,string>")),
    )
    assert r[0] == "a: 1\nb: 2" and r[1] == "b: 2\n\n  t" and r[2] == " t " and r[3] == "a..." and r[4] == "aé"
    assert r[5] == "{b} x {c}" and r[6] == "(1) x\n(2) y" and r[7] == "x" and r[8] == "The cat is." and r[10] == " t "


def test_pii(spark):
    t = F.lit("mail a.b@c.org or 555-123-4567, 4111111111111111, 1.2.3.4; Dr. Ann Lee")
    r = one(spark, pii.mask(t), pii.mask(t, ["email"], "X"), pii.has_pii(F.lit("nothing")), pii.names(t))
    assert r[0] == "mail [EMAIL] or [PHONE], [PHONE]111111, [IP_ADDRESS]; Dr. Ann Lee"
    assert r[1].startswith("mail X or") and r[2] is False and r[3] == ["Dr. Ann Lee"]
    df = spark.createDataFrame([(1, "é a@b.cd x a@b.ce")], "id long, text string")
    assert [(x.value, x.start, x.end) for x in pii.detect(df, "id", ["email"]).collect()] == [("a@b.cd", 3, 9), ("a@b.ce", 12, 18)]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (filters.Filter("a", "x"), True), (filters.Filter("a", "y", "!="), True), (filters.Filter("n", 5, ">"), True), (filters.Filter("n", 10, "<="), True),
        (filters.Filter("n", 10, ">"), False), (filters.Filter("a", ["x", "z"], "in"), True), (filters.Filter("a", ["x"], "nin"), False),
        (filters.Filter("l", ["q", "p"], "any"), True), (filters.Filter("l", ["q", "p"], "all"), False), (filters.Filter("l", "p", "contains"), True),
        (filters.Filter("a", "X", "text_match"), False), (filters.Filter("a", "X", "text_match_insensitive"), True), (filters.Filter("none", "", "is_empty"), True),
        (filters.Filter("none", "x", "!="), False), (filters.Filters((filters.Filter("a", "x"), filters.Filter("a", "y")), "or"), True),
        (filters.Filters((filters.Filter("a", "x"), filters.Filter("a", "y"))), False), (filters.Filters((filters.Filter("a", "y"),), "not"), True),
    ],
)
def test_filters(spark, f, want):
    meta = F.create_map(*map(F.lit, ["a", "x", "n", "7.5", "l", '["p","r"]']))
    assert one(spark, filters.matches(f, meta))[0] is want


def test_recency(spark):
    r = one(
        spark,
        recency.node_time(F.lit("2024-01-02")).cast("string"),
        recency.node_time(F.lit("Jan 2, 2024")).cast("string"),
        recency.node_time(F.lit("86400")).cast("long"),
        recency.node_time(F.lit("odd")),
        recency.linear(F.lit(1.0), F.lit(25.0), 100),
        recency.linear(F.lit(1.0), F.lit(250.0), 100),
        recency.linear(F.lit(2.0), F.lit(9.0), None),
        recency.exponential(F.lit(1.0), F.lit(0.0), 0.5),
        recency.exponential(F.lit(1.0), F.lit(86_401.0), 0.5),
        recency.step(F.lit(1.0), F.lit(5.0), 4, 1.0, 0.25),
    )
    assert r[0] == r[1] == "2024-01-02 00:00:00" and r[2] == 86400 and r[3] is None
    assert list(r)[4:] == [0.75, 0.0, 2.0, 0.5, 0.125, 0.25]


def test_parsers(spark):
    r = one(
        spark,
        parsers.keywords(F.lit(" a, b,,c ")),
        parsers.questions(F.lit("1. What?\n\n2) Who?")),
        parsers.json_value(F.lit('x ```json\n{"a": 3}\n``` y'), "struct<a:int>"),
        parsers.boolean(F.lit("Well, yes.")),
        parsers.boolean(F.lit("any day")),
        parsers.score(F.lit("Good.\n4.5\nBecause")),
        parsers.score(F.lit("Score: 3")),
        parsers.triplets(F.lit('(alice, knows, bob) ("x", y, \'z\') (only, two) ()')),
        parsers.query_keywords(F.lit("What is the capital of France?")),
        parsers.selections(F.lit('[{"choice": 2, "reason": "r"}]')),
        parsers.selections(F.lit('{"choice": 1, "reason": "s"}')),
        parsers.bracketed_questions(F.lit("[t1] q one\nno\n[t2]  q two")),
        parsers.relevances(F.lit("Doc: 2, Relevance: 7\nDoc: 9, Relevance: 1\nDoc: 2, Relevance: 1\nDoc: 1"), F.lit(3)),
        parsers.permutation(F.lit("[3] > [1] > [9]"), F.lit(4)),
        parsers.react(F.lit("Thought: need it\nAction: search\nAction Input: {'q': 'x'}\n")),
        parsers.react(F.lit("Thought: done\nAnswer: 42\nyes")),
        parsers.listed_keywords(F.lit("ok KEYWORDS: a, b")),
        parsers.sub_questions(F.lit('{"items": [{"sub_question": "q", "tool_name": "t"}]}')),
    )
    assert r[0] == ["a", "b", "c"] and r[1] == ["What?", "Who?"] and r[2].a == 3 and r[3] is True and r[4] is None and r[5] == 4.5 and r[6] == 3.0
    assert [tuple(t) for t in r[7]] == [("Alice", "knows", "Bob"), ("X", "y", "Z")]
    assert {"capital", "france"} <= set(r[8]) and r[9][0]["index"] == 1 and r[10][0]["index"] == 0
    assert [tuple(x) for x in r[11]] == [("t1", "q one"), ("t2", "q two")]
    assert [tuple(x) for x in r[12]] == [(2, 7.0), (1, 5.0)] and r[13] == [2, 0, 1, 3]
    assert r[14].action == "search" and r[14].action_input == '{"q": "x"}' and r[15].answer == "42\nyes" and r[16] == ["A", "B"] and r[17][0].tool_name == "t"
