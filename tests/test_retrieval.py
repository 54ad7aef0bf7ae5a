import math
import random

import pytest
from pyspark.sql import functions as F

from sparkwell.functions.models import fixed, hash_embedding
from sparkwell.operators import evaluation, extractors, graph, ingestion, keywords, memory, postprocess, retrieval, synthesis, tree
from sparkwell.plans.engine import Engine


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame([(1, "a", "n1", 0.9), (1, "a", "n2", 0.5), (1, "b", "n2", 0.8), (1, "b", "n3", 0.2)], "query_id long, retriever string, node_id string, score double")


def test_fusion(lists):
    got = {r.node_id: r.score for r in retrieval.fuse(lists, "reciprocal_rerank").collect()}
    assert got == pytest.approx({"n1": 1 / 60, "n2": 1 / 61 + 1 / 60, "n3": 1 / 61})
    got = {r.node_id: r.score for r in retrieval.fuse(lists, "relative_score").collect()}
    assert got == pytest.approx({"n1": 0.5, "n2": 0.5, "n3": 0.0})
    assert {r.node_id: r.score for r in retrieval.fuse(lists, "odd").collect()} == {"n1": 0.9, "n2": 0.8, "n3": 0.2}


def test_dense_search_matches_pairs(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("e", []), ("l", [1.0])], "node_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.node_id): round(r.score, 9) for r in retrieval.dense_search(nodes, queries, 9).collect()}
    want = {(r.query_id, r.node_id): round(r.score, 9) for r in retrieval.scored(nodes, queries).collect()}
    assert got == want and len(got) == 10
    assert [r.node_id for r in retrieval.dense_search(nodes, queries, 2).where("query_id = 1").orderBy("rank").collect()] == ["a", "c"]
    assert retrieval.dense_search(nodes, queries, 0).count() == 0


def test_recursion_merging_and_gaps(spark):
    hits = spark.createDataFrame([(1, "i1", 0.0), (1, "n", 0.4)], "query_id long, node_id string, score double")
    links = spark.createDataFrame([("i1", "t1")], "index_id string, target_id string")
    assert rows(retrieval.recurse(hits, links), "node_id", "score") == [("n", 0.4), ("t1", 1.0)]
    children = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "d"), ("q", "e"), ("r", "p")], "parent_id string, child_id string")
    hits = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (1, "d", 0.3)], "query_id long, node_id string, score double")
    assert rows(retrieval.merge_parents(hits, children), "node_id", "score") == [("d", 0.3), ("r", 0.5)]
    nodes = spark.createDataFrame([("A", None, "M"), ("M", "A", "B"), ("B", "M", None)], "node_id string, prev_id string, next_id string")
    ranked = spark.createDataFrame([(1, "A", 0.8, 1), (1, "B", 0.4, 2)], "query_id long, node_id string, score double, rank int")
    assert rows(retrieval.fill_gaps(ranked, nodes), "node_id", "score") == [("A", 0.8), ("B", 0.4), ("M", pytest.approx(0.6))]


def test_mmr_prefers_the_different(spark):
    c = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])], "query_id long, node_id string, score double, embedding array<double>")
    assert [r.node_id for r in retrieval.mmr(c, 2).orderBy("rank").collect()] == ["a", "c"]


def scored(spark, *scores):
    return spark.createDataFrame([(1, f"n{i}", f"text {i}. More here.", {"date": f"2024-01-0{i + 1}"}, float(s)) for i, s in enumerate(scores)], "query_id long, node_id string, text string, metadata map<string,string>, score double")


def test_postprocessors(spark):
    df = scored(spark, 0.9, 0.3, 0.5, 0.0)
    queries = spark.createDataFrame([(1, "text 2")], "query_id long, query_str string")
    assert rows(postprocess.similarity_cutoff(df, 0.5), "node_id") == [("n0",), ("n2",)]
    assert [r.score for r in postprocess.long_context_order(scored(spark, 1, 2, 3, 4)).orderBy("position").collect()] == [3, 1, 2, 4]
    assert [r.node_id for r in postprocess.rankgpt(df, queries, fixed("[3] > [1]"), 3).orderBy("rank").collect()] == ["n1", "n0", "n2"]
    got = postprocess.llm_rerank(df, queries, fixed("Doc: 2, Relevance: 9\nDoc: 1, Relevance: 3"), 2).orderBy("rank").collect()
    assert [(r.node_id, r.score) for r in got] == [("n2", 9.0), ("n0", 3.0)]
    got = postprocess.sliding_rankgpt(df, queries, lambda q, ts: sorted(range(len(ts)), key=lambda i: ts[i], reverse=True), 2, 1, 4)
    assert [r.node_id for r in got.orderBy("rank").collect()][0] == "n3"
    got = postprocess.chain(df, [lambda d: postprocess.similarity_cutoff(d, 0.1), lambda d: postprocess.best(d, 1)])
    assert rows(got, "node_id") == [("n0",)]
    embed = hash_embedding(32)
    out = postprocess.optimize_sentences(df, queries.withColumn("embedding", embed(F.col("query_str"))), embed, 1)
    assert all(r.text in ("More here.", f"text {r.node_id[1]}.") for r in out.collect())
    assert postprocess.replace_by_metadata(df, "date").first().text.startswith("2024")


def test_keywords_and_bm25(spark):
    docs = spark.createDataFrame([("1", "Machine learning algorithms"), ("2", "Deep learning neural networks"), ("3", "the of and")], "node_id string, text string")
    q = spark.createDataFrame([(1, "deep learning")], "query_id long, query_str string")
    got = keywords.probe(keywords.keyword_table(docs), q).orderBy("rank").collect()
    assert [(r.node_id, r.score) for r in got] == [("2", 1.0), ("1", 0.5)]
    w = keywords.bm25_weights(docs, "node_id")
    assert [r.node_id for r in keywords.bm25_search(w, q, 5, "node_id").orderBy("rank").collect()] == ["2", "1"]
    assert keywords.bm25_embedding(w, "node_id").where("node_id = '2'").first().dimension == 6


def test_ingestion(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "9")], "doc_id string, text string")
    own = lambda t: F.sha2(F.lit(t).cast("binary"), 256)
    stored = ingestion.hashed(spark.createDataFrame([("a", "1"), ("b", "old"), ("z", "3")], "doc_id string, text string")).select("doc_id", "hash")
    out, after, gone = ingestion.run(new, stored, [lambda d: d.withColumn("up", F.upper("text"))], "upserts_and_delete")
    assert rows(out, "doc_id") == [("b",), ("c",), ("d",)] and rows(gone, "doc_id") == [("z",)] and rows(after, "doc_id") == [("a",), ("b",), ("c",), ("d",)]
    by_text = ingestion.hashed(new, F.sha2(F.col("text").cast("binary"), 256))
    assert rows(ingestion.without_duplicates(by_text, spark.range(1).select(own("9").alias("hash"))), "doc_id") == [("a",), ("b",)]
    assert dict(rows(ingestion.refresh(new, stored), "doc_id", "refreshed")) == {"a": False, "b": True, "c": True, "d": True}
    assert ingestion.inputs(new, new.drop("text")).count() == 8


def test_cache(spark, tmp_path):
    calls = []

    def up(df):
        calls.append(1)
        return df.withColumn("u", F.upper("text"))

    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    cache = ingestion.Cache(str(tmp_path))
    for p in (1, 1, 2):
        assert cache.through(df, up, "up", p=p).first().u == "X"
    assert len(calls) == 2


def test_graph(spark):
    edges = spark.createDataFrame([("Alice", "knows", "Bob"), ("Bob", "works_at", "Company"), ("Company", "in", "Town"), ("Alice", "knows", "Bob")], "subject string, relation string, object string")
    start = spark.createDataFrame([("Alice",)], "subject string")
    assert rows(graph.relation_map(edges, start, 2), "level", "subject") == [(1, "Alice"), (2, "Bob")]
    assert rows(graph.relation_map(edges, start, 3, 2), "level") == [(1,), (2,)]
    assert tuple(graph.size(edges).first()) == (3, 3)
    assert graph.delete(edges, start.withColumn("relation", F.lit("knows")).withColumn("object", F.lit("Bob"))).count() == 2
    assert graph.upsert(edges, edges).count() == 3
    entities = graph.entity_nodes(edges.withColumn("node_id", F.col("relation")))
    q = spark.createDataFrame([(1, "where is alice"), (2, "nobody")], "query_id long, query_str string")
    nodes, texts = graph.retrieve(edges, entities, q)
    assert rows(nodes, "query_id", "node_id", "score") == [(1, "knows", 1000.0)]
    told = dict(rows(texts, "query_id", "texts"))
    assert told[2] == "No relationships found." and "[Bob, works_at, Company]" in told[1]
    sub = spark.createDataFrame([(1, "ab"), (1, "abc"), (1, "x")], "k long, v string")
    assert rows(graph.without_substrings(sub, "k", "v"), "v") == [("abc",), ("x",)]


def test_tree(spark):
    leaves = spark.createDataFrame([(f"l{i}", i, f"text {i}") for i in range(23)], "node_id string, pos long, text string")
    t = tree.build(leaves, 5)
    assert dict(rows(t.groupBy("level").count(), "level", "count")) == {0: 23, 1: 5}
    assert tree.roots(t).count() == 5 and tree.all_leaves(t).count() == 23 and tree.children(t).count() == 23
    q = spark.createDataFrame([(1, "text 7")], "query_id long, query_str string")
    embed = hash_embedding(16)
    got = tree.select_leaves(t, q.withColumn("embedding", embed(F.col("query_str"))), embed, 2)
    assert got.count() == 2
    assert tree.insert(t, spark.createDataFrame([("m", 0, "new")], "node_id string, pos long, text string"), 5).where("level = 0").count() == 24


def test_synthesis(spark):
    chunks = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bb"), (1, 2, "c" * 9)], "query_id long, pos long, text string")
    q = spark.createDataFrame([(1, "why {text}?"), (2, "none")], "query_id long, query_str string")
    assert rows(synthesis.packed(chunks, 8, "--"), "text") == [("aaaa--bb",), ("c" * 9,)]
    got = dict(rows(synthesis.simple(chunks, q, lambda p: p), "query_id", "response"))
    assert "aaaa\n\nbb" in got[1] and "why {text}?" in got[1] and got[2] == "Empty Response"
    got = dict(rows(synthesis.refine(chunks, q, lambda p: f"{len(p)}"), "query_id", "response"))
    assert got[1].isdigit() and got[2] == "Empty Response"
    assert "Response 2: " in dict(rows(synthesis.accumulate(chunks, q, fixed("x")), "query_id", "response"))[1]
    assert dict(rows(synthesis.tree_summarize(chunks, q, fixed("s"), 6), "query_id", "response"))[1] == "s"
    for mode in ("compact", "compact_accumulate", "generation"):
        assert synthesis.synthesize(mode, chunks, q, fixed("m"), lambda p: "m").count() == 2


def test_evaluation(spark):
    r = spark.createDataFrame([("e", 1.0, True), ("e", None, None), ("f", None, False)], "evaluator string, score double, passing boolean")
    got = {x.evaluator: (x.average_score, x.passing_rate, x.total_count) for x in evaluation.summary(r).collect()}
    assert got == {"e": (1.0, 0.5, 2), "f": (0.0, 0.0, 1)}
    judged = spark.createDataFrame([(1, "yes"), (1, "Yes."), (1, "no")], "query_id long, answer string")
    assert evaluation.context_share(judged).first().score == pytest.approx(2 / 3)
    df = spark.createDataFrame([(1, "q", "same", ["c"], "same"), (2, "q", None, [], "x")], "query_id long, query string, response string, contexts array<string>, reference string")
    runs = [evaluation.semantic_similarity(hash_embedding(8)), evaluation.correctness(fixed("4.5")), evaluation.yes_or_no("faithfulness", "{contexts}{response}", fixed("YES"))]
    got = {(x.query_id, x.evaluator): (x.score, x.passing) for x in evaluation.batch(df, runs).collect()}
    assert got[1, "semantic_similarity"] == (pytest.approx(1.0), True) and got[2, "semantic_similarity"] == (None, None)
    assert got[1, "correctness"] == (4.5, True) and got[1, "faithfulness"] == (1.0, True) and got[2, "faithfulness"] == (None, None)


def test_extractors(spark):
    n = spark.createDataFrame([("n0", "d", 0, "t0", {"k": "v"}), ("n1", "d", 1, "t1", {})], "node_id string, source_id string, pos long, text string, metadata map<string,string>")
    got = {r.node_id: r.metadata for r in extractors.summaries(n, lambda p: F.substring_index(p, "\n", -1), ("self", "next")).collect()}
    assert got == {"n0": {"k": "v", "section_summary": "t0", "next_section_summary": "t1"}, "n1": {"section_summary": "t1"}}
    out = extractors.chain(n, [lambda d: extractors.keywords(d, fixed("a, b,c"), 2), lambda d: extractors.titles(d, fixed("T"))])
    assert out.where("node_id = 'n0'").first().metadata == {"k": "v", "excerpt_keywords": "a, b", "document_title": "T"}


def test_memory(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 40), (1, 1, "assistant", "b" * 40), (1, 2, "user", "c" * 40), (1, 3, "assistant", "d" * 8)], "conv_id long, turn long, role string, text string")
    assert rows(memory.within_budget(turns, 25), "turn") == [(2,), (3,)]
    assert rows(memory.within_budget(turns, 1000), "turn") == [(0,), (1,), (2,), (3,)]
    assert memory.within_budget(turns, 2).count() == 0
    got = memory.summarized(turns, 25, fixed("S")).orderBy("turn").collect()
    assert [(r.turn, r.role) for r in got] == [(-1, "system"), (2, "user"), (3, "assistant")]
    assert memory.user_batches(turns).count() == 2 and memory.last_turns(turns, 1).first().turn == 3
    msg = spark.createDataFrame([(1, "more?"), (2, "hi")], "conv_id long, message string")
    assert dict(rows(memory.condensed(turns, msg, fixed("Q")), "conv_id", "query_str")) == {1: "Q", 2: "hi"}
    told = memory.replied(turns, msg, spark.createDataFrame([(1, "ctx")], "conv_id long, context string"), fixed("A"))
    assert rows(told.where("conv_id = 2"), "turn", "role", "text") == [(0, "user", "hi"), (1, "assistant", "A")]


def test_engine(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma."), (2, "Delta epsilon zeta.")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Alpha beta gamma.")], "query_id long, query_str string")
    for kind in ("vector", "keyword", "summary"):
        answers = Engine(docs, kind).ask(q).collect()
        assert len(answers) == 1 and "Alpha beta gamma." in answers[0].response
    assert Engine(docs).retrieve(q, 1).first().node_id == "1-chunk-0"
    assert Engine(docs).tree().count() == 2


def test_mmr_ranks_equal_values_by_score_and_not_by_rounding_errors(spark):
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(30)]

    def cosine(a, b):
        both = own = other = 0.0
        for x, y in zip(a, b, strict=True):
            both, own, other = both + x * y, own + x * x, other + y * y
        return both / math.sqrt(own * other)

    # scores are likeness to the first: of its neighbours' values 0.5 * score - 0.5 * likeness all are 0
    likeness = [1.0 if i == 0 else cosine(vectors[0], v) for i, v in enumerate(vectors)]
    c = spark.createDataFrame([(1, i, s, v) for i, (s, v) in enumerate(zip(likeness, vectors, strict=True)) if s > 0], "query_id long, node_id long, score double, embedding array<double>")
    second = max((s, -i) for i, s in enumerate(likeness) if i)
    found = retrieval.mmr(c, 2).orderBy("rank").collect()
    assert [(r.node_id, r.score) for r in found] == [(0, 0.5), (-second[1], 0.0)]


def test_all_scores_by_products_are_those_of_the_expressions(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, [1.0, 2.0], []]
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(99, None)], "node_id long, embedding array<float>")
    queries = nodes.where("node_id % 4 = 0 or node_id > 39").withColumnRenamed("node_id", "query_id")
    expected = rows(retrieval.scored(nodes, queries).withColumn("score", F.round("score", 6) + 0.0), "query_id", "node_id", "score")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "SCORE_BLOCK", 12)
    found = retrieval.list_index(nodes, queries, "embedding", digits=6)
    assert rows(found, "query_id", "node_id", "score") == expected
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no loop over dimensions for each pair
