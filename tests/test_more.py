"""Numbering, links, stores, list and tree choices, masks, property graphs: what no query shows."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwell import __main__ as cli
from sparkwell.functions import parsers, pii, text, vectors
from sparkwell.functions.arrays import running, runs
from sparkwell.functions.models import fixed, hash_embedding
from sparkwell.operators import chunking, graph, keywords, objects, programs, retrieval, tree, workflow
from sparkwell.operators.common import numbered
from sparkwell.operators.stores import DocumentStore, IndexStore, IndexStruct, KeyValueStore, Table
from sparkwell.plans.engine import Engine
from sparkwell.sources import readers


@pytest.mark.parametrize(("kind", "values"), [("long", [5, -3, 5, None, 9, 0]), ("string", ["b", "a", "é", None, "B", "b"]), ("long", []), ("long", [None, None])])
def test_rows_are_numbered_in_order(spark, kind, values):
    df = spark.createDataFrame([(v, 1) for v in values], f"k {kind}, rank int").repartition(3)
    got = sorted((r.pos, r.k) for r in numbered(df, "k").collect())
    assert [p for p, _ in got] == list(range(len(values)))
    assert [k for _, k in got] == sorted(values, key=lambda v: (v is not None, v if v is not None else 0 if kind == "long" else ""))


def test_many_rows_are_numbered_in_ranges(spark):
    df = spark.range(0, 50_000, 3).select((F.col("id") * 7919 % 100_003).alias("k"))
    got = numbered(df, "k").agg(F.count("pos"), F.countDistinct("pos"), F.max("pos"), F.corr("k", "pos")).first()
    n = df.count()
    assert got[0] == got[1] == n and got[2] == n - 1 and got[3] > 0.999


def test_document_links_keep_rows(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (3, "c"), (None, "d"), (7, "e"), (None, "f")], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.prev_id, r.next_id, r.text) for r in chunking.document_nodes(df).collect()), key=str)
    assert got == sorted([(1, None, "3", "b"), (3, "1", "7", "a"), (3, "1", "7", "c"), (7, "3", None, "e"), (None, None, None, "d"), (None, None, None, "f")], key=str)


def test_chunk_offsets_add_up(spark):
    pieces = [f"é{i}" * (i % 5 + 1) for i in range(400)]
    df = spark.createDataFrame([(1, pieces)], "doc_id long, pieces array<string>").withColumn("text", F.lit(""))
    at = 0
    for r in chunking.nodes(df, F.col("pieces")).orderBy("chunk_index").collect():
        assert (r.start_char, r.end_char, r.chunk_count, r.text) == (at, at + len(r.text.encode()), 400, pieces[r.chunk_index])
        at = r.end_char


def test_runs_and_running_values(spark):
    df = spark.createDataFrame([([1, 1, 2, 5, 5, 5],), ([],), ([4],)], "a array<int>")
    got = df.select(runs(F.col("a"), lambda x, y: x != y, lambda a, i, n: F.get(a, i) * 10 + n).alias("r"), running(F.col("a"), lambda x, y: x + y, F.lit(0)).alias("s")).collect()
    assert [r.r for r in got] == [[12, 21, 53], None, [41]] and [r.s for r in got] == [[1, 2, 4, 9, 14, 19], [], [4]]


def test_stores_replace_their_pointer_and_keep_one_row_a_key(spark, tmp_path):
    store = KeyValueStore(spark, f"{tmp_path}/kv")
    rows = [("data", "a", json.dumps({"v": 1})), ("data", "a", json.dumps({"v": 2})), ("data", "b", "{}")]
    store.put(spark.createDataFrame(rows, "collection string, key string, value string"))
    assert store.read().count() == 2 and store.get("a") == {"v": 2}
    store.put(spark.createDataFrame([("data", "a", '{"v": 3}')], "collection string, key string, value string"))
    assert store.get("a") == {"v": 3} and not list((tmp_path / "kv").glob("_next*"))
    docs = DocumentStore(spark, f"{tmp_path}/d")
    node = ("n", "t", {"k": "v"}, "s", "h")
    docs.add(spark.createDataFrame([node, node], docs.schema))
    assert docs.read().count() == 1
    (tmp_path / "kv" / "_current").write_text("")
    with pytest.raises(ValueError, match="empty"):
        Table(spark, f"{tmp_path}/kv", "a int").read()


def test_json_lines_keep_their_numbers(spark, tmp_path):
    lines = [json.dumps({"t": f"x{i}", "n": i}) if i % 4 else "" for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.json").write_text('[{"t": "one"}, {"t": "two"}]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")  # several tasks for the lines
    try:
        got = {r.doc_id.rsplit("/", 1)[1]: r.text for r in readers.json_files(spark, str(tmp_path), "t").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {**{f"a.jsonl_{i}": f"x{i}" for i in range(200) if i % 4}, "b.json_0": "one", "b.json_1": "two"}


def test_masks_keep_the_original_if_asked(spark):
    df = spark.createDataFrame([("mail a@b.org", {"k": "v"}), ("plain", {"k": "v"}), (None, {})], "text string, metadata map<string,string>")
    got = {r.text: r.metadata for r in pii.mask_nodes(df, store_original=True).collect()}
    assert got == {"mail [EMAIL]": {"k": "v", "original_text": "mail a@b.org", "pii_masked": "true"}, "plain": {"k": "v"}, None: {}}
    every = spark.createDataFrame([("x 123-45-6789 é 555-123-4567 10.0.0.1 4111 1111 1111 1111 a@b.org",)], "text string").withColumn("id", F.lit(1))
    raw = every.first().text.encode()
    found = pii.detect(every, "id").collect()
    assert {r.pii_type for r in found} == set(pii.PATTERNS) and all(raw[r.start : r.end].decode() == r.value for r in found)


def test_words_of_answers(spark):
    df = spark.createDataFrame([("my eyes",), ("YES.",), ("the quick brown Fox of What",)], "t string")
    assert [r.y for r in df.select(parsers.says_yes(F.col("t")).alias("y")).collect()] == [0.0, 1.0, 0.0]
    assert df.select(parsers.query_keywords(F.col("t")).alias("k")).collect()[2].k == ["quick", "brown", "fox"]
    own = spark.createDataFrame([("a bcd. " * 20,), ("x" * 90,), ("ab cd " * 20,)], "t string").select(text.compressed(F.col("t"), most=50).alias("c"))
    got = [r.c for r in own.collect()]
    assert got[0].endswith("bcd.") and len(got[0]) <= 50 and got[1] == "x" * 50 and got[2].endswith("cd...")


def test_vector_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 1.0]), ("b", None)], "k string, embedding array<double>")
    assert {r.k: (r.dimension, r.embedding) for r in vectors.mean(df, "k").collect()} == {"a": (2, [2.0, 4.0]), "b": (2, [0.0, 1.0])}
    mixed = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0])], "k string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        vectors.mean(mixed, "k").collect()


def test_bm25_over_asked_terms_is_that_over_all(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "old red boat"), (3, ""), (4, None), (5, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fish"), (2, "blue boat zebra")], "query_id long, query_str string")
    some = keywords.bm25_weights(docs, only=keywords.bm25_tokens(asked, "query_id", "query_str"))
    key = lambda df: {(r.doc_id, r.term): (round(r.weight, 9), round(r.idf, 9)) for r in df.collect()}
    every = key(keywords.bm25_weights(docs))
    assert key(some) == {k: v for k, v in every.items() if k[1] != "old"} and (2, "old") in every
    by_length = keywords.bm25_weights(docs, tokenize=lambda t: F.transform(F.split(t, " "), lambda w: F.length(w).cast("string")))
    assert (2, "4") in key(by_length)


def test_keyword_table_upkeep(spark):
    one = spark.createDataFrame([("n1", "apples and apples"), ("n2", "pears")], "node_id string, text string")
    table = keywords.keyword_table(one)
    table = keywords.insert(table, spark.createDataFrame([("n1", "grapes"), ("n3", "apples")], "node_id string, text string"))
    assert sorted((r.keyword, r.node_id) for r in table.collect()) == [("apples", "n3"), ("grapes", "n1"), ("pears", "n2")]
    assert sorted(r.node_id for r in keywords.delete(table, one.where("node_id = 'n2'")).collect()) == ["n1", "n3"]


def test_list_and_tree_choices(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.2], "q")], "query_id long, embedding array<double>, query_str string")
    assert retrieval.list_index(nodes, queries).count() == 2
    assert [r.node_id for r in retrieval.list_index(nodes, queries, "embedding", 1).collect()] == ["a"]
    chosen = retrieval.list_index(nodes, queries, "llm", choose=lambda n, q: n.where("node_id = 'b'").crossJoin(q.select("query_id")))
    assert [(r.query_id, r.node_id, r.score) for r in chosen.collect()] == [(1, "b", 1.0)]
    leaves = spark.createDataFrame([(f"l{i:02d}", i, f"leaf {i}") for i in range(25)], "node_id string, pos long, text string")
    built = tree.build(leaves, 5)
    asked = queries.select("query_id", "query_str")
    assert [r.node_id for r in tree.choose_leaves(built, asked, fixed("ANSWER: 2")).collect()] == ["l06"]
    assert [r.node_id for r in tree.choose_leaves(built, asked, fixed("none")).collect()] == ["l00"]


def test_property_graphs(spark):
    kind = "name string, label string, properties map<string,string>"
    old = spark.createDataFrame([("a", "x", {"k": "1", "m": "2"}), ("b", "y", {})], kind)
    new = spark.createDataFrame([("a", "z", {"k": "3"}), ("c", "y", None)], kind)
    got = graph.property_upsert(old, new)
    assert {r.name: (r.label, r.properties) for r in got.collect()} == {"a": ("z", {"k": "3", "m": "2"}), "b": ("y", {}), "c": ("y", {})}
    assert [r.name for r in graph.property_get(got, labels=["z"], properties={"m": "2"}).collect()] == ["a"]
    edges = spark.createDataFrame([("a", "to", "b"), ("b", "to", "c")], "subject string, relation string, object string")
    left, kept = graph.property_delete(got, edges, got.where("name = 'a'"))
    assert sorted(r.name for r in left.collect()) == ["b", "c"] and [r.subject for r in kept.collect()] == ["b"]
    assert graph.get(edges, subjects=["a"], objects=["c"]).count() == 0


def test_a_sentence_function_splits():
    parts = lambda t: [x for x in t.replace("|", "|\0").split("\0") if x]
    got = chunking.split_sentences("a b|c d|e f", 3, 0, count=lambda t: len(t.replace("|", " ").split()), sentence=parts)
    assert got == ["a b|", "c d|", "e f"]


def test_tools_and_objects_are_found(spark):
    tools = spark.createDataFrame([("add", "adds two numbers", False, "{}"), ("find", "", True, None)], "name string, description string, return_direct boolean, parameters string")
    nodes = objects.tool_nodes(tools)
    got = {r.node_id: r for r in nodes.collect()}
    assert got["find"].text == "find" and got["add"].text == "adds two numbers" and got["add"].metadata["object_type"] == "tool" and "parameters" not in got["find"].metadata
    asked = spark.createDataFrame([(1, "find")], "query_id long, query_str string")
    hit = objects.retrieve(nodes, asked, hash_embedding(32), 1).first()
    assert hit.node_id == "find" and json.loads(hit.payload)["return_direct"] is True
    bare = objects.object_nodes(spark.createDataFrame([(1, None)], "a int, b string"))
    assert bare.first().text == '{"a":1,"b":null}' and len(bare.first().node_id) == 64


def test_programs_read_what_fits(spark):
    rows = spark.createDataFrame([(1, "x")], "a int, query string")
    got = programs.run(rows, fixed('Here: {"v": 3}'), "struct<v:int>").first()
    assert got.output.v == 3 and programs.run(rows, fixed("none"), "struct<v:int>").first().output is None
    assert [o.v for o in programs.run_several(rows, fixed('[{"v": 1}, {"v": 2}]'), "struct<v:int>", 2).first().output] == [1, 2]
    call = fixed('[{"name": "f", "arguments": "{\\"v\\": 9}"}]')
    assert programs.call(rows, call, "f", "struct<v:int>").first().output.v == 9
    assert programs.run(rows.select("a"), lambda p: p, "struct<a:int>", None).first().output.a == 1


def test_steps_and_messages(spark):
    df = spark.range(4).withColumn("k", F.col("id") % 3)
    up = lambda d: d.withColumn("id", F.col("id") + 10)
    assert sorted(r.id for r in df.transform(workflow.branched(F.col("k"), {0: up})).collect()) == [10, 13]
    assert sorted(r.id for r in df.transform(workflow.branched(F.col("k"), {0: up}, lambda d: d)).collect()) == [1, 2, 10, 13]
    assert df.transform(workflow.parallel(up, workflow.mapped(z=F.lit(1)))).count() == 8

    def fails(x):
        raise ValueError(x)

    assert workflow.fallback(fails, lambda x: x + 1)(2) == 3
    with pytest.raises(ValueError):
        workflow.fallback(fails)(1)
    tool = workflow.Tool("t", "does t", lambda: "")
    said = workflow.reasoning_messages([tool], [("user", "q")], [("thought", "hm"), ("observation", "o")], "ctx")
    assert [r for r, _ in said] == ["system", "user", "assistant", "user"] and "does t" in said[0][1] and "ctx" in said[0][1]


def test_engines_change_and_serve_as_tools(spark):
    docs = spark.createDataFrame([("a", "red apples grow"), ("b", "blue boats float")], "doc_id string, text string")
    engine = Engine(docs, "keyword")
    more = engine.insert(spark.createDataFrame([("a", "green grapes hang"), ("c", "old cars rust")], "doc_id string, text string"))
    assert sorted(r.text for r in more.nodes.collect()) == ["blue boats float", "green grapes hang", "old cars rust"]
    assert [r.doc_id for r in more.delete(docs).nodes.collect()] == ["c"]
    assert more.as_tool("find", "finds", 2, answers=False).call(input="cars rust") == "old cars rust"
    assert "boats" in engine.as_tool("ask", "answers").call(input="boats float")


def test_broken_json_is_told_where(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": "x"}\n{"t": \n')
    with pytest.raises(Exception, match="a.jsonl at 1"):
        readers.json_files(spark, str(tmp_path), "t").collect()
    got = {r.doc_id[-1]: r for r in readers.json_files(spark, str(tmp_path), "t", strict=False).collect()}
    assert got["0"].error is None and got["0"].text == "x" and got["1"].error.endswith("a.jsonl at 1") and got["1"].text == '{"t": '


def test_room_for_metadata(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(words, "a b c"), (words, " ".join("x" * 30)), (None, "a")], "t string, m string")
    for split in (chunking.token_chunks_with_metadata(F.col("t"), F.col("m"), 10, 2), chunking.markdown_chunks_with_metadata(F.col("t"), F.col("m"), 10)):
        got = [r.c for r in df.select(split.alias("c")).collect()]
        assert max(len(x.split()) for x in got[0]) == 7 and max(len(x.split()) for x in got[1]) == 1 and got[2] == []


def test_relationships(spark):
    kind = "node_id string, source_id string, prev_id string, next_id string, parent_id string"
    nodes = spark.createDataFrame([("a", "s", None, "b", "p"), ("b", "s", "a", None, "p"), ("p", "s", None, None, None)], kind)
    assert [(r.node_id, r.related_id) for r in chunking.related(nodes, "next").collect()] == [("a", "b")]
    assert [(r.node_id, r.children) for r in chunking.children(nodes).collect()] == [("p", ["a", "b"])]


def test_index_structs(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/i")
    one = IndexStruct("i1", "vector", "about", "here", {"n": "x"})
    store.put_structs([one])
    assert store.struct() == one == IndexStruct.from_json(one.to_json()) and store.struct("none") is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Red apples grow on trees.")
    (tmp_path / "in" / "b.md").write_text("Blue boats float.")
    cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "store")])
    cli.main(["search", str(tmp_path / "store"), "which boats float", "-k", "1"])
    told = capsys.readouterr().out
    assert "2 nodes" in told and "Blue boats" in told and "apples" not in told
    assert Engine.of_directory(spark, str(tmp_path / "in"), "keyword").nodes.count() == 2
