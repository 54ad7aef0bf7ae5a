"""Queries of operators that the other modules leave out: parsers, metadata, upkeep of stores and indexes, models' answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.functions import filters, parsers, pii, text
from sparkwell.functions.models import echo, fixed
from sparkwell.operators import evaluation, extractors, graph, ingestion, keywords, memory, objects, postprocess, programs, retrieval, synthesis
from sparkwell.plans import engines
from sparkwell.plans.engine import Engine, Settings
from sparkwell.plans.queries import _DOC_WORDS, _SCORED, _asked, _docs, _t, _top, _vectors, query
from sparkwell.sources import readers

_COSINE = "coalesce(list_cosine_similarity(q.e, n.e), 0)"


def _long(*names):
    return [F.col(x).cast("long").alias(x) for x in names]


# ---- metadata and text

_FILTERS = {
    "==": ("lang", "en", "lang = 'en'"),
    "!=": ("lang", "en", "lang <> 'en'"),
    ">": ("n_chars", 1500, "n_chars > 1500"),
    "<": ("n_chars", 300, "n_chars < 300"),
    ">=": ("n_chars", 1500, "n_chars >= 1500"),
    "<=": ("n_chars", 300, "n_chars <= 300"),
    "in": ("source", ["src1", "src3"], "source IN ('src1', 'src3')"),
    "nin": ("source", ["src1", "src3"], "source NOT IN ('src1', 'src3')"),
    "any": ("tags", ["de", "x1"], "lang = 'de' OR n_chars % 3 = 1"),
    "all": ("tags", ["de", "x1"], "lang = 'de' AND n_chars % 3 = 1"),
    "text_match": ("source", "c1", "contains(source, 'c1')"),
    "text_match_insensitive": ("source", "C1", "contains(lower(source), 'c1')"),
    "contains": ("tags", "x2", "n_chars % 3 = 2"),
    "is_empty": ("odd", None, "n_chars % 2 = 0"),
}


@query(" UNION ALL ".join(f"SELECT '{op}' AS op, doc_id FROM documents WHERE {w}" for op, (_, _, w) in _FILTERS.items()))
def metadata_operators(spark, sf):
    tags = F.concat("lang", F.lit(", x"), (F.col("n_chars") % 3).cast("string"))
    odd = F.when(F.col("n_chars") % 2 == 1, "odd").otherwise("")
    own = _docs(spark, sf).select("doc_id", F.create_map(
        F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("tags"), tags, F.lit("odd"), odd
    ).alias("m"))
    parts = [
        own.where(filters.matches(filters.Filter(key, value, op), F.col("m"))).select(F.lit(op).alias("op"), "doc_id")
        for op, (key, value, _) in _FILTERS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src2'")
def metadata_equalities(spark, sf):
    own = _docs(spark, sf).withColumn("m", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return own.where(filters.equal_to({"lang": "en", "source": "src2"}, F.col("m"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (1, 5, 17)")
def restricted_ids(spark, sf):
    return _docs(spark, sf).where(filters.restricted(["1", "5", "17"], F.col("doc_id").cast("string"))).select("doc_id")


@query("SELECT doc_id, sha256(coalesce(nullif(text, ''), 'None') || '-' || coalesce(nullif(lang, ''), 'None') || '-None') AS hash FROM documents")
def joined_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", text.joined_hash(F.col("text"), F.col("lang"), F.lit("")).alias("hash"))


@query("SELECT doc_id, sha256('type=TEXTstartCharIdx=' || chr((doc_id % 50000 + 33)::INT) || ' endCharIdx=' || chr((n_chars % 50000 + 33)::INT) || text) AS hash FROM documents")
def node_hashes_with_offsets(spark, sf):
    place = lambda c: F.col(c) % 50_000 + 33
    empty = F.create_map().cast("map<string,string>")
    return _docs(spark, sf).select("doc_id", text.node_hash(F.col("text"), empty, F.lit("TEXT"), place("doc_id"), place("n_chars")).alias("hash"))


def _masked_sql() -> str:
    out = "text"
    for pattern, mask in pii.PATTERNS.values():
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return out


@query(f"""WITH m AS (SELECT doc_id, text, {_masked_sql()} AS masked FROM documents)
SELECT doc_id, md5(masked) AS masked, CASE WHEN masked <> text THEN 'true' END AS pii_masked, CASE WHEN masked <> text THEN md5(text) END AS original FROM m""")
def pii_mask_with_original(spark, sf):
    own = _docs(spark, sf).withColumn("metadata", F.create_map(F.lit("lang"), "lang"))
    own = pii.mask_nodes(own, store_original=True)
    held = lambda k: F.try_element_at("metadata", F.lit(k))
    return own.select("doc_id", F.md5(F.col("text").cast("binary")).alias("masked"), held("pii_masked").alias("pii_masked"), F.md5(held("original_text").cast("binary")).alias("original"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all('Dr. ' || text || ' Mr. Paul Smith', 'Mr\\.\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)') || regexp_extract_all('Dr. ' || text || ' Mr. Paul Smith', 'Dr\\.\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)'), '|') AS names FROM documents""")
def titled_names(spark, sf):
    told = F.concat(F.lit("Dr. "), "text", F.lit(" Mr. Paul Smith"))
    return _docs(spark, sf).select("doc_id", F.array_join(pii.names(told), "|").alias("names"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5('window ' || text) ELSE md5(text) END AS text_md5 FROM documents""")
def metadata_replacement(spark, sf):
    window = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("window"), F.concat(F.lit("window "), "text")))
    own = _docs(spark, sf).withColumn("metadata", F.coalesce(window, F.create_map().cast("map<string,string>")))
    return postprocess.replace_by_metadata(own).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^ -~]', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS t FROM documents),
h AS (SELECT doc_id, t, left(t, 200) AS h FROM w), p AS (SELECT *, length(h) - instr(reverse(h), '.') AS stop, length(h) - instr(reverse(h), ' ') AS space FROM h)
SELECT doc_id, md5(CASE WHEN length(t) <= 200 THEN t WHEN contains(h, '.') AND stop > 100 THEN left(h, stop + 1) WHEN contains(h, ' ') THEN left(h, space) || '...' ELSE h END) AS text_md5 FROM p""")
def text_compression_to_a_length(spark, sf):
    plain = F.regexp_replace("text", "[^ -~]", " ")
    own = postprocess.compress(_docs(spark, sf).withColumn("text", plain), most=200)
    return own.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- result lists

@query(_SCORED.format(score=_COSINE, where="", k=3))
def best_hits(spark, sf):
    own = postprocess.best(_top(spark, sf), 3, "vec_id")
    return own.select("query_id", "vec_id", *_long("rank"), F.round("score", 6).alias("score"))


@query("SELECT query_id, vec_id, score FROM (" + _SCORED.format(score=_COSINE, where="", k=5) + ")")
def list_index_by_embedding(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return retrieval.list_index(nodes, asked, "embedding", 5, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT q.vec_id AS query_id, n.vec_id, round(coalesce(list_cosine_similarity(q.e, n.e), 0), 6) AS score FROM v q, v n WHERE q.vec_id % 20 = 0")
def list_index_scores(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return retrieval.list_index(readers.spread(nodes), asked, "embedding", 0, "vec_id", digits=6)


# ---- indexes and stores

@query(f"WITH {_DOC_WORDS}, k AS (SELECT doc_id, word FROM kd WHERE doc_id % 3 <> 0) SELECT word AS keyword, count(*) AS n_docs, sum(doc_id)::BIGINT AS docs FROM k GROUP BY word")
def keyword_table_upkeep(spark, sf):
    docs = _docs(spark, sf)
    table = keywords.keyword_table(docs.where("doc_id % 2 = 0"), "doc_id")
    table = keywords.insert(table, docs.where("doc_id % 4 <> 0"), "doc_id")
    table = keywords.delete(table, docs.where("doc_id % 3 = 0"), "doc_id")
    return table.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("docs"))


_STORED = """h AS (SELECT doc_id, lang, sha256(doc_id::VARCHAR || text) AS hash FROM documents),
s AS (SELECT h.doc_id, CASE WHEN quality = 1 THEN 'old' ELSE hash END AS hash FROM h JOIN labels USING (doc_id))"""


def _stored(spark, sf):
    docs = ingestion.hashed(_docs(spark, sf))
    stored = docs.join(_t(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "old").otherwise(F.col("hash")).alias("hash"))
    return docs, stored


@query(f"WITH {_STORED} SELECT h.doc_id, s.hash IS NULL OR s.hash <> h.hash AS refreshed FROM h LEFT JOIN s ON h.doc_id = s.doc_id")
def index_refresh(spark, sf):
    return ingestion.refresh(_docs(spark, sf), _stored(spark, sf)[1])


@query(f"""WITH {_STORED}, n AS (SELECT doc_id, hash FROM h WHERE lang = 'en')
SELECT 'row' AS kind, n.doc_id, n.hash FROM n LEFT JOIN s ON n.doc_id = s.doc_id WHERE s.hash IS NULL OR s.hash <> n.hash
UNION ALL SELECT 'gone', doc_id, NULL FROM s WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT 'stored', doc_id, hash FROM n""")
def ingestion_run(spark, sf):
    docs, stored = _stored(spark, sf)
    rows, after, gone = ingestion.run(docs.where("lang = 'en'"), stored, [lambda d: d.select("doc_id", "hash")], "upserts_and_delete")
    kind = lambda name: F.lit(name).alias("kind")
    none = F.lit(None).cast("string").alias("hash")
    return rows.select(kind("row"), "doc_id", "hash").unionByName(gone.select(kind("gone"), "doc_id", none)).unionByName(after.select(kind("stored"), "doc_id", "hash"))


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, NULL FROM labels")
def ingestion_inputs(spark, sf):
    return ingestion.inputs(_docs(spark, sf).select("doc_id", "lang"), _t(spark, sf, "labels").select("doc_id"))


@query("SELECT n_name AS subject, 'in' AS relation, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def graph_lists(spark, sf):
    from sparkwell.plans.queries import _edges

    return graph.get(_edges(spark, sf), relations=["in"], objects=["ASIA", "EUROPE"])


@query("""SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'nation' END AS label, 'k=' || n_nationkey || CASE WHEN n_regionkey = 1 THEN ';r=1' ELSE ';r=0' END AS told FROM nation WHERE n_nationkey <> 3""")
def property_graph(spark, sf):
    nation = _t(spark, sf, "nation")
    made = F.create_map(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("r"), F.lit("0"))
    old = nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("label"), made.alias("properties"))
    new = nation.where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit("new").alias("label"), F.create_map(F.lit("r"), F.lit("1")).alias("properties"))
    vertices = graph.property_upsert(old, new)
    edges = nation.select(F.col("n_name").alias("subject"), F.lit("is").alias("relation"), F.col("n_name").alias("object"))
    left, kept = graph.property_delete(vertices, edges, graph.property_get(vertices, properties={"k": "3"}))
    told = F.concat(F.lit("k="), F.element_at("properties", F.lit("k")), F.lit(";r="), F.element_at("properties", F.lit("r")))
    return left.join(kept.select(F.col("subject").alias("name")), "name").select("name", "label", told.alias("told"))


@query("""SELECT event_id || '_' || 0 AS doc_id, props AS text, json_extract_string(props, '$.k') AS k FROM events""")
def json_values(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.lit(0).alias("index"), F.regexp_replace("props", ": ", ":").alias("value"))
    own = readers.json_documents(rows)
    return own.select("doc_id", F.regexp_replace("text", '":"?([0-9]+)"?', '": $1').alias("text"), F.element_at("metadata", F.lit("k")).alias("k"))


# ---- models' answers

@query("""SELECT event_id, event_type || ',b c' AS keywords, 'Who is ' || event_type || '?|Why?' AS questions, (event_id % 9 + 0.5)::DOUBLE AS score, event_id % 2 = 0 AS yes, (event_id % 2 = 0)::INT::DOUBLE AS says_yes FROM events""")
def answer_parsers(spark, sf):
    e = _t(spark, sf, "events")
    number = (F.col("event_id") % 9).cast("string")
    listed = F.concat(F.lit(" "), "event_type", F.lit(" , , b c,"))
    asked = F.concat(F.lit("1. Who is "), "event_type", F.lit("?\n\n 2) Why?\n"))
    scored = F.concat(F.lit("So:\n"), number, F.lit(".5\nas said"))
    told = F.when(F.col("event_id") % 2 == 0, "Well, YES.").otherwise("no, my eyes hurt")
    return e.select(
        "event_id",
        F.array_join(parsers.keywords(listed), ",").alias("keywords"),
        F.array_join(parsers.questions(asked), "|").alias("questions"),
        parsers.score(scored).alias("score"),
        parsers.boolean(told).alias("yes"),
        parsers.says_yes(told).alias("says_yes"),
    )


@query("""SELECT event_id, event_id % 3 AS choice, event_type AS reason, 'q' || event_id AS sub_question, 'tool' AS tool_name, 'T' AS tool, 'what is ' || event_type || '?' AS question FROM events""")
def answer_structures(spark, sf):
    e = _t(spark, sf, "events")
    chosen = F.concat(F.lit('Sure:\n```json\n[{"choice": '), (F.col("event_id") % 3 + 1).cast("string"), F.lit(', "reason": "'), "event_type", F.lit('"}]\n```'))
    planned = F.concat(F.lit('{"items": [{"sub_question": "q'), F.col("event_id").cast("string"), F.lit('", "tool_name": "tool"}]}'))
    lined = F.concat(F.lit("plan\n[T]  what is "), "event_type", F.lit("?\n[] none"))
    first = lambda c: F.get(c, 0)
    s, p, b = first(parsers.selections(chosen)), first(parsers.sub_questions(planned)), first(parsers.bracketed_questions(lined))
    return e.select("event_id", s["index"].cast("long").alias("choice"), s["reason"].alias("reason"), p["sub_question"].alias("sub_question"), p["tool_name"].alias("tool_name"), b["tool"].alias("tool"), b["question"].alias("question"))


@query("""SELECT event_id, 'need ' || event_type AS thought, 'search' AS action, '{"k": ' || event_id || '}' AS action_input, CASE WHEN event_id % 2 = 0 THEN 'It is ' || event_type END AS answer FROM events""")
def reasoning_steps(spark, sf):
    e = _t(spark, sf, "events")
    step = F.concat(F.lit("Thought: need "), "event_type", F.lit("\nAction: search\nAction Input: {'k': "), F.col("event_id").cast("string"), F.lit("}\n"))
    told = F.when(F.col("event_id") % 2 == 0, F.concat(step, F.lit("Answer: It is "), "event_type")).otherwise(step)
    return e.select("event_id", parsers.react(told).alias("r")).select("event_id", "r.*")


@query("""SELECT conv_id AS query_id, md5(string_agg('Sub question: ' || text || chr(10) || 'Response: ' || role, ';' ORDER BY turn)) AS chunks FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def sub_question_pairs(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("sub_question"), F.when(F.col("role") != "system", F.col("role")).alias("response"))
    own = synthesis.sub_question_chunks(rows)
    joined = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return joined.select("query_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), ";").cast("binary")).alias("chunks"))


@query("SELECT item_id AS query_id, text || chr(10) || 'a passage' AS embedding_str FROM benchmark")
def hypothetical_documents(spark, sf):
    return synthesis.hypothetical(_asked(spark, sf), fixed("a passage")).select("query_id", "embedding_str")


@query("SELECT DISTINCT conv_id AS query_id, '' AS response FROM conversations")
def retrieval_without_text(spark, sf):
    turns = _t(spark, sf, "conversations")
    chunks = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")
    return synthesis.no_text(chunks, chunks.select("query_id").distinct())


@query("""WITH a AS (SELECT item_id, item_id % 3 AS r, text FROM benchmark)
SELECT item_id AS query_id, CASE r WHEN 0 THEN 'one ' || text WHEN 1 THEN 'two ' || text ELSE 'Summarize for the query ' || text || ':' || chr(10) || 'one ' || text || chr(10) || chr(10) || 'two ' || text || chr(10) END AS response FROM a""")
def routed_engines(spark, sf):
    asked = _asked(spark, sf)
    named = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("one"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("two"))).otherwise(F.array(F.lit("one"), F.lit("two")))
    engine = lambda name: lambda q: q.select("query_id", F.concat(F.lit(name + " "), "query_str").alias("response"))
    return engines.routed({"one": engine("one"), "two": engine("two")}, asked, echo, named)


@query("""SELECT item_id AS query_id, md5(text || ' rewritten') AS response FROM benchmark""")
def rewritten_queries(spark, sf):
    ask = lambda q: q.select("query_id", F.md5(F.col("query_str").cast("binary")).alias("response"))
    return engines.rewritten(ask, lambda q: F.concat(q, F.lit(" rewritten")))(_asked(spark, sf))


# ---- conversations

@query("""WITH s AS (SELECT *, (sum(strlen(coalesce(text, ''))) OVER w + row_number() OVER w - 1) // 4 AS tokens, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS total FROM s),
b AS (SELECT conv_id, min(turn) AS start FROM m WHERE tokens <= 300 AND (role NOT IN ('assistant', 'tool') OR n = total) GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, md5(text) AS text_md5 FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn >= b.start
UNION ALL SELECT c.conv_id, -1, 'system', md5('Summarize:' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) FROM conversations c LEFT JOIN b ON c.conv_id = b.conv_id WHERE start IS NULL OR c.turn < start GROUP BY c.conv_id""")
def memory_summaries(spark, sf):
    own = memory.summarized(_t(spark, sf, "conversations"), 300, echo)
    return own.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT conv_id, md5('History:' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || 'Follow up: and ' || conv_id || '?' || chr(10) || 'Standalone question: ') AS query FROM conversations GROUP BY conv_id""")
def condensed_questions(spark, sf):
    turns = _t(spark, sf, "conversations")
    new = turns.select("conv_id").distinct().withColumn("message", F.concat(F.lit("and "), F.col("conv_id").cast("string"), F.lit("?")))
    return memory.condensed(turns, new, echo).select("conv_id", F.md5(F.col("query_str").cast("binary")).alias("query"))


@query("""WITH l AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, m + 1, 'user' FROM l UNION ALL SELECT conv_id, m + 2, 'assistant' FROM l""")
def chat_replies(spark, sf):
    turns = _t(spark, sf, "conversations")
    new = turns.select("conv_id").distinct().withColumn("message", F.lit("more?"))
    return memory.replied(turns, new, new.select("conv_id", F.lit("ctx").alias("context")), echo).select("conv_id", "turn", "role")


# ---- evaluation and extraction

@query("""SELECT doc_id AS query_id, 'faithfulness' AS evaluator, CASE WHEN lang <> 'de' THEN 1.0::DOUBLE END AS score, CASE WHEN lang <> 'de' THEN true END AS passing, CASE WHEN lang = 'de' THEN 'response or contexts are missing' END AS invalid_reason FROM documents WHERE lang IS NOT NULL""")
def faithfulness(spark, sf):
    own = _docs(spark, sf).where("lang is not null").select(F.col("doc_id").alias("query_id"), F.lit("q").alias("query"), F.when(F.col("lang") != "de", F.col("lang")).alias("response"), F.array(F.lit("c")).alias("contexts"))
    return evaluation.yes_or_no("faithfulness", "{query} {response} {contexts}", fixed("Yes."))(own)


@query("""SELECT doc_id AS query_id, 'correctness' AS evaluator, (quality * 3 + 1.5)::DOUBLE AS score, quality = 1 AS passing, NULL::VARCHAR AS invalid_reason FROM labels""")
def correctness(spark, sf):
    own = _t(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.lit("q").alias("query"), F.lit("r").alias("reference"), F.when(F.col("quality") == 1, "4.5").otherwise("1.5").alias("response"))
    model = lambda prompt: F.regexp_extract(prompt, r"Answer: ([0-9.]+)", 1)
    return evaluation.correctness(model)(own)


@query("""SELECT doc_id, 'alpha, beta' AS found, 'What?' || chr(10) || 'Why?' AS asked FROM documents""")
def extracted_metadata(spark, sf):
    nodes = _docs(spark, sf).select("doc_id", "text", F.create_map(F.lit("lang"), "lang").alias("metadata"))
    own = extractors.questions(extractors.keywords(nodes, fixed("alpha, beta, gamma"), 2), fixed("1. What?\n2. Why?\n3. How?"), 2)
    held = lambda k: F.element_at("metadata", F.lit(k))
    return own.select("doc_id", held("excerpt_keywords").alias("found"), held("questions_this_excerpt_can_answer").alias("asked"))


@query("""WITH s AS (SELECT doc_id, 'Summarize:' || chr(10) || text AS s, lag('Summarize:' || chr(10) || text) OVER w AS p, lead('Summarize:' || chr(10) || text) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, md5(s) AS own, md5(p) AS prev, md5(n) AS next FROM s""")
def extracted_summaries(spark, sf):
    nodes = _docs(spark, sf).select("doc_id", F.col("doc_id").alias("pos"), F.col("source").alias("source_id"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"))
    own = extractors.summaries(nodes, echo, ("self", "prev", "next"))
    held = lambda k: F.md5(F.try_element_at("metadata", F.lit(k)).cast("binary"))
    return own.select("doc_id", held("section_summary").alias("own"), held("prev_section_summary").alias("prev"), held("next_section_summary").alias("next"))


# ---- objects and programs

@query("""SELECT n_name AS node_id, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS text, 'nation' AS kind, n_name AS name FROM nation""")
def object_nodes(spark, sf):
    own = objects.object_nodes(_t(spark, sf, "nation"), "nation", "n_name", "n_name")
    held = lambda k: F.element_at("metadata", F.lit(k))
    return own.select("node_id", "text", held("object_type").alias("kind"), held("name").alias("name"))


@query(_SCORED.format(score=_COSINE, where="AND n.label < 5", k=3).replace("vec_id, rank", "vec_id::VARCHAR AS node_id, rank"))
def object_retrieval(spark, sf):
    nodes, asked = _vectors(spark, sf)
    # descriptions are vectors written as text, and reading them is the embedding
    told = lambda df, key: df.select(key, F.to_json("embedding").alias("said"), "label")
    made = objects.object_nodes(told(nodes.where("label < 5"), "vec_id"), "vector", "vec_id", description="said")
    questions = asked.select("query_id", F.to_json("embedding").alias("query_str"))
    own = objects.retrieve(made, questions, lambda t: F.from_json(t, "array<float>"), 3)
    return own.select("query_id", "node_id", *_long("rank"), F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, p_brand AS brand, p_size::BIGINT AS size, p_size % 2 = 0 AS several FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, p_size % 2 = 0 FROM part WHERE p_size % 5 = 0""")
def programs_with_schema(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    # the stand-in for a model reads the parts of its prompt, and fails at every fifth size
    said = lambda p: F.concat(F.lit('```json\n{"brand": "'), F.regexp_extract(p, r"(Brand#\d+)", 1), F.lit('", "size": '), F.regexp_extract(p, r"of (\d+)", 1), F.lit("}\n```"))
    model = lambda p: F.when(F.regexp_extract(p, r"of (\d+)", 1).cast("int") % 5 != 0, said(p)).otherwise("I can't say.")
    own = programs.run(rows, model, "struct<brand:string,size:bigint>", "What is {p_brand} of {p_size}?")
    return own.select("p_partkey", F.col("output.brand").alias("brand"), F.col("output.size").alias("size"), (F.col("p_size") % 2 == 0).alias("several"))


@query("""SELECT p_partkey, p_name AS name, 2 AS n FROM part""")
def programs_by_function(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("input"))
    call = lambda p: F.to_json(F.array(*[F.struct(F.lit(n).alias("name"), F.to_json(F.struct(p.alias("value"))).alias("arguments")) for n in ("other", "keep")]))
    own = programs.call(rows, call, "keep", "struct<value:string>")
    several = programs.run_several(rows.select("p_partkey", "input"), fixed('[{"v": 1}, {"v": 2}]'), "struct<v:int>", 2)
    both = own.select("p_partkey", F.col("output.value").alias("name")).join(several.select("p_partkey", F.size("output").cast("int").alias("n")), "p_partkey")
    return both.select("p_partkey", "name", "n")


@query("""WITH d AS (SELECT source || '-' || doc_id AS doc_id, n_chars FROM documents WHERE n_chars < 300),
k AS (SELECT doc_id FROM d WHERE n_chars % 3 <> 1) SELECT doc_id FROM k""")
def engine_upkeep(spark, sf):
    docs = _docs(spark, sf).where("n_chars < 300").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("doc_id"), "text", "n_chars")
    engine = Engine(docs.where("n_chars % 3 = 0"), "keyword", Settings(chunk_size=4096, chunk_overlap=0))
    engine = engine.insert(docs.where("n_chars % 3 = 1")).delete(docs.where("n_chars % 3 = 1"))
    stored = ingestion.hashed(docs.where("n_chars % 3 = 0")).select("doc_id", "hash")
    engine, _ = engine.refresh(docs.where("n_chars % 3 <> 1"), stored)
    return engine.nodes.select("doc_id").distinct()
