"""More queries: graph upkeep, sparse vectors, synthesis with an echoing model, re-ranking, evaluation parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions import parsers, text, vectors
from sparkwell.functions.models import echo, fixed, hash_embedding
from sparkwell.operators import chunking, evaluation, extractors, graph, memory, postprocess, retrieval, synthesis, tree
from sparkwell.plans.queries import _EDGES, _PROBE, _SCORED, _TOP, _asked, _docs, _edges, _leaves, _probe, _t, _top, _vectors, query


@query(f"""WITH {_EDGES}, new AS (SELECT s_name AS subject, 'based in' AS relation, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT subject, relation, object FROM (SELECT * FROM edges UNION SELECT * FROM new) WHERE relation <> 'in'""")
def graph_upsert_delete(spark, sf):
    edges, nation = _edges(spark, sf), _t(spark, sf, "nation")
    new = _t(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    new = new.select(F.col("s_name").alias("subject"), F.lit("based in").alias("relation"), F.col("n_name").alias("object"))
    return graph.delete(graph.upsert(edges, new), edges.where("relation = 'in'"))


@query(f"WITH {_EDGES} SELECT subject, relation, object FROM edges WHERE subject IN (SELECT n_name FROM nation)")
def graph_get(spark, sf):
    return graph.of_subjects(_edges(spark, sf).distinct(), _t(spark, sf, "nation").select(F.col("n_name").alias("subject")))


@query("""SELECT DISTINCT p_brand, p_type FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND strlen(b.p_type) > strlen(a.p_type) AND contains(b.p_type, a.p_type))""")
def substring_elimination(spark, sf):
    return graph.without_substrings(_t(spark, sf, "part"), "p_brand", "p_type")


# the region names are plain words, so these are found
@query(f"""WITH {_EDGES}, t AS (SELECT DISTINCT r_regionkey, subject, relation, object FROM region JOIN edges ON lower(subject) = regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g'))
SELECT r_regionkey::BIGINT AS query_id, coalesce((SELECT string_agg('[' || subject || ', ' || relation || ', ' || object || ']', chr(10) ORDER BY subject, relation, object) FROM t WHERE t.r_regionkey = region.r_regionkey), 'No relationships found.') AS texts FROM region""")
def graph_retrieval(spark, sf):
    edges = _edges(spark, sf)
    asked = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("What is the "), "r_name", F.lit("?")).alias("query_str"))
    return graph.retrieve(edges, graph.entity_nodes(edges.withColumn("node_id", F.col("relation"))), asked)[1]


_PAIRS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0 END) AS s FROM embeddings), p AS (SELECT a.vec_id, a.e AS ae, b.e AS be, a.s AS a, b.s AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf):
    a = _vectors(spark, sf)[0].select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    own = a.join(b, "vec_id")
    return own.withColumn("a", vectors.to_sparse(F.col("x"), 0.1)).withColumn("b", vectors.to_sparse(F.col("y"), 0.1))


@query(f"""WITH {_PAIRS} SELECT vec_id, round(list_inner_product(a, b), 6) AS dot, round(sqrt(list_inner_product(a, a)), 6) AS mag,
 round(coalesce(CASE WHEN list_inner_product(a, a) * list_inner_product(b, b) > 0 THEN list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) END, 0), 6) AS cos,
 round(list_sum(a) + list_sum(b), 6) AS total FROM p""")
def sparse_functions(spark, sf):
    own = _pairs(spark, sf)
    both = vectors.sparse_add(F.col("a"), F.col("b"))
    return own.select(
        "vec_id",
        F.round(vectors.sparse_dot(F.col("a"), F.col("b")), 6).alias("dot"),
        F.round(vectors.magnitude(F.col("a.values")), 6).alias("mag"),
        F.round(vectors.sparse_cosine(F.col("a"), F.col("b")), 6).alias("cos"),
        F.round(F.aggregate(both["values"], F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(f"""WITH {_PAIRS} SELECT vec_id, round(0.3 * list_cosine_similarity(ae, be) + 0.7 * coalesce(CASE WHEN list_inner_product(a, a) * list_inner_product(b, b) > 0 THEN list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) END, 0), 6) AS sim FROM p""")
def hybrid_similarity(spark, sf):
    own = _pairs(spark, sf)
    return own.select("vec_id", F.round(vectors.hybrid_similarity(F.col("x"), F.col("y"), F.col("a"), F.col("b"), 0.3), 6).alias("sim"))


@query("SELECT item_id AS query_id, doc_id, 1.0::DOUBLE AS score FROM benchmark, documents")
def summary_index(spark, sf):
    return retrieval.list_index(_docs(spark, sf), _asked(spark, sf), key="doc_id")


def _chunks(spark, sf):
    return _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")


def _queries(spark, sf):
    return _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("query_str", F.concat(F.lit("q"), F.col("query_id").cast("string")))


def _prompt_sql(context: str, name: str) -> str:
    before, after = synthesis.QA.split("{context_str}")
    middle, end = after.split("{query_str}")
    q = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    return f"{q(before)} || {context} || {q(middle)} || {name} || {q(end)}"


@query(f"""SELECT conv_id AS query_id, md5({_prompt_sql("string_agg(text, chr(10) || chr(10) ORDER BY turn)", "'q' || conv_id")}) AS response FROM conversations GROUP BY conv_id""")
def simple_synthesis(spark, sf):
    own = synthesis.simple(_chunks(spark, sf), _queries(spark, sf), echo)
    return own.select("query_id", F.md5(F.col("response").cast("binary")).alias("response"))


@query(f"""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {_prompt_sql("text", "'q' || conv_id")} AS p FROM conversations)
SELECT conv_id AS query_id, md5(string_agg('Response ' || i || ': ' || p, chr(10) || '---------------------' || chr(10) ORDER BY i)) AS response FROM p GROUP BY conv_id""")
def accumulate_synthesis(spark, sf):
    own = synthesis.accumulate(_chunks(spark, sf), _queries(spark, sf), echo)
    return own.select("query_id", F.md5(F.col("response").cast("binary")).alias("response"))


@query("SELECT DISTINCT conv_id AS query_id, 'summary' AS response FROM conversations")
def tree_summarize_synthesis(spark, sf):
    return synthesis.tree_summarize(_chunks(spark, sf), _queries(spark, sf), fixed("summary"))


_BARE_QA = len(synthesis.QA.replace("{context_str}", "").replace("{query_str}", ""))
_BARE_REFINE = len(synthesis.REFINE.replace("{context_msg}", "").replace("{query_str}", "").replace("{existing_answer}", ""))
_PACKS = """c AS (SELECT conv_id, text, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
k AS (SELECT conv_id, i, 0 AS pack, n AS size FROM c WHERE i = 1
 UNION ALL SELECT c.conv_id, c.i, CASE WHEN size = 0 OR size + 2 + n > 4096 THEN pack + 1 ELSE pack END, CASE WHEN size = 0 OR size + 2 + n > 4096 THEN n ELSE size + 2 + n END FROM k JOIN c ON c.conv_id = k.conv_id AND c.i = k.i + 1),
p AS (SELECT k.conv_id, pack, length(string_agg(text, chr(10) || chr(10) ORDER BY c.i)) AS n FROM k JOIN c ON k.conv_id = c.conv_id AND k.i = c.i GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_PACKS}, a AS (SELECT conv_id, pack, (n + {_BARE_QA} + length('q' || conv_id))::VARCHAR AS answer FROM p WHERE pack = 0
 UNION ALL SELECT p.conv_id, p.pack, (p.n + {_BARE_REFINE} + length('q' || p.conv_id) + length(answer))::VARCHAR FROM a JOIN p ON p.conv_id = a.conv_id AND p.pack = a.pack + 1)
SELECT conv_id AS query_id, arg_max(answer, pack) AS response FROM a GROUP BY conv_id""")
def refine_synthesis(spark, sf):
    return synthesis.compact_and_refine(_chunks(spark, sf), _queries(spark, sf), lambda prompt: str(len(prompt)))


@query(f"""WITH t AS ({_TOP}) SELECT query_id, vec_id, score, CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE rank END AS rank
FROM t WHERE rank <= 5""")
def rankgpt_rerank(spark, sf):
    own = _top(spark, sf).drop("rank").withColumn("text", F.col("vec_id").cast("string"))
    asked = _vectors(spark, sf)[1].select("query_id", F.lit("q").alias("query_str"))
    out = postprocess.rankgpt(own, asked, fixed("[3] > [1]"), 5, "vec_id")
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH t AS ({_TOP}), j AS (SELECT query_id, vec_id, CASE (rank - 1) % 4 + 1 WHEN 2 THEN 9.0::DOUBLE WHEN 1 THEN 3.5::DOUBLE END AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM j WHERE score IS NOT NULL)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 3""")
def llm_rerank(spark, sf):
    own = _top(spark, sf).drop("rank").withColumn("text", F.col("vec_id").cast("string"))
    asked = _vectors(spark, sf)[1].select("query_id", F.lit("q").alias("query_str"))
    out = postprocess.llm_rerank(own, asked, fixed("Doc: 2, Relevance: 9\nDoc: 1, Relevance: 3.5"), 3, 4, "vec_id")
    return out.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE t AS ({_SCORED.format(score="coalesce(list_cosine_similarity(q.e, n.e), 0)", where="", k=10).replace("round(score, 6) AS score", "round(score, 12) AS score")}),
c AS (SELECT t.*, e.embedding::DOUBLE[] AS e FROM t JOIN embeddings e ON t.vec_id = e.vec_id),
s AS (SELECT a.query_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b ON a.query_id = b.query_id),
r AS (SELECT query_id, 0 AS step, []::BIGINT[] AS picked, []::DOUBLE[] AS told FROM c GROUP BY query_id
 UNION ALL SELECT query_id, step, picked || [w.vec_id], told || [w.value] FROM (
  SELECT query_id, step + 1 AS step, picked, told, arg_max(struct_pack(vec_id := vec_id, value := value), value) AS w FROM (
   SELECT r.query_id, r.step, r.picked, r.told, c.vec_id, 0.5 * any_value(c.score) - 0.5 * greatest(coalesce(max(s.sim) FILTER (list_contains(r.picked, s.b)), 0), 0) AS value
   FROM r JOIN c ON r.query_id = c.query_id AND NOT list_contains(r.picked, c.vec_id) JOIN s ON s.query_id = c.query_id AND s.a = c.vec_id WHERE r.step < 5 GROUP BY ALL) GROUP BY ALL))
SELECT query_id, unnest(picked) AS vec_id, round(unnest(told), 6) + 0.0::DOUBLE AS score, unnest(range(1, 6)) AS rank FROM r WHERE step = 5""")
def mmr_rerank(spark, sf):
    own = _top(spark, sf).join(_vectors(spark, sf)[0].select("vec_id", "embedding"), "vec_id")
    out = retrieval.mmr(own, 5, 0.5, "vec_id")
    return out.select("query_id", "vec_id", (F.round("score", 6) + F.lit(0.0)).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PROBE} SELECT query_id, CASE WHEN d.lang = 'de' THEN 'target-' || d.source ELSE d.doc_id::VARCHAR END AS node_id, round(max(score), 6) AS score
FROM kp JOIN documents d ON kp.doc_id = d.doc_id GROUP BY ALL""")
def recursive_retrieval(spark, sf):
    hits = _probe(spark, sf).select("query_id", F.col("doc_id").cast("string").alias("node_id"), "score")
    links = _docs(spark, sf).where("lang = 'de'").select(F.col("doc_id").cast("string").alias("index_id"), F.concat(F.lit("target-"), "source").alias("target_id"))
    return retrieval.recurse(hits, links).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT quality AS query_id, doc_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rank FROM labels JOIN documents USING (doc_id)),
n AS (SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS p, lead(doc_id) OVER (ORDER BY doc_id) AS nx FROM documents),
j AS (SELECT h.*, n.nx, lead(n.p) OVER w AS np, lead(h.doc_id) OVER w AS nd, lead(score) OVER w AS ns FROM h JOIN n ON h.doc_id = n.doc_id WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, doc_id::VARCHAR AS node_id, score FROM h UNION ALL SELECT query_id, nx::VARCHAR, (score + ns) / 2 FROM j WHERE nx = np AND nx <> nd""")
def gap_filling(spark, sf):
    from pyspark.sql import Window

    nodes = chunking.document_nodes(_docs(spark, sf)).select("node_id", "prev_id", "next_id")
    hits = _t(spark, sf, "labels").join(_docs(spark, sf), "doc_id")
    w = Window.partitionBy("quality").orderBy("doc_id")
    ranked = hits.select(F.col("quality").alias("query_id"), F.col("doc_id").cast("string").alias("node_id"), F.col("n_chars").cast("double").alias("score"), F.row_number().over(w).alias("rank"))
    return retrieval.fill_gaps(ranked, nodes)


@query("""WITH c AS (SELECT source, 'Give a title for:' || chr(10) || text AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
t AS (SELECT source, string_agg(c, ', ' ORDER BY r) || chr(10) || 'Best title:' AS t FROM c WHERE r <= 5 GROUP BY source)
SELECT doc_id, md5(t) AS title FROM documents JOIN t USING (source)""")
def title_candidates(spark, sf):
    nodes = _docs(spark, sf).select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").alias("pos"), "text", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    own = extractors.titles(nodes, echo)
    return own.select("doc_id", F.md5(F.element_at("metadata", F.lit("document_title")).cast("binary")).alias("title"))


@query("SELECT source AS query_id, round(avg(quality), 9) AS score, avg(quality) > 0.5 AS passing FROM labels JOIN documents USING (doc_id) GROUP BY source")
def context_relevancy(spark, sf):
    own = _t(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", F.col("source").alias("query_id")), "doc_id")
    out = evaluation.context_share(own.withColumn("answer", F.when(F.col("quality") == 1, "Yes, it is.").otherwise("No.")))
    return out.select("query_id", F.round("score", 9).alias("score"), "passing")


@query("SELECT round(avg(CASE WHEN toxic = 1 THEN 0 ELSE quality END), 9) AS score FROM labels")
def faithfulness_mean(spark, sf):
    own = _t(spark, sf, "labels").select(F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("score"))
    return evaluation.mean_with_missing_as_zero(own).select(F.round("score", 9).alias("score"))


@query("SELECT doc_id, (quality - 1) / 4.0::DOUBLE AS low, quality * 4 + 1.0::DOUBLE AS high FROM labels")
def score_scaling(spark, sf):
    q = F.col("quality").cast("double")
    return _t(spark, sf, "labels").select("doc_id", parsers.unit_score(q).alias("low"), parsers.five_score(q).alias("high"))


_HASHED = """c AS (SELECT {key}, {text} AS t FROM {table}),
b AS (SELECT {key}, unnest(list_transform(string_split(t, ''), lambda x: unicode(x))) AS u, unnest(list_transform(string_split(t, ''), lambda x: strlen(x))) AS w, unnest(range(1, length(t) + 1)) AS i FROM c WHERE t <> ''),
o AS (SELECT {key}, u, i, coalesce(sum(w) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b)"""


@query("WITH " + _HASHED.format(key="item_id", text="text", table="benchmark") + """, u AS (SELECT item_id, place % 64 AS p, sum(u / 1000.0) AS x, sum(CASE u WHEN 101 THEN 97 WHEN 32 THEN 95 ELSE u END / 1000.0) AS y FROM o GROUP BY ALL),
s AS (SELECT item_id, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS s FROM u GROUP BY item_id)
SELECT item_id AS query_id, 'semantic_similarity' AS evaluator, round(s, 6) AS score, s >= 0.8 AS passing FROM s""")
def semantic_similarity(spark, sf):
    rows = _asked(spark, sf).select("query_id", F.col("query_str").alias("response"), F.translate("query_str", "e ", "a_").alias("reference"))
    own = evaluation.semantic_similarity(hash_embedding(64))(rows)
    return own.select("query_id", "evaluator", F.round("score", 6).alias("score"), "passing")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def memory_last_turns(spark, sf):
    return memory.last_turns(_t(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


_BATCHES = """bt AS (SELECT *, sum((role IN ('user', 'system'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS batch FROM conversations),
bb AS (SELECT conv_id * 1000 + batch AS id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM bt GROUP BY ALL
 UNION ALL SELECT -1 - conv_id, coalesce(text, '') FROM conversations WHERE turn = 0)"""


@query("WITH " + _BATCHES + ", " + _HASHED.format(key="id", text="t", table="bb") + """, u AS (SELECT id, place % 64 AS p, sum(u / 1000.0) AS x FROM o GROUP BY ALL),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM u GROUP BY id),
s AS (SELECT -1 - q.id AS query_id, b.id % 1000 AS batch, coalesce(sum(a.x * c.x) / any_value(q.n) / any_value(b.n), 0) AS score
 FROM n q JOIN n b ON q.id < 0 AND b.id >= 0 AND b.id // 1000 = -1 - q.id JOIN u a ON a.id = q.id JOIN u c ON c.id = b.id AND c.p = a.p GROUP BY q.id, b.id)
SELECT query_id, batch::BIGINT AS batch, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, batch) AS rank FROM s QUALIFY rank <= 2""")
def memory_recall(spark, sf):
    embed = hash_embedding(64)
    turns = _t(spark, sf, "conversations")
    asked = turns.where("turn = 0").select("conv_id", F.col("conv_id").alias("query_id"), embed(F.col("text")).alias("embedding"))
    return memory.recall(turns, asked, embed, 2).select("query_id", "batch", F.col("rank").cast("long").alias("rank"))


@query("SELECT n_regionkey AS region, string_agg('(' || i || ') ' || n_name, chr(10) ORDER BY i) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY n_regionkey")
def choice_lists(spark, sf):
    own = _t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return own.select("region", text.numbered(F.col("n")).alias("listed"))


@query(None)
def tree_select_leaf(spark, sf):
    embed = hash_embedding(64)
    asked = _asked(spark, sf).select("query_id", embed(F.col("query_str")).alias("embedding"))
    return tree.select_leaves(tree.build(_leaves(spark, sf)), asked, embed, 1)


@query("""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS p, unnest(range(0, len(w))) AS i FROM w),
n AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')) AS n FROM e),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM n),
f AS (SELECT doc_id, upto, min(i) AS i, arg_min(n, i) AS n FROM c GROUP BY doc_id, upto),
b AS (SELECT doc_id, upto - n AS before, min(i) AS i FROM c GROUP BY ALL),
x AS (SELECT c.doc_id, c.i AS s, c.upto - c.n + 201 AS want FROM c),
y AS (SELECT x.doc_id, x.s, f.i, greatest(f.upto - f.n - 20, f.upto - 200) AS want FROM x ASOF JOIN f ON x.doc_id = f.doc_id AND f.upto >= x.want),
z AS (SELECT y.doc_id, y.s, y.i, b.i AS s2 FROM y ASOF JOIN b ON y.doc_id = b.doc_id AND b.before >= y.want),
r AS (SELECT doc_id, 0 AS k, 0::BIGINT AS s FROM w WHERE len(w) > 0 UNION ALL SELECT r.doc_id, k + 1, z.s2 FROM r JOIN z ON r.doc_id = z.doc_id AND r.s = z.s)
SELECT r.doc_id, k::BIGINT AS chunk_index, md5(array_to_string(w[r.s + 1 : coalesce(z.i, len(w))], ' ')) AS text_md5
FROM r JOIN w ON r.doc_id = w.doc_id LEFT JOIN z ON z.doc_id = r.doc_id AND z.s = r.s""")
def token_chunks(spark, sf):
    own = _docs(spark, sf).select("doc_id", F.posexplode(chunking.token_chunks(F.col("text"), 200, 20)).alias("chunk_index", "text"))
    return own.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(None)
def markdown_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.markdown_chunks(F.col("text"), 200)).alias("chunk_index", "text"))
