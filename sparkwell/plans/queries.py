"""Queries that apply the library to the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions import filters, parsers, pii, recency, text, vectors
from sparkwell.operators import (
    callbacks,
    chunking,
    evaluation,
    extractors,
    graph,
    ingestion,
    keywords,
    memory,
    postprocess,
    retrieval,
    stores,
    synthesis,
    tree,
)
from sparkwell.operators.common import numbered
from sparkwell.sources import readers
from sparkwell.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.table(spark, sf, name)


def _docs(spark, sf):
    return readers.spread(_t(spark, sf, "documents"))


def _vectors(spark, sf):
    own = _t(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return own, own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _asked(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_str"))


# ---- dense vectors

_SCORED = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, n.vec_id, {score} AS score FROM v q, v n WHERE q.vec_id % 20 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_SCORED.format(score="coalesce(list_cosine_similarity(q.e, n.e), 0)", where="", k=10))
def dense_topk(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return _hits(retrieval.dense_search(nodes, asked, 10, "vec_id"))


@query(_SCORED.format(score="coalesce(list_cosine_similarity(q.e, n.e), 0)", where="AND n.label = 3", k=5))
def dense_topk_filtered(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return _hits(retrieval.dense_search(nodes, asked, 5, "vec_id", where=F.col("label") == 3))


@query(_SCORED.format(score="list_inner_product(q.e, n.e)", where="", k=10))
def dense_topk_dot(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return _hits(retrieval.dense_search(nodes, asked, 10, "vec_id", "dot_product"))


@query(_SCORED.format(score="1 / (1 + list_distance(q.e, n.e))", where="", k=10))
def dense_topk_euclidean(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return _hits(retrieval.dense_search(nodes, asked, 10, "vec_id", "euclidean"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cos, round(list_inner_product(a.e, b.e), 6) AS dot,
 round(list_distance(a.e, b.e), 6) AS dist, round(1 / (1 + list_distance(a.e, b.e)), 6) AS sim,
 round(sqrt(list_inner_product(a.e, a.e)), 6) AS mag, round(a.e[1] + b.e[1], 6) AS added, round(a.e[2] - b.e[2], 6) AS taken,
 round(a.e[3] / sqrt(list_inner_product(a.e, a.e)), 6) AS unit
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_functions(spark, sf):
    a = _vectors(spark, sf)[0].select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(vectors.cosine(x, y), 6).alias("cos"),
        F.round(vectors.dot(x, y), 6).alias("dot"),
        F.round(vectors.euclidean_distance(x, y), 6).alias("dist"),
        F.round(vectors.euclidean_similarity(x, y), 6).alias("sim"),
        F.round(vectors.magnitude(x), 6).alias("mag"),
        F.round(F.get(vectors.add(x, y), 0), 6).alias("added"),
        F.round(F.get(vectors.subtract(x, y), 1), 6).alias("taken"),
        F.round(F.get(vectors.normalize(x), 2), 6).alias("unit"),
    )


@query("""SELECT label, p AS pos, round(avg(embedding[p + 1]::DOUBLE), 6) AS mean
FROM embeddings, range(0, 64) t(p) GROUP BY label, p""")
def vector_mean(spark, sf):
    own = vectors.mean(_vectors(spark, sf)[0], "label").select("label", F.posexplode("embedding").alias("pos", "x"))
    return own.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, len(list_filter(e, lambda x: abs(x) > 0.1))::BIGINT AS n_values, len(e)::BIGINT AS dimension,
 round(coalesce(list_sum(list_filter(e, lambda x: abs(x) > 0.1)), 0), 6) AS total FROM v""")
def sparse_from_dense(spark, sf):
    own = _vectors(spark, sf)[0].withColumn("s", vectors.to_sparse(F.col("embedding"), 0.1))
    dense = vectors.to_dense(F.col("s"))
    return own.select(
        "vec_id",
        F.size("s.indices").cast("long").alias("n_values"),
        F.size(dense).cast("long").alias("dimension"),
        F.round(F.aggregate(dense, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# ---- keywords, BM25, fusion

_PUNCT = keywords.PUNCTUATION.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in keywords.STOP_WORDS)
_BM_STOP = ", ".join(f"'{w}'" for w in keywords.BM25_STOP_WORDS)
_KEYWORDS = """{name}_w AS (SELECT {key}, trim(w, '{punct}') AS word FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS w FROM {table})),
{name}_c AS (SELECT {key}, word, count(*) AS n FROM {name}_w WHERE strlen(word) >= 3 AND word NOT IN ({stop}) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, word) AS rank FROM {name}_c QUALIFY rank <= 10)"""
_DOC_WORDS = _KEYWORDS.format(name="kd", key="doc_id", text="text", table="documents", punct=_PUNCT, stop=_STOP)
_ASK_WORDS = _KEYWORDS.format(name="kq", key="item_id", text="text", table="benchmark", punct=_PUNCT, stop=_STOP)


@query(f"WITH {_DOC_WORDS} SELECT doc_id, word, n, rank FROM kd")
def keyword_extraction(spark, sf):
    return keywords.extract_keywords(_docs(spark, sf), "doc_id").select("doc_id", "word", "n", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DOC_WORDS} SELECT word AS keyword, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM kd GROUP BY word")
def keyword_table(spark, sf):
    own = keywords.keyword_table(_docs(spark, sf), "doc_id")
    return own.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


_PROBE = f"""{_DOC_WORDS}, {_ASK_WORDS}, nk AS (SELECT item_id, count(*) AS n_keywords FROM kq GROUP BY item_id),
probe AS (SELECT kq.item_id AS query_id, kd.doc_id, count(DISTINCT kd.word) / any_value(n_keywords) AS score
 FROM kq JOIN kd ON kq.word = kd.word JOIN nk ON nk.item_id = kq.item_id GROUP BY kq.item_id, kd.doc_id),
kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM probe QUALIFY rank <= 10)"""


def _probe(spark, sf):
    return keywords.probe(keywords.keyword_table(_docs(spark, sf), "doc_id"), _asked(spark, sf), 10, "doc_id")


def _doc_hits(df):
    return df.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_PROBE} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM kp")
def keyword_probe(spark, sf):
    return _doc_hits(_probe(spark, sf))


_BM = f"""tok AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+')) AS term FROM documents) WHERE term <> '' AND term NOT IN ({_BM_STOP})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, count(*) AS df, ln((n::DOUBLE - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term, n),
wt AS (SELECT tf.doc_id, tf.term, idf.idf, idf.idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (dl / mean)))) AS weight FROM tf JOIN dl ON tf.doc_id = dl.doc_id JOIN idf ON tf.term = idf.term, st),
qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+')) AS term FROM benchmark) WHERE term <> '' AND term NOT IN ({_BM_STOP})),
bs AS (SELECT query_id, doc_id, sum(weight * idf) AS score FROM qt JOIN wt ON qt.term = wt.term GROUP BY ALL HAVING sum(weight * idf) > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs QUALIFY rank <= 10)"""


def _bm25(spark, sf):
    asked = _asked(spark, sf)
    return keywords.bm25_search(keywords.bm25_weights(_docs(spark, sf), only=keywords.bm25_tokens(asked, "query_id", "query_str")), asked, 10)


@query(f"WITH {_BM} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark, sf):
    return _doc_hits(_bm25(spark, sf))


@query(f"WITH {_BM} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(spark, sf):
    docs = _docs(spark, sf)
    tf = keywords.bm25_tokens(docs, "doc_id").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return keywords.bm25_fit(tf, "doc_id", docs.count()).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_BM} SELECT doc_id, count(*) AS n_terms, round(sum(weight + idf * 0.5), 5) AS total FROM wt GROUP BY doc_id")
def bm25_plus_weights(spark, sf):
    own = keywords.bm25_weights(_docs(spark, sf), delta=0.5)
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"))


def _lists(spark, sf):
    one = _bm25(spark, sf).withColumn("retriever", F.lit("bm25"))
    two = _probe(spark, sf).withColumn("retriever", F.lit("keyword"))
    cols = ["query_id", "doc_id", "score", "retriever"]
    return one.select(*cols).unionByName(two.select(*cols))


_LISTS = f"WITH {_PROBE}, {_BM}, lists AS (SELECT query_id, doc_id, score, rank, 'bm25' AS retriever, 0.5 AS w FROM bm UNION ALL SELECT query_id, doc_id, score, rank, 'keyword', 0.5 FROM kp)"
_FUSED = """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
_SCALE = """, b AS (SELECT *, {low} AS lo, {high} AS hi FROM lists),
f AS (SELECT query_id, doc_id, sum(CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END * w) AS score FROM b GROUP BY ALL)"""
_OVER = "OVER (PARTITION BY query_id, retriever)"


@query(_LISTS + ", f AS (SELECT query_id, doc_id, sum(1.0 / (rank - 1 + 60.0)) AS score FROM lists GROUP BY ALL)" + _FUSED)
def fusion_rrf(spark, sf):
    return _doc_hits(retrieval.fuse(_lists(spark, sf), "reciprocal_rerank", key="doc_id"))


@query(_LISTS + _SCALE.format(low=f"min(score) {_OVER}", high=f"max(score) {_OVER}") + _FUSED)
def fusion_relative_score(spark, sf):
    return _doc_hits(retrieval.fuse(_lists(spark, sf), "relative_score", {"bm25": 1.0, "keyword": 1.0}, "doc_id"))


@query(_LISTS + _SCALE.format(low=f"avg(score) {_OVER} - 3 * stddev_pop(score) {_OVER}", high=f"avg(score) {_OVER} + 3 * stddev_pop(score) {_OVER}") + _FUSED)
def fusion_distribution(spark, sf):
    return _doc_hits(retrieval.fuse(_lists(spark, sf), "dist_based_score", {"bm25": 1.0, "keyword": 1.0}, "doc_id"))


@query(_LISTS + ", f AS (SELECT query_id, doc_id, max(score) AS score FROM lists GROUP BY ALL)" + _FUSED)
def fusion_simple(spark, sf):
    return _doc_hits(retrieval.fuse(_lists(spark, sf), "simple", key="doc_id"))


@query(_LISTS + ", f AS (SELECT query_id, doc_id, sum(CASE WHEN retriever = 'bm25' THEN 0.7 ELSE 0.3 END * score) AS score FROM lists GROUP BY ALL)" + _FUSED)
def hybrid_search(spark, sf):
    return _doc_hits(retrieval.hybrid(_bm25(spark, sf), _probe(spark, sf), 0.7, 10, "doc_id"))


@query(_LISTS + " SELECT query_id, doc_id, round(arg_max(score, CASE WHEN retriever = 'keyword' THEN 1 ELSE 0 END), 6) AS score FROM lists GROUP BY ALL")
def router_union(spark, sf):
    cols = ["query_id", "doc_id", "score"]
    own = retrieval.route({"bm25": _bm25(spark, sf).select(*cols), "keyword": _probe(spark, sf).select(*cols)}, key="doc_id")
    return own.select("query_id", "doc_id", F.round("score", 6).alias("score"))


# ---- post-processing

_TOP = _SCORED.format(score="coalesce(list_cosine_similarity(q.e, n.e), 0)", where="", k=10)


def _top(spark, sf):
    nodes, asked = _vectors(spark, sf)
    return retrieval.dense_search(nodes, asked, 10, "vec_id")


@query(f"SELECT query_id, vec_id, rank, score FROM ({_TOP}) WHERE score <> 0 AND score >= 0.3")
def similarity_cutoff(spark, sf):
    return _hits(postprocess.similarity_cutoff(_top(spark, sf), 0.3))


@query(f"""WITH t AS ({_TOP}), i AS (SELECT *, 10 - rank AS i FROM t),
p AS (SELECT *, CASE WHEN i % 2 = 0 THEN -i ELSE i END AS place FROM i)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS position FROM p""")
def long_context_reorder(spark, sf):
    return postprocess.long_context_order(_top(spark, sf).drop("rank"), "vec_id").select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


@query(f"SELECT query_id, vec_id, (rank - 1) // 4 AS batch, (rank - 1) % 4 + 1 AS place FROM ({_TOP})")
def rerank_batches(spark, sf):
    return postprocess.batches(_top(spark, sf), 4, "vec_id").select("query_id", "vec_id", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'license')")
def keyword_filter(spark, sf):
    return postprocess.keyword_filter(_docs(spark, sf), ("The",), ("LICENSE",)).select("doc_id")


_LATE = "TIMESTAMP '2024-02-01 00:00:00'"


@query(f"""WITH w AS (SELECT user_id, event_id, value * greatest(0.0, 1 - epoch({_LATE} - ts) / 2592000.0) AS score FROM events WHERE epoch({_LATE} - ts) <= 2592000),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_id) AS rank FROM w)
SELECT user_id, event_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def recency_linear(spark, sf):
    own = _t(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("t"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = postprocess.recency_order(own, F.col("t"), now, 5, "linear", 2_592_000, "event_id")
    return out.select(F.col("query_id").alias("user_id"), "event_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH a AS (SELECT event_id, value, epoch({_LATE} - ts) AS age FROM events)
SELECT event_id, round(value * pow(0.9, 1 + ceil(greatest(age, 0) / 86400.0)), 6) AS exponential,
 round(value * CASE WHEN age <= 604800 THEN 1.0 ELSE 0.5 END, 6) AS step FROM a""")
def recency_weights(spark, sf):
    own = _t(spark, sf, "events").withColumn("age", recency.age_seconds(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")))
    return own.select(
        "event_id",
        F.round(recency.exponential(F.col("value"), F.col("age"), 0.9), 6).alias("exponential"),
        F.round(recency.step(F.col("value"), F.col("age"), 604_800, 1.0, 0.5), 6).alias("step"),
    )


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events)
SELECT user_id, event_id, rank FROM r WHERE rank <= 3""")
def recency_newest(spark, sf):
    own = _t(spark, sf, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("value").alias("score"), "ts")
    out = postprocess.recency_order(own, F.col("ts"), F.lit("2024-02-01").cast("timestamp"), 3, key="event_id")
    return out.select(F.col("query_id").alias("user_id"), "event_id", F.col("rank").cast("long").alias("rank"))


def _mask_sql(column: str = "text") -> str:
    out = column
    for pattern, mask in pii.PATTERNS.values():
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_mask_sql()}) AS masked FROM documents")
def pii_mask(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(pii.mask(F.col("text")).cast("binary")).alias("masked"))


@query("SELECT doc_id FROM documents WHERE NOT (" + " OR ".join(f"regexp_matches(text, '{p}')" for p, _ in pii.PATTERNS.values()) + ")")
def pii_filter(spark, sf):
    return pii.drop_pii(_docs(spark, sf)).select("doc_id")


_PII = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pii_type, regexp_extract_all(text, '{p}') AS h, regexp_split_to_array(text, '{p}') AS g FROM documents" for k, (p, _) in pii.PATTERNS.items())


@query(f"""WITH m AS ({_PII}), e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
p AS (SELECT doc_id, pii_type, h[i] AS value, (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS a FROM e)
SELECT doc_id, pii_type, value, a AS start_byte, a + strlen(value) AS end_byte FROM p""")
def pii_detect(spark, sf):
    own = pii.detect(_docs(spark, sf), "doc_id")
    return own.select("doc_id", "pii_type", "value", F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"))


@query("SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND list_position(string_split('a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need this that these those i you he she it we they what which who whom when where why how all each every both few more most other some such no nor not only own same so than too very just also now here there', ' '), lower(w)) IS NULL), ' ')) AS text_md5 FROM documents")
def text_compression(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(text.compressed(F.col("text"), True).cast("binary")).alias("text_md5"))


# ---- chunks and nodes

_SENT = f"list_filter(list_transform(regexp_extract_all(text, '{chunking.SENTENCE}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS l FROM documents),
e AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM s),
w AS (SELECT *, greatest(i - 3, 0) AS a, least(i + 3, len(l) - 1) AS b FROM e)
SELECT doc_id, i AS sentence_index, a AS window_start, b AS window_end, md5(array_to_string(l[a + 1 : b + 1], ' ')) AS window_md5, l[i + 1] AS original_sentence FROM w""")
def sentence_windows(spark, sf):
    own = chunking.sentence_windows(_docs(spark, sf), 3)
    long = [F.col(c).cast("long").alias(c) for c in ("sentence_index", "window_start", "window_end")]
    return own.select("doc_id", *long, F.md5(F.col("window").cast("binary")).alias("window_md5"), "original_sentence")


_CHUNKS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, (len(w) + 99) // 100 AS n, unnest(range(0, (len(w) + 99) // 100)) AS i, w FROM w),
k AS (SELECT doc_id, n, i, array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ') AS t FROM c)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, i AS chunk_index, md5(t) AS text_md5 FROM k")
def word_chunks(spark, sf):
    own = _docs(spark, sf).select("doc_id", F.posexplode(chunking.word_chunks(F.col("text"), 100)).alias("chunk_index", "t"))
    return own.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query(f"""WITH {_CHUNKS} SELECT doc_id || '-chunk-' || i AS node_id, CASE WHEN i > 0 THEN doc_id || '-chunk-' || (i - 1) END AS prev_id,
 CASE WHEN i < n - 1 THEN doc_id || '-chunk-' || (i + 1) END AS next_id, n AS chunk_count,
 coalesce(sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char,
 sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS end_char, sha256('type=TEXT' || t) AS node_hash FROM k""")
def node_building(spark, sf):
    own = chunking.nodes(_docs(spark, sf), chunking.word_chunks(F.col("text"), 100))
    long = [F.col(c).cast("long").alias(c) for c in ("chunk_count", "start_char", "end_char")]
    return own.select("node_id", "prev_id", "next_id", *long, "node_hash")


@query(None)
def sentence_chunks(spark, sf):
    own = _docs(spark, sf).select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"), 200, 20)).alias("chunk_index", "text"))
    return own


@query("SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id)::VARCHAR AS prev_id, lead(doc_id) OVER (ORDER BY doc_id)::VARCHAR AS next_id FROM documents")
def document_links(spark, sf):
    return chunking.document_nodes(_docs(spark, sf)).select("doc_id", "prev_id", "next_id")


@query("SELECT doc_id, sha256(doc_id::VARCHAR || text) AS hash FROM documents")
def document_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", text.document_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def _with_metadata(spark, sf):
    return _docs(spark, sf).withColumn("metadata", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("n_chars"), F.col("n_chars").cast("string")))


@query("""SELECT doc_id, md5(regexp_replace('lang: ' || lang || chr(10) || 'n_chars: ' || n_chars || chr(10) || 'source: ' || source || chr(10) || chr(10) || text, '^\\s+|\\s+$', '', 'g')) AS all_md5,
 md5(regexp_replace('lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || text, '^\\s+|\\s+$', '', 'g')) AS embed_md5 FROM documents""")
def node_content(spark, sf):
    own = _with_metadata(spark, sf)
    args = (F.col("text"), F.col("metadata"))
    return own.select(
        "doc_id",
        F.md5(text.content(*args).cast("binary")).alias("all_md5"),
        F.md5(text.content(*args, mode="embed", excluded_embed=F.array(F.lit("n_chars"))).cast("binary")).alias("embed_md5"),
    )


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND (n_chars > 2000 OR source IN ('src1', 'src2')) AND NOT (contains(source, '7'))")
def metadata_filter(spark, sf):
    f = filters.Filters((
        filters.Filter("lang", "en"),
        filters.Filters((filters.Filter("n_chars", 2000, ">"), filters.Filter("source", ["src1", "src2"], "in")), "or"),
        filters.Filters((filters.Filter("source", "7", "text_match"),), "not"),
    ))
    return _with_metadata(spark, sf).where(filters.matches(f, F.col("metadata"))).select("doc_id")


@query("SELECT doc_id, 'Document ' || doc_id || ' in ' || lang || ': {unknown}' AS prompt FROM documents")
def prompt_formatting(spark, sf):
    return _docs(spark, sf).select("doc_id", text.format_prompt("Document {id} in {lang}: {unknown}", {"id": F.col("doc_id"), "lang": F.col("lang")}).alias("prompt"))


# ---- sources

def _html_sql() -> str:
    t = "html"
    for tag in readers.REMOVED:
        t = f"regexp_replace(regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g'), '(?i)<{tag}\\b[^>]*/?>', '', 'g')"
    t = f"regexp_replace({t}, '<!--[\\s\\S]*?-->', '', 'g')"
    body = "(?is)<body[^>]*>(.*?)</body>"
    t = f"(SELECT CASE WHEN regexp_matches(x, '{body}') THEN regexp_extract(x, '{body}', 1) ELSE x END FROM (SELECT {t} AS x))"
    t = f"regexp_replace(regexp_replace({t}, '(?i)</?(?:{readers.BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    for name, char in readers.ENTITIES.items():
        char = char.replace("'", "''")
        t = f"replace({t}, '{name}', '{char}')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, md5({_html_sql()}) AS text_md5 FROM pages")
def html_text(spark, sf):
    return readers.spread(_t(spark, sf, "pages")).select("page_id", F.md5(readers.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '') AS title,
 nullif(trim(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1)), '') AS language FROM pages""")
def html_metadata(spark, sf):
    own = _t(spark, sf, "pages").withColumn("m", readers.html_metadata(F.col("html")))
    return own.select("page_id", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("language")).alias("language"))


# ---- ingestion and stores

@query("""WITH h AS (SELECT doc_id, lang, sha256(text) AS hash FROM documents)
SELECT min(doc_id) AS doc_id FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE lang = 'de') GROUP BY hash""")
def ingestion_dedup(spark, sf):
    docs = ingestion.hashed(_docs(spark, sf), F.sha2(F.col("text").cast("binary"), 256))
    return ingestion.without_duplicates(docs, docs.where("lang = 'de'").select("hash")).select("doc_id")


@query("""WITH s AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE sha256(d.doc_id::VARCHAR || text) END AS hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT d.doc_id, CASE WHEN s.hash IS NULL THEN 'insert' WHEN s.hash <> sha256(d.doc_id::VARCHAR || text) THEN 'update' ELSE 'skip' END AS status
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""")
def ingestion_upserts(spark, sf):
    docs = ingestion.hashed(_docs(spark, sf))
    stored = docs.join(_t(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "old").otherwise(F.col("hash")).alias("hash"))
    return ingestion.upserts(docs.select("doc_id", "hash"), stored).select("doc_id", "status")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def ingestion_deletions(spark, sf):
    return ingestion.deletions(_docs(spark, sf).where("lang = 'en'"), _t(spark, sf, "labels"))


@query("SELECT source AS source_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS node_ids FROM documents GROUP BY source")
def source_info(spark, sf):
    own = stores.source_info(_docs(spark, sf).select(F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("source_id")))
    return own.select("source_id", F.array_join("node_ids", ",").alias("node_ids"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_nodes(spark, sf):
    return extractors.first_nodes(_docs(spark, sf), 5, "source", "doc_id").select("doc_id")


@query("SELECT doc_id, lag(lang) OVER w AS prev_lang, lead(lang) OVER w AS next_lang FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbour_summaries(spark, sf):
    return extractors.neighbours(_docs(spark, sf), "lang", "doc_id", "source").select("doc_id", "prev_lang", "next_lang")


# ---- trees, merging

_LEVELS = """WITH RECURSIVE t AS (SELECT 0 AS level, count(*) AS n FROM documents UNION ALL SELECT level + 1, (n + 9) // 10 FROM t WHERE n > 10)
SELECT CASE WHEN level = 0 THEN d.doc_id::VARCHAR ELSE 'summary-' || level || '-' || pos END AS node_id, level::BIGINT AS level, pos,
 CASE WHEN n > 10 THEN 'summary-' || (level + 1) || '-' || (pos // 10) END AS parent_id
FROM (SELECT level, n, unnest(range(0, n)) AS pos FROM t) x LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) d ON level = 0 AND p = pos"""


def _leaves(spark, sf):
    return numbered(_docs(spark, sf), "doc_id").select(F.col("doc_id").cast("string").alias("node_id"), "pos", "text")


@query(_LEVELS)
def tree_build(spark, sf):
    return tree.build(_leaves(spark, sf)).select("node_id", F.col("level").cast("long").alias("level"), "pos", "parent_id")


@query("""WITH h AS (SELECT quality AS query_id, d.source, d.doc_id::VARCHAR AS node_id, n_chars::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'fr'),
f AS (SELECT h.query_id, h.source, count(*) AS n, avg(score) AS score, (SELECT count(*) FROM documents d WHERE d.source = h.source) AS total FROM h GROUP BY h.query_id, h.source),
g AS (SELECT * FROM f WHERE n / total > 0.15)
SELECT query_id, node_id, round(score, 4) AS score FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = h.query_id AND g.source = h.source)
UNION ALL SELECT query_id, source, round(score, 4) FROM g""")
def auto_merging(spark, sf):
    docs = _docs(spark, sf)
    hits = docs.where("lang <> 'fr'").join(_t(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("query_id"), F.col("doc_id").cast("string").alias("node_id"), F.col("n_chars").cast("double").alias("score"))
    children = docs.select(F.col("source").alias("parent_id"), F.col("doc_id").cast("string").alias("child_id"))
    return retrieval.merge_parents(hits, children, 0.15).select("query_id", "node_id", F.round("score", 4).alias("score"))


# ---- graph

def _edges(spark, sf):
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    parts = [
        places.select(F.col("n_name").alias("subject"), F.lit("in").alias("relation"), F.col("r_name").alias("object")),
        region.select(F.col("r_name").alias("subject"), F.lit("part of").alias("relation"), F.lit("WORLD").alias("object")),
        _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("lives in").alias("relation"), F.col("n_name").alias("object")),
    ]
    return reduce(DataFrame.unionByName, parts)


_EDGES = """edges AS (SELECT n_name AS subject, 'in' AS relation, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT r_name, 'part of', 'WORLD' FROM region UNION SELECT c_name, 'lives in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT subject AS start, 1 AS level, subject, relation, object FROM edges
UNION SELECT p.start, p.level + 1, e.subject, e.relation, e.object FROM p JOIN edges e ON e.subject = p.object WHERE p.level < 3)
SELECT start, level::BIGINT AS level, subject, relation, object FROM p""")
def relation_map(spark, sf):
    edges = _edges(spark, sf)
    return graph.relation_map(edges, edges.select("subject"), 3).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_EDGES} SELECT count(DISTINCT subject) AS n_subjects, count(*) AS n_edges FROM edges")
def graph_size(spark, sf):
    return graph.size(_edges(spark, sf))


@query("""SELECT c_custkey AS node_id, upper(c_name[1]) || c_name[2:] AS subject, 'lives in' AS relation, upper(n_name[1]) || n_name[2:] AS object
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def triplet_parse(spark, sf):
    own = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = F.concat(F.lit("Found: ("), "c_name", F.lit(", lives in, \""), "n_name", F.lit("\")\n(only, two) ()"))
    return graph.extract(own.select(F.col("c_custkey").alias("node_id"), told.alias("t")), F.col("t"))


@query(f"""WITH {_EDGES}, e AS (SELECT subject AS entity, subject AS node_id FROM edges UNION SELECT object, subject FROM edges)
SELECT entity, count(DISTINCT node_id) AS n_nodes, min(node_id) AS first_node FROM e GROUP BY entity""")
def entity_nodes(spark, sf):
    own = graph.entity_nodes(_edges(spark, sf).withColumn("node_id", F.col("subject")))
    return own.groupBy("entity").agg(F.count("node_id").alias("n_nodes"), F.min("node_id").alias("first_node"))


@query("""SELECT item_id AS query_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND list_position(string_split('the a an is are was were be been being have has had do does did will would could should may might must shall of in to for with on at by from as and or but if then that which who whom whose this these those it its what when where why how', ' '), w) IS NULL)[1:10], ',') AS keywords FROM benchmark""")
def query_keywords(spark, sf):
    return _asked(spark, sf).select("query_id", F.array_join(parsers.query_keywords(F.col("query_str")), ",").alias("keywords"))


# ---- conversations, synthesis

@query("""WITH s AS (SELECT *, (sum(strlen(coalesce(text, ''))) OVER w + row_number() OVER w - 1) // 4 AS tokens, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS total FROM s),
b AS (SELECT conv_id, min(turn) AS start FROM m WHERE tokens <= 300 AND (role NOT IN ('assistant', 'tool') OR n = total) GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn >= b.start""")
def memory_budget(spark, sf):
    return memory.within_budget(_t(spark, sf, "conversations"), 300).select("conv_id", "turn", "role")


@query("""WITH b AS (SELECT *, sum((role IN ('user', 'system'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS batch FROM conversations)
SELECT conv_id, batch::BIGINT AS batch, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS text_md5 FROM b GROUP BY conv_id, batch""")
def memory_batches(spark, sf):
    return memory.user_batches(_t(spark, sf, "conversations")).select("conv_id", "batch", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, text, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, i, 0 AS pack, n AS size FROM c WHERE i = 1
 UNION ALL SELECT c.conv_id, c.i, CASE WHEN size = 0 OR size + 2 + n > 1500 THEN pack + 1 ELSE pack END, CASE WHEN size = 0 OR size + 2 + n > 1500 THEN n ELSE size + 2 + n END FROM p JOIN c ON c.conv_id = p.conv_id AND c.i = p.i + 1)
SELECT p.conv_id AS query_id, pack::BIGINT AS pos, md5(string_agg(text, chr(10) || chr(10) ORDER BY c.i)) AS text_md5 FROM p JOIN c ON p.conv_id = c.conv_id AND p.i = c.i GROUP BY ALL""")
def chunk_packing(spark, sf):
    own = _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")
    return synthesis.packed(own, 1500).select("query_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT conv_id AS query_id, md5(string_agg('> Source (Doc id: ' || turn || '): ' || text, chr(10) || chr(10) ORDER BY turn)) AS sources FROM conversations GROUP BY conv_id""")
def citations(spark, sf):
    own = _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("turn").alias("node_id"), "text")
    return synthesis.sources(own, 1 << 28).select("query_id", F.md5(F.col("sources").cast("binary")).alias("sources"))


# ---- evaluation, callbacks

_RESULTS = """res AS (SELECT 'quality' AS evaluator, lang, quality::DOUBLE AS score, quality = 1 AS passing FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'toxic', lang, CASE WHEN toxic = 1 THEN 1.0 END, CASE WHEN toxic = 1 THEN true END FROM labels JOIN documents USING (doc_id))"""


def _results(spark, sf):
    own = _t(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    one = own.select(F.lit("quality").alias("evaluator"), "lang", F.col("quality").cast("double").alias("score"), (F.col("quality") == 1).alias("passing"))
    two = own.select(F.lit("toxic").alias("evaluator"), "lang", F.when(F.col("toxic") == 1, 1.0).alias("score"), F.when(F.col("toxic") == 1, True).alias("passing"))
    return one.unionByName(two)


def _summary_sql(where: str = "true") -> str:
    return f"SELECT evaluator, round(coalesce(avg(score), 0), 9) AS average_score, round(avg(coalesce(passing, false)::INT), 9) AS passing_rate, count(*) AS total_count FROM res WHERE {where} GROUP BY evaluator"


@query(f"WITH {_RESULTS} {_summary_sql()}")
def evaluation_summary(spark, sf):
    own = evaluation.summary(_results(spark, sf))
    return own.select("evaluator", F.round("average_score", 9).alias("average_score"), F.round("passing_rate", 9).alias("passing_rate"), "total_count")


@query(f"""WITH {_RESULTS}, a AS ({_summary_sql("lang = 'en'")}), b AS ({_summary_sql("lang <> 'en'")})
SELECT evaluator, round(b.average_score - a.average_score, 6) AS score_diff, round(b.passing_rate - a.passing_rate, 6) AS passing_rate_diff FROM a JOIN b USING (evaluator)""")
def evaluation_compare(spark, sf):
    own = _results(spark, sf)
    out = evaluation.compare(evaluation.summary(own.where("lang = 'en'")), evaluation.summary(own.where("lang <> 'en'")))
    return out.select("evaluator", F.round("score_diff", 6).alias("score_diff"), F.round("passing_rate_diff", 6).alias("passing_rate_diff"))


@query("""SELECT event_type, count(*) AS n_events, coalesce(sum(json_extract(props, '$.k')::BIGINT), 0)::BIGINT AS prompt_tokens, round(avg(value), 6) AS mean_duration FROM events GROUP BY event_type""")
def token_totals(spark, sf):
    own = _t(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.col("value").alias("duration"))
    return callbacks.token_totals(own).select("event_type", "n_events", "prompt_tokens", F.round("mean_duration", 6).alias("mean_duration"))


@query("SELECT user_id AS parent_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS children FROM events GROUP BY user_id")
def trace_tree(spark, sf):
    own = callbacks.trace_tree(_t(spark, sf, "events").select(F.col("user_id").alias("parent_id"), "event_id"))
    return own.select("parent_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf):
    own = incremental.windowed_counts(_t(spark, sf, "events"))
    return own.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
