"""Keyword extraction, the keyword table and its probe; BM25 weights and scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.arrays import runs
from sparkwell.operators.common import numbered, small_side, top_k

# fixed values: words that are no keywords
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall to of in for"
    " on with at by from as into through during before after above below between under again and but or nor so yet both either"
    " neither not only own same than too very just also this that these those i me my myself we our ours ourselves you your"
    " yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what"
    " which who whom whose when where why how"
).split()
PUNCTUATION = ".,!?;:\"'()[]{}#@$%^&*-_=+<>/\\|`~"
# fixed values: words that BM25 leaves out
BM25_STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could"
    " should may might must shall can need this that these those i you he she it we they what which who whom when where why how"
    " all each every both few more most other some such no nor not only own same so than too very just also now"
).split()


#: Asked terms up to which their document frequencies go through the driver.
FEW_TERMS = 100_000


def words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word) of every keyword occurrence: lower-cased, without punctuation around it, three bytes or more."""
    own = df.select(key, F.explode(F.split(F.lower(text), r"\s+", -1)).alias("w"))
    return own.select(key, F.btrim("w", F.lit(PUNCTUATION)).alias("word")).where(
        (F.octet_length("word") >= 3) & ~F.col("word").isin(STOP_WORDS)
    )


def extract_keywords(df: DataFrame, key: str, most: int = 10, text: str = "text") -> DataFrame:
    """(key, word, n, rank): each text's most frequent keywords; ties in the order of the words.

    A text's words are sorted and counted in its own row, without a shuffle.
    """
    trimmed = F.transform(F.split(F.lower(text), r"\s+", -1), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    own = F.filter(trimmed, lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOP_WORDS))
    counted = runs(F.sort_array(own), lambda x, y: x != y, lambda a, i, n: F.struct((-n).alias("n"), F.get(a, i).alias("word")))
    best = F.slice(F.sort_array(counted), 1, most)
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(best).alias("rank", "w"))
    return rows.select(key, "w.word", (-F.col("w.n")).cast("long").alias("n"), (F.col("rank") + 1).alias("rank"))


def keyword_table(nodes: DataFrame, key: str = "node_id", most: int = 10) -> DataFrame:
    """(keyword, node): the inverted table in long form."""
    return extract_keywords(nodes, key, most).select(F.col("word").alias("keyword"), key)


def insert(table: DataFrame, nodes: DataFrame, key: str = "node_id", most: int = 10) -> DataFrame:
    """The table with more nodes; a node that it has already gets its new keywords."""
    return delete(table, nodes, key).unionByName(keyword_table(nodes, key, most))


def delete(table: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """The table without the nodes."""
    return table.join(nodes.select(key).distinct(), key, "left_anti")


def probe(table: DataFrame, queries: DataFrame, k: int = 10, key: str = "node_id", most: int = 10) -> DataFrame:
    """(query_id, node, score, rank): matched keywords over the query's keywords, the best k."""
    asked = extract_keywords(queries, "query_id", most, "query_str").select("query_id", F.col("word").alias("keyword"))
    n = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_keywords"))
    hits = asked.join(table, "keyword").groupBy("query_id", key).agg(F.countDistinct("keyword").alias("matched"))
    scored = hits.join(n, "query_id").select("query_id", key, (F.col("matched") / F.col("n_keywords")).alias("score"))
    return top_k(scored, k, F.col("score"), key)


def bm25_tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term) of every term occurrence: lower-cased, ASCII word characters, without stop words."""
    own = df.select(key, F.explode(F.split(F.lower(text), r"\W+", -1)).alias("term"))
    return own.where((F.col("term") != "") & ~F.col("term").isin(BM25_STOP_WORDS))


def bm25_fit(tf: DataFrame, key: str, n_docs: int) -> DataFrame:
    """(term, df, idf) from term frequencies, one row for each key and term."""
    df = tf.groupBy("term").agg(F.count(key).alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25_words(text: str, tokenize: Callable[[Column], Column] | None = None) -> Column:
    """A text's terms as an array: by default lower-cased, ASCII word characters, without stop words."""
    if tokenize is not None:
        return tokenize(F.col(text))
    parts = F.split(F.lower(text), r"\W+", -1)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(BM25_STOP_WORDS))


def bm25_weights(
    docs: DataFrame,
    key: str = "doc_id",
    k1: float = 1.5,
    b: float = 0.75,
    delta: float = 0.0,
    only: DataFrame | None = None,
    tokenize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(key, term, weight, idf): idf * tf(k1+1) / (tf + k1(1 - b + b dl/avgdl)), plus idf * delta for BM25+.

    Lengths count the terms that remain after stop words; documents without any term count in the mean. With `only`
    (term), weights of these terms alone: other terms leave before they are counted or shuffled.
    """
    own = docs.select(key, bm25_words("text", tokenize).alias("__t"))
    terms = own.select(key, F.coalesce(F.size("__t"), F.lit(0)).alias("dl"), F.explode_outer("__t").alias("term"))
    terms = terms.where(F.col("term").isNotNull())  # a plain explode would ask for the array's size first, and so split twice
    asked = None if only is None else only.select("term").distinct()
    if asked is not None and asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        # one pass for the few terms' document frequencies, and for the lengths, which stand under the empty term
        every = F.concat(F.array(F.lit("")), F.coalesce(F.array_distinct("__t"), F.array().cast("array<string>")))
        once = own.select(F.size("__t").alias("dl"), F.explode(every).alias("term"))
        once = once.join(F.broadcast(asked.union(docs.sparkSession.createDataFrame([("",)], "term string"))), "term", "left_semi")
        found = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("s")).collect()
        n, total = next(((r.df, r.s or 0) for r in found if r.term == ""), (0, 0))
        rows = [(r.term, math.log((n - r.df + 0.5) / (r.df + 0.5) + 1)) for r in found if r.term != ""]
        idf = F.broadcast(docs.sparkSession.createDataFrame(rows, "term string, idf double"))
        terms = terms.join(F.broadcast(asked), "term", "left_semi")
    else:
        n, total = own.agg(F.count(F.lit(1)), F.sum(F.size("__t"))).first()
        terms = terms if asked is None else terms.join(asked, "term", "left_semi")
        idf = None
    mean = (total or 0) / n if n else 0.0
    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    idf = bm25_fit(tf, key, n) if idf is None else idf
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * (F.col("dl") / F.lit(float(mean)))))
    return tf.join(idf, "term").select(key, "term", (F.col("idf") * (norm + delta)).alias("weight"), "idf")


def bm25_search(weights: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query_weight: str = "idf") -> DataFrame:
    """(query_id, key, score, rank): sum over a query's distinct known terms of its weight (idf or 1) times the document's."""
    asked = bm25_tokens(queries, "query_id", "query_str").distinct()
    hits = weights.join(small_side(asked, 1_000_000), "term")
    by = F.col("weight") * (F.col("idf") if query_weight == "idf" else F.lit(1.0))
    scored = hits.groupBy("query_id", key).agg(F.sum(by).alias("score")).where("score > 0")
    return top_k(scored, k, F.round("score", 9), key)


def bm25_embedding(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, indices, values, dimension): sparse vectors with terms numbered in their order."""
    terms = numbered(weights.select("term").distinct(), "term", "index").withColumn("index", F.col("index").cast("int"))
    n = terms.count()
    pairs = weights.join(terms, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("p"))
    return pairs.select(
        key,
        F.transform("p", lambda p: p["index"]).alias("indices"),
        F.transform("p", lambda p: p["weight"]).alias("values"),
        F.lit(n).alias("dimension"),
    )
