"""Texts to chunks: sentence, token, markdown and window splitters, and the nodes made of chunks.

Lengths are counted in words between white space unless a tokenizer is given. The splitters whose state runs through a
text are Arrow functions; windows, node links and offsets are native.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.functions.arrays import let, running
from sparkwell.operators.common import ordered_list, ranges

# fixed values
SENTENCE = r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]"
PARAGRAPH = "\n\n\n"

Tokenizer = Callable[[str], list]


def check_sizes(size: int, overlap: int) -> None:
    problems = []
    if size <= 0:
        problems.append(f"chunk size {size} must be positive")
    if overlap < 0:
        problems.append(f"chunk overlap {overlap} must not be negative")
    if overlap >= size > 0:
        problems.append(f"chunk overlap {overlap} must be less than chunk size {size}")
    if problems:
        raise ValueError("; ".join(problems))


def _keep_separator(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]


def split_sentences(
    text: str, size: int, overlap: int = 0, count: Callable[[str], int] | None = None, sentence: str | Callable[[str], list[str]] = SENTENCE
) -> list[str]:
    """Chunks of at most `size` tokens: by paragraphs, sentences, spaces, then characters, packed greedily.

    Sentences are matches of a pattern, or what a function (say, a trained splitter) makes of a text.
    """
    to_sentences = sentence if callable(sentence) else re.compile(sentence).findall
    count = count or (lambda t: len(t.split()))
    if not text:
        return [""]

    def ways(t):
        yield _keep_separator(t, PARAGRAPH)
        yield to_sentences(t)
        yield _keep_separator(t, " ")
        yield list(t)

    pieces: list[tuple[str, int]] = []
    todo = [text]
    while todo:
        t = todo.pop()
        n = count(t)
        if n <= size or len(t) == 1:
            pieces.append((t, n))
            continue
        parts = next((w for w in ways(t) if len(w) > 1), None)
        if parts is None:
            pieces.append((t, n))
        else:
            todo.extend(reversed(parts))

    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total, fresh = 0, True
    for t, n in pieces:
        if held and not fresh and total + n > size:
            chunks.append("".join(x for x, _ in held))
            tail, total = [], 0
            for piece in reversed(held):
                if total + piece[1] > overlap:
                    break
                tail.insert(0, piece)
                total += piece[1]
            held, fresh = tail, True
        held.append((t, n))
        total += n
        fresh = False
    if held and not fresh:
        chunks.append("".join(x for x, _ in held))
    return [c for c in map(str.strip, chunks) if c]


def split_tokens(text: str, size: int, overlap: int = 0, separator: str = " ", keep_separator: bool = False) -> list[str]:
    """Greedy packs of the parts between separators; a part over `size` words is cut between words."""
    parts = _keep_separator(text, separator) if keep_separator else [p for p in text.split(separator) if p]
    pieces: list[tuple[str, int]] = []
    for p in parts:
        words = p.split()
        if len(words) <= size:
            pieces.append((p, len(words)))
        else:
            pieces += [(" ".join(words[i : i + size]), len(words[i : i + size])) for i in range(0, len(words), size)]
    glue = "" if keep_separator else separator
    chunks, held, total = [], [], 0
    for p, n in pieces:
        if held and total + n > size:
            chunks.append(glue.join(x for x, _ in held))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((p, n))
        total += n
    if held:
        chunks.append(glue.join(x for x, _ in held))
    return chunks


_FENCE = re.compile(r"(?s)```[^`]*```")


def split_markdown(text: str, size: int) -> list[str]:
    """Fenced blocks whole (large ones cut by lines and fenced again), the rest by headers, paragraphs, lines, words."""
    count = lambda t: len(t.split())
    pieces: list[str] = []

    def prose(t: str) -> None:
        for section in re.split(r"(?m)^(?=#{1,6}\s)", t):
            if count(section) <= size:
                pieces.append(section)
                continue
            for paragraph in section.split("\n\n"):
                if count(paragraph) <= size:
                    pieces.append(paragraph + "\n\n")
                    continue
                for line in paragraph.split("\n"):
                    words = line.split()
                    pieces.extend(" ".join(words[i : i + size]) + "\n" for i in range(0, len(words), size))

    at = 0
    for m in _FENCE.finditer(text):
        prose(text[at : m.start()])
        block, at = m.group(), m.end()
        if count(block) <= size:
            pieces.append(block)
            continue
        first, *body = block[:-3].split("\n")
        held: list[str] = []
        for line in [*body, None]:
            if line is None or (held and count("\n".join([first, *held, line])) > size):
                pieces.append("\n".join([first, *held, "```\n"]))
                held = []
            if line is not None:
                held.append(line)
    prose(text[at:])
    chunks, held, total = [], [], 0
    for p in pieces:
        n = count(p)
        if held and total + n > size:
            chunks.append("".join(held).strip())
            held, total = [], 0
        held.append(p)
        total += n
    chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def _chunker(split: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t is not None else [])

    return run


def sentence_chunks(
    text: Column, size: int = 1024, overlap: int = 200, tokenizer: Tokenizer | None = None, sentence: str | Callable[[str], list[str]] = SENTENCE
) -> Column:
    check_sizes(size, overlap)
    count = (lambda t: len(tokenizer(t))) if tokenizer else None
    return _chunker(lambda t: split_sentences(t, size, overlap, count, sentence))(text)


def _with_room(size: int, overlap: int, split: Callable[[str, int, int], list[str]], least: int | None):
    """A splitter of (text, metadata text) that leaves room for the metadata's words in each chunk."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, metas: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, metas, strict=True):
            room = size - len((m or "").split())
            if least is not None and room < least:
                raise ValueError(f"metadata leaves {room} of {size} tokens for the text")
            room = max(room, 1)
            out.append(split(t, room, min(overlap, room - 1)) if t is not None else [])
        return pd.Series(out)

    return run


def sentence_chunks_with_metadata(text: Column, metadata: Column, size: int = 1024, overlap: int = 200, least: int = 50) -> Column:
    """As sentence_chunks, with room left in each chunk for the row's metadata text; fails if less than `least` remains."""
    check_sizes(size, overlap)
    return _with_room(size, overlap, split_sentences, least)(text, metadata)


def token_chunks_with_metadata(text: Column, metadata: Column, size: int = 1024, overlap: int = 20, separator: str = " ") -> Column:
    """As token_chunks, with room for the row's metadata text; one word a chunk at least."""
    check_sizes(size, overlap)
    return _with_room(size, overlap, lambda t, n, o: split_tokens(t, n, o, separator), None)(text, metadata)


def markdown_chunks_with_metadata(text: Column, metadata: Column, size: int = 1024) -> Column:
    """As markdown_chunks, with room for the row's metadata text; one word a chunk at least."""
    check_sizes(size, 0)
    return _with_room(size, 0, lambda t, n, _: split_markdown(t, n), None)(text, metadata)


def token_chunks(text: Column, size: int = 1024, overlap: int = 20, separator: str = " ") -> Column:
    check_sizes(size, overlap)
    return _chunker(lambda t: split_tokens(t, size, overlap, separator))(text)


def markdown_chunks(text: Column, size: int = 1024) -> Column:
    check_sizes(size, 0)
    return _chunker(lambda t: split_markdown(t, size))(text)


def word_chunks(text: Column, size: int) -> Column:
    """Consecutive runs of `size` words, without overlap, natively."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    n = F.ceil(F.size(words) / F.lit(size)).cast("int")
    run = lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " ")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), run)).otherwise(
        F.array().cast("array<string>")
    )


def sentences(text: Column, pattern: str = SENTENCE) -> Column:
    """All matches of the sentence pattern, trimmed, without empty ones."""
    # the default pattern matches what a cut after each of its marks leaves; cutting is faster where threads share a class
    found = F.split(text, "(?<=[,.;。？！])", -1) if pattern == SENTENCE else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def prose_sentences(text: Column) -> Column:
    """Sentences that end in . ! ? before white space and a capital, or at a blank line."""
    parts = F.split(text, r"(?<=[.!?])(?=\s+\p{Lu})|\n\n", -1)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentence_windows(docs: DataFrame, width: int = 3, pattern: str = SENTENCE) -> DataFrame:
    """One row for each sentence: original_sentence, sentence_index, and the window of +-width sentences around it.

    Windows are cut from the row's own array before it is written out, so nothing is shuffled or repeated.
    """

    def windows(found):
        def one(x, i):
            start, end = F.greatest(i - width, F.lit(0)), F.least(i + width, F.size(found) - 1)
            text = F.array_join(F.slice(found, start + 1, end - start + 1), " ")
            return F.struct(
                i.alias("sentence_index"), x.alias("original_sentence"), start.alias("window_start"), end.alias("window_end"), text.alias("window")
            )

        return F.transform(found, one)

    own = docs.select("doc_id", F.explode(let(sentences(F.col("text"), pattern), windows)).alias("w"))
    return own.select("doc_id", "w.*")


def nodes(docs: DataFrame, chunks: Column, metadata: Column | None = None) -> DataFrame:
    """The node table of the documents' chunks: ids, links, byte offsets that add up the chunks' lengths, and hashes.

    Links and offsets come from the row's own array, offsets by one running sum.
    """
    own = docs.withColumn("__c", chunks).withColumn("__m", metadata if metadata is not None else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")))
    ends = running(F.transform("__c", lambda c: F.octet_length(c)), lambda a, b: a + b, F.lit(0))
    pairs = F.arrays_zip(F.col("__c").alias("text"), ends.alias("end"))
    own = own.select("doc_id", "__m", F.size("__c").alias("__n"), F.posexplode(pairs).alias("chunk_index", "__p"))
    own = own.select("doc_id", "__m", "__n", "chunk_index", F.col("__p.text").alias("text"), F.col("__p.end").alias("__end"))
    doc = F.col("doc_id").cast("string")
    node = lambda i: F.concat(doc, F.lit("-chunk-"), i.cast("string"))
    i = F.col("chunk_index")
    return own.select(
        node(i).alias("node_id"),
        "doc_id",
        "text",
        F.lit("TEXT").alias("node_type"),
        F.map_concat(F.map_filter("__m", lambda k, v: ~k.isin("chunk_index", "chunk_count")), F.create_map(
            F.lit("chunk_index"), i.cast("string"), F.lit("chunk_count"), F.col("__n").cast("string"))).alias("metadata"),
        doc.alias("source_id"),
        F.when(i > 0, node(i - 1)).alias("prev_id"),
        F.when(i < F.col("__n") - 1, node(i + 1)).alias("next_id"),
        "chunk_index",
        F.col("__n").alias("chunk_count"),
        (F.col("__end") - F.octet_length("text")).alias("start_char"),
        F.col("__end").alias("end_char"),
        F.sha2(F.concat(F.lit("type=TEXT"), F.col("text")).cast("binary"), 256).alias("node_hash"),
    )


def document_nodes(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """One node for each document, linked to the documents with the next smaller and larger value of `order`.

    Rows that share a value share its links; a row without one has none. Values are linked inside ranges; the ranges'
    first and last values, a few on the driver, link these.
    """
    kind = docs.schema[order].dataType.simpleString()
    rows, n = ranges(docs.select(order).where(F.col(order).isNotNull()).distinct(), order)
    ends = {r["__part"]: r for r in rows.groupBy("__part").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).collect()}
    before, after, last = [], [None] * n, None
    for p in range(n):
        before.append(last)
        last = ends[p].hi if p in ends else last
    last = None
    for p in reversed(range(n)):
        after[p] = last
        last = ends[p].lo if p in ends else last
    w = Window.partitionBy("__part").orderBy(order)
    edge = lambda values: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("__part"))
    links = rows.select(
        F.col(order).alias("__o"),
        F.coalesce(F.lag(order).over(w), edge(before)).cast("string").alias("prev_id"),
        F.coalesce(F.lead(order).over(w), edge(after)).cast("string").alias("next_id"),
    )
    return docs.join(links, F.col(order) == F.col("__o"), "left").drop("__o").withColumn("node_id", F.col("doc_id").cast("string"))


def related(nodes: DataFrame, kind: str) -> DataFrame:
    """(node_id, related_id) of a node table's source, previous, next or parent relationship; nodes without one are left out."""
    column = {"source": "source_id", "previous": "prev_id", "next": "next_id", "parent": "parent_id"}[kind]
    return nodes.where(F.col(column).isNotNull()).select("node_id", F.col(column).alias("related_id"))


def children(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """(node_id, children): the ids of each parent's children, in order."""
    own = nodes.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("node_id"))
    return own.agg(ordered_list(F.col("node_id"), F.col(order)).alias("children"))
