"""Secret scans by a trigram inverted index, DataFrame operations only.

Each rule's regular expression gives a Boolean query over lower-cased trigrams that every match must contain. The
index has postings (trigram, row) for the trigrams that any rule asks for; the postings of each conjunction are
intersected, and only rows that remain are verified with the expression. A rule without mandatory trigrams is
verified on all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import cut, few, let, running, whole_text

#: Strings that a finite part of an expression may spell before it is cut into trigrams.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)


def _finite(items) -> set[str] | None:
    """All strings that the items can spell, lower-cased, or None if they are many or unbounded."""
    out = {""}
    for item in items:
        if (own := _spelt(item)) is None:
            return None
        out = {a + b for a in out for b in own}
        if len(out) > MOST_STRINGS:
            return None
    return out


def _spelt(item) -> set[str] | None:
    kind, value = item
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        if all(k is sre.LITERAL for k, _ in value) and len(value) <= 4:
            return {chr(v).lower() for _, v in value}
        return None
    if kind is sre.SUBPATTERN:
        return _finite(value[3])
    if kind is sre.BRANCH:
        parts = [_finite(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        own = _finite(inner)
        if own is None or high is sre.MAXREPEAT or high > 4:
            return None
        out, step = set(), {""}
        for n in range(high + 1):
            if n >= low:
                out |= step
            step = {a + b for a in step for b in own}
            if len(step) > MOST_STRINGS:
                return None
        return out
    return {""} if kind is sre.AT else None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    return _least({x | y for x in a for y in b})


def _least(query: set[frozenset]) -> set[frozenset]:
    """Without conjunctions that another one makes needless."""
    return {x for x in query if not any(y < x for y in query)}


def _query(items) -> set[frozenset]:
    """Conjunctions of trigrams of which every match contains one, in full."""
    out: set[frozenset] = {frozenset()}
    spelt = {""}
    for item in [*items, None]:
        own = None if item is None else _spelt(item)
        grown = None if own is None else {a + b for a in spelt for b in own}
        if grown is not None and len(grown) <= MOST_STRINGS:
            spelt = grown
            continue
        out = _both(out, _least({_trigrams(x) for x in spelt}))
        spelt = {""} if own is None else own
        if item is not None and own is None:
            kind, value = item
            if kind is sre.SUBPATTERN:
                out = _both(out, _query(value[3]))
            elif kind is sre.BRANCH:
                out = _both(out, _least(set().union(*(_query(x) for x in value[1]))))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                out = _both(out, _query(value[2]))
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern's Boolean query in disjunctive form; empty if it has no mandatory trigrams."""
    found = _query(list(sre.parse(pattern)))
    return [] if frozenset() in found else sorted(found, key=sorted)


def postings(docs: DataFrame, key: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, row_key): which rows contain each trigram that a rule asks for."""
    asked = sorted(set().union(*(c for r in rules for c in trigram_query(r.pattern)), set()))
    wanted = F.array(*[F.lit(x) for x in asked]).cast("array<string>")
    return docs.select(key.alias("row_key"), F.lower(whole_text()).alias("folded")).select(
        F.explode(F.filter(wanted, lambda t: F.contains(F.col("folded"), t))).alias("trigram"), "row_key"
    )


def candidates(docs: DataFrame, key: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, kinds): the rows that a rule's query leaves, and for which kinds."""
    terms = [
        (t, r.kind, n, len(c)) for r in rules for n, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)
    ]
    table = docs.sparkSession.createDataFrame(terms, "trigram string, kind string, part int, needed int")
    hits = postings(docs, key, rules).join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    whole = (
        hits.groupBy("row_key", "kind", "part", "needed")
        .agg(F.collect_set("trigram").alias("held"))
        .where(F.size("held") == F.col("needed"))
    )
    return whole.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start:int,place:int,end:int>>"


def _spans(text: Column, rule: Rule, place: int, size: Callable[[Column], Column]) -> Column:
    """Array of (start, place, end) of the rule's matches that are long enough, as `size` counts.

    What split() leaves between the matches gives their starts, by a running sum.
    """
    pattern = F.lit(rule.pattern)

    def found(hits):
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(gaps, hits, lambda gap, hit: size(gap) + size(hit))
        spans = lambda ends: F.zip_with(
            ends, hits, lambda end, hit: F.struct((end - size(hit)).alias("start"), F.lit(place).alias("place"), end.alias("end"))
        )
        long = lambda values: F.filter(
            let(running(steps, lambda x, y: x + y, F.lit(0)), spans), lambda _, i: F.length(F.get(values, i)) >= rule.least
        )
        return let(F.regexp_extract_all(text, pattern, F.lit(rule.group)), long)

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.rlike(text, pattern), let(hits, found)).otherwise(F.array().cast(SPANS))


def _written(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(
        ":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def with_spans(
    docs: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA, size: Callable[[Column], Column] = F.length
) -> DataFrame:
    """All columns of `docs` and secret_spans: the matches of all rules as (start, place of the rule, end).

    Places are code points, or what else `size` counts (F.octet_length: bytes). Rows are told apart by doc_id (by their
    text where it is null); rows that share one are verified each. The candidates of the index are broadcast if they are
    few, so that no text is shuffled; else texts are joined with them.
    """
    rules = base + extra
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    kept = cut(candidates(docs, key, indexed).withColumnsRenamed({"row_key": "__secret_key", "kinds": "__secret_kinds"}))
    text = whole_text()
    found = F.concat(
        *[
            _spans(text, r, i, size)
            if r not in indexed
            else F.when(F.array_contains("__secret_kinds", r.kind), _spans(text, r, i, size)).otherwise(F.array().cast(SPANS))
            for i, r in enumerate(rules)
        ]
    )
    return (
        docs.withColumn("__secret_key", key)
        .join(few(kept), "__secret_key", "left")
        .select(*[docs[c] for c in docs.columns], found.alias("secret_spans"))
    )


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 and spans of every row.

    base_sha256 digests the base rules' spans, spans lists those of all rules. Spans of one rule never overlap. A null
    or empty text has none (the digest is then that of the empty string); a very long text costs hardly more than its
    length, however many matches it has; repeated rows are scanned each; an empty table gives no rows; extra columns are
    ignored.
    """
    kinds = [r.kind for r in base + extra]
    rows = with_spans(docs.select("doc_id", "text"), base, extra)
    spans = F.col("secret_spans")
    of_base = F.filter(spans, lambda s: s["place"] < len(base))

    def count(place):
        return F.size(F.filter(spans, lambda s: s["place"] == place)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_written(of_base, kinds).cast("binary"), 256).alias("base_sha256"),
        _written(spans, kinds).alias("spans"),
    )


def redact(docs: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """The rows of `docs`, unchanged in columns, with every found secret in text replaced by [kind].

    Overlapping spans are replaced together, by the name of the first. Texts without a secret, null and empty ones
    included, stay as they are, repeated rows are redacted each, and an empty table stays empty.
    """
    names = F.array(*[F.lit(f"[{r.kind}]") for r in base + extra])
    rows = with_spans(docs, base, extra, F.octet_length)
    raw = F.col("text").cast("binary")
    piece = lambda start, end: F.substring(raw, start + 1, end - start).cast("string")

    def groups(spans):
        """(start, place of the first, end) of spans that overlap one another, in order."""

        def of(reach):
            heads = F.filter(
                F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1))
            )
            own = lambda h: F.transform(
                h,
                lambda b, j: F.struct(
                    F.get(spans, b)["start"].alias("start"),
                    F.get(spans, b)["place"].alias("place"),
                    F.get(reach, F.coalesce(F.get(h, j + 1), F.size(spans)) - 1).alias("end"),
                ),
            )
            return let(heads, own)

        return let(running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0)), of)

    def clean(found):
        put = F.transform(
            found,
            lambda g, i: F.concat(piece(F.coalesce(F.get(found, i - 1)["end"], F.lit(0)), g["start"]), F.get(names, g["place"])),
        )
        last = F.get(found, F.size(found) - 1)["end"]
        return F.concat(F.array_join(put, ""), piece(last, F.octet_length("text")))

    new = let(let(F.sort_array("secret_spans"), groups), clean)
    return rows.withColumn("text", F.when(F.size("secret_spans") > 0, new).otherwise(F.col("text"))).select(*docs.columns)


def python_spans(text: str | None, rules: tuple[Rule, ...] = BASE) -> list[tuple[int, int, int]]:
    """The same spans by scanning; for tests."""
    return sorted(
        (m.start(), i, m.end())
        for i, r in enumerate(rules)
        for m in re.finditer(r.pattern, text or "")
        if len(m.group(r.group)) >= r.least
    )
