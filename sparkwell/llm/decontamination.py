"""Benchmark decontamination by template canonicalisation, DataFrame operations only.

Numbers, names and units become typed placeholders, so a question with other figures or names has the same template.
Windows of template tokens are hash-joined with those of the benchmark items; each aligned pair is then checked for
the slots: an item's value must stand for one and the same value of the document throughout. Windows in which it stands
for another value than in most places of the alignment don't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import FEW, cut, few, let, runs, whole_text

#: Template tokens of a window; a shorter item is its own window.
WINDOW = 8
#: Literal tokens that a window needs to say anything.
LITERAL = 4
#: Share of an item's tokens that consistent windows must cover.
COVER = 0.5
#: Windows of the benchmark that are broadcast at once (about 200 bytes each); more are asked in several passes.
BLOCK = 100_000
#: Tokens of a text whose windows are held at once.
STRETCH = 4096
# fixed values: units of measurement that may follow a number
UNITS = (
    "mm cm m km in inch inches ft feet yd yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw kwh v a j kj cal kcal percent dollars euros pounds cents degrees"
).split()
NUMBER, NAME, UNIT = "#", "@", "%"
# a word keeps the space before it if a lower-case letter or a comma stands there: then a capital is a name's
_TOKEN = r"(?:(?<=[\p{Ll},;]) )?\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,][0-9]+)*"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def template_tokens(raw: Column) -> Column:
    """The template of an array of raw tokens, token by token."""
    units = F.array(*[F.lit(u) for u in UNITS])
    digit = lambda t: (t >= "0") & (t < ":")

    def one(t, i):
        initial = F.substring(t, 2, 1)
        after_number = (i > 0) & F.coalesce(digit(F.get(raw, i - 1)), F.lit(False))
        return (
            F.when(digit(t), NUMBER)
            .when(after_number & F.array_contains(units, F.lower(F.ltrim(t))), UNIT)
            .when((t < "!") & (initial != F.lower(initial)), NAME)
            .when(t < "!", F.lower(F.substring(t, 2, 1 << 30)))
            .otherwise(F.lower(t))
        )

    return F.transform(raw, one)


#: What a window is compared by: its template, its very words, or (of a text that is nothing else) the whole of them.
TEMPLATE, WORDS, WHOLE = "template", "words", "whole"


def _words(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.lower(F.ltrim(t)))


def _hash(tokens: Column, at: Column, window: int, kind: str) -> Column:
    return F.xxhash64(F.lit(kind), *[F.get(tokens, at + j) for j in range(window)])


def _places(tokens: Column, window: int) -> Column:
    """Starts of all windows of an array of tokens; null if there is none."""
    last = F.size(tokens) - window
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def asked_windows(benchmark: DataFrame, window: int, literal: int) -> DataFrame:
    """(kind, window, hash, item_id, item_hash, item_at, item_tokens, slots) of each window by which an item is found.

    Windows of `window` template tokens with `literal` literal ones, or the whole template and the very words of a shorter
    item. Where an item has no such window, those of its very words; where it has fewer than `literal` tokens, a text that
    says nothing else. slots holds (place in the item, kind, value) of the window's placeholders.
    """
    rows = benchmark.select("item_id", raw_tokens(whole_text()).alias("raw"))
    rows = rows.select("item_id", "raw", template_tokens(F.col("raw")).alias("template"), F.size("raw").alias("item_tokens"))
    rows = rows.withColumn("window", F.least(F.lit(window), "item_tokens")).where("window > 0")
    last = F.col("item_tokens") - F.col("window")
    says = lambda i: F.size(
        F.filter(F.slice("template", i + 1, F.col("window")), lambda t: ~t.isin(NUMBER, NAME, UNIT))
    ) >= F.lit(literal)
    good = F.filter(F.sequence(F.lit(0), last), says)
    short = F.col("item_tokens") < window
    kinds = (
        F.when((F.size("good") > 0) & short, F.array(F.lit(TEMPLATE), F.lit(WORDS)))
        .when(F.size("good") > 0, F.array(F.lit(TEMPLATE)))
        .otherwise(F.array(F.when(F.col("item_tokens") >= literal, WORDS).otherwise(WHOLE)))
    )
    rows = rows.withColumn("good", good).withColumn("kind", F.explode(kinds))
    starts = F.when(F.col("kind") == TEMPLATE, F.col("good")).otherwise(F.sequence(F.lit(0), last))
    rows = rows.withColumn("item_at", F.explode(starts))
    tokens = {TEMPLATE: F.col("template"), WORDS: _words(F.col("raw")), WHOLE: _words(F.col("raw"))}
    found = F.coalesce(
        *[
            F.when((F.col("kind") == k) & (F.col("window") == w), _hash(x, F.col("item_at"), w, k))
            for k, x in tokens.items()
            for w in range(1, window + 1)
        ]
    )
    value = lambda i: F.struct(
        i.alias("place"), F.get("template", i).alias("kind"), F.ltrim(F.get("raw", i)).alias("asked")
    )
    inside = F.sequence(F.col("item_at"), F.col("item_at") + F.col("window") - 1)
    slots = F.transform(F.filter(inside, lambda i: F.get("template", i).isin(NUMBER, NAME, UNIT)), value)
    return rows.select(
        "kind",
        "window",
        found.alias("hash"),
        "item_id",
        F.xxhash64(_words(F.col("raw"))).alias("item_hash"),
        "item_at",
        "item_tokens",
        F.when(F.col("kind") == TEMPLATE, slots).otherwise(F.array().cast("array<struct<place:int,kind:string,asked:string>>")).alias("slots"),
    )


def held_windows(docs: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, text_hash, hash, at) of each window of the texts of the asked kinds and lengths.

    Texts are taken in stretches of STRETCH tokens, so a very long one needs little memory.
    """
    longest = max((w for k, w in kinds if k != WHOLE), default=1)
    rows = docs.select("doc_id", text_hash().alias("text_hash"), raw_tokens(whole_text()).alias("raw"))
    by_words = any(k != TEMPLATE for k, _ in kinds)
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.size("raw").alias("tokens"),
        template_tokens(F.col("raw")).alias("template"),
        *([_words(F.col("raw")).alias("words")] if by_words else []),
    )
    part = lambda x, b: F.slice(x, b + 1, F.lit(STRETCH + longest - 1)).alias(x)
    held = ["template", *(["words"] if by_words else [])]
    stretch = lambda b: F.struct(b.alias("base"), *[part(x, b) for x in held])
    bases = F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(STRETCH))
    stretches = F.when(F.col("tokens") > 0, F.transform(bases, stretch))
    rows = rows.select("doc_id", "text_hash", "tokens", F.explode(stretches).alias("s")).select("doc_id", "text_hash", "tokens", "s.*")

    def of(kind, window):
        tokens = F.col("template" if kind == TEMPLATE else "words")
        last = F.least(F.size(tokens) - window, F.lit(STRETCH - 1))  # those that begin in the next stretch are found there
        held = (last >= 0) & ((F.col("tokens") == window) if kind == WHOLE else F.lit(True))
        return F.when(held, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _hash(tokens, i, window, kind)))

    every = [of(k, w) for k, w in kinds]
    if len(every) > 1:
        rows = rows.select("doc_id", "text_hash", "base", F.explode(F.array(*every)).alias("hashes"))
    own = F.col("hashes") if len(every) > 1 else every[0]
    rows = rows.select("doc_id", "text_hash", "base", F.posexplode(own).alias("pos", "hash"))
    return rows.select("doc_id", "text_hash", "hash", (F.col("base") + F.col("pos")).alias("at"))


def text_hash() -> Column:
    return F.xxhash64(whole_text())


def _conforming(windows: Column) -> Column:
    """The windows of one alignment in which each value of the item stands for what it stands for in most places."""

    def values(of: Callable) -> Column:
        flat = F.flatten(F.transform(windows, lambda w: w["slots"]))
        return F.sort_array(F.transform(flat, of))

    by_place = values(lambda s: F.struct(s["kind"], s["asked"], s["held"], s["place"]))
    once = runs(by_place, lambda x, y: x != y, lambda a, b, n: F.get(a, b))
    same = lambda *names: lambda x, y: ~_all_equal(x, y, names)
    votes = runs(
        once,
        same("kind", "asked", "held"),
        lambda a, b, n: let(
            F.get(a, b),
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["asked"].alias("asked"),
                (-n).alias("votes"),
                (s["asked"] != s["held"]).alias("other"),
                s["held"].alias("held"),
            ),
        ),
    )
    key = lambda s: F.struct(s["kind"].alias("kind"), s["asked"].alias("asked"), s["held"].alias("held"))
    won = runs(F.sort_array(votes), same("kind", "asked"), lambda a, b, n: let(F.get(a, b), key))
    return let(
        won,
        lambda x: F.filter(
            windows, lambda w: F.coalesce(F.forall(w["slots"], lambda s: F.array_contains(x, key(s))), F.lit(True))
        ),
    )


def _all_equal(x: Column, y: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & (x[name] == y[name])
    return out


TEXT = ["doc_id", "text_hash"]


def _with_values(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits as (text, item, shift, w: item_at, window, slots with the values that the text has for them).

    The hits of a text, each once, go to its row, so its tokens are made once. Only texts with hits are read for that.
    """
    names = ["item_id", "item_hash", "item_tokens", "item_at", "window", "slots"]
    own = cut(hits.groupBy(*TEXT).agg(F.collect_set(F.struct("at", *names)).alias("hits")))
    keys = own.select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_text"))
    same = F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.col("text_hash") == F.col("__hit_text"))
    texts = docs.select("doc_id", text_hash().alias("text_hash"), whole_text().alias("text")).join(few(keys, FEW), same, "left_semi")
    texts = texts.select(*TEXT, raw_tokens(F.col("text")).alias("raw"))
    both = own.withColumnsRenamed({"doc_id": "__hit_id", "text_hash": "__hit_text"}).join(texts, same)

    def valued(h):
        shift = h["at"] - h["item_at"]
        value = lambda s: F.struct(
            s["place"], s["kind"], s["asked"], F.ltrim(F.get("raw", s["place"] + shift)).alias("held")
        )
        slots = F.transform(h["slots"], value).alias("slots")
        return F.struct(*[h[x] for x in names[:3]], shift.alias("shift"), F.struct(h["item_at"], h["window"], slots).alias("w"))

    return both.select(*TEXT, F.explode(F.transform("hits", valued)).alias("h")).select(*TEXT, "h.*")


def _text_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, literal: int = LITERAL
) -> DataFrame:
    """The rows of leaks() for each text: doc_id and text_hash together tell the texts of one doc_id or of none apart."""
    asked = asked_windows(benchmark, window, literal)
    kinds = asked.groupBy("kind", "window").count().collect()  # at most three kinds of `window` lengths
    passes = -(-sum(r["count"] for r in kinds) // BLOCK)
    wanted = sorted((r["kind"], r["window"]) for r in kinds) or [(TEMPLATE, window)]
    held = held_windows(docs, wanted)
    asked = asked.drop("kind")
    block = F.pmod(F.xxhash64("hash", "item_id", "item_at"), F.lit(max(1, passes)))
    hits = None
    for k in range(max(1, passes)):
        own = held.join(F.broadcast(asked.where(block == k) if passes > 1 else asked), "hash")
        hits = own if hits is None else hits.unionByName(own)
    hits = _with_values(hits, docs)
    text, item = TEXT, ["item_id", "item_hash", "item_tokens"]
    aligned = hits.groupBy(*text, *item, "shift").agg(F.collect_set("w").alias("windows"))
    kept = aligned.select(*text, *item, F.explode(_conforming(F.col("windows"))).alias("w"))
    places = kept.select(
        *text,
        *item,
        F.forall("w.slots", lambda s: s["asked"] == s["held"]).alias("same"),
        F.explode(F.sequence(F.col("w.item_at"), F.col("w.item_at") + F.col("w.window") - 1)).alias("place"),
    )
    covered = places.groupBy(*text, *item, "place").agg(F.min("same").alias("same"))
    found = covered.groupBy(*text, *item).agg(F.count(F.lit(1)).cast("int").alias("covered"), F.min("same").alias("same_slots"))
    found = found.where(F.col("covered") >= F.lit(cover) * F.col("item_tokens"))
    return found.select(*text, "item_id", "covered", "item_tokens", "same_slots")


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, literal: int = LITERAL
) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, same_slots) of each document and benchmark item that it contains.

    covered counts the item's tokens in windows whose template the document has at one alignment with consistent
    slots; a pair is returned if that is at least `cover` of the item's tokens. same_slots is false for a
    re-parameterised question. An item of fewer than `window` tokens is one window, compared by template and by its words; an item without a window of `literal`
    literal tokens is found by its very words, and one of fewer than `literal` tokens only in a text that says nothing
    else; an item without any token matches nothing. Null and empty texts contain nothing; repeated items and documents
    give one row for each doc_id and item_id; texts that share a doc_id, or have none, are judged each by itself, and the
    row of those that contain the item has the largest covered; very long texts are taken in stretches; empty tables give
    no rows; extra columns are ignored.

    The benchmark's windows are broadcast, BLOCK at a time. No text is shuffled, or where more than FEW have windows of the
    benchmark, only in order to verify these.
    """
    found = _text_leaks(docs, benchmark, window, cover, literal)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("covered").alias("covered"),
        F.max("item_tokens").alias("item_tokens"),
        F.min("same_slots").alias("same_slots"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose own text contains no benchmark item, unchanged in columns.

    Rows are told apart by doc_id and a hash of the text, so a clean row stays whatever shares its doc_id, or has none
    as it has. Null and empty texts stay, repeated rows stay or go together, empty tables stay empty.
    """
    found = _text_leaks(docs, benchmark, **options)
    found = cut(found.select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_text")).distinct())
    own = F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (text_hash() == F.col("__leak_text"))
    return docs.join(few(found, FEW), own, "left_anti")
