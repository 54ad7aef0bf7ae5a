"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, DataFrame operations only.

A paragraph is a line, cut further at sentence ends and word boundaries that the letters next to them choose: whether a cut
falls depends on three characters only, so an edit changes the paragraphs that it touches and no others, and a text of one
line has several.

A paragraph's digest is added to one cell in each of three parts of a sketch: the cell counts its digests and keeps their
exclusive or; the low bits of a digest check its high ones. The difference of two sketches, cell by cell, holds only the
digests that one text has and the other has not. Peeling takes a digest from each cell that holds just one, removes it from
its other cells, and goes on; if cells remain in the end, a larger sketch of both texts is tried.

A fingerprint has as many cells as its text asks for, a power of two a part, and folds to any smaller power of two, so
two fingerprints of different sizes subtract too. Empty cells are neither kept nor written. All steps are sorts and
passes over the cells, so the work is close to linear in a text's paragraphs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwell.llm.common import let, runs, whole_text

#: Parts of a sketch; a digest's cell is read at other bits for each (beyond 2^14 cells these overlap a little).
PARTS = 3
CELLS = "array<struct<at:int,n:int,k:bigint>>"
#: Least cells of a part, and digests for each cell of a part in a fingerprint.
LEAST, LOAD = 8, 2
#: Least digests from which the size of a difference is guessed.
GUESS = 16
#: How many sizes of sketches are tried; then the digests themselves are compared.
TRIES = 4
#: Where a text is cut into paragraphs.
CUTS = r"[\n。！？]| (?=(?<=[.!?] )[A-F]|(?<=n )[a-h])"
#: Turns of the parts in peeling.
TURNS = 90
#: Low bits of a digest that check the others.
CHECK = 20


def _checked(hashed: Column) -> Column:
    """A hash whose low CHECK bits are a hash of the others."""
    high = F.shiftleft(F.shiftrightunsigned(hashed, CHECK), CHECK)
    return high.bitwiseOR(_check(high))


def _check(high: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(high), 64 - CHECK)


def digests(text: Column) -> Column:
    """Ascending digests of the text's non-blank paragraphs; the n-th copy of a paragraph has its own digest."""
    own = F.transform(F.filter(F.split(text, CUTS, -1), lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p))
    copies = lambda a, b, n: F.transform(F.slice(a, b + 1, n), lambda d, i: _checked(F.xxhash64(d, i)))
    numbered = F.flatten(runs(F.sort_array(own), lambda x, y: x != y, copies))
    return F.sort_array(F.coalesce(numbered, F.array().cast("array<bigint>")))


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def width(n: Column) -> Column:
    """The least power of two that is at least n, and LEAST."""
    cells = F.greatest(n.cast("double"), F.lit(float(LEAST)))
    return _shifted(F.lit(1).cast("long"), F.ceil(F.log2(cells)).cast("int"))


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _cell(key: Column, part: Column | int, wide: Column) -> Column:
    bits = F.lit(part) * 14 + CHECK if isinstance(part, int) else part * 14 + CHECK
    return F.call_function("shiftrightunsigned", key, bits).bitwiseAND(wide - 1).cast("int")


def gathered(cells: Column) -> Column:
    """Contents (at, n, k) of the same cell added up, in order of the cells; empty cells go."""

    def added(run):
        return F.struct(
            F.get(run, 0)["at"].alias("at"),
            F.aggregate(run, F.lit(0), lambda s, x: s + x["n"]).alias("n"),
            F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x["k"])).alias("k"),
        )

    body = lambda a, b, n: F.when(n == 1, F.get(a, b)).otherwise(let(F.slice(a, b + 1, n), added))
    whole = runs(F.sort_array(cells), lambda x, y: x["at"] != y["at"], body)
    return F.coalesce(F.filter(whole, lambda x: (x["n"] != 0) | (x["k"] != 0)), F.array().cast(CELLS))


def spread(keys: Column, part: int, wide: Column, n: int = 1) -> Column:
    """What n of each key add to the cells of a part."""
    one = lambda k: F.struct(_cell(k, part, wide).alias("at"), F.lit(n).alias("n"), k.alias("k"))
    return F.transform(keys, one)


def sketch(keys: Column, wide: Column) -> Column:
    """For each part the occupied ones (at, n, k) of its `wide` cells, in order, when each key is added to one of them."""
    return F.array(*[gathered(spread(keys, p, wide)) for p in range(PARTS)])


def folded(cells: Column, wide: Column, sign: int = 1) -> Column:
    """Contents of a part's cells as they stand in a sketch with `wide` cells a part, a smaller power of two."""
    one = lambda x: F.struct(x["at"].bitwiseAND(wide.cast("int") - 1).alias("at"), (x["n"] * sign).alias("n"), x["k"])
    return F.transform(cells, one)


def peeled(difference: list[Column], wide: Column) -> Column:
    """How many digests the parts of a difference of sketches hold, by peeling; null if that gets stuck.

    Parts take turns: the digests that stand alone in a cell of one leave it and their cells of the others.
    """

    def single(x):
        high = F.shiftleft(F.shiftrightunsigned(x["k"], CHECK), CHECK)
        return (F.abs(x["n"]) == 1) & (x["k"].bitwiseAND(F.lit((1 << CHECK) - 1)) == _check(high))

    def step(held, turn):
        def without(cells, pure, later):
            part = (turn + later) % PARTS
            gone = lambda x: F.struct(_cell(x["k"], part, wide).alias("at"), (-x["n"]).alias("n"), x["k"])
            return F.when(F.size(cells) > 0, gathered(F.concat(cells, F.transform(pure, gone)))).otherwise(cells)

        def taken(pure):
            return F.when(
                F.size(pure) > 0,
                F.struct(
                    without(held["b"], pure, 1).alias("a"),
                    without(held["c"], pure, 2).alias("b"),
                    F.filter(held["a"], lambda x: ~single(x)).alias("c"),
                    (held["found"] + F.size(pure)).alias("found"),
                    F.lit(0).alias("idle"),
                ),
            ).otherwise(
                F.struct(
                    held["b"].alias("a"), held["c"].alias("b"), held["a"].alias("c"), held["found"], (held["idle"] + 1).alias("idle")
                )
            )

        return F.when(held["idle"] < PARTS, let(F.filter(held["a"], single), taken)).otherwise(held)

    start = F.struct(*[x.alias(n) for x, n in zip(difference, "abc", strict=True)], F.lit(0).alias("found"), F.lit(0).alias("idle"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), start, step)
    clear = lambda s: (F.size(s["a"]) == 0) & (F.size(s["b"]) == 0) & (F.size(s["c"]) == 0)
    return let(end, lambda s: F.when(clear(s), s["found"]))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`df` with the Jaccard likeness of two texts, of which it has <name>_keys, _wide and _cells; 1 if both have no paragraph.

    How many digests differ is guessed from their least ones. The fingerprints are subtracted, folded to the size that
    asks for, if they have it. Otherwise, or if they can't be peeled, larger sketches of both texts are, four times as large
    each time.
    """
    x, y = F.col(f"{a}_keys"), F.col(f"{b}_keys")
    both = F.size(x) + F.size(y)
    low = lambda keys: F.slice(keys, 1, GUESS)
    common = F.size(F.array_intersect(low(x), low(y))) / F.least(F.lit(GUESS), F.greatest(F.size(x), F.size(y), F.lit(1)))
    kept = F.least(f"{a}_wide", f"{b}_wide")

    def start(guess):
        return F.when(guess <= LOAD * kept, F.least(width(guess), kept)).otherwise(width(guess))

    def attempt(wide):
        def part(p):
            stored = [folded(F.get(f"{z}_cells", F.lit(p)), wide, n) for z, n in ((a, 1), (b, -1))]
            made = [spread(F.col(f"{z}_keys"), p, wide, n) for z, n in ((a, 1), (b, -1))]
            return gathered(F.when(wide <= kept, F.concat(*stored)).otherwise(F.concat(*made)))

        return peeled([part(p) for p in range(PARTS)], wide)

    def retry(found, i):
        wide = lambda first: _shifted(first, F.lit(2) * i)
        return F.when(found.isNotNull(), found).otherwise(let(wide(F.col(f"__{name}_start")), attempt))

    df = df.withColumn(f"__{name}_start", let(both * (1 - common), start))
    tried = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.when(x == y, F.lit(0)), retry)
    exact = F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    df = df.withColumn(f"__{name}", F.coalesce(tried, exact))
    ratio = F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(f"__{name}")) / (both + F.col(f"__{name}")))
    return df.withColumn(name, ratio.cast("double")).drop(f"__{name}", f"__{name}_start")


def written(cells: Column, wide: Column) -> Column:
    """A sketch as text: its cells a part, then each part's occupied cells in base64, all with place, count (16 bits) and digests."""
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    one = lambda c: F.concat(
        hexed(c["at"].cast("long"), 8), hexed(c["n"].cast("long").bitwiseAND(F.lit(65535)), 4), hexed(c["k"], 16)
    )
    packed = F.transform(
        cells, lambda part: F.replace(F.base64(F.unhex(F.array_join(F.transform(part, one), ""))), F.lit("\r\n"), F.lit(""))
    )
    return F.concat_ws(":", wide.cast("string"), F.array_join(packed, ":"))


def with_next(docs: DataFrame, computed: dict[str, Column], parts_per_partition: int = 4) -> DataFrame:
    """doc_id, text and what `computed` gives of a row, and as next_<name> the same of the next document (and next_text).

    The next document is the one of the next lower doc_id; after the last one comes the first.

    Rows of one doc_id stand in order of a hash of their texts; rows without doc_id come last. Ranges of (doc_id, hash)
    make the order distributed: doc_ids are cut at approximate quantiles, and a doc_id that several quantiles fall on is
    cut by the hash. The first document of each range also goes to the range before it. The driver gets a few numbers
    for each range, whose number depends on the shuffle partitions only. Rows equal in doc_id and text share a range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", whole_text().alias("text"), key.alias("key"))
    rows = rows.withColumn("spot", F.struct("key", F.xxhash64("text").alias("hash")))
    n = parts_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = [i / n for i in range(1, n)]
    often = Counter(rows.agg(F.percentile_approx("key", asked, 10_000)).first()[0] or [])
    # the k-th of m cuts of one doc_id: an m-th of all hashes on each side
    cuts = [(x, (k << 64) // m - (1 << 63)) for x, m in sorted(often.items()) for k in range(m)]
    step = max(1, int(len(cuts) ** 0.5))
    kind = "array<struct<key:bigint,hash:bigint>>"
    place = lambda x, h: F.struct(F.lit(x).cast("long").alias("key"), F.lit(h).cast("long").alias("hash"))
    bounds = lambda of: F.array(*[place(*x) for x in of]).cast(kind)
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col("spot")))
    rows = rows.withColumn("__block", below(bounds(cuts[step - 1 :: step])) * step)
    part = F.col("__block") + below(F.slice(bounds(cuts), F.col("__block") + 1, F.lit(step)))
    rows = rows.withColumn("part", part).drop("__block")
    heads = rows.groupBy("part", "key").agg(F.max("spot.hash").alias("hash")).groupBy("part")
    first = {r["part"]: r["head"] for r in heads.agg(F.max(F.struct("key", "hash")).alias("head")).collect()}
    held = sorted(first)
    names = ["text", *computed]
    if not held:
        for name, value in computed.items():
            rows = rows.withColumn(name, value)
        return rows.select("doc_id", *names, *[F.col(x).alias(f"next_{x}") for x in names])
    goes = {p: held[i + 1] if i + 1 < len(held) else held[0] for i, p in enumerate(held)}
    size = held[-1] + 1
    none = F.lit(None).cast("struct<key:bigint,hash:bigint>")
    head = F.array(*[place(*first[p]) if p in first else none for p in range(size)]).cast(kind)
    to = F.array(*[F.lit(goes.get(p)) for p in range(size)]).cast("array<int>")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(to, F.col("part")).alias("part"), F.lit(True).alias("guest"))
    seats = F.when(F.get(head, F.col("part")) == F.col("spot"), F.array(own, guest)).otherwise(F.array(own))
    seated = rows.withColumn("seat", F.explode(seats)).select("doc_id", "spot", "text", "seat.part", "seat.guest")
    seated = seated.repartition("part")
    for name, value in computed.items():
        seated = seated.withColumn(name, value)
    order = Window.partitionBy("part").orderBy("guest", F.col("spot").desc(), "text")
    after = [F.coalesce(F.lead(x).over(order), x).alias(f"next_{x}") for x in names]
    return seated.select("doc_id", "guest", *names, *after).where(~F.col("guest")).drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like the first is to the second and the next text's.

    The edited text has its last floor(n_chars/2) code points replaced by as many from the start of the next document.
    Null and empty texts have n_chars 0 and the fingerprint of no paragraph; a likeness of two such is 1. A text too short
    for a cut is one paragraph. Repeated rows follow one another in the order; an empty table gives no rows; extra columns
    are ignored. Whole texts are read; a fingerprint is as long as its text has paragraphs.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    sketched = {
        "keys": digests(F.col("text")),
        "wide": width(F.ceil(F.size("keys") / F.lit(LOAD))),
        "cells": sketch(F.col("keys"), F.col("wide")),
    }
    rows = with_next(docs, sketched).withColumnsRenamed({x: f"own_{x}" for x in sketched})
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("edited")).alias("edited_keys"),
        *[f"{x}_{y}" for x in ("own", "next") for y in sketched],
    )
    rows = rows.withColumn("edited_wide", width(F.ceil(F.size("edited_keys") / F.lit(LOAD))))
    rows = rows.withColumn("edited_cells", sketch(F.col("edited_keys"), F.col("edited_wide")))
    rows = likeness(rows, "own", "edited", "near_edited")
    rows = likeness(rows, "own", "next", "near_next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own_cells"), F.col("own_wide")).alias("fingerprint"),
        written(F.col("edited_cells"), F.col("edited_wide")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
