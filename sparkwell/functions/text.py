"""Content rendering, hashes, prompts and small text operations. Lengths are bytes; cuts fall between characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, f"{WHITE}+", -1), lambda w: w != "")


def head_bytes(text: Column, n: int, more: str = "") -> Column:
    """At most n bytes of the text, whole characters only, with `more` after a cut."""
    # the characters that end within n bytes: n characters are enough to look at
    head = F.substring(text, 1, n)
    size = F.octet_length(head)
    chars = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda s, c: F.when(
            s["bytes"] + F.octet_length(c) <= n,
            F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), (s["chars"] + 1).alias("chars")),
        ).otherwise(F.struct(F.lit(n + 1).alias("bytes"), s["chars"].alias("chars"))),
    )["chars"]
    cut = F.when(size <= n, head).otherwise(F.substring(head, F.lit(1), chars))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(cut, F.lit(more)))


def metadata_text(metadata: Column, excluded: Column | None = None, template: str = "{key}: {value}", separator: str = "\n") -> Column:
    """Keys in order, without the excluded ones, each by the template."""
    keys = F.array_sort(F.map_keys(metadata))
    if excluded is not None:
        keys = F.filter(keys, lambda k: ~F.coalesce(F.array_contains(excluded, k), F.lit(False)))
    value = lambda k: F.coalesce(F.element_at(metadata, k), F.lit(""))
    one = lambda k: format_prompt(template, {"key": k, "value": value(k)})
    return F.coalesce(F.array_join(F.transform(keys, one), separator), F.lit(""))


def content(text: Column, metadata: Column, mode: str = "all", excluded_embed: Column | None = None, excluded_llm: Column | None = None) -> Column:
    """A node's content: the text alone (none), or after its metadata without what the mode excludes."""
    if mode == "none":
        return text
    excluded = {"all": None, "embed": excluded_embed, "llm": excluded_llm}[mode]
    meta = metadata_text(metadata, excluded)
    return F.when(meta == "", text).otherwise(trimmed(F.concat(meta, F.lit("\n\n"), text)))


def _code_point(n: Column) -> Column:
    """The character with this number as UTF-8 bytes; numbers that are no character give the replacement character."""
    valid = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    own = F.when(valid, n).otherwise(F.lit(0xFFFD)).cast("long")
    return F.encode(F.decode(F.unhex(F.lpad(F.hex(own), 8, "0")), "UTF-32"), "UTF-8")


def node_hash(text: Column, metadata: Column, node_type: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Digest of the type, the content and, where both are given, the offsets, each written as the character of that number."""
    head = F.concat(F.lit("type="), node_type).cast("binary")
    body = content(text, metadata).cast("binary")
    if start is None or end is None:
        return F.sha2(F.concat(head, body), 256)
    place = F.concat(F.lit("startCharIdx=").cast("binary"), _code_point(start), F.lit(" endCharIdx=").cast("binary"), _code_point(end))
    return F.sha2(F.concat(head, F.when(start.isNotNull() & end.isNotNull(), place).otherwise(F.lit("").cast("binary")), body), 256)


def document_hash(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(doc_id.cast("string"), text).cast("binary"), 256)


def joined_hash(*parts: Column) -> Column:
    """Digest of the parts with - between them; missing and empty ones read None."""
    return F.sha2(F.concat_ws("-", *[F.coalesce(F.nullif(p, F.lit("")), F.lit("None")) for p in parts]).cast("binary"), 256)


def format_prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} replaced once by each value; unknown names stay, values are not expanded again."""
    parts = re.split(r"\{(\w+)\}", template)
    out = [F.lit(parts[0])]
    for name, text in zip(parts[1::2], parts[2::2], strict=True):
        out += [values[name].cast("string") if name in values else F.lit("{" + name + "}"), F.lit(text)]
    return F.concat(*out)


def numbered(items: Column, most: int | None = None) -> Column:
    """(1) first ... of an array of strings, each cut to so many bytes."""
    one = lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), head_bytes(x, most) if most else x)
    return F.array_join(F.transform(items, one), "\n")


def citation(doc_id: Column, text: Column, n: int = 100) -> Column:
    return F.concat(F.lit("> Source (Doc id: "), doc_id.cast("string"), F.lit("): "), head_bytes(text, n, "..."))


# fixed values: words that compression leaves out
COMPRESSED_AWAY = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could"
    " should may might must shall can need this that these those i you he she it we they what which who whom when where why how"
    " all each every both few more most other some such no nor not only own same so than too very just also now here there"
).split()


def compressed(text: Column, stop_words: bool = False, most: int | None = None) -> Column:
    """White space collapsed, optionally without stop words, cut at a sentence's end past the middle or else a word's."""
    words = fields(text)
    if stop_words:
        words = F.filter(words, lambda w: ~F.lower(w).isin(COMPRESSED_AWAY))
    joined = F.array_join(words, " ")
    if most is None:
        return joined
    head = head_bytes(joined, most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    space = F.length(head) - F.instr(F.reverse(head), " ")
    # the last full stop's offset in bytes decides
    to_stop = F.substring(head, F.lit(1), stop)
    at_stop = F.when((F.instr(head, ".") > 0) & (F.octet_length(to_stop) - 1 > most // 2), to_stop)
    at_space = F.when(F.instr(head, " ") > 0, F.concat(F.substring(head, F.lit(1), space), F.lit("...")))
    return F.when(F.octet_length(joined) <= most, joined).otherwise(F.coalesce(at_stop, at_space, head))
