"""Token counts by the whole-token shortcut: pre-tokens that are one token each are counted, only the rest is merged."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: scripts in which `regex` and the library class all characters alike; others are split by the library.
PLAIN = r"[\x00-\u0557\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens besides the whole tokens, and words, whose count a worker remembers, and the length of the longest such.
REMEMBERED, LONGEST = 600_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


def whole_tokens(definition: str) -> list[str]:
    """The vocabulary strings that are one pre-token and that the library itself encodes as one token.

    This is the proof made offline: every vocabulary entry is decoded, encoded alone and kept if that gives one id.
    Bounded by the vocabulary.
    """
    tokenizer = Tokenizer.from_str(definition)
    alphabet, one = byte_alphabet(), regex.compile(PRE_TOKEN)
    texts = []
    for entry in json.loads(definition)["model"]["vocab"]:
        try:
            text = bytes(alphabet[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if (m := one.match(text)) and m.end() == len(text):
            texts.append(text)
    coded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, coded, strict=True) if len(e.ids) == 1]


def rank_merger(definition: str):
    """Byte-pair merging by rank, or None if this vocabulary's ids are not the order of its merges."""
    model, alphabet = json.loads(definition)["model"], byte_alphabet()
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(alphabet[c] for c in entry): number for entry, number in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe


class Counter:
    """Counts tokens of texts with one tokenizer; special strings inside a text are one token, as is its default."""

    def __init__(self, definition: str, whole: list[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = sorted((t["content"] for t in json.loads(definition)["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pre, self.plain = regex.compile(PRE_TOKEN), re.compile(PLAIN)
        self.spaced = re.compile(r"[\n\x20-\x7e\u00a1-\u0557\u2010-\u2027]*")
        self.ranks = rank_merger(definition)
        self.whole = dict.fromkeys(whole, 1)
        self.known, self.by_word = dict(self.whole), {}

    def merged(self, pre_token: str) -> int:
        """Tokens of one pre-token by merging it."""
        if self.ranks is None:
            return len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        return len(self.ranks.encode_single_piece(pre_token.encode()))

    def learned(self, pre_token: str) -> int:
        n = self.merged(pre_token)
        if len(self.known) < len(self.whole) + REMEMBERED and len(pre_token) <= LONGEST:
            self.known[pre_token] = n
        return n

    def _pre_tokens(self, text: str) -> int:
        if self.plain.fullmatch(text):
            tokens = self.pre.findall(text)
        else:
            tokens = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        n = 0
        for token in tokens:
            n += self.known.get(token) or self.learned(token)
        return n

    def _words(self, text: str) -> int:
        """The same by words, each with the one space or line end before it, where white space is only such."""
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            return self._pre_tokens(first) + sum(map(self.by_word.__getitem__, words))
        except KeyError:
            found = {}
            new = set(words).difference(self.by_word)
            for word in [w for w in new if w[:1] == "\n"]:
                found[word] = self._pre_tokens(word)
            if new := [w for w in new if w[:1] != "\n"]:
                at = -1  # every word begins with the space before it, and no other pre-token has a space
                for token in self.pre.findall(" " + " ".join(new)):
                    if token[0] == " ":
                        at += 1
                        found[new[at]] = 0
                    found[new[at]] += self.known.get(token) or self.learned(token)
            if len(self.by_word) < REMEMBERED:  # frequent words come early
                self.by_word.update((w, k) for w, k in found.items() if len(w) <= LONGEST)
            if all(map(self.by_word.__contains__, found)):
                return self._pre_tokens(first) + sum(map(self.by_word.__getitem__, words))
            return self._pre_tokens(first) + sum([found[w] if w in found else self.by_word[w] for w in words])

    def _segment(self, text: str) -> int:
        simple = self.spaced.fullmatch(text) and not any(x in text for x in ("  ", "\n ", " \n", "\n\n"))
        return self._words(text) if simple and text[-1:] != " " else self._pre_tokens(text)

    def count(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return self._segment(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._segment, parts))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row; a null text is empty.

    `tokenizer` is the path of a byte-level tokenizer file; the driver reads it once and ships it with its proven
    whole tokens, both bounded by the vocabulary. One pass without a shuffle: repeated rows are counted each,
    very long texts are one pass of the pattern, an empty table gives no rows and extra columns are not read.
    """
    definition = Path(tokenizer).read_text()
    shipped = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shipped.value)
        for batch in batches:
            texts = batch.column(1)
            n = [counter.count(t.as_py() or "") for t in texts]
            size = [len((t.as_py() or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTS)
