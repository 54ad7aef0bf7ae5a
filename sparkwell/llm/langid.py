"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the labelled sample: so many documents of each language, those with the smallest key hashes.
SAMPLE_PER_LANGUAGE = 2_000
SPARE = 1.25
UNDETERMINED = "und"
#: Posterior probability below which a filter rejects a text.
LEAST_SCORE = 0.5
#: Code points of a text that are featurised at once.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of the lower-cased text, in bounded pieces; non-letters count as spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = letters()
    reach = max(ORDERS) - 1
    for at in range(0, len(codes), PIECE):
        part = codes[max(0, at - reach) : at + PIECE]
        lead = min(at, reach)
        x = np.where(is_letter[part], part, 32).astype(np.uint32)
        mixed = np.zeros(len(x), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            mixed = (mixed[: len(x) - order + 1] * np.uint32(0x01000193)) ^ (x[order - 1 :] * np.uint32(0x9E3779B1))
            if order in ORDERS and len(mixed):
                own = mixed[max(0, lead - order + 1) :]
                h = own ^ (own >> np.uint32(15)) ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
                yield (h * np.uint32(0xC2B2AE35) >> np.uint32(16)) & np.uint32(BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """Languages in ascending order and the log probability of each bucket in each (BUCKETS x languages)."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def scores(self, counts: Counts) -> np.ndarray:
        """The log joint probability of every text of a batch in every language: sparse counts times the matrix."""
        out = np.tile(self.log_prior, (len(counts.starts) - 1, 1))
        held = np.flatnonzero(np.diff(counts.starts))
        if len(held):
            for k in range(len(self.languages)):
                weighted = counts.times * self.log_prob[counts.buckets, k].astype(np.float64)
                out[held, k] += np.add.reduceat(weighted, counts.starts[held])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its posterior probability; `und` and 0 for a text without a letter."""
        known = [bool(t) and bool(self.languages) and any(map(str.isalpha, t)) for t in texts]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        at = 0
        while at < len(texts):  # as many texts as fill a piece
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= PIECE):
                size += len(texts[upto] or "") if known[upto] else 0
                upto += 1
            rows = [i for i in range(at, upto) if known[i]]
            score = self.scores(count_batch([texts[i] for i in rows]))
            best = score.argmax(axis=1)  # the first of equals
            share = 1.0 / np.exp(score - score[np.arange(len(rows)), best][:, None]).sum(axis=1)
            for i, k, p in zip(rows, best.tolist(), share.tolist(), strict=True):
                out[i] = self.languages[k], p
            at = upto
        return out


@dataclass(frozen=True)
class Counts:
    """Sparse rows: row i has `times` of `buckets` from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    buckets: np.ndarray
    times: np.ndarray


def count_batch(texts: list[str]) -> Counts:
    """How often each text has each bucket; a text of several pieces is counted piece by piece."""
    keys, held, seen = [], 0, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, text in enumerate(texts):
        for ids in grams(text):
            keys.append(ids.astype(np.uint64) | np.uint64(i << 16))
            held += len(ids)
            if held > 4 * PIECE:
                seen.append(np.unique(np.concatenate(keys), return_counts=True))
                keys, held = [], 0
    if keys:
        seen.append(np.unique(np.concatenate(keys), return_counts=True))
    found = np.concatenate([k for k, _ in seen])
    rows = (found >> np.uint64(16)).astype(np.int64)
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return Counts(starts, (found & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([n for _, n in seen]))


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, alpha: float = 0.5) -> Model:
    """A model from rows with doc_id, text and lang; rows without text or lang are left out.

    Fits on at most `per_language` documents of each language, those with the smallest hashes of doc_id, read whole.
    Which hashes are small enough follows from the number of each language's rows, so no language is sorted whole.
    What reaches the driver is one number and one count vector per language. Without any labelled row nothing is learned, and
    every prediction is `und`.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    # hashes below these bounds are about SPARE times as many as asked for, so only so many rows are ranked
    bounds = [x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SPARE * per_language / n)))]
    key = F.xxhash64("doc_id")
    fraction = F.shiftrightunsigned(key, 12) / F.lit(float(1 << 52))
    rank = Window.partitionBy("lang").orderBy(key, "doc_id", F.xxhash64("text"))
    sample = (
        rows.where(F.col("text").isNotNull() & (fraction <= F.element_at(F.create_map(*bounds), F.col("lang"))))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= per_language)
        .select("lang", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, sums = seen.get(lang, (0, np.zeros(BUCKETS, np.int64)))
                for ids in grams(text.as_py()):
                    sums += np.bincount(ids, minlength=BUCKETS)
                seen[lang] = n + 1, sums
        for lang, (n, sums) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())],
                ["lang", "n", "sums"],
            )

    docs: dict[str, int] = {}
    sums: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, n long, sums binary").collect():
        docs[row.lang] = docs.get(row.lang, 0) + row.n
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.sums, np.int64)
    languages = tuple(sorted(docs))
    if not languages:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([sums[x] for x in languages], axis=1).astype(np.float64) + alpha
    prior = np.log(np.array([docs[x] for x in languages], np.float64) / sum(docs.values()))
    return Model(languages, prior, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the prediction's posterior probability) of every row, from its whole text only.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned. Texts are scored in batches: their
    n-grams' counts as sparse rows, times the matrix. The matrix is broadcast; its size is fixed by BUCKETS and the number
    of languages. No shuffle; repeated rows are predicted each; very long texts are counted in pieces; an empty table
    gives no rows; extra columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shipped.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def is_held_out():
    """Whether a document is kept out of training: crc32 of its doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose whole text has a determined language; null `lang` becomes the prediction.

    Rejected are null texts, texts without a letter, and texts whose best language has a posterior below `least`, so no
    language is likelier than the others together. Where the model has learned nothing, every text with a letter stays
    as it is. Columns, repeated rows and all other values are kept; an empty table stays empty; `lang` may be missing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if ("lang", "string") in docs.dtypes else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if shipped.value.languages:
                found = shipped.value.predict(texts)
                kept = [x != UNDETERMINED and score >= least for x, score in found]
            else:
                found = [(None, 0.0)] * len(texts)
                kept = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            if lang is not None:
                known = batch.column(lang)
                filled = pa.array([y if y is not None else x for y, (x, _) in zip(known.to_pylist(), found, strict=True)], known.type)
                columns = [filled if i == lang else c for i, c in enumerate(batch.columns)]
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
