"""Best-fit packing of token sequences by the linear grouping scheme.

All that the packing needs to know of the corpus is how many pieces there are of each length: at most `limit` numbers
however large the corpus. They are planned on the driver; executors then look up each piece's place by its length and
its rank among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwell.llm.common import cut
from sparkwell.llm.tokens import byte_alphabet

#: Lengths above limit / SMALL are grouped, the others are best-fitted afterwards.
SMALL = 6
#: Groups of equal cardinality, and so sizes in a configuration.
GROUPS = 128
#: Configurations are optimised to within this share of the optimum.
GAP = 0.002
#: Parts in which the pieces of one length are numbered independently.
PARTS = 256
#: Words that a worker remembers the ids of, and the bytes of the longest such word.
REMEMBERED, LONGEST = 600_000, 64
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class RankMerger:
    """Merges one run of bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        core = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.encode_single_piece = core._core_bpe.encode_single_piece


def rank_merger(definition: str) -> tuple[RankMerger | None, dict[int, bytes]]:
    """A merger of runs of Latin letters, and the byte that stands for each last byte of a run.

    Ids from 512 on are the merges in their order, so ids are ranks (else there is no merger, and the library does
    all). A run's last byte carries the end-of-word mark; bytes that no letter has stand for those.
    """
    model = json.loads(definition)["model"]
    alphabet = byte_alphabet()
    lower = [*range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]
    spare = iter(sorted(set(range(256)) - set(lower)))
    last = {b: bytes([next(spare)]) for b in lower if b != 0xC3}
    allowed, ranks = set(lower), {}
    end = model["end_of_word_suffix"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if not end or any(model["vocab"].get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)):
        return None, {}
    for entry, number in model["vocab"].items():
        ended = entry.endswith(end) and len(entry) > len(end)
        data = [alphabet.get(c, -1) for c in (entry[: -len(end)] if ended else entry)]
        if set(data) <= allowed and not (ended and data[-1] == 0xC3):
            ranks[bytes(data[:-1]) + last[data[-1]] if ended else bytes(data)] = number
    rest = (b for b in range(256) if bytes([b]) not in ranks)
    ranks.update((bytes([b]), (1 << 31) + b) for b in rest)  # never met
    return RankMerger(ranks), last


class Coder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what white space separates, so a text's ids are those of its
    words, which are remembered. A new word of Latin letters is split by the tokenizer's pattern and its letter runs
    are merged by rank; every other new word goes through the library.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^\n0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
        self.plain = re.compile(r"[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        self.letters = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
        self.merger, self.last = rank_merger(definition)
        if not all("<|" in t["content"] for t in json.loads(definition)["added_tokens"]):
            self.merger = None

    def _run(self, run: str) -> bytes:
        if self.letters.fullmatch(run):
            data = run.encode()
            found = self.merger.encode_single_piece(data[:-1] + self.last[data[-1]])
        else:
            found = self.tokenizer.encode(run, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.runs) < REMEMBERED and len(run) <= LONGEST:
            self.runs[run] = ids
        return ids

    def _new(self, words: list[bytes]) -> list[bytes]:
        text = b"\n".join(words).decode()
        if self.merger is None or not self.plain.fullmatch(text) or "<|" in text:
            if len(words) > 1:
                return [x for w in words for x in self._new([w])]
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return [struct.pack(f"<{len(found)}I", *found)]
        out, own, runs = [], [], self.runs
        for run in self.split.findall(text.lower()):
            if run == "\n":
                out.append(b"".join(own))
                own = []
            else:
                own.append(runs.get(run) or self._run(run))
        out.append(b"".join(own))
        return out

    def ids(self, text: str) -> bytes:
        words = text.encode().split()  # ASCII white space only
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            new = list(set(words).difference(self.known))
            found = dict(zip(new, self._new(new), strict=True))
            if len(self.known) < REMEMBERED:  # frequent words come early
                self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
            if all(map(self.known.__contains__, new)):
                return b"".join(map(self.known.__getitem__, words))
            return b"".join([found[w] if w in found else self.known[w] for w in words])


def cut_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """The pieces (PIECES) of all rows: the text's ids and a closing 0, cut after every `limit` ids."""
    definition = Path(tokenizer).read_text()
    json.loads(definition)  # a broken file fails here, not on the executors
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shipped.value)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = coder.ids(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data) // 4, limit)):
                    own = data[4 * at : 4 * (at + limit)]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _configurations(sizes: list[int], demand: list[int], limit: int) -> list[tuple[list[int], float]]:
    """(rounded sizes, how often) of the sequences that cover the demand: the cutting-stock programme, by columns.

    A simplex over one row per size; a new column is the best-valued knapsack at the current prices. It ends when the
    best column is worth at most 1 + GAP, so the number of sequences is within that factor of the programme's optimum.
    """
    m = len(sizes)
    basis = np.diag([float(limit // s) for s in sizes])
    inverse = np.diag([1.0 / (limit // s) for s in sizes])
    amount = np.array(demand, float) @ inverse
    for _ in range(60 * m):
        price = inverse.sum(axis=0)
        best = np.zeros((m + 1, limit + 1))
        for k, (s, y) in enumerate(zip(sizes, price, strict=True)):
            best[k + 1] = best[k]
            if y > 1e-12:
                for _ in range(limit // s):
                    np.maximum(best[k + 1, s:], best[k + 1, :-s] + y, out=best[k + 1, s:])
        if best[m, limit] <= 1 + GAP:
            break
        column, room = np.zeros(m), limit
        for k in range(m - 1, -1, -1):
            s, y = sizes[k], price[k]
            while room >= s and best[k + 1, room] > best[k, room] + 1e-12 and y > 1e-12:
                column[k] += 1
                room -= s
        if column @ price <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        row = int(ratio.argmin())
        if not np.isfinite(ratio[row]):
            break
        step = ratio[row]
        amount = amount - step * change
        amount[row] = step
        pivot = inverse[row] / change[row]
        inverse = inverse - np.outer(change, pivot)
        inverse[row] = pivot
        basis[:, row] = column
    slots = [[s for s, n in zip(sizes, basis[:, i], strict=True) for _ in range(int(n))] for i in range(m)]
    return [(own, float(often)) for own, often in zip(slots, amount, strict=True) if own and often > 1e-9]


class Plan:
    """Places for pieces: for each length, runs of ranks that go to consecutive sequences at one offset."""

    def __init__(self, limit: int):
        self.limit, self.sequences = limit, 0
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int]] = []
        #: by free room: (sequences, first sequence, tokens in it)
        self.open: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.rooms = np.zeros(limit + 1, bool)
        #: Pieces that filled configurations, those of full length included.
        self.by_configuration = 0

    def placed(self) -> int:
        return sum(self.used.values())

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next n pieces of this length go to so many sequences from `sequence` on."""
        self.runs.append((length, self.used[length], sequence, offset))
        self.used[length] += n

    def leave(self, n: int, sequence: int, filled: int) -> None:
        room = self.limit - filled
        if n and room:
            self.open[room].append((n, sequence, filled))
            self.rooms[room] = True

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def best_fit(self, length: int, n: int) -> None:
        while n:
            fits = self.rooms[length:].argmax() + length
            if self.rooms[fits]:
                m, sequence, filled = self.open[fits].pop()
                if not self.open[fits]:
                    self.rooms[fits] = False
                now = min(m, n)
                self.leave(m - now, sequence + now, filled)
            else:
                each = self.limit // length
                now = n // each or 1
                sequence, filled = self.new(now), 0
                for i in range(min(each, n) - 1):
                    self.place(length, now, sequence, i * length)
                    n -= now
                    filled += length
            self.place(length, now, sequence, filled)
            self.leave(now, sequence, filled + length)
            n -= now


def _groups(counts: dict[int, int], lengths: list[int], groups: int) -> tuple[list[int], list[int]]:
    """Descending lengths in groups of equal cardinality: each group's largest length, and how many pieces it rounds up.

    Groups of one size are one.
    """
    share, room = -(-sum(counts[x] for x in lengths) // groups), 0
    sizes: list[int] = []
    demand: list[int] = []
    for x in lengths:
        n = counts[x]
        while n:
            if not room:
                room = share
                if not sizes or sizes[-1] != x:
                    sizes.append(x)
                    demand.append(0)
            now = min(n, room)
            demand[-1] += now
            room -= now
            n -= now
    return sizes, demand


def plan_packing(counts: dict[int, int], limit: int = 2048, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """A place for every piece, from the number of pieces of each length.

    Large lengths are put in `groups` groups of equal cardinality and rounded up to the largest of their group; the
    configurations of these few sizes are optimised. Then actual pieces take the places of rounded ones: a slot gets the
    longest piece left that is no longer than its size, the last slot of a sequence the longest that fits the room, so
    what rounding up lost is given back. Whole multiples of the configurations are filled first, then one sequence more
    of each as long as there are pieces for all its slots. What is left over and all small lengths, longest first, are
    best-fitted into the room that remains. Pieces of `limit` ids are a sequence each.
    """
    plan, left = Plan(limit), {x: n for x, n in counts.items() if n}
    if left.get(limit):
        plan.place(limit, left[limit], plan.new(left[limit]), 0)
        left[limit] = 0
    large = sorted((x for x, n in left.items() if n and x > limit // small), reverse=True)
    held = np.zeros(limit + 1, bool)
    held[large] = True

    def fill(slots: list[int], bins: int) -> None:
        while bins:
            took: dict[int, int] = defaultdict(int)
            room = limit
            for k, size in enumerate(slots):
                upto = room if k == len(slots) - 1 else min(size, room)
                x = upto - int(held[upto::-1].argmax())
                if not held[x]:
                    break
                took[x] += 1
                room -= x
                held[x] = left[x] > took[x]
            now = min([bins, *(left[x] // n for x, n in took.items())]) if sum(took.values()) == len(slots) else 0
            if now:
                first, filled = plan.new(now), 0
                for x, n in took.items():
                    for _ in range(n):
                        plan.place(x, now, first, filled)
                        left[x] -= now
                        filled += x
                plan.leave(now, first, filled)
            for x in took:
                held[x] = left[x] > 0
            if not now:
                return
            bins -= now

    found = sorted(_configurations(*_groups(left, large, groups), limit), reverse=True) if large else []
    for slots, often in found:
        fill(slots, int(often + 1e-9))
    for slots, _ in sorted(found, key=lambda x: x[1] % 1, reverse=True):
        fill(slots, 1)
    plan.by_configuration = plan.placed()
    for x in sorted(left, reverse=True):
        if left[x]:
            plan.best_fit(x, left[x])
    return plan


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, parts: int = PARTS) -> DataFrame:
    """Every piece of every row with its sequence_id and its offset there; offsets fill each sequence without gaps.

    Only texts of more than `limit` ids are cut. A null text is empty and still has the closing 0; repeated rows are
    packed each; a very long text is tokenised at once; an empty table gives no rows; extra columns are not read. Pieces are tokenised once and checkpointed.
    The driver gets one count for each length (at most `limit`). Ranks come from a numbering in `parts` parts of each
    length and the parts' offsets, so many equal documents do not meet in one task.
    """
    pieces = cut(cut_pieces(docs, tokenizer, limit))
    plan = plan_packing({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, limit)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 4)
    # one sorted key for (length, rank)
    shipped = docs.sparkSession.sparkContext.broadcast((runs[:, 0].copy(), runs[:, 1:].copy()))

    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("length", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        parted.withColumn("inside", F.row_number().over(inside))
        .join(offsets, ["length", "part"])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("inside") - 1).alias("rank")
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, rest = shipped.value
        first = {int(x): i for i, x in reversed(list(enumerate(lengths)))}
        last = {int(x): i + 1 for i, x in enumerate(lengths)}
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine, a, b = length == x, first[int(x)], last[int(x)]
                run[mine] = a + np.searchsorted(rest[a:b, 0], rank[mine], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(length),
                    batch.column(4),
                    pa.array(rest[run, 1] + rank - rest[run, 0]),
                    pa.array(rest[run, 2]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
