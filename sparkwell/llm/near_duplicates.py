"""N-gram Jaccard join by prefix trees.

An exact self-join of the documents' sets of word shingles, for connectivity:

1. Each document's distinct shingles, as 64-bit hashes, are dealt by hash to buckets in packed form (one row per bucket
   and batch). A bucket finds the shingles that at least two different sets hold. Only these can be in an overlap, so a
   set stays only if at least 3/4 of it is shared: the overlap is at least 3/4 of either set.
2. Sets are ordered by document frequency, rarest first. Of two sets that link, the larger has a shingle among its first
   n - ceil(3n/4) + 1 that the smaller has among its first n - ceil(6n/7) + 1; sets that share such a one, and whose
   lengths allow a link, are put in one block. A block of very many sets gives way to the groups that share one shingle
   (a group is taken once, however many shingles it shares) where these are less work than all of the block.
3. In a block the sets go into a path-compressed prefix tree (most frequent first, so that near copies share long paths).
   Each set walks the tree, carrying the overlap of the path that the subtree's sets share; a subtree is left when even
   its longest rest cannot reach the overlap that its smallest set needs, or when it is already linked to the set. What
   comes out is a spanning forest, never all pairs. A block too large for a task is cut into chunks, and each pair of
   chunks is one task.
4. Links of all tasks are joined to components.

Equal sets are one class from the start, so thousands of copies cost one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import cut, few
from sparkwell.llm.components import components

WORDS = 5
#: A link needs 100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (sum of sizes).
SHARE = (3, 4)
#: Shared shingles that one task holds of a block; larger blocks are cut into chunks.
BLOCK = 2_000_000
#: Chunks of a block from which on it is asked whether its groups are less work.
CHUNKS = 8
#: Buckets of shingles for each shuffle partition; a worker holds one bucket at a time.
SPLIT = 2
#: Bytes of text that are hashed at once.
SLICE = 2_000_000
#: Bytes kept of a shingle's hash in the packed form; its bucket holds more of it.
KEPT = 7

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _stream(WORDS, 1 << 20)


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text; the texts' UTF-8 bytes stand one after another in `data`."""
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ends)
    if not len(data):
        return sets
    starts = np.concatenate([[0], ends[:-1]])
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = starts[(starts < len(data)) & (ends > starts)]
    begins[at] = solid[at]
    index = np.flatnonzero(solid)
    first = np.flatnonzero(begins)
    if not len(first):
        return sets
    opens = np.flatnonzero(begins[index])
    place = np.arange(len(index)) - np.repeat(opens, np.diff(np.append(opens, len(index))))
    value = (_FOLD[data[index]].astype(np.uint64) + _U(1)) * _stream(int(place.max()) + 1, 0)[place]
    words = mixed(np.add.reduceat(value, opens))
    span = np.searchsorted(first, np.stack([starts, ends]))
    whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        whole += words[j : j + len(whole)] * _PLACE[j]
    whole = mixed(whole)
    for i, (a, b) in enumerate(span.T):
        if b - a >= WORDS:
            sets[i] = np.unique(whole[a : b - WORDS + 1])
        elif b > a:
            sets[i] = mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a))
    return sets


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    return np.array([int(mixed(mixed(s + _U(len(s)))).sum()) & (2**64 - 1) for s in sets], np.uint64).view(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of slices of a text column."""
    texts = [(t.as_py() or "").encode() for t in column]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (size < SLICE or upto == at):
            size += len(texts[upto])
            upto += 1
        part = texts[at:upto]
        yield at, shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(x) for x in part]))
        at = upto


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return out.view(np.uint64).ravel()


_ENTRY = np.dtype([("key", "<i8"), ("size", "<u4"), ("count", "u1")])


def _entries(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """Set by set how many of the hashes are its own; a set with more than 255 has several entries."""
    many = -(-counts // 255)
    entry = np.empty(int(many.sum()), _ENTRY)
    entry["key"], entry["size"], entry["count"] = np.repeat(keys, many), np.repeat(sizes, many), 255
    entry["count"][np.cumsum(many) - 1] = counts - 255 * (many - 1)
    return entry.tobytes()


_DEALT = "bucket int, doc_id long, set_key long, n int, entries binary, hashes binary"


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _deal(buckets: int):
    """Map side of step 1: a row for each document, and for each bucket one packed row with its part of the sets."""
    names = ["bucket", "doc_id", "set_key", "n", "entries", "hashes"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat = (TaskContext.get().partitionId() * 7919) % buckets
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, sets in _texts(batch.column(1)):
                keys = set_keys(sets)
                n = [len(s) for s in sets]
                own = [
                    [(seat + i) % buckets for i in range(len(sets))],  # copies and empty texts spread evenly
                    ids[at : at + len(sets)],
                    [int(k) if m else None for k, m in zip(keys, n, strict=True)],
                    n,
                    [None] * len(sets),
                    [None] * len(sets),
                ]
                yield _batch(names, kinds, own)
                seat = (seat + len(sets)) % buckets
                _, once = np.unique(keys, return_index=True)  # copies within a slice are dealt once
                once = np.array([i for i in once if n[i]], np.int64)
                if not len(once):
                    continue
                hashes = np.concatenate([sets[i] for i in once])
                of = np.repeat(once, [n[i] for i in once])
                bucket = ((hashes >> _U(33)) % _U(buckets)).astype(np.int32 if buckets > 32767 else np.int16)
                order = np.argsort(bucket, kind="stable")
                hashes, of, bucket = hashes[order], of[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket)) + 1
                rows = []
                for lo, hi in zip(np.append(0, edges), np.append(edges, len(bucket)), strict=True):
                    turn = np.append(0, np.flatnonzero(np.diff(of[lo:hi])) + 1)
                    own = of[lo:hi][turn]
                    told = _entries(keys[own], np.array(n)[own], np.diff(np.append(turn, hi - lo)))
                    rows.append((int(bucket[lo]), None, None, None, told, _packed(hashes[lo:hi])))
                yield _batch(names, kinds, list(zip(*rows, strict=True)))

    return run


_SHARED = "bucket int, doc_id long, set_key long, n int, entries binary, hashes binary, frequency binary"
_SHARED_NAMES = ["bucket", "doc_id", "set_key", "n", "entries", "hashes", "frequency"]
_SHARED_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _by_bucket(batches: Iterator[pa.RecordBatch], width: int):
    """What a partition sorted by bucket holds, one after another: (batch of plain rows, None) or (None, a bucket's rows)."""
    held: list[dict] = []
    for batch in batches:
        mask = pa.compute.is_null(batch.column(4))
        if (plain := batch.filter(mask)).num_rows:
            yield [plain.column(i) for i in range(width)], None
        for i in np.flatnonzero(~mask.to_numpy(zero_copy_only=False)):  # row by row: a batch can be a whole partition
            row = {name: batch.column(j)[int(i)].as_py() for j, name in enumerate(batch.schema.names)}
            if held and held[-1]["bucket"] != row["bucket"]:
                yield None, held
                held = []
            held.append(row)
    if held:
        yield None, held


def _find_shared(buckets: int):
    """Reduce side of step 1: the shingles of each bucket that at least two sets hold, dealt by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plain, held in _by_bucket(batches, 6):
            if plain:
                yield pa.RecordBatch.from_arrays([*plain, pa.nulls(len(plain[0]), pa.binary())], _SHARED_NAMES)
                continue
            bucket = held[0]["bucket"]
            entries = np.concatenate([np.frombuffer(r["entries"], _ENTRY) for r in held])
            hashes = np.concatenate([_unpacked(r["hashes"]) for r in held])
            held.clear()
            keys, first, which = np.unique(entries["key"], return_index=True, return_inverse=True)
            sizes = entries["size"][first]
            of = np.repeat(which.astype(np.int32), entries["count"])
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            single = new.copy()
            single[1:] |= of[1:] != of[:-1]  # a copy's posting of the same shingle goes
            hashes, of, new = hashes[single], of[single], new[single]
            starts = np.flatnonzero(new)
            length = np.diff(np.append(starts, len(hashes)))
            frequency = np.repeat(length, length).astype(np.uint32)
            keep = frequency >= 2
            hashes, of, frequency = hashes[keep], of[keep], frequency[keep]
            to = (keys % buckets).astype(np.int64)
            order = np.lexsort((of, to[of]))
            hashes, of, frequency = hashes[order] ^ _U(bucket << 56 & (2**64 - 1)), of[order], frequency[order]
            edges = np.flatnonzero(np.diff(to[of])) + 1
            rows = []
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(of)), strict=True):
                if hi > lo:
                    turn = np.append(0, np.flatnonzero(np.diff(of[lo:hi])) + 1)
                    own = of[lo:hi][turn]
                    told = _entries(keys[own], sizes[own], np.diff(np.append(turn, hi - lo)))
                    rows.append((int(to[of[lo]]), None, None, None, told, hashes[lo:hi].tobytes(), frequency[lo:hi].tobytes()))
            if rows:
                yield _batch(_SHARED_NAMES, _SHARED_KINDS, list(zip(*rows, strict=True)))

    return run


_SETS = "doc_id long, set_key long, n int, prefix int, index int, shingles array<long>"


def _order_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2's sets: enough shared shingles, rarest first; how many of them a larger set's prefix takes, and a smaller one's."""
    names = ["doc_id", "set_key", "n", "prefix", "index", "shingles"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for plain, held in _by_bucket(batches, 4):
        if plain:
            m = len(plain[0])
            yield pa.RecordBatch.from_arrays([*plain[1:], *(pa.nulls(m, k) for k in kinds[3:])], names)
            continue
        entry = np.concatenate([np.frombuffer(r["entries"], _ENTRY) for r in held])
        shingle = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held])
        often = np.concatenate([np.frombuffer(r["frequency"], np.uint32) for r in held])
        keys, first, which = np.unique(entry["key"], return_index=True, return_inverse=True)
        n = entry["size"][first].astype(np.int64)
        shared = np.bincount(which, weights=entry["count"], minlength=len(keys)).astype(np.int64)
        stays = SHARE[1] * shared >= SHARE[0] * n
        of = np.repeat(which, entry["count"])
        keep = stays[of]
        of, shingle, often = of[keep], shingle[keep], often[keep]
        order = np.lexsort((shingle, often, of))
        shingle, of = shingle[order].view(np.int64), of[order]
        edges = np.searchsorted(of, np.arange(len(keys) + 1))
        rows = []
        for i in np.flatnonzero(stays):
            prefix = shared[i] + 1 + -SHARE[0] * n[i] // SHARE[1]  # without ceil(3n/4), the least overlap with a smaller set
            index = shared[i] + 1 + -2 * SHARE[0] * n[i] // (SHARE[0] + SHARE[1])  # ceil(6n/7), that with a larger one
            rows.append((None, int(keys[i]), int(n[i]), int(prefix), int(max(0, index)), shingle[edges[i] : edges[i + 1]]))
            if len(rows) == 1000:
                yield _batch(names, kinds, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield _batch(names, kinds, list(zip(*rows, strict=True)))


class Node:
    """A path of the prefix tree: its shingles, what hangs below, and bounds over the sets below."""

    __slots__ = ("below", "label", "least", "path", "rest", "sets")

    def __init__(self, path: np.ndarray, least: int, rest: int, label: int):
        self.path, self.least, self.rest, self.label = path, least, rest, label
        self.below: dict[int, Node] = {}
        self.sets: list[int] = []


class Tree:
    """A prefix tree over sets of ranks that links each new set to the sets before it."""

    def __init__(self, sizes: list[int], ranks: int):
        self.sizes, self.parent = sizes, list(range(len(sizes)))
        self.root = Node(np.zeros(0, np.int64), 1 << 60, 0, -1)
        self.held = np.zeros(ranks + 1, bool)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, own: np.ndarray) -> None:
        """Unites set i with every set in the tree that it links to."""
        size, held = self.sizes[i], self.held
        held[own] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.label >= 0 and self.find(node.label) == self.find(i):
                continue
            rest = len(own)
            if len(node.path):
                overlap += int(np.count_nonzero(held[node.path]))
                rest -= int(own.searchsorted(node.path[-1], "right"))
            # the smallest set below that the lengths allow
            least = max(node.least, -(-SHARE[0] * size // SHARE[1]))
            if 7 * (overlap + min(rest, node.rest)) < 3 * (size + least):
                continue
            for j in node.sets:
                if 7 * overlap >= 3 * (size + self.sizes[j]):
                    self.parent[self.find(j)] = self.find(i)
            stack.extend((child, overlap) for child in node.below.values())
        held[own] = False

    def insert(self, i: int, own: np.ndarray) -> None:
        node, at, size = self.root, 0, self.sizes[i]
        while True:
            node.least, node.rest = min(node.least, size), max(node.rest, len(own) - at)
            if node.label >= 0 and self.find(node.label) != self.find(i):
                node.label = -1
            if at == len(own):
                node.sets.append(i)
                return
            child = node.below.get(int(own[at]))
            if child is None:
                leaf = Node(own[at:], size, 0, i)
                leaf.sets.append(i)
                node.below[int(own[at])] = leaf
                return
            m = min(len(child.path), len(own) - at)
            differs = np.flatnonzero(child.path[:m] != own[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.path):
                upper = Node(child.path[:same], child.least, child.rest + len(child.path) - same, child.label)
                child.path = child.path[same:]
                upper.below[int(child.path[0])] = child
                node.below[int(own[at])] = child = upper
            node, at = child, at + same


def block_links(keys: list[int], sizes: list[int], sets: list[np.ndarray], sides: list[int]) -> list[tuple[int, int]]:
    """(set, smallest linked set) within a block; with sides 1 and 2 there are only links across them to find."""
    flat = np.concatenate(sets)
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    ranked = np.split(rank[which], np.cumsum([len(s) for s in sets])[:-1])
    tree = Tree(sizes, len(often))
    first = [i for i, s in enumerate(sides) if s != 2]
    for i in sorted(first, key=lambda i: (sizes[i], keys[i])):
        own = np.sort(ranked[i])
        if sides[i] == 0:
            tree.link(i, own)
        tree.insert(i, own)
    for i in (i for i, s in enumerate(sides) if s == 2):
        tree.link(i, np.sort(ranked[i]))
    least: dict[int, int] = {}
    for i in range(len(keys)):
        r = tree.find(i)
        least[r] = min(least.get(r, keys[i]), keys[i])
    return [(k, least[tree.find(i)]) for i, k in enumerate(keys) if least[tree.find(i)] != k]


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows sorted by task."""
    current, held = None, []

    def done():
        links = block_links([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], [r[3] for r in held])
        return _batch(["a", "b"], [pa.int64(), pa.int64()], [[x for x, _ in links], [y for _, y in links]])

    for batch in batches:
        offsets = batch.column(4).offsets.to_numpy()
        values = batch.column(4).values.to_numpy(zero_copy_only=False)
        for i, (task, key, n, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if task != current and held:
                if len(held) > 1:
                    yield done()
                held = []
            current = task
            held.append((key, n, values[offsets[i] : offsets[i + 1]].copy(), side))
    if len(held) > 1:
        yield done()


def _in_chunks(members: DataFrame, sets: DataFrame, by: str, block: int) -> DataFrame:
    """(task, set_key, n, side, shingles): the sets of each group (by, set_key), in chunks if they are more than a task holds.

    Each pair of chunks is a task; side tells the two apart, 0 is a chunk with itself.
    """
    held = members.join(sets.select("set_key", "n", "shingles"), "set_key")
    volume = held.groupBy(by).agg(F.ceil(F.sum(F.size("shingles")) / F.lit(block)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int")
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return (
        held.join(volume, by)
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.concat_ws(":", by, low, high).alias("task"), "set_key", "n", side.alias("side"), "shingles")
    )


def _tasks(sets: DataFrame, block: int, chunks: int) -> DataFrame:
    """Step 2: what each task of step 3 takes, by blocks, and by groups of one shingle where blocks are too much work."""
    # lengths that can link are in the same bin or in neighbouring ones
    bin_ = F.floor(F.log("n") / F.log(F.lit(SHARE[1] / SHARE[0]))).cast("int")
    probes = sets.select(
        "set_key", bin_.alias("bin"), "index", F.posexplode(F.slice("shingles", 1, F.col("prefix"))).alias("at", "shingle")
    ).select("set_key", "shingle", (F.col("at") < F.col("index")).alias("smaller"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    centre = F.min(F.when(F.col("smaller"), F.col("set_key")))
    centres = probes.groupBy("shingle", "bin").agg(centre.alias("centre"), F.count(F.lit(1)).alias("many"))
    centres = centres.where("many > 1 and centre is not null")
    together = probes.join(centres, ["shingle", "bin"]).where("set_key <> centre").select(F.col("set_key").alias("a"), F.col("centre").alias("b"))
    labels = components(together).select(F.col("node").alias("set_key"), "label")
    size = sets.select("set_key", F.size("shingles").alias("s"))
    large = labels.join(size, "set_key").groupBy("label").agg(F.sum("s").alias("volume")).where(F.col("volume") > F.lit(chunks * block))
    large = cut(large)
    if large.isEmpty():
        return _in_chunks(labels, sets, "label", block)

    inside = labels.join(few(large.select("label")), "label")
    groups = probes.join(inside, "set_key").groupBy("label", "shingle", "bin")
    # groups of the same sets are one: told by their number and two sums of hashes without carry
    own = groups.agg(
        F.count(F.lit(1)).alias("many"),
        F.max("smaller").alias("asked"),
        F.bit_xor(F.xxhash64("set_key")).alias("x"),
        F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("y"),
    ).where("many > 1 and asked")
    once = own.groupBy("label", "many", "x", "y").agg(F.min(F.struct("shingle", "bin")).alias("group")).select("label", "group")
    grouped = cut(
        once.select("label", "group.shingle", "group.bin")
        .join(probes.drop("smaller"), ["shingle", "bin"])
        .select("label", F.concat_ws("/", "shingle", "bin").alias("group"), "set_key")
    )
    work = grouped.join(size, "set_key").groupBy("label").agg(F.sum("s").alias("work")).join(large, "label")
    better = cut(work.where(F.col("work") < F.col("volume") * F.ceil(F.col("volume") / F.lit(block))).select("label"))
    by_group = grouped.join(few(better), "label", "left_semi").select("group", "set_key")
    by_block = labels.join(few(better), "label", "left_anti")
    return _in_chunks(by_block, sets, "label", block).unionByName(_in_chunks(by_group, sets, "group", block))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, parts: int) -> DataFrame:
    """`rows` with the columns of `table` (key, rows: how many rows have it, ...); null where it lacks the key.

    Keys of more than a share of 1 / (4 * parts) of all rows, at most 4 * parts, are broadcast, so that no task gets them whole.
    """
    total = table.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * F.lit(4 * parts) > F.lit(total)
    hot = F.broadcast(table.where(often).drop("rows"))
    rest = rows.join(F.broadcast(table.where(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~often).drop("rows"), key, "left"))


def near_duplicates(docs: DataFrame, block: int = BLOCK, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A text's words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; its set holds its distinct five-word shingles, or
    the whole sequence if it has fewer words. Null texts and texts without words have the empty set and link with
    nothing: their component is their own doc_id. Sets link at a Jaccard similarity of 0.75 or more, counted exactly on
    64-bit hashes; component_id is the smallest doc_id reachable. Repeated rows have equal results; very long texts are
    one set each; an empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * SPLIT
    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_deal(buckets), _DEALT)
    sorted_ = lambda df: df.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    shared = sorted_(dealt).mapInArrow(_find_shared(buckets), _SHARED)
    found = cut(sorted_(shared).mapInArrow(_order_sets, _SETS))
    members = found.where("shingles is null").select("doc_id", "set_key", "n")
    sets = found.where("shingles is not null").select("set_key", "n", "prefix", "index", "shingles")

    tasks = _tasks(sets, block, chunks)
    links = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_join_blocks, "a long, b long")
    linked = components(links)
    # for each distinct set its copies, then for each class its sets
    copies = members.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    copies = copies.join(linked, copies["set_key"] == linked["node"], "left")
    copies = cut(copies.select("set_key", "rows", "least", F.coalesce("label", "set_key").alias("class")))
    classes = cut(copies.groupBy("class").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows")))
    sets_known = cut(_looked_up(copies.select("class", "set_key", F.col("rows").alias("copies")), classes, "class", parts))
    known = sets_known.select("set_key", F.col("copies").alias("rows"), "component_id")
    told = _looked_up(members.where("set_key is not null"), known, "set_key", parts)
    alone = members.where("set_key is null").withColumn("component_id", F.col("doc_id"))
    every = told.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    return every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
