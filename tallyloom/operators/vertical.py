"""Counting itemsets by bitmaps of items within blocks of baskets.

A block holds some baskets of one split, numbered within it, and for each item the numbers of its baskets: packed bits
where that is smaller, else a sorted list.  An itemset's count in a block is the size of an intersection, and blocks'
counts add up.  Blocks are rows of a table and are never moved again; candidates come to them, and only counts leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a block, as near as dealing baskets by their hash comes.
BLOCK_LINES = 200_000
#: Candidate sets that meet a block at once, and up to which all of them are sent along to every task.
CHUNK, SENT = 50_000, 200_000
#: Numbers worked on at once within a block.
STEP = 4_000_000
BLOCK = "split_id long, block long, names array<string>, baskets int, starts binary, packed binary, held binary, weights binary"
COUNTS = "split_id long, items array<string>, cnt long"


def pack(table: pa.Table) -> pa.RecordBatch:
    """A block from its lines (split_id, basket_id, item, weight)."""
    item, basket = table.column("item").combine_chunks().dictionary_encode(), table.column("basket_id").combine_chunks().dictionary_encode()
    names = item.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    codes, numbers = place[item.indices.to_numpy()], basket.indices.to_numpy().astype(np.int64)
    n = len(basket.dictionary)
    weights = np.ones(n, np.int64)
    weights[numbers] = table.column("weight").to_numpy()
    by = np.lexsort((numbers, codes))
    numbers, starts = numbers[by], np.searchsorted(codes[by], np.arange(len(names) + 1))
    packed, held = np.zeros(len(names), bool), []
    for i in range(len(names)):
        own = numbers[starts[i] : starts[i + 1]]
        packed[i] = 32 * len(own) > n
        if packed[i]:
            bits = np.zeros(n, np.uint8)
            bits[own] = 1
            held.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            held.append(own.astype("<u4").tobytes())
    sizes = np.cumsum([0, *map(len, held)]).astype("<i8")
    plain = b"" if (weights == 1).all() else weights.astype("<i8").tobytes()
    values = [[table.column("split_id")[0].as_py()], [table.column("block")[0].as_py()], [[names[i] for i in order]], [n], [sizes.tobytes()], [packed.tobytes()], [b"".join(held)], [plain]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), *[pa.binary()] * 4))], [f.split()[0] for f in BLOCK.split(", ")])


def blocks(held: DataFrame) -> DataFrame:
    """Blocks of the baskets (split_id, basket_id, weight, items) of a table."""
    lines = held.agg(F.sum(F.size("items")).alias("n")).first()["n"] or 0
    number = F.pmod(F.xxhash64("basket_id"), F.lit(-(-lines // BLOCK_LINES) or 1)).cast("long")
    rows = held.select("split_id", number.alias("block"), "basket_id", "weight", F.explode("items").alias("item"))
    return rows.groupBy("split_id", "block").applyInArrow(lambda t: pa.Table.from_batches([pack(t)]), BLOCK)


class Block:
    def __init__(self, row: dict) -> None:
        self.names, self.n = np.array(row["names"], object), row["baskets"]
        starts, packed = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["packed"], bool)
        self.dense = packed
        words = -(-self.n // 64)
        self.bits = np.zeros((int(packed.sum()), words), np.uint64)
        self.row_of = np.cumsum(packed) - 1
        flat = self.bits.view(np.uint8)
        lists: list[np.ndarray] = []
        for i in range(len(packed)):
            data = row["held"][starts[i] : starts[i + 1]]
            if packed[i]:
                flat[self.row_of[i], : len(data)] = np.frombuffer(data, np.uint8)
                lists.append(np.zeros(0, np.int64))
            else:
                lists.append(np.frombuffer(data, "<u4").astype(np.int64))
        sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.numbers = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.keys = np.repeat(np.arange(len(lists), dtype=np.int64), sizes) << 32 | self.numbers
        self.sizes = sizes.copy()
        self.sizes[packed] = np.bitwise_count(self.bits).sum(axis=1)
        self.weights = np.frombuffer(row["weights"], "<i8") if row["weights"] else None
        self.planes = []
        if self.weights is not None:
            padded = np.zeros(words * 64, np.int64)
            padded[: self.n] = self.weights
            for b in range(int(padded.max()).bit_length()):
                self.planes.append(np.packbits((padded >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64))

    def holds(self, items: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether baskets hold items, pair by pair."""
        out, dense = np.zeros(len(items), bool), self.dense[items]
        at = numbers[dense]
        out[dense] = self.bits[self.row_of[items[dense]], at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        if len(self.keys):
            wanted = items[~dense] << 32 | numbers[~dense]
            near = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[~dense] = self.keys[near] == wanted
        return out

    def counts(self, sets: np.ndarray) -> np.ndarray:
        """The weight of baskets that hold each row of items."""
        out = np.zeros(len(sets), np.int64)
        packed = self.dense[sets].all(axis=1)
        step = max(1, STEP // max(1, self.bits.shape[1]))
        which = np.flatnonzero(packed)
        for at in range(0, len(which), step):
            some = which[at : at + step]
            both = self.bits[self.row_of[sets[some, 0]]]
            for k in range(1, sets.shape[1]):
                both &= self.bits[self.row_of[sets[some, k]]]
            if self.weights is None:
                out[some] = np.bitwise_count(both).sum(axis=1)
            else:
                out[some] = sum((1 << b) * np.bitwise_count(both & plane).sum(axis=1, dtype=np.int64) for b, plane in enumerate(self.planes))
        which = np.flatnonzero(~packed)
        if len(which):
            # the rarest item of such a set has a list, and the other items are asked for its baskets
            ordered = np.take_along_axis(sets[which], np.argsort(self.sizes[sets[which]], axis=1, kind="stable"), axis=1)
            lengths = self.sizes[ordered[:, 0]]
            ends = np.cumsum(lengths)
            start = 0
            while start < len(which):
                end = max(start + 1, int(np.searchsorted(ends, ends[start] - lengths[start] + STEP, "right")))
                own = lengths[start:end]
                of = np.repeat(np.arange(start, end), own)
                within = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
                numbers = self.numbers[self.first[ordered[of, 0]] + within]
                for k in range(1, sets.shape[1]):
                    kept = self.holds(ordered[of, k], numbers)
                    of, numbers = of[kept], numbers[kept]
                weight = np.ones(len(of)) if self.weights is None else self.weights[numbers]
                out[which[start:end]] = np.bincount(of - start, weights=weight, minlength=end - start).astype(np.int64)
                start = end
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs of items, weights) in parts: by intersections, or by going through baskets where that is less."""
        m, size = len(self.names), np.zeros(self.n, np.int64)
        dense = np.flatnonzero(self.dense)
        lists = [np.flatnonzero(np.unpackbits(self.bits[self.row_of[i]].view(np.uint8), bitorder="little")) for i in dense]
        numbers = np.concatenate([self.numbers, *lists])
        items = np.concatenate([self.keys >> 32, *(np.full(len(x), i) for i, x in zip(dense, lists))])
        np.add.at(size, numbers, 1)
        if m * (m - 1) <= (size * (size - 1)).sum():
            for first in range(m - 1):
                sets = np.column_stack([np.full(m - first - 1, first), np.arange(first + 1, m)])
                yield sets, self.counts(sets)
            return
        by = np.lexsort((items, numbers))
        numbers, items = numbers[by], items[by]
        later = np.repeat(np.cumsum(size[size > 0]), size[size > 0]) - np.arange(len(items)) - 1
        ends = np.cumsum(later)
        start = 0
        while start < len(items):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] - later[start] + STEP, "right")))
            own = later[start:end]
            a = np.repeat(np.arange(start, end), own)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
            keys, at = np.unique(items[a] * m + items[b], return_inverse=True)
            weight = np.ones(len(a)) if self.weights is None else self.weights[numbers[a]]
            if len(keys):
                yield np.column_stack([keys // m, keys % m]), np.bincount(at, weights=weight).astype(np.int64)
            start = end


def counted(split: int, block: Block, sets: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    sets, counts = sets[counts > 0], counts[counts > 0]
    for at in range(0, len(sets), CHUNK):
        some = sets[at : at + CHUNK]
        items = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * some.shape[1], pa.int32()), pa.array(block.names[some.ravel()], pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), split, np.int64)), items, pa.array(counts[at : at + CHUNK])], ["split_id", "items", "cnt"])


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def pair_counts(table: DataFrame) -> DataFrame:
    """(split_id, items, cnt) of every pair that a block holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            for sets, counts in block.pairs():
                yield from counted(row["split_id"], block, sets, counts)

    return table.mapInArrow(run, COUNTS)


def set_counts(table: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(split_id, items, cnt) of the ``n`` wanted sets (split_id, items), all of one size, within each block.

    Up to ``SENT`` of them go along to every task; more are joined to the blocks of their split in chunks.
    """
    chunks = wanted.groupBy("split_id", F.pmod(F.xxhash64("items"), F.lit(-(-n // CHUNK))).alias("chunk")).agg(F.collect_list("items").alias("sets"))
    if n <= SENT:
        met = table.join(F.broadcast(chunks), "split_id")
    else:
        # every block gets a key of its own, so no split gathers its blocks in one task
        met = table.join(table.select("split_id", "block").join(chunks, "split_id"), ["split_id", "block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            number = {name: i for i, name in enumerate(block.names)}
            sets = np.array([[number.get(x, -1) for x in items] for items in row["sets"]], np.int64)
            sets = sets[(sets >= 0).all(axis=1)]
            if len(sets):
                yield from counted(row["split_id"], block, sets, block.counts(sets))

    return met.mapInArrow(run, COUNTS)
