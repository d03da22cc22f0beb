"""Best-fit decreasing packing of tokenised documents into fixed-length training sequences.

Documents are tokenised where they are read; only (document, piece, length, checksum) rows move.  Pieces are dealt
over blocks by a hash of their document, and every block runs best-fit decreasing with a segment tree over remaining
capacities.  Sequences that stay under-filled in a block are taken apart and packed again in as many blocks as what is
left over fills, so no block grows beyond about ``per_block`` pieces, however badly pieces pair up.

Defined cases: null or empty text is the single end token; a document longer than the capacity, of whatever length, is
cut into full pieces with the shorter remainder first; repeated rows, and rows without doc_id, are packed once each;
among pieces of equal length the one that was read first is placed first, and among equally tight sequences the one
that became so tight last takes it; an empty table gives an empty result; other columns are never read, so their names
cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encode
from .common import batches, slices, texts_of, written

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder, if any, and then full ones."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if s == 0 and first else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece.  ``row_key`` tells repeated rows of one document apart and deals out the blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            doc_ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            for at, texts in slices(batch):
                out: list[tuple] = []
                for i, text in enumerate(texts, at):
                    ids = np.array([*encode(text, tokenizer), end_id], "<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        out.append((doc_ids[i], keys[i], k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
                )

    return texts_of(docs).withColumn("row_key", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


class Capacities:
    """Segment tree over remaining capacities 0..limit: each leaf counts the open bins with that much room."""

    def __init__(self, limit: int):
        self.width = 1 << (limit + 1).bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, bin_no: int) -> None:
        self.open[room].append(bin_no)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with at least ``size`` left."""
        i = size + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i *= 2
                if not self.count[i]:
                    i += 1
        room = i - self.width
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item, items by size, largest first and then as given; and the fill of every bin."""
    tree, bins, offsets, fill = Capacities(capacity), np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8"), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = tree.take(n) if n < capacity else None
        if found is None:
            room, b = capacity, len(fill)
            fill.append(0)
        else:
            room, b = found
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room - n:
            tree.put(room - n, b)
    return bins, offsets, np.array(fill, "i8")


def pack_pieces(pieces: DataFrame, capacity: int, per_block: int = 100_000, full_enough: float = 0.98) -> DataFrame:
    """Sequence and offset of every piece.

    ``per_block`` pieces, on average, are packed in one task; a sequence is final in the first round when it is filled
    to ``full_enough``.  The others go to a second round, over as many blocks as they fill.
    """
    n = pieces.agg(F.count("*")).first()[0]
    blocks = max(1, -(-n // per_block))

    def pack(final_fill: int, id_base: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("row_key", "ascending"), ("piece", "ascending")])
            bins, offsets, fill = best_fit_decreasing(t.column("length").to_numpy(), capacity)
            final = fill[bins] >= final_fill
            ids = (int(key[0].as_py()) + id_base) * (1 << 32) + bins
            drop = [c for c in ("block", "sequence_id", "offset") if c in t.column_names]
            t = t.drop_columns(drop)
            return t.append_column("sequence_id", pa.array(ids, mask=~final)).append_column("offset", pa.array(offsets, mask=~final))

        return run

    schema = PIECES + ", sequence_id long, `offset` long"
    block = (F.xxhash64("row_key", "piece") % blocks + blocks) % blocks
    first = pieces.withColumn("block", block).groupBy("block").applyInArrow(pack(int(capacity * full_enough), 0), schema)
    first = written(first, "packed")
    again = max(1, -(-first.where("sequence_id is null").count() // per_block))
    rest = first.where("sequence_id is null").withColumn("block", (F.xxhash64("row_key", "piece") % again + again) % again)
    last = rest.groupBy("block").applyInArrow(pack(0, blocks), schema)
    return first.where("sequence_id is not null").unionByName(last).drop("row_key")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)
