"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks at places that depend on content alone, so passages that
documents share fall into the same chunks.  A task encodes each chunk once and keeps the result; inside a new chunk
the library sees each white-space-delimited piece once.  A cut may fall inside a word: its two halves are then no
tokens of the whole text.  Such a join is repaired by re-encoding a window from the last gap before the cut to the
first gap after it.  Then a window that a cut had parted is encoded again with the pieces on either side: the repair
stands if that gives the ids of the window and of its neighbours exactly; where it doesn't, the window grows to the
whole text.

The memory of chunks lives in a Python worker, over all its tasks, and is bounded (``max_chunks``; what was not used
lately goes first): a chunk that two workers hold is encoded in both.  To encode a chunk once in the whole cluster its text and its ids would have to be
shuffled, which is more than the texts themselves.

Defined cases: null text is empty; an empty text has no tokens and decodes to the empty string; strings of special
tokens in a text are those tokens, as in the library; texts of any length are encoded whole; repeated rows give
repeated rows; an empty table gives an empty result; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import BYTE_LETTERS
from .common import batches, slices, texts_of

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>, decoded string"
WINDOW, FACTOR, MASK, LOOK = 8, 0x9E3779B1, 0xFF, 0x5A


class Memory(dict):
    """A mapping of at most about ``most`` entries: what was not looked up lately goes first, half of it at a time."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def holds(self, key) -> bool:
        """Whether the key is held; if so, it stays until the next ``age``."""
        if key not in self and key in self.old:
            self[key] = self.old[key]
        return key in self

    def age(self) -> None:
        """To be called between uses."""
        if 2 * len(self) > self.most:
            self.old = dict(self)
            self.clear()


def cuts(data: bytes) -> np.ndarray:
    """Byte positions to cut before: where the hash of the last WINDOW bytes has the wanted low bits, between characters."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= WINDOW:
        return np.zeros(0, "i8")
    h, f = np.zeros(len(b) - WINDOW, np.uint32), 1
    for k in range(WINDOW):
        h += b[WINDOW - 1 - k : len(b) - 1 - k] * np.uint32(f)
        f = f * FACTOR & 0xFFFFFFFF
    at = np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == LOOK) + WINDOW
    return at[(b[at] & 0xC0) != 0x80]


class Chunk:
    """What a chunk has before its first and after its last gap, and the pieces between them: as such, then encoded."""

    __slots__ = ("head", "whole", "tail", "first", "last", "ids", "text")

    def __init__(self, data: bytes):
        text = data.decode()
        for gap in "\n\t\r":
            if gap in text:
                text = text.replace(gap, " ")
        parts = text.split(" ")
        self.head, self.whole, self.tail = parts[0], [p for p in parts[1:-1] if p], parts[-1] if len(parts) > 1 else None
        self.first, self.last = (self.whole[0], self.whole[-1]) if self.whole else ("", "")
        self.ids = self.text = b""


class ChunkCoder:
    """Encodes texts through two bounded memories: of pieces between white space, and of chunks."""

    def __init__(self, path: str, max_pieces: int = 700_000, max_chunks: int = 20_000):
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokens = self.lib.model.tokenize
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = "<|"
        if not all(t["content"].startswith(self.special) for t in spec["added_tokens"]):
            raise ValueError("special tokens are expected to start with " + self.special)
        self.max_pieces = max_pieces
        self.chunks: Memory = Memory(max_chunks)
        self.forget()
        self.reused = self.widened = 0

    def forget(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.word: dict[str, tuple[bytes, str]] = {}

    def plain(self, text: str) -> bool:
        """Whether normalizing only lower-cases: Latin-1 letters at most, and no special token."""
        return (text.isascii() or max(text) < "\u0100") and self.special not in text

    def learn(self, pieces: set[str]) -> None:
        rest, word = [], self.word
        for piece in pieces - self.ids.keys():
            if not self.plain(piece):
                rest.append(piece)
                continue
            made = []
            for w in self.words(piece.lower()):
                if (known := word.get(w)) is None:
                    tokens = self.tokens(w if w.isascii() and w.isprintable() else "".join([BYTE_LETTERS[b] for b in w.encode()]))
                    known = word[w] = (array("I", [t.id for t in tokens]).tobytes(), " ".join([t.value for t in tokens]))
                made.append(known)
            self.ids[piece] = b"".join([i for i, _ in made])
            self.text[piece] = " ".join([t for _, t in made]).encode()
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            coded = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
            for piece, ids, back in zip(part, coded, self.lib.decode_batch(coded, skip_special_tokens=False)):
                self.ids[piece], self.text[piece] = array("I", ids).tobytes(), back.encode()

    def parts(self, text: str, fresh: list[Chunk]) -> list[Chunk | str]:
        """Chunks of a whole text and, as strings, the repaired pieces at their joins, in order."""
        data, out, window = (text.lower() if text and self.plain(text) else text).encode(), [], ""
        at = [0, *cuts(data).tolist(), len(data)]
        for i in range(len(at) - 1):
            key = data[at[i] : at[i + 1]]
            if self.chunks.holds(key):
                chunk = self.chunks[key]
                self.reused += 1
            else:
                chunk = self.chunks[key] = Chunk(key)
                fresh.append(chunk)
            window += chunk.head
            if chunk.tail is not None:
                out += (window, chunk)
                window = chunk.tail
        out.append(window)
        return out

    def joins(self, parts: list[Chunk | str]) -> list[tuple[str, str, str]]:
        """Every join of a text that cuts a word: the piece before its window, the window, the piece after it."""
        at = range(2, len(parts) - 1, 2)
        return [(parts[i - 1].last, parts[i], parts[i + 1].first) for i in at if parts[i] not in (parts[i - 1].tail, parts[i + 1].head)]

    def agree(self, found: set[tuple[str, str, str]]) -> dict[tuple[str, str, str], bool]:
        """Whether each join, encoded together with the pieces on either side, gives the ids that all three have alone."""
        some = list(found)
        coded = self.lib.encode_batch_fast([" ".join(j) for j in some], add_special_tokens=False)
        return {j: array("I", e.ids).tobytes() == b"".join(map(self.ids.__getitem__, j)) for j, e in zip(some, coded)}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded text in UTF-8, of each text."""
        if len(self.ids) > self.max_pieces:
            self.forget()
        self.chunks.age()
        fresh: list[Chunk] = []
        split = [self.parts(t, fresh) for t in texts]
        joins = [self.joins(parts) for parts in split]
        every = set().union(*joins)
        self.learn({"", *(p for parts in split for p in parts if isinstance(p, str)), *(p for j in every for p in j)}.union(*(c.whole for c in fresh)))
        ids, text = self.ids.__getitem__, self.text.__getitem__
        for c in fresh:
            c.ids, c.text = b"".join(map(ids, c.whole)), b" ".join(filter(None, map(text, c.whole)))
            c.whole = []
        wrong = {j for j, right in self.agree(every).items() if not right}
        for i, parts in enumerate(split):
            if wrong and not wrong.isdisjoint(joins[i]):
                self.widened += 1
                coded = self.lib.encode(texts[i], add_special_tokens=False).ids
                yield array("I", coded).tobytes(), self.lib.decode(coded, skip_special_tokens=False).encode()
                continue
            back = [text(p) if isinstance(p, str) else p.text for p in parts]
            yield b"".join([ids(p) if isinstance(p, str) else p.ids for p in parts]), b" ".join(filter(None, back))


@lru_cache(1)
def coder_of(path: str) -> ChunkCoder:
    """One for each Python worker: tasks that follow each other in it share what it has encoded."""
    return ChunkCoder(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids and the text they decode to."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches(rows):
            for at, texts in slices(batch):
                done = list(coder.encode(texts))
                ids = pa.array([np.frombuffer(i, "<u4").astype("i4") for i, _ in done], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids, pa.array([t.decode() for _, t in done], pa.string())], ["doc_id", "ids", "decoded"])

    return texts_of(docs).mapInArrow(run, TOKENS)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Like ``encode_documents`` with digests in the place of ids and texts, so that they don't leave the task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches(rows):
            for at, texts in slices(batch):
                done = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for i, t in coder.encode(texts)]
                n, ids, back = zip(*done)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, ENCODED)
