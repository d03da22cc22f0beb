"""Scoring of texts by a causal self-attention model over subword ids, beside a word-unigram base.

Words are lower-cased and joined by single spaces; a byte-level BPE turns them into subword ids between two end marks.
The model predicts each id in two steps.  A single attention head with learned relative-position biases looks at the
last ``LEAD`` to ``WINDOW`` ids and corrects the pair counts' distribution over classes of the next id; within the class, ids follow
the pair counts of their rows (the ``HEADS - 1`` most frequent ids have their own, the others share one).  Windows
overlap by ``LEAD``, and each scores only what comes after, so every id is scored once.

A token's probability (a word's, or the end's) mixes the product of its ids' with its share of all training tokens and
its share of the text's tokens before it: ``w * c / N + q * before / place + (1 - w - q) * product``.  An id that begins with a space begins a word, so a word's product holds that the next
id begins a word or ends the text, and the first id's is conditional on that; products of all tokens then add up to at
most one.  The score of a text is the mean of its probabilities over all ``SHARES`` (w, q), taken as equally likely before the
text, so none is fitted and what a text shows of its best shares bears on its later tokens only.

1. Each task turns what it reads into blocks of about ``BLOCK_CHARS``: distinct words, and subword ids.  Texts themselves
   never move.
2. A block asks for its words by sorted hashes, cut into hash ranges; a range adds up all blocks and answers each with
   totals in the order it asked.  Rows of (block, range) without anything to ask don't exist, so there are never more of
   them than there are distinct words in blocks.
3. Counts of ids, and of pairs of rows, are sums over all learning documents; what comes to the driver has at most
   ``VOCAB`` and ``HEADS ** 2`` rows, whatever the corpus.  The weights are fitted on every block: in each of ``ROUNDS``
   rounds a block takes another ``ROUNDS``-th of its windows, long documents' included, from the common weights on, so
   every window is taken, and once where they fill ``ROUND_STEPS`` batches of ``LEAST_BATCH`` (fewer are taken again until
   they do); Spark
   adds up the blocks' weights, each as often as the block has windows, and their mean is common to the next round.  Sums are of whole numbers, so the order of adding does not matter.
4. Ids are scored where they were written; only places of words, and their products rounded down to steps of
   1 / ``STEPS`` in log10, move to meet the answers.

Defined cases: a null or empty text, or one of white space, is the end mark alone; without anything to learn from, the
base is that of no counts and the score is that of the starting model and the text so far; repeated rows, and rows without doc_id, count and return as
often as they come; texts of any length are scored whole and are never cut; other columns are never read, so their names
cannot clash; an empty table gives an empty result.  Ids of equal count have rows in the order of ids.  Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import load_encoder
from .common import batches, id_remainder, slices, texts_of, written
from .wordhash import lowered, words_in

WINDOW, STRIDE, DIM, HEADS, CLASSES, OWN = 24, 16, 16, 1024, 32, 16
LEAD = WINDOW - STRIDE
BLOCK_CHARS, BLOCKS_A_RANGE = 2_000_000, 16
#: Blocks in a row group of their table.  A reader holds a group's columns three times over: as read, as vectors, as Arrow.
BLOCKS_A_GROUP = 2
ROUNDS, ROUND_STEPS, LEAST_BATCH, FIT_BATCH, SEED = 2, 75, 32, 256, 7
#: Windows worked on at once; rows of a head that are added up layer by layer.
AT_ONCE, LAYERS = 256, 16
#: How far back each key of a window is from each query; below 0 it comes after.
AWAY = LEAD + np.arange(STRIDE)[:, None] - np.arange(WINDOW)[None, :]
#: Exponents beyond this are cut; looking for them is left out where weights are too small for any.
MOST = np.float32(60)
#: Shares of the word counts and of the text so far in a token's probability; steps of log10 in which products move.
SHARES = [(w * (1 - q), q) for w in (0.2, 0.5, 0.8) for q in (0.02, 0.1, 0.4)]
STEPS = 256
#: Words that a task keeps with their spelling; numbers that are added up side by side.
KEPT, SIDE = 2**19, 1024
#: Weights are added up as whole numbers of this fraction.
GRAIN = 2.0**-24
VOCAB, END = 50_257, 50_256
PACKS = ("held", "lengths", "ids", "words", "where", "ends")
CONTENT = "block long, doc_ids array<long>, " + ", ".join(f"{c} binary" for c in PACKS)
SCORED = "block long, doc_ids array<long>, held binary, where binary, ends binary, costs binary"
REPORT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"
#: White space that isn't a gap between words, and the sign that stands for it with a letter, so long runs of it stay
#: words and different words have different spellings.
GAPS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u00b7"
INNER_GAPS = re.compile(f"[{GAPS}]")


def packed(x: np.ndarray) -> bytes:
    """Small numbers, after the number of their bytes; hashes and ids would not get much smaller."""
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little")), kind)


def by_plane(x: np.ndarray) -> bytes:
    """Numbers of four bytes, most of them small: all first bytes, then all second ones, and so on."""
    return packed(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Texts with their words and subword ids, each distinct word told apart and spelled once.

    words: sorted hashes of the distinct words; where: place in ``words`` of every word of every text, one after the
    other; ends: where each text's words end in it; ids: subword ids of all texts, each between two end marks; lengths:
    how many of them are each text's; spelled: subword ids, and where each distinct word's begin in them and how many they
    are; new: the same words, ids and numbers of those that ``last``, a block or what is known of several, has not spelled.
    """

    def __init__(self, texts: list[str], encoder, last: Block | Known | None = None):
        data = [lowered(t) for t in texts]
        whole = b"\n".join(data)
        hashes, starts, ends = words_in(whole)
        # like np.unique, whose stable sort takes longer: any place of a word will do
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]][: len(order)]
        self.words, first, self.where = ordered[new], order[new], np.empty(len(order), np.int64)
        self.where[order] = np.cumsum(new) - 1
        self.ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))
        found, lengths, known = np.zeros(0, np.int32), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        offset = np.zeros(len(first), np.int64)
        if last is not None and len(last.words):
            at = np.minimum(np.searchsorted(last.words, self.words), len(last.words) - 1)
            known = last.words[at] == self.words
            found, begins, n = last.spelled
            lengths[known], offset[known] = n[at[known]], begins[at[known]]
        new_ids, new_lengths = spell_joined(joined(whole, starts[first[~known]], ends[first[~known]]), len(first) - int(known.sum()), encoder)
        lengths[~known], offset[~known] = new_lengths, len(found) + np.cumsum(new_lengths) - new_lengths
        ids = np.concatenate([found, new_ids])[np.repeat(offset - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        n = lengths[self.where]
        stop = np.cumsum(n)
        offset = np.cumsum(lengths) - lengths
        self.spelled, self.new = (ids, offset, lengths), (self.words[~known], new_ids, new_lengths)
        flat = ids[np.repeat(offset[self.where] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        at = np.r_[0, stop][np.r_[0, self.ends]]
        self.lengths = np.diff(at) + 2
        last = np.cumsum(self.lengths)
        self.ids = np.full(int(last[-1]), END, np.uint16)
        inner = np.ones(len(self.ids), bool)
        inner[last - 1] = inner[last - self.lengths] = False
        self.ids[inner] = flat


class Known:
    """The words of several blocks, at most about ``KEPT`` of them, as a block has them."""

    def __init__(self):
        self.words, self.spelled = np.zeros(0, np.uint64), (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, block: Block) -> None:
        """Also the new words of a block that was made with these; where they would be too many, only all words of the block."""
        words, found, n = block.new
        if len(self.words) + len(words) > KEPT:
            self.words, self.spelled = block.words, block.spelled
            return
        at, (ids, begins, lengths) = np.searchsorted(self.words, words), self.spelled
        self.words = np.insert(self.words, at, words)
        self.spelled = np.r_[ids, found], np.insert(begins, at, len(ids) + np.cumsum(n) - n), np.insert(lengths, at, n)


def spelled(text: str) -> str:
    return INNER_GAPS.sub(lambda m: "\u00b7" + chr(ord("a") + GAPS.index(m[0])), text)


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words that stand there, each with a space before."""
    n = ends - starts
    inner = np.ones(int((n + 1).sum()), bool)
    inner[np.cumsum(n + 1) - n - 1] = False
    found = np.full(len(inner), 32, np.uint8)
    found[inner] = np.frombuffer(data, np.uint8)[np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)]
    return found.tobytes()


def spell(words: list[bytes], encoder) -> tuple[np.ndarray, np.ndarray]:
    return spell_joined(b"".join(b" " + w for w in words), len(words), encoder)


def spell_joined(words: bytes, n: int, encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of words with a space before each."""
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    text = spelled(words.decode())
    ids = encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    first = np.flatnonzero(opens(encoder)[ids])
    if len(first) == n:
        return ids, np.diff(np.r_[first, len(ids)])
    each = encoder.encode_ordinary_batch([" " + w for w in text[1:].split(" ")], num_threads=1)
    return np.array([i for w in each for i in w], np.int32), np.array([len(w) for w in each])


@lru_cache(2)
def opens(encoder) -> np.ndarray:
    """Ids that begin with a space, and so begin a word."""
    return np.array([i != END and encoder.decode_single_token_bytes(i).startswith(b" ") for i in range(VOCAB)])


def split_at(flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(lengths)[:-1])


def choose_heads(sequences: list[np.ndarray]) -> np.ndarray:
    return heads_of(np.bincount(np.concatenate(sequences), minlength=VOCAB) if sequences else np.zeros(VOCAB, np.int64))


def heads_of(counts: np.ndarray) -> np.ndarray:
    """Row of each id: the most frequent have their own, the last is for all others."""
    head_of = np.full(VOCAB, HEADS - 1, np.int64)
    order = np.lexsort((np.arange(VOCAB), -counts))[: HEADS - 1]
    head_of[order] = np.arange(HEADS - 1)
    return head_of


def cluster(pairs: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Class of each row: the largest have their own, the others are grouped by what stands before and after them."""
    rng = np.random.default_rng(SEED)
    after = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    before = np.sqrt(pairs.T / np.maximum(pairs.sum(axis=0)[:, None], 1)).astype(np.float32)
    x = np.hstack([m @ rng.standard_normal((len(m), 24)).astype(np.float32) for m in (after, before)])
    order = np.argsort(-mass, kind="stable")
    classes = np.zeros(len(mass), np.int64)
    classes[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    centres = x[rest[: CLASSES - OWN]].copy()
    for _ in range(12):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x[rest] @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own := near == c).any():
                centres[c] = x[rest][own].mean(axis=0)
    classes[rest] = OWN + near
    return classes


@dataclass
class Model:
    """head_of and class_of tell an id's row and a row's class.  base: log of each class after each row; within: log10
    of each row in its class after each row; tail: log10 of ids among those of the last row; opening: the share of each
    class after each row that begins a word or ends a text; starts: the ids that begin a word."""

    head_of: np.ndarray
    class_of: np.ndarray
    base: np.ndarray
    within: np.ndarray
    tail: np.ndarray
    opening: np.ndarray
    starts: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, head_of: np.ndarray, counts: np.ndarray, pairs: np.ndarray, opens: np.ndarray) -> Model:
        """What follows from the counts of the whole corpus and from which ids begin words; weights at their start."""
        others = head_of == HEADS - 1
        tail = np.zeros(VOCAB)
        tail[others] = np.log10((counts[others] + 1) / (counts[others] + 1).sum())
        mass = np.bincount(head_of, counts + 1, HEADS)
        class_of = cluster(pairs, mass)
        kinds = (pairs > 0).sum(axis=1, keepdims=True) + 1.0
        p = (pairs + kinds * (mass / mass.sum())) / (pairs.sum(axis=1, keepdims=True) + kinds)
        order = np.argsort(class_of, kind="stable")
        first = np.searchsorted(class_of[order], np.arange(CLASSES))
        by_class = np.add.reduceat(p[:, order], np.minimum(first, HEADS - 1), axis=1)
        by_class[:, np.bincount(class_of, minlength=CLASSES) == 0] = 1e-12
        within = (np.log10(p) - np.log10(by_class)[:, class_of]).astype(np.float32)
        parts = opens | (np.arange(VOCAB) == END)
        share = np.bincount(head_of, np.where(others, 10**tail, 1) * parts, HEADS)
        opening = np.minimum(np.add.reduceat((p * share)[:, order], np.minimum(first, HEADS - 1), axis=1) / by_class, 1)
        rng = np.random.default_rng(SEED)
        init = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        weights = {"q": init(HEADS, DIM), "k": init(HEADS, DIM), "v": init(HEADS, DIM), "near": np.linspace(2, -1, WINDOW, dtype=np.float32), "out": init(DIM, CLASSES)}
        return cls(head_of, class_of, np.log(by_class).astype(np.float32), within, tail, opening.astype(np.float32), opens, weights)

    def windows(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Rows of the ids of each overlapping window and of the id after it, sequence by sequence; -1 fills up."""
        lengths = np.array([len(s) for s in sequences])
        rows = -(-(lengths - 1) // STRIDE)
        sizes = rows * STRIDE + WINDOW
        at = np.cumsum(sizes) - sizes
        padded = np.full(sizes.sum(), -1, np.int16)
        padded[np.arange(lengths.sum()) + np.repeat(at + LEAD - np.cumsum(lengths) + lengths, lengths)] = self.head_of[np.concatenate(sequences)]
        first = np.repeat(at - (np.cumsum(rows) - rows) * STRIDE, rows) + np.arange(rows.sum()) * STRIDE
        return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[first]

    def attend(self, keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention of each query over the window's ids up to its own; q comes back scaled."""
        q, k = taken(self.weights["q"], queries), taken(self.weights["k"], keys)
        q *= np.float32(DIM**-0.5)
        s = q @ k.transpose(0, 2, 1)
        s += self.bias()
        # only before a sequence: what fills up its end comes after every query that counts
        some = np.flatnonzero(keys[:, 0] < 0)
        s[some] += np.where(keys[some] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        if not largest(self.weights["q"]) * largest(self.weights["k"]) * DIM**0.5 + largest(self.weights["near"]) < MOST:
            np.minimum(s, MOST, out=s)
        np.exp(s, out=s)
        s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(1e-30)).reshape(-1, STRIDE, 1)
        return s, q, k

    def pulls(self) -> tuple[np.ndarray, np.ndarray]:
        """For weights that stay as they are: exp of each row's product with each key, and exp of ``bias``."""
        q = apart(self.weights["q"] * np.float32(DIM**-0.5), 16)
        return np.exp(np.minimum(q @ self.weights["k"].T, MOST)).ravel(), np.exp(np.minimum(self.bias(), 20))

    def bias(self) -> np.ndarray:
        """The bias of each (query, key) of a window by their distance; keys after the query are masked."""
        return np.where(AWAY >= 0, self.weights["near"][np.maximum(AWAY, 0)], np.float32(-1e9))

    def logits(self, queries: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        z = (together(mixed) @ self.weights["out"]).reshape(-1, CLASSES)
        z += taken(self.base, queries.ravel())
        # values are mixed by shares, and the base are logs of shares
        if not largest(self.weights["v"]) * largest(self.weights["out"]) * DIM < MOST:
            np.minimum(z, MOST, out=z)
        return z

    def score(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """log10 probability of each id after the first of each sequence."""
        return [logs for logs, _ in self.foresee(sequences)]

    def foresee(self, sequences: list[np.ndarray], pulls: tuple[np.ndarray, ...] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """log10 probabilities of each id after the first, and of any that begins a word or ends the text in its place, many windows at a time."""
        windows, ids = self.windows(sequences), np.concatenate([s[1:] for s in sequences])
        (pull, near), v, within = pulls or self.pulls(), self.weights["v"], self.within.ravel()
        logs, marks = np.empty((len(windows), STRIDE)), np.empty((len(windows), STRIDE), np.float32)
        for i in range(0, len(windows), AT_ONCE):
            w = windows[i : i + AT_ONCE].astype(np.intp)
            keys, q, to = w[:, :WINDOW], w[:, LEAD:WINDOW], w[:, LEAD + 1 :].ravel()
            rows = q * HEADS
            s = taken(pull, rows[:, :, None] + keys[:, None, :])
            s *= near
            some = np.flatnonzero(keys[:, 0] < 0)
            s[some] *= (keys[some] >= 0)[:, None, :]
            mixed = s @ taken(v, keys)
            mixed /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32) + np.float32(1e-30)).reshape(-1, STRIDE, 1)
            z = self.logits(q, mixed)
            q = q.ravel()
            chosen = z.ravel()[np.arange(0, z.size, CLASSES) + taken(self.class_of, to)]
            np.exp(z, out=z)
            total = z @ np.ones(CLASSES, np.float32)
            logs[i : i + AT_ONCE] = ((chosen - np.log(total)) / np.log(10) + taken(within, rows.ravel() + to)).reshape(-1, STRIDE)
            z *= taken(self.opening, q)
            marks[i : i + AT_ONCE] = (z @ np.ones(CLASSES, np.float32) / total).reshape(-1, STRIDE)
        real, ends = np.flatnonzero(windows[:, LEAD + 1 :] >= 0), np.cumsum([len(s) - 1 for s in sequences])[:-1]
        opened = np.log(np.clip(marks.ravel()[real], np.float32(1e-30), np.float32(1))) / np.log(10)
        return list(zip(np.split(logs.ravel()[real] + self.tail[ids], ends), np.split(opened, ends)))

    def fit(self, sequences: list[np.ndarray]) -> Model:
        """All rounds over one block."""
        for turn in range(ROUNDS):
            self.learn(sequences, turn)
        return self

    def learn(self, sequences: list[np.ndarray], turn: int) -> int:
        """Adam over this round's part of the windows, each taken once, or as often as ``ROUND_STEPS`` asks; how many windows there are."""
        if not sequences:
            return 0
        windows = self.windows(sequences)
        own = np.random.default_rng(SEED).permutation(len(windows))[turn::ROUNDS]
        if not len(own):
            return len(windows)
        names, rng = list(self.weights), np.random.default_rng([SEED, turn])
        flat = np.concatenate([self.weights[n].ravel() for n in names])
        ends = np.cumsum([self.weights[n].size for n in names])[:-1]
        self.weights = {n: x.reshape(self.weights[n].shape) for n, x in zip(names, np.split(flat, ends))}
        m, v, g, move = (np.zeros_like(flat) for _ in range(4))
        parts = {n: x.reshape(self.weights[n].shape) for n, x in zip(names, np.split(g, ends))}
        size = min(max(len(own) // ROUND_STEPS, LEAST_BATCH), FIT_BATCH)
        order = np.concatenate([rng.permutation(own) for _ in range(-(-ROUND_STEPS * size // len(own)))])
        steps = -(-len(order) // size)
        for step in range(1, steps + 1):
            rate = 0.02 / (turn + 1) * (1 - step / (steps + 1))
            found = self.gradients(windows[order[(step - 1) * size : step * size]].astype(np.int64))
            for n, part in parts.items():
                part[...] = found[n]
            m += np.multiply(np.subtract(g, m, out=move), np.float32(0.1), out=move)
            g *= g
            g -= v
            v += np.multiply(g, np.float32(0.01), out=g)
            np.sqrt(np.divide(v, np.float32(1 - 0.99**step), out=g), out=g)
            g += np.float32(1e-6)
            np.multiply(m, np.float32(rate / (1 - 0.9**step)), out=move)
            flat -= np.divide(move, g, out=move)
        return len(windows)

    def gradients(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        real, w = (windows[:, LEAD + 1 :] >= 0).sum(), self.weights
        # a place's three rows side by side, so its head is looked up once; the first places are no queries
        rows, out, near = np.empty((len(windows), WINDOW, 3 * DIM), np.float32), 0, 0
        rows[:, :LEAD, :DIM] = 0
        for i in range(0, len(windows), AT_ONCE):
            keys, queries, targets = (windows[i : i + AT_ONCE, x] for x in (slice(WINDOW), slice(LEAD, WINDOW), slice(LEAD + 1, None)))
            a, q, k = self.attend(keys, queries)
            v, row = taken(w["v"], keys), rows[i : i + AT_ONCE]
            mixed = a @ v
            z = self.logits(queries, mixed)
            np.exp(z, out=z)
            share = (targets.ravel() >= 0) / np.float32(max(1, real))
            z *= (share / (z @ np.ones(CLASSES, np.float32) + np.float32(1e-30)))[:, None]
            z.ravel()[np.arange(0, z.size, CLASSES) + taken(self.class_of, targets.ravel())] -= share
            z = together(z.reshape(len(keys), STRIDE, CLASSES))
            out = out + (together(mixed).transpose(0, 2, 1) @ z).sum(axis=0)
            d_mixed = (z @ w["out"].T).reshape(mixed.shape)
            d_s = d_mixed @ v.transpose(0, 2, 1)
            d_s -= np.einsum("bid,bid->bi", d_mixed, mixed)[:, :, None]
            d_s *= a
            near = near + d_s.sum(axis=0)
            np.matmul(d_s, k, out=row[:, LEAD:, :DIM])
            np.matmul(d_s.transpose(0, 2, 1), q, out=row[:, :, DIM : 2 * DIM])
            np.matmul(a.transpose(0, 2, 1), d_mixed, out=row[:, :, 2 * DIM :])
        near = np.bincount(np.maximum(AWAY, 0).ravel(), near.ravel(), WINDOW)[:WINDOW].astype(np.float32)
        found = scatter(windows[:, :WINDOW], rows.reshape(-1, 3 * DIM))
        found[:, :DIM] *= np.float32(DIM**-0.5)
        return {"near": near, "out": out, "q": found[:, :DIM], "k": found[:, DIM : 2 * DIM], "v": found[:, 2 * DIM :]}


def apart(table: np.ndarray, rows: int) -> np.ndarray:
    """A table by so many rows at a time: products of at most 2**18 terms stay on the thread of their task, larger ones start others."""
    return table.reshape(-1, rows, table.shape[-1])


def together(windows: np.ndarray) -> np.ndarray:
    """As many windows at a time as a product with a table of DIM rows and CLASSES columns may have."""
    return apart(windows, math.gcd(len(windows), 2**18 // (DIM * CLASSES * STRIDE)) * STRIDE)


def largest(numbers: np.ndarray) -> float:
    return max(float(numbers.max()), -float(numbers.min()))


def taken(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; -1 is the last."""
    return np.take(table, at, axis=0, mode="wrap")


def scatter(heads: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gradient rows added up by head; -1 is the last, where masks have left zeros.

    The first rows of all heads are added at once, then the second ones, and so on; heads with more than ``LAYERS``
    rows come first and the others by falling number of rows, so each such layer is a slice.  What is beyond ``LAYERS`` belongs to few heads.
    """
    h = heads.ravel().astype(np.int16)
    h[h < 0] = HEADS - 1
    n = np.bincount(h, minlength=HEADS)
    by_size, place = np.argsort((-np.minimum(n, LAYERS + 1)).astype(np.int8), kind="stable"), np.empty(HEADS, np.int16)
    place[by_size] = np.arange(HEADS)
    n, h = n[by_size], taken(place, h)
    order = np.argsort(h, kind="stable")
    layer = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n), LAYERS)
    order = order[np.argsort(layer.astype(np.int8), kind="stable")]
    ordered, found, at = taken(rows, order), np.zeros((HEADS, rows.shape[1]), np.float32), 0
    for size in (HEADS - np.cumsum(np.bincount(np.minimum(n, LAYERS)))[:LAYERS]).tolist():
        found[:size] += ordered[at : at + size]
        at += size
    more = n[n > LAYERS] - LAYERS
    if len(more):
        found[: len(more)] += np.add.reduceat(ordered[at:], np.cumsum(more) - more, axis=0)
    return found[place]


def range_ends(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal hash ranges ends in sorted hashes."""
    return np.searchsorted((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(1, ranges + 1, dtype=np.uint64))


def read_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each block, with all that later steps need of its texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made, known = load_encoder(tokenizer), 0, Known()
        for batch in batches(rows):
            for at, texts in slices(batch, chars=BLOCK_CHARS):
                part = batch.slice(at, len(texts))
                block = Block(texts, encoder, known)
                known.add(block)
                held = np.array(part.column("held_out").to_pylist(), bool)
                stored = held.tobytes(), block.lengths.astype("<u4").tobytes(), block.ids.tobytes(), block.words.tobytes(), by_plane(block.where), block.ends.astype("<u4").tobytes()
                number = (TaskContext.get().partitionId() << 24) + made
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in stored)], ["block", "doc_ids", *PACKS])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CONTENT)


@dataclass
class Stored:
    """A block as ``read_blocks`` wrote it."""

    held: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    where: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Stored:
        kinds = dict(zip(PACKS, ("?", "<u4", "<u2", "<u8", "<u4", "<u4")))
        found = {c: (from_planes(row[c]) if c == "where" else np.frombuffer(row[c], k)) if c in row else None for c, k in kinds.items()}
        return cls(**{c: x.astype(np.int64) if c in ("lengths", "where", "ends") and x is not None else x for c, x in found.items()})

    def taught(self) -> list[np.ndarray]:
        """The sequences that learning may use, in an order that doesn't depend on that of rows."""
        return sorted((s for s, held in zip(split_at(self.ids, self.lengths), self.held) if not held), key=lambda s: s.tobytes())

    def foreseen(self) -> np.ndarray:
        """Places in ``ids`` of all that learning may count as coming after another."""
        own = np.repeat(~self.held, self.lengths)
        own[np.cumsum(self.lengths) - self.lengths] = False
        return np.flatnonzero(own)


def rows_of(found: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches(found):
        yield from batch.to_pylist()


def ask_counts(content: DataFrame, ranges: int) -> DataFrame:
    """For each block and hash range the block's words and what learning may count of them."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(found):
            b = Stored.of(row)
            n = np.bincount(b.where[np.repeat(~b.held, np.diff(np.r_[0, b.ends]))], minlength=len(b.words)).astype("<u4")
            ends = np.r_[0, range_ends(b.words, ranges)]
            some = np.flatnonzero(np.diff(ends)).tolist()
            parts = [slice(ends[r], ends[r + 1]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([b.words[x].tobytes() for x in parts], pa.binary()), pa.array([packed(n[x]) for x in parts], pa.binary())], ["range", "block", "words", "counts"])

    return content.select("block", "held", "words", "where", "ends").mapInArrow(run, "range long, block long, words binary, counts binary")


def answer_counts(asked: DataFrame) -> DataFrame:
    """(block, range, totals, n, v): totals in the order of the block's words; n and v of the range with one of its blocks."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        blocks = t.column("block").to_pylist()
        words = [np.frombuffer(b, "<u8") for b in t.column("words").to_pylist()]
        every, where = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(where, np.concatenate([unpacked(b, "<u4") for b in t.column("counts").to_pylist()]), len(every)).astype(np.int64)
        back = [packed(x) for x in split_at(totals[where].astype("<u4"), np.array([len(w) for w in words]))]
        first = [1] + [0] * (len(blocks) - 1)
        return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "totals": pa.array(back, pa.binary()), "n": pa.array([int(totals.sum()) * f for f in first], pa.int64()), "v": pa.array([int((totals > 0).sum()) * f for f in first], pa.int64())})

    return asked.groupBy("range").applyInArrow(run, "block long, range long, totals binary, n long, v long")


def added(content: DataFrame, each: Callable[[Stored], tuple], size: int, wide: bool = False) -> np.ndarray:
    """Sum of what ``each`` gives for a block (places, whole numbers): tasks add up what they read, and then ``SIDE`` neighbours'
    sums of all tasks, one after the other.

    What comes to the driver has at most ``size`` numbers, whatever the corpus.  They are added in two halves, which
    hold what a long doesn't; ``wide`` ones come back as the nearest doubles.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for row in rows_of(found):
            at, n = each(Stored.of(row))
            total[at] += n
        parts = np.unique(np.flatnonzero(total) // SIDE).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([packed(total[p * SIDE : (p + 1) * SIDE]) for p in parts], pa.binary())], ["part", "n"])

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in rows_of(found):
            n = unpacked(row["n"], "<i8")
            sums[row["part"]] = sums.get(row["part"], 0) + np.stack([n >> 32, n & 2**32 - 1])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "n"])

    found = content.select("held", "lengths", "ids").mapInArrow(run, "part long, n binary").repartition("part").mapInArrow(add, "part long, n binary").toArrow()
    total = np.zeros(size, np.float64 if wide else np.int64)
    for part, data in zip(*(found.column(c).to_pylist() for c in ("part", "n"))):
        high, low = np.frombuffer(data, "<i8").reshape(2, -1)
        total[part * SIDE : part * SIDE + len(low)] = [float((h << 32) + x) for h, x in zip(high.tolist(), low.tolist())] if wide else (high << 32) + low
    return total


def add_ids(content: DataFrame) -> tuple[int, np.ndarray]:
    """Learning documents and counts of ids."""

    def each(b: Stored) -> tuple[slice, np.ndarray]:
        return slice(None), np.r_[(~b.held).sum(), np.bincount(b.ids[b.foreseen()], minlength=VOCAB)]

    total = added(content, each, 1 + VOCAB)
    return int(total[0]), total[1:]


def add_pairs(content: DataFrame, head_of: np.ndarray) -> np.ndarray:
    """Counts of pairs of rows."""

    def each(b: Stored) -> tuple[slice, np.ndarray]:
        heads, at = head_of[b.ids], b.foreseen()
        return slice(None), np.bincount(heads[at - 1] * HEADS + heads[at], minlength=HEADS * HEADS)

    return added(content, each, HEADS * HEADS).reshape(HEADS, HEADS)


def fit_blocks(content: DataFrame, model: Model) -> Model:
    """The model with weights fitted on all blocks, a round at a time."""
    names = list(model.weights)
    shapes = [model.weights[n].shape for n in names]
    ends = np.cumsum([np.prod(x) for x in shapes])
    for turn in range(ROUNDS):
        spread = content.sparkSession.sparkContext.broadcast(replace(model, within=model.within[:0], tail=model.tail[:0], opening=model.opening[:0]))

        def each(b: Stored, turn: int = turn, spread=spread) -> tuple[slice, np.ndarray]:
            own = replace(spread.value, weights={k: w.copy() for k, w in spread.value.weights.items()})
            n = own.learn(b.taught(), turn)
            flat = np.concatenate([own.weights[k].ravel() for k in names]).astype(np.float64)
            return slice(None), np.r_[np.rint(flat / GRAIN).astype(np.int64) * n, n]

        total = added(content, each, int(ends[-1]) + 1, wide=True)
        if total[-1]:
            mean = total[:-1] / total[-1] * GRAIN
            model = replace(model, weights={k: x.reshape(shape).astype(np.float32) for k, x, shape in zip(names, np.split(mean, ends[:-1]), shapes)})
    return model


def costs_of(sequences: list[np.ndarray], foreseen: list[tuple[np.ndarray, np.ndarray]], opens: np.ndarray) -> np.ndarray:
    """Of each word, then the end, of each sequence: minus log10 of its product in whole steps, rounded up."""
    last = np.cumsum([len(s) - 1 for s in sequences]) - 1
    begins = opens[np.concatenate([s[1:] for s in sequences])]
    begins[last] = True
    first = np.flatnonzero(begins)
    logs, marks = (np.concatenate(x) for x in zip(*foreseen))
    after = np.r_[marks[first[1:]], 0]
    after[np.searchsorted(first, last)] = 0
    products = np.add.reduceat(logs, first) - marks[first] + after
    return np.maximum(np.ceil(products * -STEPS), 0).astype("<u4")


def score_blocks(content: DataFrame, model: Model) -> DataFrame:
    """Every block with the costs of its tokens, text by text."""
    spread = content.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pulls = spread.value.pulls()
        for row in rows_of(found):
            b, costs = Stored.of({c: row[c] for c in ("held", "lengths", "ids")}), []
            sequences = split_at(b.ids, b.lengths)
            for i in range(0, len(sequences), 128):
                some = sequences[i : i + 128]
                costs.append(costs_of(some, spread.value.foresee(some, pulls), spread.value.starts))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (row["held"], row["where"], row["ends"], by_plane(np.concatenate(costs))))], ["block", "doc_ids", "held", "where", "ends", "costs"])

    return content.select("block", "doc_ids", "held", "lengths", "ids", "where", "ends").mapInArrow(run, SCORED)


def seen_before(texts: np.ndarray, where: np.ndarray, words: int) -> np.ndarray:
    """How often each word stands earlier in its own text."""
    key = texts * max(1, words) + where
    # numbers of key and place sort faster than places do by key
    place, bits = np.arange(len(key)), len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits < 64:
        both = np.sort(key << bits | place)
        ordered, order = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    first = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]][: len(key)], place, 0))
    found = np.empty(len(key), np.int64)
    found[order] = place - first
    return found


def mixed(counts: np.ndarray, total: int, before: np.ndarray, costs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 of each text's mean probability over ``SHARES``; counts, earlier places and costs of all tokens, ends of texts in them."""
    products, at = costs / -STEPS, np.r_[0, ends[:-1]]
    place = np.arange(len(costs)) - np.repeat(at, ends - at)
    known, again = counts / max(1, total), before / np.maximum(place, 1)
    # parts over the product, as long as that can be written so; far beyond, the product adds nothing
    scale = np.maximum(products, -290.0)
    over = (10.0 ** (np.arange(290 * STEPS + 1) / STEPS))[np.minimum(costs, 290 * STEPS)]
    known, again, own = known * over, again * over, 10.0 ** (products - scale) if (products < scale).any() else 1.0
    whole = np.add.reduceat(scale, at)
    beyond = np.where(known + again == 0, products - scale, 0)
    own = np.where(beyond < 0, 1.0, own)
    whole += np.add.reduceat(beyond, at)
    sums = np.stack([np.add.reduceat(np.log(w * known + q * again + (1 - w - q) * own), at) for w, q in SHARES]) / np.log(10)
    best = sums.max(axis=0)
    return whole + best + np.log10((10.0 ** (sums - best)).mean(axis=0))


def report(scored: DataFrame, totals: DataFrame, end_count: int, total: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, the sum of log10(c + 1) and the score of every row, where places of words meet their counts."""

    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64())])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("range").to_numpy())
        parts = known.column("totals").to_pylist()
        counts = np.concatenate([unpacked(parts[i], "<u4") for i in order]) if len(order) else np.zeros(0, "<u4")
        made = []
        for row in rows.to_pylist():
            ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
            # the end is a token after each text's words
            where = from_planes(row["where"]).astype(np.int64)
            before = seen_before(np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends])), where, len(counts))
            c, before = np.insert(counts[where].astype(np.int64), ends, end_count), np.insert(before, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
            at = np.r_[0, ends[:-1]]
            known_here, logs = np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(c + 1.0), at)
            columns = row["doc_ids"], np.frombuffer(row["held"], bool), ends - at, known_here, logs, mixed(c, total, before, from_planes(row["costs"]), ends)
            made.append(pa.table([pa.array(x, f.type) for x, f in zip(columns, shape)], schema=shape))
        return pa.concat_tables(made) if made else shape.empty_table()

    return scored.groupBy("block").cogroup(totals.select("block", "range", "totals").groupBy("block")).applyInArrow(run, REPORT)


def score_documents(docs: DataFrame, tokenizer: str, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = texts_of(docs).withColumn("held_out", id_remainder(F.col("doc_id"), modulus) == held)
    content = written(read_blocks(docs, tokenizer), "blocks", **{"parquet.block.row.count.limit": str(BLOCKS_A_GROUP)})
    ranges = max(1, -(-content.count() // BLOCKS_A_RANGE))
    answered = written(answer_counts(ask_counts(content, ranges)), "totals")
    n_docs, ids = add_ids(content)
    head_of = heads_of(ids)
    n_words = answered.agg(F.sum("n"), F.sum("v")).first()
    tokens, distinct = (n_words[0] or 0) + n_docs, (n_words[1] or 0) + (n_docs > 0)
    model = fit_blocks(content, Model.start(head_of, ids, add_pairs(content, head_of), opens(load_encoder(tokenizer))))
    below = float(np.log10(float(tokens + distinct + 1)))
    found = report(score_blocks(content, model), answered, n_docs, tokens)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")
