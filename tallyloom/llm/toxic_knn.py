"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters) and their first four and five letters; those that depend on the label (chi-square over
the examples) make up the vocabulary, however many they are.  The cosine is over these terms: over all words, texts
meet by their subject, and half of the toxic ones were lost.  Document frequencies are counted over all documents.  A
term's postings name the examples that hold it, in blocks of examples; each block of postings keeps its largest weight, and
these bound the similarity of every example of a block.  Blocks are opened in falling order of their bound until the
k-th best similarity reaches the next bound, so the neighbours are exactly the nearest.  Neighbours vote by
1 / (distance + GAP), distance being that of unit vectors.  The share of toxic votes becomes a probability through a
logistic curve, fitted on the examples, each voted on by the others.

Labelled rows are a sample of at most ``max_labelled`` (smallest hashes of ids), all of which are examples; this bounds
what goes to the driver and to each task.  All else covers all documents.

Defined cases: a text without any term of the vocabulary, an empty or a null one gets the share of toxic rows among
such examples, or among all examples if there is none; without labels every score is 0; rows labelled twice count as toxic if one says
so; of documents that share an id the first text in order is the example; ties in similarity go to the smaller id;
repeated rows give repeated rows; texts of any length are taken whole; other columns take no part and cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, id_remainder, slices, texts_of, written

WORDS = re.compile(r"[^\W\d_]+")
BLOCK, FIRST, GAP, EXACT = 64, 128, 0.1, 9
#: Factors of a word's first five letters in their hash, of which SIEVE bits are kept.
FACTORS, SIEVE = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32), 20


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter of words."""
    found = np.zeros(0x110000, bool)
    for m in WORDS.finditer("".join(map(chr, range(len(found))))):
        found[m.start() : m.end()] = True
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def terms_of(text: str, letters: np.ndarray) -> set[str]:
    """The terms of a text: words, and their openings marked by ^."""
    x = code_points(text.lower())
    words = set(np.where(letters[x], x, np.uint32(32)).tobytes().decode("utf-32-le").split())
    return words.union(["^" + w[:4] for w in words if len(w) > 4], ["^" + w[:5] for w in words if len(w) > 5])


@dataclass
class Finder:
    """Finds the terms of a vocabulary: ``sieve`` tells by hashes of four and five first letters which words may have any."""

    vocabulary: dict[str, int]
    letters: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, vocabulary: dict[str, int]) -> Finder:
        sieve = np.zeros(1 << SIEVE, bool)
        for t in vocabulary:
            first = code_points(t[1:] if t.startswith("^") else t[:5])
            sieve[(first * FACTORS[: len(first)]).sum(dtype=np.uint32) >> (32 - SIEVE)] = True
        return cls(vocabulary, letters(), sieve)

    def known(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the terms of the vocabulary in their order, and how often each stands in it."""
        low = [t.lower() for t in texts]
        whole = "\n".join([*low, "\n" * len(FACTORS)])
        x = code_points(whole)
        letter = self.letters[x]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        edges = np.r_[0, edges] if letter[0] else edges
        starts, ends = edges[::2], edges[1::2]
        four = five = np.zeros(len(starts), np.uint32)
        for i, factor in enumerate(FACTORS):
            four, five = five, five + x[starts + i] * (ends - starts > i) * factor
        some = np.flatnonzero(self.sieve[four >> np.uint32(32 - SIEVE)] | self.sieve[five >> np.uint32(32 - SIEVE)])
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts[some], side="right")
        found: list[dict[int, int]] = [{} for _ in texts]
        get = self.vocabulary.get
        for text, start, end in zip(of.tolist(), starts[some].tolist(), ends[some].tolist()):
            w, counts = whole[start:end], found[text]
            for t in (w, "^" + w[:4], "^" + w[:5]) if len(w) > 5 else (w, "^" + w[:4]) if len(w) > 4 else (w,):
                if (i := get(t)) is not None:
                    counts[i] = counts.get(i, 0) + 1
        ordered = [sorted(counts) for counts in found]
        return [(np.array(at, "i8"), np.array([counts[i] for i in at], "f8")) for at, counts in zip(ordered, found)]


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then those from first[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


@dataclass
class Index:
    """Unit vectors of labelled examples, as postings by term and block of BLOCK examples."""

    finder: Finder
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    lists: np.ndarray  # term: its first block of postings; one more at the end
    blocks: np.ndarray  # block of postings: the block of examples it is about
    bounds: np.ndarray  # block of postings: the largest weight
    postings: np.ndarray  # block of postings: its first posting; one more at the end
    examples: np.ndarray  # posting: the example
    weights: np.ndarray  # posting: the term's weight in the example
    bare: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def build(cls, vocabulary: dict[str, int], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """``held``: for each example its terms and their counts."""
        vectors = [cls.vector(at, n, idf) for at, n in held]
        term = np.concatenate([at for at, _ in held]) if held else np.zeros(0, "i8")
        example = np.repeat(np.arange(len(held)), [len(at) for at, _ in held])
        weight = np.concatenate(vectors) if held else np.zeros(0)
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        n = -(-len(held) // BLOCK)
        key = term * max(n, 1) + example // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "i8")
        bounds = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        lists = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
        return cls(Finder.of(vocabulary), idf, ids, labels.astype("f8"), lists, example[first] // BLOCK, bounds, np.r_[first, len(key)], example, weight)

    @staticmethod
    def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * idf[at]
        return v / math.sqrt(float(v @ v)) if len(v) else v

    def nearest(self, at: np.ndarray, n: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities) of the k examples with the largest cosine, zeros and ``without`` left out."""
        q = self.vector(at, n, self.idf)
        size = self.lists[at + 1] - self.lists[at]
        lists, q = runs(self.lists[at], size), np.repeat(q, size)
        bound = np.bincount(self.blocks[lists], q * self.bounds[lists], -(-len(self.ids) // BLOCK))
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        rank = place[self.blocks[lists]]
        best_i, best_s = np.zeros(0, "i8"), np.zeros(0)
        start, step = 0, FIRST
        while start < len(order) and bound[order[start]] > 0 and (len(best_s) < k or bound[order[start]] >= best_s[-1] - 10.0**-EXACT):
            here = np.flatnonzero((rank >= start) & (rank < start + step))
            first = self.postings[lists[here]]
            size = self.postings[lists[here] + 1] - first
            opened = runs(first, size)
            at = np.repeat((rank[here] - start) * BLOCK, size) + self.examples[opened] % BLOCK
            s = np.bincount(at, np.repeat(q[here], size) * self.weights[opened])
            some = np.flatnonzero(s)
            if len(best_s) == k:
                some = some[s[some] >= best_s[-1] - 10.0**-EXACT]
            i, s = order[start + some // BLOCK] * BLOCK + some % BLOCK, s[some]
            if without >= 0:
                i, s = i[i != without], s[i != without]
            if len(i) > k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * 10.0**-EXACT
                i, s = i[near], s[near]
            i, s = np.concatenate([best_i, i]), np.concatenate([best_s, np.round(s, EXACT)])
            first = np.lexsort((i, -s))[:k]
            best_i, best_s = i[first], s[first]
            start, step = start + step, step * 2
        return best_i, best_s

    def votes(self, at: np.ndarray, n: np.ndarray, k: int, without: int = -1) -> tuple[float | None, np.ndarray]:
        """(share of toxic votes or None without neighbours, the examples that voted) for a text with these terms."""
        if not len(at):
            return None, at
        i, s = self.nearest(at, n, k, without)
        if not len(i):
            return None, i
        w = 1 / (np.sqrt(np.maximum(2 - 2 * s, 0)) + GAP)
        return float(w @ self.labels[i] / w.sum()), i

    def score(self, at: np.ndarray, n: np.ndarray, k: int) -> tuple[float, list[int]]:
        share, i = self.votes(at, n, k)
        if share is None:
            return self.bare, []
        return float(1 / (1 + math.exp(-(self.slope * share + self.offset)))), self.ids[i].tolist()


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the most likely curve, with targets drawn a little inwards so that it stays finite."""
    pos = float(y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(move, -4, 4)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, k: int = 11, max_labelled: int = 20_000, min_chi2: float = 25.0, min_rows: int = 5, label_col: str = "toxic") -> Index:
    """The index, learned from labelled rows that satisfy ``learn`` (over labels' doc_id).

    Terms are those in at least ``min_rows`` examples whose chi-square with the label is at least ``min_chi2``.
    """
    spark = docs.sparkSession
    rows = labels.where(learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = texts_of(docs).join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    sample = written(sample, "labelled")

    table = spark.sparkContext.broadcast(letters())

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for batch in batches(found):
            marks = batch.column("label").to_pylist()
            for at, texts in slices(batch):
                for mark, text in zip(marks[at:], texts):
                    n[mark > 0].update({"": 1})
                    n[mark > 0].update(terms_of(text, table.value))
        terms = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    counts = sample.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    toxic, clean = sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    a, b = F.col("a"), F.col("b")
    c, d = toxic - a, clean - b
    below = (a + b).cast("double") * (c + d) * float(max(toxic, 1)) * float(max(clean, 1))
    chi2 = F.when(below > 0, (toxic + clean) * F.pow((a * d - b * c).cast("double"), 2) / below).otherwise(0.0)
    kept = counts.where("term <> ''").where(((a + b) >= min_rows) & (chi2 >= min_chi2)).select("term")
    vocabulary = {t: i for i, t in enumerate(sorted(r["term"] for r in kept.collect()))}
    spread = spark.sparkContext.broadcast(Finder.of(vocabulary))

    def frequencies(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(spread.value.vocabulary) + 1, "i8")
        for batch in batches(found):
            for _, texts in slices(batch):
                df[-1] += len(texts)
                for at, _ in spread.value.known(texts):
                    df[at] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["at", "n"])

    df = np.zeros(len(vocabulary) + 1)
    for r in texts_of(docs).select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]

    def vectors(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            held = [x for _, texts in slices(batch) for x in spread.value.known(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([at for at, _ in held], pa.list_(pa.int64())), pa.array([n for _, n in held], pa.list_(pa.float64()))], ["doc_id", "label", "at", "n"])

    made = sample.mapInArrow(vectors, "doc_id long, label int, at array<long>, n array<double>").collect()
    made.sort(key=lambda r: r["doc_id"])
    held = [(np.array(r["at"], "i8"), np.array(r["n"], "f8")) for r in made]
    label = np.array([r["label"] > 0 for r in made], "f8")
    index = Index.build(vocabulary, np.log((df[-1] + 1) / (df[:-1] + 1)) + 1, np.array([r["doc_id"] for r in made], "i8"), label, held)
    shared = spark.sparkContext.broadcast(index)

    def left_out(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            at = np.searchsorted(shared.value.ids, batch.column("doc_id").to_numpy())
            shares = [shared.value.votes(*x, k, int(at[start + i]))[0] for start, texts in slices(batch) for i, x in enumerate(shared.value.finder.known(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(shares, pa.float64())], ["doc_id", "label", "share"])

    voted = sample.mapInArrow(left_out, "doc_id long, label int, share double").collect()
    voted.sort(key=lambda r: r["doc_id"])
    some = np.array([r["share"] is not None for r in voted], bool)
    if some.any():
        index.slope, index.offset = logistic(np.array([r["share"] for r in voted if r["share"] is not None]), label[some])
    if len(label):
        index.bare = float(label[~some].mean() if (~some).any() else label.mean())
    discard(sample)
    return index


def score(docs: DataFrame, index: Index, k: int = 11, *keep: str) -> DataFrame:
    """doc_id, score and the ids of the examples that voted."""
    spread = docs.sparkSession.sparkContext.broadcast(index)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for at, texts in slices(batch):
                done = [spread.value.score(*x, k) for x in spread.value.finder.known(texts)]
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *keep)), pa.array([s for s, _ in done], pa.float64()), pa.array([e for _, e in done], pa.list_(pa.int64()))], ["doc_id", *keep, "score", "evidence"])

    docs = texts_of(docs, "doc_id", "text", *(k for k in keep if k != "text"))
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", score double, evidence array<long>")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), modulus) == held
    scored = score(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
