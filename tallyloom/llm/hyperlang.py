"""Language identification with hyperdimensional profiles.

Every letter, of whatever script, has a random bipolar vector of its own, hashed from its code point; all that is no
letter shares one.  A trigram is bound from its letters' vectors, each permuted by its place; a document bundles its trigrams' vectors; a language prototype bundles the unit profiles of all documents that learning
may use.  A document gets the language whose prototype has the largest cosine with it.

Prototypes are sums over the whole corpus: tasks add up what they read, and Spark adds the partial sums.  Profiles are
rounded before they are added, so the sums don't depend on the order of rows.

Defined cases: a null text or one without letters is ``und`` with score 0; nothing to learn from gives ``und``
throughout; ties go to the language that sorts first; repeated rows count and return as often as they come; texts of
any length are taken whole; other columns take no part and cannot clash; more than MAX_LANGUAGES languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, id_remainder, slices, texts_of
from .wordhash import mix

DIM, SEED, GRAIN = 512, 20_240_117, 10_000
WORDS = DIM // 64
#: Trigrams whose vectors are held at once.
PART = 4096
#: The prototypes go to every task: this many languages at most, of DIM integers each (16 MB).
MAX_LANGUAGES = 4096
PREDICTED = "doc_id long, has_text boolean, lang_pred string, score double"


@lru_cache(1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """DIM random bits for each code point, as words of 64; the same wherever they are asked for."""
    return mix(points.astype(np.uint64)[:, None] * np.uint64(WORDS) + np.arange(WORDS, dtype=np.uint64) + np.uint64(SEED << 32))


def profile(text: str) -> np.ndarray | None:
    """The bundle of a text's trigrams, or None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    points = np.concatenate([[0], np.where(is_letter()[points], points, 0), [0]])
    letters, at = np.unique(points, return_inverse=True)
    n = len(letters)
    if n == 1:
        return None
    grams = ((at[:-2] * n + at[1:-1]) * n + at[2:])[at[1:-1] > 0]
    if n**3 <= 1 << 18:
        counts = np.bincount(grams)
        grams = np.flatnonzero(counts)
        counts = counts[grams]
    else:
        grams, counts = np.unique(grams, return_counts=True)
    bits = letter_vectors(letters)
    first, second = np.roll(bits, 2, axis=1), np.roll(bits, 1, axis=1)
    ones = np.zeros(DIM)
    for i in range(0, len(grams), PART):
        g = grams[i : i + PART]
        bound = first[g // (n * n)] ^ second[g // n % n] ^ bits[g % n]
        ones += counts[i : i + PART].astype(np.float32) @ np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32)
    return counts.sum() - 2 * ones


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / n if n else v


def prototypes(docs: DataFrame, learn: Column, lang_col: str = "lang") -> DataFrame:
    """(lang, at, total): the bundled vector of each language, one row per coordinate."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches(rows):
            langs = batch.column("lang").to_pylist()
            for start, texts in slices(batch):
                for lang, text in zip(langs[start:], texts):
                    if (v := profile(text)) is not None:
                        total = sums.setdefault(lang, np.zeros(DIM, np.int64))
                        total += np.rint(unit(v) * GRAIN).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "part"])

    known = docs.where(learn & F.col(lang_col).isNotNull())
    parts = texts_of(known, "doc_id", "text", F.col(lang_col).cast("string").alias("lang")).select("text", "lang").mapInArrow(run, "lang string, part array<long>")
    return parts.select("lang", F.posexplode("part").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("total"))


def load_prototypes(found: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = found.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda s: s["total"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows.sort(key=lambda r: r["lang"])
    matrix = np.array([unit(np.array(r["v"], np.float64)) for r in rows], np.float64).reshape(len(rows), DIM)
    return [r["lang"] for r in rows], matrix


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, *keep: str) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for start, texts in slices(batch):
                names, scores = [], []
                for text in texts:
                    v = profile(text) if langs else None
                    cosines = matrix @ unit(v).astype(np.float64) if v is not None else None
                    best = -1 if cosines is None else int(np.argmax(np.round(cosines, 9)))
                    names.append("und" if best < 0 else langs[best])
                    scores.append(0.0 if best < 0 else min(1.0, max(0.0, float(cosines[best]))))
                part = batch.slice(start, len(texts))
                kept = [part.column(c) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(scores, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    docs = texts_of(docs, "doc_id", "text", *(k for k in keep if k != "text"))
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, lang_col: str = "lang") -> DataFrame:
    """Learns from rows whose id's remainder isn't ``held`` and predicts all rows."""
    held_out = id_remainder(F.col("doc_id"), modulus) == held
    langs, matrix = load_prototypes(prototypes(docs, ~held_out, lang_col))
    return predict(docs, langs, matrix).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
