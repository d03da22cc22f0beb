"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the order of rules is free.  On a sample of documents every rule is timed
and asked; rules are then ordered by rejections per second, each counted over what the rules before it leave, so cheap
and selective ones come first and most rejected documents never meet the dear ones.  The order changes costs, never
verdicts.  What several rules need of a text (words, lines, repeats) is worked out at most once, when first asked for.

Defined cases: null text is empty, has no words and is rejected; repeated rows give repeated rows; texts of any length
are taken whole; only doc_id and text are read, so other columns cannot clash; an empty table gives an empty result;
rules that reject nothing in the sample, or all rules if it is empty, keep the order of costs and then of names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices, texts_of

#: About how many documents rules are timed on.
SAMPLE = 2000
#: Clock readings of a rule on a document, of which the least counts.
TIMINGS = 2
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """A text and what rules ask of it, each worked out once."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        """Parted by space, tab, line feed, vertical tab, form feed and carriage return."""
        return self.text.encode("utf-8", "replace").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.text.encode("utf-8", "replace").split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in any window of three words that the text holds more than once."""
        n = self.n_words - 2
        if n < 2:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in self.words], np.int64)
        two = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, window, times = np.unique(two[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[window] > 1)
        covered = np.zeros(n + 2, bool)
        for k in range(3):
            covered[again + k] = True
        return int(covered.sum())

    @cached_property
    def n_lettered(self) -> int:
        return sum(LETTER.search(w) is not None for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# The limits of published rules for web text, in whole numbers.
BASE = (
    Rule("few words", lambda t: t.n_words < 50),
    Rule("repeated words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("short or long words", lambda t: not 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("repeated lines", lambda t: t.n_dup_lines > 2 and 10 * t.n_dup_lines > 3 * len(t.lines)),
    Rule("words without letters", lambda t: 5 * t.n_lettered < 4 * t.n_words),
    Rule("bullets", lambda t: 10 * sum(line.lstrip().startswith((b"-", b"*", "•".encode())) for line in t.lines) > 9 * len(t.lines)),
    Rule("ellipses", lambda t: 10 * sum(line.rstrip().endswith((b"...", "…".encode())) for line in t.lines) > 3 * len(t.lines)),
)


def measured(rows: Iterable[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    """(seconds, rejected) of every rule, for each document of the sample."""
    for batch in batches(rows):
        for _, texts in slices(batch):
            seconds, rejected = [], []
            for text in texts:
                spent, said = [], []
                for rule in rules:
                    least = float("inf")
                    for _ in range(TIMINGS):
                        fresh, began = Text(text), time.perf_counter()
                        verdict = rule.rejects(fresh)
                        least = min(least, time.perf_counter() - began)
                    spent.append(least)
                    said.append(verdict)
                seconds.append(spent)
                rejected.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(seconds, pa.list_(pa.float64())), pa.array(rejected, pa.list_(pa.bool_()))], ["seconds", "rejected"])


def best_order(rules: Sequence[Rule], seconds: np.ndarray, rejected: np.ndarray) -> list[Rule]:
    """Rules by rejections per second over the documents that those before leave."""
    left, order = np.ones(len(seconds), bool), []
    todo = list(range(len(rules)))
    while todo:
        cost = {i: max(float(seconds[left, i].sum()), 1e-12) for i in todo}
        pick = max(todo, key=lambda i: (rejected[left, i].sum() / cost[i], -cost[i], rules[i].name))
        order.append(rules[pick])
        left &= ~rejected[:, pick]
        todo.remove(pick)
    return order


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The order found on about ``sample`` documents, picked by a hash of their ids over the whole table.

    As many numbers reach the driver as the sample has documents, times rules.
    """
    rows = docs.count()
    if not rows:
        return list(rules)
    part = min(1.0, sample / rows)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))).limit(2 * sample)
    found = picked.mapInArrow(lambda b: measured(b, rules), "seconds array<double>, rejected array<boolean>").toPandas()
    if not len(found):
        return list(rules)
    return best_order(rules, np.array(found.seconds.tolist()), np.array(found.rejected.tolist(), bool))


def first_rejection(text: Text, rules: Sequence[Rule]) -> str | None:
    """The rule that rejects a text; those after it aren't asked."""
    return next((r.name for r in rules if r.rejects(text)), None)


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, *keep: str) -> DataFrame:
    """(doc_id, text, what is to be kept, rejected_by) of all documents; rejected_by is null for those that stay."""
    read = texts_of(docs, "doc_id", "text", *keep)
    order = ordered_rules(read, rules, sample)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            said = [first_rejection(Text(t), order) for _, texts in slices(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, "rejected_by"])

    from pyspark.sql.types import StringType, StructField, StructType

    return read.mapInArrow(run, StructType([*read.schema.fields, StructField("rejected_by", StringType())]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept: base rules are settled by the counts, the others by the cascade."""
    read = texts_of(docs)
    order = [r for r in ordered_rules(read, RULES, sample) if r not in BASE]

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for first, texts in slices(batch):
                counts, failed, kept = [], [], []
                for text in map(Text, texts):
                    counts.append([getattr(text, c) for c in COUNTS])
                    failed.append(any(r.rejects(text) for r in BASE))
                    kept.append(not failed[-1] and first_rejection(text, order) is None)
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])

    return read.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")


#: The same rows in SQL.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
  p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
  t AS (SELECT r, i, word, lead(word) OVER x AS b, lead(word, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
  again AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, word, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
  rep AS (SELECT r, COUNT(DISTINCT i + k) AS n FROM again, range(3) s(k) GROUP BY r),
  n AS (SELECT d.r, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x80-\x{10FFFF}]'))) AS n_lettered,
      len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
    FROM d JOIN w ON w.r = d.r LEFT JOIN rep ON rep.r = d.r),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 3 * n_words AND 10 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
  OR 5 * n_lettered < 4 * n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept FROM f"""
