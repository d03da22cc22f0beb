"""How the sources of a language differ in their words: divergences of pairs of sources, and each source's telling terms.

Sort-based streaming.  Tasks take texts apart in slices, sort (term, lang and source, document) and scan the runs for
document frequencies and counts; these partial runs are dealt by (lang, term, source) order into partitions by
(lang, term), sorted there, and a second scan, which holds one run at a time, merges them and drops terms of fewer than
``min_documents`` documents.  A frequent term so costs a row for each slice and source, not one for each document.

A second sorted scan meets all sources of a term and emits partial sums for pairs of sources that both hold it.  What a
pair gains from terms that only one of them holds depends on the count alone, so it comes from each source's histogram
of counts; nothing is done for pairs of sources without the term.  Whole numbers throughout: the sums are exact.

Defined cases: null text, lang and source are the empty string; every row is a document, so repeated rows count each
time, whatever their ids; texts of any length are taken whole (long ones in pieces cut between terms); groups without
terms and languages without kept terms have their pairs, of value 0 in the latter; ties are in UTF-8 order of items;
an empty table gives an empty result; only text, lang and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, slices, written

#: Bytes of text whose terms are sorted together, and the longest piece of one text that is split at once.
SORTED_BYTES = 8_000_000
#: Sources of one language whose pairs a task sums in a matrix; beyond, pairs leave it unsummed.
MATRIX = 1024
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUNS = "lang string, term string, source string, docs long, cnt long"
KEPT = "lang string, term string, source string, cnt long, total long, first boolean"
PAIRS = "lang string, source string, item string, value long"
SCALE = 1_000_000_000


def terms_in(text: str) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of code points from U+0080."""
    return text.encode("utf-8", "replace").translate(_KEEP).split()


def counted(text: str) -> dict[bytes, int]:
    """Counts of a long text's terms, split piece by piece."""
    data, found, start = text.encode("utf-8", "replace").translate(_KEEP), Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + SORTED_BYTES // 2)
        end = len(data) if end < 0 else end
        found.update(data[start:end].split())
        start = end
    return found


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's runs begin: rows that differ from the one before in any column."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Slice:
    """Terms of some documents, to be sorted and scanned for runs."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.columns: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        self.size = 0

    def add(self, text: str, lang: str, source: str) -> None:
        known = self.terms
        if len(text) > SORTED_BYTES // 2:
            found = counted(text)
            ids, weights = [known.setdefault(t, len(known)) for t in found], np.fromiter(found.values(), np.int64, len(found))
        else:
            ids = [known.setdefault(t, len(known)) for t in terms_in(text)]
            weights = np.ones(len(ids), np.int64)
        self.columns.append((np.array(ids, np.int64), weights, self.groups.setdefault((lang, source), len(self.groups)), len(self.columns)))
        self.size += len(text) + 1

    def runs(self) -> pa.RecordBatch | None:
        """A row for each (lang, term, source), in order of the columns."""
        if not self.terms:
            return None
        lengths = [len(ids) for ids, *_ in self.columns]
        term, weight = np.concatenate([c[0] for c in self.columns]), np.concatenate([c[1] for c in self.columns])
        group, doc = np.repeat([c[2] for c in self.columns], lengths), np.repeat([c[3] for c in self.columns], lengths)
        rank_of = np.empty(len(self.terms), np.int64)
        words = sorted(self.terms)
        rank_of[[self.terms[w] for w in words]] = np.arange(len(words))
        names = sorted(self.groups)
        place = np.empty(len(names), np.int64)
        place[[self.groups[g] for g in names]] = np.arange(len(names))
        term, group = rank_of[term], place[group]
        lang_no = np.cumsum([0] + [int(a[0] != b[0]) for a, b in zip(names, names[1:])])[group]
        order = np.lexsort((doc, group, term, lang_no))
        term, group, doc, weight = term[order], group[order], doc[order], weight[order]
        of_docs = starts_of(group, term, doc)
        counts = np.add.reduceat(weight, of_docs)
        term, group = term[of_docs], group[of_docs]
        of_runs = starts_of(group, term)
        docs = np.diff(np.append(of_runs, len(term)))
        counts, term, group = np.add.reduceat(counts, of_runs), term[of_runs], group[of_runs]
        spelled = pa.array([w.decode("utf-8", "replace") for w in words])
        langs, sources = pa.array([g[0] for g in names]), pa.array([g[1] for g in names])
        at = pa.array(group)
        return pa.RecordBatch.from_arrays([langs.take(at), spelled.take(pa.array(term)), sources.take(at), pa.array(docs, pa.int64()), pa.array(counts, pa.int64())], ["lang", "term", "source", "docs", "cnt"])


def partial_runs(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Slice()
    for batch in batches(rows):
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for first, texts in slices(batch):
            for i, text in enumerate(texts, first):
                held.add(text, langs[i], sources[i])
                if held.size >= SORTED_BYTES:
                    yield from filter(None, [held.runs()])
                    held = Slice()
    yield from filter(None, [held.runs()])


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name)
    return values.to_numpy(zero_copy_only=False)


def whole_runs(rows: Iterable[pa.RecordBatch], key: tuple[str, ...], merge) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in chunks that end where a run of ``key`` does; ``merge`` makes what waits smaller."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches(rows):
        fresh = {n: column(batch, n) for n in batch.schema.names}
        held = merge(fresh if held is None else {n: np.concatenate([held[n], fresh[n]]) for n in fresh})
        last = starts_of(*(held[k] for k in key))[-1]
        if last:
            yield {n: c[:last] for n, c in held.items()}
        held = {n: c[last:] for n, c in held.items()}
    if held is not None and len(held[key[0]]):
        yield held


def kept_runs(rows: Iterable[pa.RecordBatch], min_documents: int) -> Iterator[pa.RecordBatch]:
    """Merges the partial runs of each (lang, term, source) and keeps terms that enough documents of the language hold."""

    def merge(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = starts_of(c["lang"], c["term"], c["source"])
        return {n: np.add.reduceat(v, at) if n in ("docs", "cnt") else v[at] for n, v in c.items()}

    for c in whole_runs(rows, ("lang", "term"), merge):
        at = starts_of(c["lang"], c["term"])
        lengths = np.diff(np.append(at, len(c["term"])))
        good = np.repeat(np.add.reduceat(c["docs"], at) >= min_documents, lengths)
        total, first = np.repeat(np.add.reduceat(c["cnt"], at), lengths), np.zeros(len(good), bool)
        first[at] = True
        if good.any():
            out = [pa.array(c[n][good], pa.string()) for n in ("lang", "term", "source")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(c["cnt"][good]), pa.array(total[good]), pa.array(first[good])], ["lang", "term", "source", "cnt", "total", "first"])


def kept_terms(docs: DataFrame, min_documents: int = 3) -> DataFrame:
    """(lang, term, source, cnt, total, first) of each language's kept terms where they occur; total is the language's count."""
    parts = docs.mapInArrow(partial_runs, RUNS)
    ordered = parts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ordered.mapInArrow(lambda rows: kept_runs(rows, min_documents), KEPT)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_terms(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for pairs of sources over terms that both hold, less what the histograms add for these terms.

    Sums wrap around at 2 ** 64 if they must; the value of a pair doesn't, so it comes out right.
    """
    number: dict[str, int] = {}
    sums = np.zeros((0, 0), np.int64)
    lang = None

    def out(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

    def flush() -> Iterator[pa.RecordBatch]:
        names = np.array(list(number), object)
        a, b = np.nonzero(sums[: len(names), : len(names)])
        if len(a):
            yield out(names[a], names[b], sums[a, b])

    for c in whole_runs(rows, ("lang", "term"), lambda c: c):
        at = starts_of(c["lang"], c["term"])
        for start, end in zip(at, np.append(at[1:], len(c["term"]))):
            if c["lang"][start] != lang:
                yield from flush()
                number, sums, lang = {}, np.zeros((0, 0), np.int64), c["lang"][start]
            if end - start < 2:
                continue
            names, p, p0 = c["source"][start:end], c["p"][start:end], c["p0"][start:end]
            for i in range(0, len(p), MATRIX):
                for j in range(0, len(p), MATRIX):
                    a, b = slice(i, i + MATRIX), slice(j, j + MATRIX)
                    more = distance(p[a, None], p[None, b]) - distance(p[a, None], p0[None, b]) - distance(p0[a, None], p[None, b]) + distance(p0[a, None], p0[None, b])
                    if len(p) > MATRIX:
                        x, y = np.nonzero(more)
                        yield out(names[a][x], names[b][y], more[x, y])
                        continue
                    if len(number) + len(p) > 2 * MATRIX:
                        yield from flush()
                        number, sums = {}, np.zeros((0, 0), np.int64)
                    ids = [number.setdefault(n, len(number)) for n in names]
                    if len(number) > len(sums):
                        wider = np.zeros((2 * len(number),) * 2, np.int64)
                        wider[: len(sums), : len(sums)] = sums
                        sums = wider
                    sums[np.ix_(ids, ids)] += more
    yield from flush()


def chance(count: Column | int, of: str) -> Column:
    """1 + floor(10 ** 9 * (count + 1) / of): decimals, so that no count overflows."""
    more = F.lit(count).cast("decimal(20,0)") + 1 if isinstance(count, int) else count.cast("decimal(20,0)") + 1
    ratio = F.call_function("div", more * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(F.col(of), F.lit(0)).cast("decimal(20,0)"))
    return ratio + 1


def apart(p: str, q: str) -> Column:
    """floor((p - q) ** 2 / q) of two columns; below 2 ** 63, for a chance is at most 10 ** 9 + 1."""
    d = F.col(p) - F.col(q)
    return F.call_function("div", d * d, F.col(q))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum over all kept terms for every ordered pair of sources of a language."""
    sized = kept.join(groups, ["lang", "source"]).withColumn("p", chance(F.col("cnt"), "size"))
    met = sized.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    shared = met.mapInArrow(shared_terms, PAIRS).select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    counts = sized.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q"))
    lone = counts.join(other, "lang").where("source <> other")
    away = lambda p, q: F.col("n").cast("decimal(18,0)") * apart(p, q).cast("decimal(19,0)")
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    full = groups.join(held, ["lang", "source"], "left").na.fill(0, ["held"])
    two = full.select("lang", "source", "p0", "vocabulary", "held").join(full.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"), F.col("held").alias("held_2")), "lang").where("source <> item")
    neither = F.coalesce((F.col("vocabulary") - F.col("held") - F.col("held_2")).cast("decimal(18,0)") * apart("p0", "q").cast("decimal(19,0)"), F.lit(0))
    parts = [
        two.select("lang", "source", "item", neither.cast("decimal(38,0)").alias("value")),
        lone.groupBy("lang", "source", F.col("other").alias("item")).agg(exact(away("p", "q")).alias("value")),
        lone.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(exact(away("q", "p")).alias("value")),
        shared.where("source <> item"),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that are likelier in a source than in its language."""
    sized = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), chance(F.col("cnt"), "size").alias("p"), chance(F.col("total"), "lang_size").alias("q"))
    return sized.where("p > q").select("lang", "source", "item", apart("p", "q").alias("value"))


def audit(docs: DataFrame, min_documents: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources and the ``top`` terms of each source."""
    empty = F.lit("")
    read = docs.select(*(F.coalesce(F.col(c), empty).alias(c) for c in ("text", "lang", "source")))
    kept = written(kept_terms(read, min_documents), "divergence-terms")
    counts = kept.groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("cnt").alias("lang_n"), F.count_if("first").alias("vocabulary"))
    groups = read.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "vocabulary"])
    groups = groups.select("lang", "source", "vocabulary", (F.col("n") + F.col("vocabulary")).alias("size"), (F.col("lang_n") + F.col("vocabulary")).alias("lang_size"))
    groups = written(groups.withColumn("p0", chance(0, "size")), "divergence-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pair_values(kept, groups), "pair").unionByName(part(term_values(kept, groups), "term").where(F.col("rank") <= top))


#: The same rows by plain joins, for small tables.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  v AS (SELECT lang, term, COUNT(*)::HUGEINT AS c FROM t GROUP BY ALL HAVING COUNT(DISTINCT doc) >= 3),
  l AS (SELECT lang, SUM(c)::HUGEINT + COUNT(*) AS z FROM v GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  k AS (SELECT lang, source, term, COUNT(*)::HUGEINT AS c FROM t JOIN v USING (lang, term) GROUP BY ALL),
  a AS (SELECT g.lang, g.source, v.term, coalesce(k.c, 0) AS c, v.c AS lc FROM g JOIN v USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
  z AS (SELECT lang, source, SUM(c)::HUGEINT + COUNT(*) AS z FROM a GROUP BY ALL),
  p AS (SELECT a.lang, a.source, term, c, 1 + {SCALE}::HUGEINT * (c + 1) // z.z AS p, 1 + {SCALE}::HUGEINT * (lc + 1) // l.z AS q FROM a JOIN z USING (lang, source) JOIN l ON l.lang = a.lang),
  r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, SUM((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
  SELECT * FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""
