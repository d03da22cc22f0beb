"""Whitening, quality rules and source divergence against plain versions, with odd rows and skewed groups."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallyloom.llm import quality_cascade, source_divergence, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value long, rank string, kept string, words array<string>"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, 1, "x", None, None) for i, t, lang, source in rows], SCHEMA)


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return con.execute(sql).fetchall()


def mixed_documents(n=160, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "näive", "Ünï", "x1y", "don't", "中文", "a_b", "É", "zz", "q r", " "] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        lang, source = ("en" if i % 3 else rng.choice(["fr", None, ""])), rng.choice(["a", "b", "hot", "hot", "hot", None])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), lang, source))
    return rows + [(7, None, "en", "a"), (7, "", "lone", "only"), (8, "once", "lone", "other"), rows[3], rows[3], (None, "the the\tTHE", "en", "late"), (9, "the " * 30000 + "end", "en", "long")]


# --- source divergence


def plain_audit(rows, min_documents=3, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for _, text, lang, source in rows]
    df, by_group, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        df[lang].update(set(found))
        by_group[lang, source].update(found)
        by_lang[lang].update(found)
    out = []
    for lang, source in by_group:
        kept = [t for t, c in df[lang].items() if c >= min_documents]

        def chances(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p, f = chances(by_group[lang, source]), lambda a, b: (a - b) ** 2 // b
        pairs = []
        for other in {s for l, s in by_group if l == lang and s != source}:
            q = chances(by_group[lang, other])
            pairs.append((sum(f(p[t], q[t]) for t in kept), other))
        q = chances(by_lang[lang])
        terms = [(f(p[t], q[t]), t) for t in kept if by_group[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ordered, 1) if part == "pair" or i <= top]
    return sorted(out)


def audited(spark, rows, **kw):
    return sorted(tuple(r) for r in source_divergence.audit(table(spark, rows), **kw).collect())


def test_divergence_is_that_of_plain_counts_and_of_sql(spark, monkeypatch):
    rows = mixed_documents()
    want = plain_audit(rows)
    assert audited(spark, rows) == want and want == sorted(by_sql(rows, source_divergence.SQL))
    assert audited(spark, rows, min_documents=5, top=3) == plain_audit(rows, 5, 3)
    assert audited(spark, []) == []


def test_divergence_over_small_slices_matrices_and_batches(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "SORTED_BYTES", 300)
    monkeypatch.setattr(source_divergence, "MATRIX", 2)
    rows = mixed_documents(60)
    pieces = source_divergence.Slice()
    pieces.add("ab " * 500 + "Cd", "en", "a")
    assert pieces.runs().to_pylist() == [{"lang": "en", "term": "ab", "source": "a", "docs": 1, "cnt": 500}, {"lang": "en", "term": "cd", "source": "a", "docs": 1, "cnt": 1}]
    parts = list(source_divergence.partial_runs(table(spark, [(i, t or "", l or "", s or "") for i, t, l, s in rows]).select("text", "lang", "source").toArrow().to_batches(7)))
    assert len(parts) > 10
    import pyarrow as pa

    whole = pa.Table.from_batches(parts).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
    for size in (1, 2, 1000):
        kept = pa.Table.from_batches(list(source_divergence.kept_runs(whole.to_batches(size), 3)))
        counts = {(r["lang"], r["term"], r["source"]): r["cnt"] for r in kept.to_pylist()}
        assert sum(counts.values()) == sum(r["total"] for r in kept.to_pylist() if r["first"]) and len(counts) == kept.num_rows
        sized = kept.append_column("p", pa.array([100 + 7 * c for c in kept["cnt"].to_pylist()])).append_column("p0", pa.array([3 + len(s) for s in kept["source"].to_pylist()]))
        got, want = Counter(), Counter()
        for batch in source_divergence.shared_terms(sized.to_batches(size)):
            for r in batch.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["value"]
        f = lambda a, b: (a - b) ** 2 // b
        groups = defaultdict(list)
        for r in sized.to_pylist():
            groups[r["lang"], r["term"]].append(r)
        for (lang, _), held in groups.items():
            for x in held:
                for y in held:
                    want[lang, x["source"], y["source"]] += f(x["p"], y["p"]) - f(x["p"], y["p0"]) - f(x["p0"], y["p"]) + f(x["p0"], y["p0"])
        clean = lambda c: {k: v for k, v in c.items() if v and k[1] != k[2]}
        assert clean(got) == clean(want)


def test_counts_beyond_64_bits_of_the_scaled_product(spark):
    found = spark.createDataFrame([(10**12, 10**14)], "cnt long, size long").select(source_divergence.chance(source_divergence.F.col("cnt"), "size")).first()[0]
    assert found == 1 + 10**9 * (10**12 + 1) // 10**14


# --- quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def quality_texts():
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    good = prose(80)
    texts = [good, good, None, "", " \t\n\v", prose(49), "a b c a b c a b c x", "a b c " * 40, prose(70) + " #" * 20, "\n".join([prose(10)] * 5) + "\n" + prose(60), "• " + "\n- ".join(prose(8) for _ in range(12)), "...\n".join(prose(9) for _ in range(9)), "12 34 5678 " + " ".join(str(rng.random()) for _ in range(90)), "x" * 900 + " " + prose(60), "\x1c\x85 ".join(prose(60).split()), "wort zwei " + prose(60), "\r\n".join(prose(12) for _ in range(9)), prose(40000)]
    return texts + ["a\n \na\n" + prose(50), "a\nb\na\n" * 20]


def test_quality_is_that_of_plain_counts_and_of_sql(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(quality_texts())] + [(0, quality_texts()[0], None, None), (None, "no id", None, None)]
    got = [tuple(r) for r in quality_cascade.quality_report(table(spark, rows)).collect()]
    assert [r[:-1] for r in got] == [(i, *plain_counts(t)) for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(by_sql(rows, quality_cascade.SQL), key=key)
    assert got[0][-1] and got[0][1:] == got[1][1:] and not any(got[i][-1] for i in (2, 3, 5, 7, 8, 9, 10, 11, 12))
    assert quality_cascade.quality_report(table(spark, [])).count() == 0


def test_the_cascade_keeps_the_same_documents_in_any_order_and_stops_early(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(quality_texts())]
    docs = table(spark, rows)
    kept = {r["doc_id"] for r in quality_cascade.filter_documents(docs, quality_cascade.RULES, 2000, "lang").where("rejected_by is null").collect()}
    assert kept == {r["doc_id"] for r in quality_cascade.quality_report(docs).where("kept").collect()} and kept
    for order in (quality_cascade.RULES, quality_cascade.RULES[::-1]):
        assert {i for i, t, *_ in rows if quality_cascade.first_rejection(quality_cascade.Text(t or ""), order) is None} == kept
    asked = []
    rules = [quality_cascade.Rule(n, lambda t, n=n: asked.append(n) or n == "b") for n in "abc"]
    assert quality_cascade.first_rejection(quality_cascade.Text("x"), rules) == "b" and asked == ["a", "b"]


def test_order_is_by_rejections_per_cost_over_what_is_left():
    rules = [quality_cascade.Rule(n, bool) for n in ("dear", "cheap", "implied", "never")]
    seconds = np.array([[10.0, 1.0, 1.1, 0.1]] * 4)
    rejected = np.array([[1, 1, 1, 0], [1, 1, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]], bool)
    assert [r.name for r in quality_cascade.best_order(rules, seconds, rejected)] == ["cheap", "dear", "never", "implied"]


# --- whitening


def plain_whitening(vectors):
    x = np.array([[math.floor(64 * float(np.float32(e))) + 1000000 for e in v] for v in vectors])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    v = (u - s / n).T @ (u - s / n) / n
    values, axes = np.linalg.eigh(v)
    return x, n, s, values[::-1], axes[:, ::-1], np.trace(v)


def test_whitening_of_distinct_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))
    vectors = [*base.tolist(), *([base[0].tolist()] * 100)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * 18, 1), (903, [float("nan")] + [0.0] * 19, 1), (904, [float("inf")] * 20, 1), (905, [1.0, 2.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, component int")).toPandas()
    x, n, s, values, axes, trace = plain_whitening(vectors)
    assert n == 200 and len(got) == 300 * 16 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in range(16):
        of = got[got.component == k + 1].sort_values("vec_id")
        want = (x - s / n) @ axes[:, k] / np.sqrt(values[k])
        assert of.vec_id.tolist() == list(range(300)) and min(np.abs(of.whitened - want).max(), np.abs(of.whitened + want).max()) < 1e-8
        assert abs(of.explained.iloc[0] - values[k] / trace) < 1e-12 and of.deviation.tolist() == ((n * x - s) ** 2).sum(1).tolist()


def test_whitening_of_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-50, 50, 40) / 64
    vectors = [[float(v), float(v), 0.25] for v in a]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 120 and set(got[got.component > 1].whitened) == {0.0} and got.identity_error.max() < 1e-9 and abs(got[got.component == 1].explained.iloc[0] - 1) < 1e-9
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["whitened"], r["deviation"], r["n"]) for r in one] == [(1, 0.0, 0, 1)] * 2 + [(None, 0.0, 0, 1)] * 2
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<float>"))
