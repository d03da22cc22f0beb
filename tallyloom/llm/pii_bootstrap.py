"""Personal data: base patterns, and unseen identifiers by bootstrapped contexts.

What the base patterns find are seeds, each span as one instance.  Other instances are identifier-like tokens (with a
digit) that no base span touches.  Of these, tokens that touch a number which a base rule turned down, such as one of
16 digits that fails its check digit, are known not to be identifiers: their score is held at 0, so they count against
the contexts they stand in, and they are never found.  A lexical pattern is a window of words around an instance, whatever its shape: two
before, one before, one on either side, or two after.  Patterns and tokens form a graph; a pattern's confidence is the
mean score of its tokens, a token's score that no confident pattern is wrong about it, with seeds held at 1.  A few
rounds of joins and aggregations spread scores; in each, a pattern is supported by the tokens accepted so far.  Tokens
that confident patterns reach become new spans of kind ``id``.
Everything is DataFrame functions over one reading of the texts; afterwards only matches move.

Defined cases: null text is empty and has no spans; repeated rows give repeated rows; an empty table gives an empty
result; without seeds nothing is discovered; a token that a base rule turned down anywhere is found nowhere; texts of
any length are read whole, a context up to ``SIDE`` characters from its token; of overlapping spans redaction takes the
first, and of those with one start the one that ends first; columns that are kept keep their names, and rows are told
apart by a number that is written with the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written
from .spans import hits, listed, placed

# The base patterns, written so that no start inside a failed run is tried again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Characters on either side of a match in which words are looked for.
SIDE = 96
KINDS = ["email", "ip", "card", "phone"]


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right is doubled."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(False)
    )


def with_sides(found: Column, text: Column, pattern: str) -> Column:
    """Hits with the two words ``before`` and ``after``: ^ and $ stand for an end of the text, # for what has a digit or is a hit."""
    gaps = F.split(text, pattern, -1)
    n = F.size(gaps)
    words = lambda part: F.regexp_extract_all(F.lower(F.regexp_replace(part, r"\S*[0-9]\S*", " # ")), F.lit(r"[\p{L}\p{M}]+|[#^$]"), F.lit(0))
    before = F.transform(gaps, lambda g, i: F.slice(words(F.concat(F.when(F.length(g) > SIDE, "").when(i > 0, "# # ").otherwise("^ ^ "), F.substring(g, -SIDE, SIDE))), -2, 2))
    after = F.transform(gaps, lambda g, i: F.slice(words(F.concat(F.substring(g, 1, SIDE), F.when(F.length(g) > SIDE, "").when(i < n - 1, " # #").otherwise(" $ $"))), 1, 2))
    sides = F.zip_with(F.slice(before, 1, n - 1), F.slice(after, 2, n - 1), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    joined = F.zip_with(found, sides, lambda h, s: F.struct(h["gap"].alias("gap"), h["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))
    return F.when(found.isNotNull(), joined)


def read_hits(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, doc_id, and what is to be kept) with the hits of each kind and of identifier-like tokens, and the words around each."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    tried = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, digit & text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, digit & text.rlike(CARD)),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
        "token": (TOKEN, digit),
    }
    tried = [with_sides(hits(text, pattern, trigger), text, pattern).alias(k) for k, (pattern, trigger) in tried.items()]
    return written(texts_of(docs, "doc_id", "text", *(k for k in keep if k != "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, *tried), "pii-hits")


def instances(found: DataFrame, tried: DataFrame) -> DataFrame:
    """(row, start, end, token, patterns, seed, rejected): base spans, which are seeds, and identifier-like tokens that
    none touches; rejected are those that touch what a base rule turned down."""
    tokens = placed(found.select("row", "token"), "row", ["token"], "before", "after")
    core = F.regexp_replace(F.col("match"), r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "")
    lead = F.length(F.regexp_extract("match", r"^[^\p{L}0-9+]+", 0))
    tokens = tokens.select("row", (F.col("start") + lead).alias("start"), core.alias("token"), "before", "after")
    tokens = tokens.withColumn("end", F.col("start") + F.length("token"))
    spans = tried.groupBy("row").agg(F.collect_list(F.struct("start", "end", "good")).alias("spans"))
    touched = lambda good: F.coalesce(F.exists("spans", lambda s: (s["good"] == good) & (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), F.lit(False))
    tokens = tokens.join(spans, "row", "left").where(~touched(True)).withColumn("seed", F.lit(False)).withColumn("rejected", touched(False))
    seeds = tried.where("good").withColumnRenamed("match", "token").withColumn("seed", F.lit(True)).withColumn("rejected", F.lit(False))
    before, after = F.array_join("before", " "), F.array_join("after", " ")
    near, next_ = F.try_element_at("before", F.lit(-1)), F.try_element_at("after", F.lit(1))
    patterns = F.filter(F.array(F.concat(before, F.lit(" _")), F.concat(near, F.lit(" _")), F.concat(near, F.lit(" _ "), next_), F.concat(F.lit("_ "), after)), lambda p: p.isNotNull())
    columns = ["row", "start", "end", "token", "before", "after", "seed", "rejected"]
    return tokens.select(columns).unionByName(seeds.select(columns)).select("row", "start", "end", "token", F.array_distinct(patterns).alias("patterns"), "seed", "rejected")


def discover(found: DataFrame, tried: DataFrame, rounds: int = 3, min_confidence: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """(row, start, end) of tokens that confident patterns reach and no base span touches."""
    tokens = written(instances(found, tried), "pii-tokens")
    edges = written(tokens.select(F.explode("patterns").alias("pattern"), "token", "seed", "rejected").groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.max("rejected").alias("rejected")), "pii-edges")
    seeds = edges.groupBy("token").agg(F.max("seed").cast("double").alias("seed"), F.max("rejected").alias("rejected"))
    scores, confident = seeds.select("token", F.col("seed").alias("score")), None
    for _ in range(rounds):
        supported = edges.join(scores, "token").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= min_confidence).alias("accepted"))
        confident = written(supported.where((F.col("accepted") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "confidence"), "pii-patterns")
        reached = edges.join(confident, "pattern").groupBy("token").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("reach"))
        scores = written(seeds.join(reached, "token", "left").select("token", F.greatest("seed", F.when(F.col("rejected"), 0.0).otherwise(F.coalesce("reach", F.lit(0.0)))).alias("score")), "pii-scores")
    good = tokens.where(~F.col("seed") & ~F.col("rejected")).select("row", "start", "end", "token", F.explode("patterns").alias("pattern"))
    good = good.join(confident, "pattern", "left_semi").join(scores.where(F.col("score") >= min_confidence), "token", "left_semi")
    return good.select("row", "start", "end").distinct()


def spans_of(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, doc_id, and what is to be kept) with the spans of every row: base ones and those discovered."""
    found = read_hits(docs, *keep)
    tried = placed(found, "row", KINDS, "before", "after").withColumn("good", valid(F.col("kind"), F.col("match")))
    tried = written(tried.select("row", "kind_no", "kind", "start", "end", "match", "before", "after", "good"), "pii-base")
    base = tried.where("good")
    added = discover(found, tried).select("row", F.lit(len(KINDS)).alias("kind_no"), F.lit("id").alias("kind"), "start", "end")
    spans = base.select(added.columns).unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind_no", "start", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint,kind:string>>")
    return found.select("row", "doc_id", *keep).join(spans.hint("merge"), "row", "left").withColumn("spans", F.coalesce("spans", none))


def pii_report(docs: DataFrame) -> DataFrame:
    rows = spans_of(docs)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    first = F.filter("spans", lambda s: s["kind_no"] < len(KINDS))
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(listed(first), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first of them."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        between = F.concat(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(s["start"] >= acc["pos"], F.array_append(acc["parts"], between)).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, step, finish)).otherwise(text)


def redact(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text, and what is to be kept) with personal data replaced; a null text becomes empty."""
    return spans_of(docs, "text", *keep).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text"), *keep)
