"""Secret scans over all historical versions of files, through a ledger of blobs.

Every version is addressed by the hash of its content.  The ledger is a table, at a path that outlives a run, of (blob,
rule, version of the rule) that have been scanned, with what was found.  A run compares hashes with it first; only
texts of blobs that it lacks for some rule move, once, to meet their copies, are scanned for the rules they lack, and
are appended.  Findings are joined back from the ledger to every path that ever held a blob.  The report takes its
documents in increments, as a history arrives: later ones scan only what earlier ones haven't.  Everything is DataFrame
functions.

Defined cases: null text is the empty blob; it and blobs without findings give zero counts and empty span lists;
repeated rows give repeated rows; an empty table gives an empty result; two runs over the same blobs scan once; a rule
whose pattern changes needs a new version, under which all blobs are scanned again; a run that is lost before it
appends leaves the ledger as it was; texts of any length are scanned whole; of matches at one start the rule listed
first comes first; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, texts_of, written
from .spans import hits, listed, placed

# The patterns of the three base kinds, and the header of a private key.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    trigger: str  # what a text must match for the pattern to be tried
    base: bool = True

    def keep(self, match: Column) -> Column:
        if self.kind == "assign":
            return F.length(F.regexp_extract(match, "^" + self.pattern + "$", 1)) >= 6
        return F.length(match) >= {"access": 20, "hex": 24}.get(self.kind, 1)


RULES = [
    Rule("assign", 1, ASSIGN, r"(?i:passw|secret|token|api_?key)"),
    Rule("access", 1, ACCESS, "AKIA"),
    Rule("hex", 1, HEX, HEX),
    Rule("key_block", 1, KEY_BLOCK, "-----BEGIN ", False),
]
LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """(blob, text, rules): the content of each blob that some rule's version hasn't scanned, and those rules.

    What is to be scanned is settled by hashes alone, before any text moves.
    """
    names = F.array(*(F.lit(f"{r.kind}/{r.version}") for r in rules))
    blobs = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs(versions).withColumn("rules", names)
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", F.col("version").cast("string"))).alias("done"))
    todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    lacking = versions.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)
    lacking = written(lacking, "unseen-blobs")
    return blobs(versions.join(lacking, "blob", "left_semi")).join(lacking, "blob")


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Ledger rows for the given blobs: one for each blob and rule, with the spans found."""
    text = F.col("text")
    tried = [hits(text, r.pattern, F.array_contains("rules", f"{r.kind}/{r.version}") & text.rlike(r.trigger)).alias(r.kind) for r in rules]
    found = written(blobs.select("blob", "rules", *tried), "blob-hits")
    kinds = [r.kind for r in rules]
    spans = placed(found, "blob", kinds)
    good = F.lit(False)
    for r in rules:
        good = good | ((F.col("kind") == r.kind) & r.keep(F.col("match")))
    spans = spans.where(good).groupBy("blob", "kind").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pairs = found.select("blob", F.explode("rules").alias("pair")).select("blob", F.split("pair", "/")[0].alias("rule"), F.split("pair", "/")[1].cast("int").alias("version"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return pairs.join(spans.withColumnRenamed("kind", "rule"), ["blob", "rule"], "left").select("blob", "rule", "version", F.coalesce("spans", none).alias("spans"))


def addressed(versions: DataFrame) -> DataFrame:
    return texts_of(versions).withColumn("blob", F.sha2("text", 256))


def findings(versions: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, blob, found) of each row: the spans that the current rules' versions have in the ledger."""
    current, order = F.lit(False), F.lit(0)
    for i, r in enumerate(rules):
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
        order = F.when(F.col("rule") == r.kind, i).otherwise(order)
    found = ledger.where(current & (F.size("spans") > 0)).select("blob", F.col("rule").alias("kind"), order.alias("kind_no"), F.explode("spans").alias("s"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", "kind_no", "s.end", "kind"))).alias("found"))
    return addressed(versions).select("doc_id", "blob").join(found, "blob", "left")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings for each row of ``versions`` (doc_id, text), the ledger with the new scans)."""
    fresh = written(scan(unseen(addressed(versions), ledger, rules), rules), "ledger")
    full = fresh if ledger is None else ledger.unionByName(fresh)
    return findings(versions, full, rules), full


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, or None if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if known else None


def extend_ledger(versions: DataFrame, path: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends it there, and returns these new rows."""
    fresh = written(scan(unseen(addressed(versions), read_ledger(versions.sparkSession, path), rules), rules), "scanned")
    fresh.write.mode("append").parquet(path)
    return fresh


#: Parts of the history that a report takes one after the other.
INCREMENTS = 2


def secret_report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """What the rules find in every document, through the ledger at ``ledger_path``, which is kept for the next run;
    without a path the ledger is a table of this run."""
    path = ledger_path or shared_path(docs.sparkSession, "secret-ledger")
    for i in range(INCREMENTS):
        extend_ledger(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(INCREMENTS)) == i), path)
    found = findings(docs, read_ledger(docs.sparkSession, path))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    spans = F.coalesce("found", none)
    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
