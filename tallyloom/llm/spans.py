"""Spans of regular-expression matches in plain DataFrame functions.

``split`` and ``regexp_extract_all`` walk a text alike, so the lengths of the gaps and of the matches give every
match's place in code points.  Matches are exploded with the length of the gap before them, and a running sum over the
text's matches turns lengths into starts; the work is linear in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(text: Column, pattern: str, trigger: Column) -> Column:
    """[(gap, match)] for the matches of a text, gap being the length of what lies before; null without trigger."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    return F.when(trigger, F.filter(F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"))), lambda x: x["match"].isNotNull()))


def placed(found: DataFrame, key: str, kinds: list[str], *more: str) -> DataFrame:
    """(key, kind_no, kind, match, more fields of a hit, end, start) from a table with a column of hits for each kind."""
    stack = F.array(*(F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), F.col(k).alias("hits")) for i, k in enumerate(kinds)))
    rows = found.select(key, F.explode(stack).alias("x")).select(key, "x.kind_no", "x.kind", F.posexplode("x.hits").alias("nth", "hit"))
    rows = rows.select(key, "kind_no", "kind", "nth", F.col("hit.gap").alias("gap"), F.col("hit.match").alias("match"), *(F.col(f"hit.{m}").alias(m) for m in more))
    end = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy(key, "kind_no").orderBy("nth")).cast("long")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("gap", "nth")


def listed(spans: Column) -> Column:
    """Comma-joined kind:start:end of an ordered array of structs."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
