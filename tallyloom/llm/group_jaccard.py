"""Jaccard self-join of documents on word shingles, through a token-group matrix.

1. Every text becomes a set of shingle hashes; equal sets are one node, named by its smallest document.  A node keeps
   its first shingles in an order that puts those common in the corpus last, one more than a set can do without in a pair
   that links (so sets that link share one of them), and a bitmap of its shingles modulo a power of two near 3 n.
   Any order finds all links; it decides only how many candidates fail.  It is learned on every ``ORDER_SHARE``-th
   document, a part that grows with the corpus, and holds at most ``ORDER_SHINGLES`` shingles (16 MB); whatever is beyond
   comes first, by hash.
2. Nodes for which the same kept shingle is the one that most nodes keep, and of about the same size, are a group, in
   pieces of about ``GROUP``; each piece also holds the smallest node of the whole group, which ties its pieces together.
3. Token-group matrix: the union of the members' bitmaps bounds the overlap of a query with the whole group, and a
   member's own bitmap that with the member: a set bit that the other lacks is a shingle that the other lacks.  Only
   groups and members that can reach the threshold by these bounds are opened: their texts are read and compared.
4. Each group is asked by its own members first; links make up components.  Then nodes ask the groups of other
   components with which they share a kept shingle, those of the smaller component asking those of the larger.  All pairs
   that share a kept shingle and aren't in one component by then are bounded or compared, so components lose no link.

Bitmaps move in the place of texts until a pair can link.  Groups and shares of their queries have at most about
``GROUP`` rows each, so a passage, line or near copy that a third of all documents hold is dealt over many tasks.

Defined cases: an empty or null text, or one without words, has no shingles and links with nothing; texts of any length
are compared whole; rows that share a doc_id are one document's and fall into one component (of its texts that no
smaller doc_id has, the one with the smallest hash is compared); a row without doc_id links with nothing and its component is null; repeated
rows give repeated rows; of equally frequent shingles the smaller hash comes first, and a component is named by its
smallest document, so ties never matter; other columns are never read, so their names cannot clash; an empty table gives
an empty result.  Words and shingles are told apart by 64-bit hashes and sets by 128-bit ones: n documents of m shingles
are answered wrongly with a probability below (n m)^2 / 2^64 times the share of pairs that are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, slices, texts_of, written
from .wordhash import STEP, mix, shingles

GROUP = 128
#: Sizes of one group differ by at most about this factor.
GROWTH = 1.25
ORDER_SHARE, ORDER_SHINGLES = 8, 1 << 20
NODE = "node long, n long, key binary, firsts array<long>, bits binary"


def kept(n: int, percent: int) -> int:
    """How many first shingles two sets of at least ``percent`` can't both do without sharing one."""
    return n - -(-percent * n // 100) + 1


def first_shingles(tokens: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, rank = common
    late = np.zeros(len(tokens), "i8")
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        late = np.where(known[at] == tokens, rank[at], 0)
    return tokens[np.argsort(late, kind="stable")[: kept(len(tokens), percent)]].view(np.int64)


def bitmap(tokens: np.ndarray) -> bytes:
    """Which of 2 n to 4 n places, a power of two, some shingle falls on."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    on = np.zeros(size, np.uint8)
    on[tokens & np.uint64(size - 1)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps in ``size`` bytes: places modulo a smaller power of two."""
    while bits.shape[-1] > size:
        bits = bits[..., : bits.shape[-1] // 2] | bits[..., bits.shape[-1] // 2 :]
    return bits


def key_of(tokens: np.ndarray) -> bytes:
    m = mix(tokens)
    return np.array([m.sum(dtype=np.uint64), mix(m + np.uint64(STEP)).sum(dtype=np.uint64)]).tobytes()


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents hold, sorted, with their places in the order from rare to common."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for _, texts in slices(batch):
                found, n = np.unique(np.concatenate([shingles(t, width) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    some = texts_of(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SHARE)) == 0)
    seen = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    top = seen.orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    shown = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shown)
    return shown[order], (len(shown) - np.arange(len(shown)))[order]


def sets_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, key, firsts, bits): the size of each document's set, a hash of it, its first shingles and its bitmap."""
    common = common_shingles(docs, width)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for at, texts in slices(batch):
                sets = [shingles(t, width) for t in texts]
                firsts = [first_shingles(s, percent, common) if len(s) else np.zeros(0, np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]).astype("i4")), pa.array(np.concatenate(firsts)))
                keys, bits = [key_of(s) if len(s) else None for s in sets], [bitmap(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(bits, pa.binary())], ["doc_id", "n", "key", "firsts", "bits"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, key binary, firsts array<long>, bits binary")


def nodes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node) of all keys, and the nodes with what they keep: one for each set, and for ids with several sets one for all."""
    named = written(sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node")), "keys")
    chosen = named.groupBy("node").agg(F.min("key").alias("key"))
    rows = sets.withColumnRenamed("doc_id", "node").join(chosen.hint("merge"), ["node", "key"], "left_semi").dropDuplicates(["node"])
    return named, written(rows.select("node", "n", "key", "firsts", "bits"), "nodes")


def ties(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that share an id and differ in their sets."""
    own = sets.where("key is not null and doc_id is not null").select("doc_id", "key").join(named, "key").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("nodes"))
    return own.where(F.size("nodes") > 1).select("a", F.explode("nodes").alias("b")).where("a <> b")


def shared_firsts(nodes: DataFrame) -> DataFrame:
    """(shingle, node, holders): kept shingles that several nodes have, and how many do."""
    rows = nodes.select("node", F.explode("firsts").alias("shingle"))
    several = rows.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    return rows.join(several.hint("merge"), "shingle")


def grouped(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """(node, n, key, bits, whole, piece, leader) of the nodes with a shared shingle: its group's name, the piece, the group's smallest node."""
    most = held.groupBy("node").agg(F.max(F.struct("holders", "shingle")).alias("most")).select("node", F.col("most.shingle").alias("shingle"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(GROWTH)))
    named = most.join(nodes.select("node", "n", "key", "bits").hint("merge"), "node").withColumn("whole", F.xxhash64("shingle", size)).drop("shingle")
    named = written(named, "grouped")
    wholes = named.groupBy("whole").agg(F.count("*").alias("size"), F.min("node").alias("leader"))
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(GROUP))).cast("int")
    return named.join(wholes.hint("merge"), "whole").select("node", "n", "key", "bits", "whole", piece.alias("piece"), "leader", F.col("size").alias("whole_size"))


class TokenGroups:
    """The token-group matrix of one group: the union of its members' shingles, with the members that hold each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(tokens)])

    def partners(self, q: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with the set q; the group is opened only if q's overlap with the union allows any."""
        at = np.searchsorted(self.union, q)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == q] if len(at) else at
        if 100 * len(at) < percent * max(len(q), int(self.sizes.min())):
            return np.zeros(0, "i8")
        n = self.count[at]
        rows = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.member[rows], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(q) + self.sizes - both))


class BitGroup:
    """The token-group matrix of one group in bitmaps: bounds in the place of overlaps."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.width = min(map(len, maps))
        self.sizes, self.bits = sizes, np.stack([folded(np.frombuffer(b, np.uint8), self.width) for b in maps])
        self.union = np.bitwise_or.reduce(self.bits, axis=0)

    def possible(self, n: int, q: bytes, percent: int) -> np.ndarray:
        """Members that may link with a set of n shingles and the bitmap q."""
        bits = np.frombuffer(q, np.uint8)
        width = min(len(bits), self.width)
        bits, union = folded(bits, width), folded(self.union, width)
        if 100 * (n - int(np.bitwise_count(bits & ~union).sum())) < percent * max(n, int(self.sizes.min())):
            return np.zeros(0, "i8")
        own = folded(self.bits, width)
        most = np.minimum(n - np.bitwise_count(bits & ~own).sum(axis=1, dtype=np.int64), self.sizes - np.bitwise_count(own & ~bits).sum(axis=1, dtype=np.int64))
        return np.flatnonzero(100 * most >= percent * (n + self.sizes - most))


ASKED = ["whole", "piece", "share", "node", "comp"]


def bounded(asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(whole, piece, share, node, comp, key, asks): queries that may link with members of other components, and these."""
    columns = [*ASKED, "n", "key", "bits"]

    def run(asking: pa.Table, holding: pa.Table) -> pa.Table:
        queries, hit = [], np.zeros(holding.num_rows, bool)
        if asking.num_rows and holding.num_rows:
            comps = holding.column("comp").to_numpy()
            group = BitGroup(holding.column("n").to_numpy(), holding.column("bits").to_pylist())
            for i, (comp, n, bits) in enumerate(zip(*(asking.column(c).to_pylist() for c in ("comp", "n", "bits")))):
                found = group.possible(n, bits, percent)
                found = found[comps[found] != comp]
                if len(found):
                    queries.append(i)
                    hit[found] = True
        some = [asking.take(pa.array(queries, pa.int64())), holding.filter(pa.array(hit))]
        some = [t.select([*ASKED, "key"]).append_column("asks", pa.array([asks] * t.num_rows, pa.bool_())) for t, asks in zip(some, (True, False))]
        return pa.concat_tables(some)

    keys = ["whole", "piece", "share"]
    return asked.select(columns).toDF(*columns).groupBy(keys).cogroup(members.select(columns).toDF(*columns).groupBy(keys)).applyInArrow(run, "whole long, piece int, share int, node long, comp long, key binary, asks boolean")


def texts_for(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with its nodes' texts, each read once; rows that share an id are told apart by their keys later."""
    ids = found.select("node").distinct()
    texts = texts_of(docs).withColumnRenamed("doc_id", "node").join(ids.hint("merge"), "node", "left_semi")
    return found.join(texts.hint("merge"), "node")


def opened(found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the queries and members that ``bounded`` left: enough of them to connect whatever links connect."""

    def run(t: pa.Table) -> pa.Table:
        rows = {}
        for i, (node, comp, key, text, asks) in enumerate(zip(*(t.column(c).to_pylist() for c in ("node", "comp", "key", "text", "asks")))):
            known = rows.get((asks, node))
            if known is None and key_of(s := shingles(text, width)) == key:
                rows[asks, node] = (node, comp, s)
        asking, holding = ([r for (asks, _), r in sorted(rows.items()) if asks == kind] for kind in (True, False))
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while c in top:
                c = top[c]
            return c

        links = []
        if asking and holding:
            matrix = TokenGroups([s for _, _, s in holding])
            for node, comp, s in asking:
                for i in matrix.partners(s, percent):
                    low, high = sorted((root(comp), root(holding[i][1])))
                    if low != high:
                        top[high] = low
                        links.append((node, holding[i][0]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return found.groupBy("whole", "piece", "share").applyInArrow(run, "a long, b long")


def linked_through(asked: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between queries and members of their groups' pieces: bounds first, then texts of what is left."""
    found = written(bounded(asked, members, percent), "bounded")
    return written(opened(texts_for(docs, found), width, percent), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node that can be reached."""
    both = written(edges.union(edges.select("b", "a")), "edges").toDF("node", "to")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("to")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # a shortcut: what the label's own label is
        jump = step.groupBy("comp").agg(F.min("low").alias("low2")).withColumnRenamed("comp", "was")
        step = step.join(jump, F.col("comp") == F.col("was")).select("node", "comp", F.least("low", "low2").alias("next"))
        up = labels.select(F.col("node").alias("at"), F.col("comp").alias("upper"))
        step = step.join(up, F.col("next") == F.col("at"), "left").select("node", "comp", F.least("next", F.coalesce("upper", "next")).alias("next"))
        step = written(step, "labels")
        discard(labels)
        if not step.where("comp <> next").limit(1).count():
            discard(both)
            return step.select("node", "comp")
        labels = step.select("node", F.col("next").alias("comp"))


def asked_elsewhere(held: DataFrame, members: DataFrame) -> DataFrame:
    """(node, whole, piece): nodes and the other pieces whose members of other components share a kept shingle with them.

    The node's component is smaller than the largest of those members', or as large and named by less.
    """
    sized = members.groupBy("comp").agg(F.count("*").alias("comp_size"))
    place = members.select("node", "n", "comp", "whole", "piece").join(sized.hint("merge"), "comp").withColumn("rank", F.struct("comp_size", "comp"))
    rows = held.select("shingle", "node").join(place.hint("merge"), "node")
    mixed = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    rows = written(rows.join(mixed.hint("merge"), "shingle", "left_semi").select("shingle", "node", "n", "whole", "piece", "rank"), "mixed")
    pieces = rows.groupBy("shingle", "whole", "piece").agg(F.max("rank").alias("largest"), F.min("n").alias("low"), F.max("n").alias("high"))
    pieces = pieces.withColumnsRenamed({"whole": "to_whole", "piece": "to_piece"})
    apart = (F.col("whole") != F.col("to_whole")) | (F.col("piece") != F.col("to_piece"))
    return rows.join(pieces.hint("merge"), "shingle").where(apart & (F.col("rank") < F.col("largest"))).select("node", "n", "low", "high", F.col("to_whole").alias("whole"), F.col("to_piece").alias("piece"))


def join_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sets = written(sets_of(docs, width, percent), "sets")
    named, nodes = nodes_of(sets)
    held = written(shared_firsts(nodes), "held")
    groups = written(grouped(nodes, held), "groups")
    own = groups.withColumn("share", F.lit(0)).withColumn("comp", F.col("node"))
    # the smallest node of a group in pieces is a member of each
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("whole_size") / F.lit(GROUP)).cast("int") - 1))
    leaders = own.where("node = leader").withColumnRenamed("piece", "at_home").withColumn("piece", pieces).where("piece <> at_home").drop("at_home")
    several = own.where("whole_size > 1")
    links = linked_through(several, several.unionByName(leaders), docs, width, percent).union(written(ties(sets, named), "ties"))
    labels = components(links)
    members = written(groups.join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    size = lambda a, b: F.col(a) * 100 >= F.col(b) * percent
    asked = asked_elsewhere(held, members).where(size("high", "n") & size("n", "low")).select("node", "whole", "piece").distinct()
    asked = written(asked, "asked")
    shares = asked.groupBy("whole", "piece").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("shares"))
    dealt = asked.join(shares.hint("merge"), ["whole", "piece"]).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    dealt = dealt.join(members.select("node", "n", "key", "bits", "comp").hint("merge"), "node")
    holding = members.join(shares.hint("merge"), ["whole", "piece"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    more = linked_through(dealt, holding, docs, width, percent)
    if more.limit(1).count():
        labels = components(links.union(more))
    # rows that share an id join their sets' components
    comp = named.join(labels, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(comp, "key", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


#: The query's rows as DuckDB SQL: all pairs that share a shingle, for small tables.
SQL = """WITH RECURSIVE
  w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
  t AS (SELECT r, word, lead(word) OVER x AS b, lead(word, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
  each AS (SELECT DISTINCT r, concat_ws(' ', word, b, c) AS gram FROM t WHERE c IS NOT NULL UNION ALL SELECT r, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2),
  sets AS (SELECT r, doc_id, COUNT(gram) AS n_shingles FROM w LEFT JOIN each USING (r) GROUP BY ALL),
  met AS (SELECT x.r AS a, y.r AS b, COUNT(*) AS n FROM each x JOIN each y ON x.gram = y.gram AND x.r < y.r GROUP BY ALL),
  links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM met JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * n >= 90 * (x.n_shingles + y.n_shingles - n)),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
  low AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n_shingles, component_id FROM sets LEFT JOIN low USING (doc_id)"""
