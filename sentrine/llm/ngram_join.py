"""N-gram Jaccard join over prefix trees.

Every document becomes its set of word n-grams, kept in one global order (rare first). Documents that can be
similar share one of the first few grams of that order, so these prefixes give the candidates; what a pair's two
prefixes share bounds what their sets can share, and few pairs pass. The sets of those are stored per hub document
in a trie, and the hub's set is walked through it once: a path that several sets share is compared once, and a
subtree is left as soon as the grams still to come cannot reach the threshold for any length below it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrine.llm.common import gram_hashes
from sentrine.operators.components import connected_components
from sentrine.storage import drop, materialize, release

BUCKETS = 1 << 16
BLOCK = 64  # candidates in one trie
FEW = 500_000  # rows of 24 bytes that may be broadcast
_SIGN = np.uint64(1 << 63)


def ordered(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The distinct hashes with their leading 16 bits, the counting bucket, replaced by the bucket's rank: sorted, rare first."""
    top = rank[(h >> np.uint64(48)).astype(np.int64)].astype(np.uint64)
    return np.unique((top << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)))


def bucket_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """Rank of each of 65,536 hash buckets by how many grams of the whole corpus fall in it.

    What comes to the driver is this table of fixed size, whatever the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i in range(0, len(texts), 256):
                grams = np.concatenate(gram_hashes(texts[i : i + 256], n))
                total += np.bincount((grams >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    rank = np.empty(BUCKETS, np.int64)
    rank[np.lexsort((np.arange(BUCKETS), total))] = np.arange(BUCKETS)
    return rank


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes a and b with den * intersection >= num * union."""
    return -((-num * (a + b)) // (num + den))


def _walk(query: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> Iterator[int]:
    """Positions in ``sets`` (sorted as sequences) of those similar to ``query``; the trie is the sorted list itself."""
    nq, size = len(query), np.array([len(s) for s in sets])
    want = np.array([needed(nq, int(k), num, den) for k in size])
    todo = [(0, len(sets), 0, 0)]
    while todo:
        lo, hi, depth, overlap = todo.pop()
        first, last = sets[lo], sets[hi - 1]
        m = min(len(first), len(last)) - depth  # the run of grams that the whole subtree shares
        differ = np.flatnonzero(first[depth : depth + m] != last[depth : depth + m])
        end = depth + (int(differ[0]) if len(differ) else m)
        if end > depth:
            run = first[depth:end]
            at = np.searchsorted(query, run)
            overlap += int((query[np.minimum(at, nq - 1)] == run).sum())
            left = nq - int(np.searchsorted(query, run[-1], "right"))
        else:
            left = nq
        can = overlap + np.minimum(size[lo:hi] - end, left) >= want[lo:hi]
        if not can.any():
            continue
        while lo < hi and len(sets[lo]) == end:  # sets that end here come first
            if overlap >= want[lo]:
                yield lo
            lo += 1
        while lo < hi:
            gram, a, b = sets[lo][end], lo, hi
            while a < b:
                mid = (a + b) // 2
                if sets[mid][end] <= gram:
                    a = mid + 1
                else:
                    b = mid
            todo.append((lo, a, end, overlap))
            lo = a


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (hub, doc) that are similar. The candidates of a hub are dealt out in blocks; each block is one trie."""
    heavy = materialize(pairs.groupBy("hub").count().where(F.col("count") > BLOCK).select("hub", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    dealt = materialize(pairs.join(heavy, "hub", "left").select("hub", "doc", F.expr("int(pmod(xxhash64(doc), coalesce(parts, 1)))").alias("part")))
    hubs = dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("doc"), F.lit(0).alias("role"))
    rows = hubs.union(dealt.select("hub", "part", "doc", F.lit(1).alias("role")))
    rows = rows.join(sets, rows["doc"] == sets["node"]).select("hub", "part", "role", "doc", "grams")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, query, block = None, None, []

        def flush():
            block.sort(key=lambda x: x[0])
            got = [block[i][1] for i in _walk(query, [np.frombuffer(x[0], ">u8").astype(np.uint64) for x in block], num, den)] if block else []
            return pd.DataFrame({"hub": np.full(len(got), key[0] if key else 0, np.int64), "doc": np.array(got, np.int64)})

        for pdf in batches:
            for hub, part, role, doc, grams in pdf.itertuples(index=False):
                if (hub, part) != key:
                    if block:
                        yield flush()
                    key, query, block = (hub, part), None, []
                if role == 0:
                    query = np.frombuffer(grams, ">u8").astype(np.uint64)
                else:
                    block.append((bytes(grams), doc))
        if block:
            yield flush()

    out = materialize(rows.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", "role").mapInPandas(verify, "hub long, doc long"))
    drop(heavy, dealt)
    return out


def _least(n1: Column, n2: Column, num: int, den: int) -> Column:
    """``needed`` of two columns, in whole numbers."""
    return F.call_function("div", F.lit(num).cast("long") * (n1 + n2) + F.lit(num + den - 1), F.lit(num + den))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, all_links: bool = True) -> DataFrame:
    """Group documents whose n-gram sets have ``den * intersection >= num * union``.

    Input: ``doc_id`` and ``text``; other columns are ignored. Returns one row per input row: ``doc_id``,
    ``n_shingles`` (size of the set), ``component_id`` (smallest doc_id reachable by links, itself included) and
    ``n_links`` (other distinct sets linked to this row's set). Without ``all_links`` the components are the same
    and found sooner, but ``n_links`` is null.

    A text of fewer than n words is one gram; a null or blank text has an empty set, links to nothing and is its
    own component. Rows that repeat a doc_id are judged one by one, whatever their order: sets are known by their
    contents, not by ids. Rows without doc_id keep their count and have a null component; they take no part in
    links. Grams are compared by 64-bit hashes, whole sets by 128 bits.

    Equal sets are collapsed first, so a group of copies costs one set. Candidates come from shared prefix grams:
    first each gram's rarest-first list is tried against its smallest and largest member (linear in the list),
    links found there are contracted, and the other members of a list are tried pairwise, with the length and
    position bounds applied inside the join; without ``all_links`` only those still in different components. Of
    the pairs, those go on whose whole prefixes share enough; only their sets are made and moved.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rank = spark.sparkContext.broadcast(bucket_ranks(docs, n))

    def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 256):
            yield from (ordered(h, rank.value) for h in gram_hashes(texts[i : i + 256], n))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in sets_of(pdf["text"].tolist()):
                keep = len(s) - math.ceil(num * len(s) / den) + 1 if len(s) else 0
                out.append((len(s), hashlib.md5(s.tobytes()).digest(), (s[:keep] ^ _SIGN).view(np.int64)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [x[0] for x in out], "sig": [x[1] for x in out], "prefix": [x[2] for x in out]})

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(sets_of(pdf["text"].tolist()))
            yield pd.DataFrame({"made": [hashlib.md5(s.tobytes()).digest() for s in sets], "grams": [s.astype(">u8").tobytes() for s in sets], "sig": pdf["sig"], "node": pdf["node"]})

    every = materialize(docs.mapInPandas(describe, "doc_id long, n long, sig binary, prefix array<long>"))
    classes = every.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("cid"), F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))
    unsorted = materialize(classes)
    wide, every = every, materialize(every.select("doc_id", "n", "sig"))
    drop(wide)
    # nodes are numbered in order of doc_id: the hubs of a gram are its first and its last document
    classes = materialize(unsorted.orderBy("cid", "sig").withColumn("node", F.monotonically_increasing_id()))
    drop(unsorted)
    release(spark)
    lists = classes.select(F.col("node").alias("doc"), "n", F.posexplode("prefix").alias("pos", "gram"))
    span = materialize(lists.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo != hi"))
    release(spark)
    part = materialize(lists.join(span, "gram"))
    drop(span)
    release(spark)

    def may(n1, p1, n2, p2):
        return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= _least(n1, n2, num, den))

    ends = part.where("doc = lo or doc = hi").select("gram", F.col("doc").alias("end"), F.col("n").alias("end_n"), F.col("pos").alias("end_pos"))
    me = (F.col("n"), F.col("pos"))
    tried = part.join(ends, "gram").where((F.col("end") != F.col("doc")) & may(*me, F.col("end_n"), F.col("end_pos")))
    star = tried.select(F.least("end", "doc").alias("hub"), F.greatest("end", "doc").alias("doc")).distinct()

    def promising(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The pairs as written, those whose prefixes share enough, and the sets of their members.

        Of the prefix that ends first in the global order, every gram that the sets share is in both prefixes; what
        lies beyond it is at most the rest of that set.
        """
        pairs = materialize(pairs)
        wanted = materialize(pairs.select(F.col("hub").alias("node")).union(pairs.select("doc")).distinct())
        some = materialize(classes.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "node").select("node", "n", "prefix"))
        a, b = (some.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("prefix").alias(f"{k}_p")) for k in ("hub", "doc"))
        rest = lambda k: F.col(f"{k}_n") - F.size(f"{k}_p")
        most = F.size(F.array_intersect("hub_p", "doc_p")) + F.when(F.get("hub_p", F.size("hub_p") - 1) <= F.get("doc_p", F.size("doc_p") - 1), rest("hub")).otherwise(rest("doc"))
        good = materialize(pairs.join(a, "hub").join(b, "doc").where(most >= _least(F.col("hub_n"), F.col("doc_n"), num, den)).select("hub", "doc"))
        drop(some, wanted)
        nodes = good.select(F.col("hub").alias("node")).union(good.select("doc")).distinct()
        known = materialize(classes.join(nodes, "node").select("node", "sig", "cid"))
        ids = F.broadcast(known) if known.count() <= FEW else known  # else the texts are shuffled
        text = docs.join(ids, F.col("doc_id") == F.col("cid")).select("sig", "node", "text")
        made = text.mapInPandas(full, "made binary, grams binary, sig binary, node long").where("made = sig")
        sets = materialize(made.select("node", "grams").dropDuplicates(["node"]))
        drop(known)
        release(spark)
        return pairs, good, sets

    star, good, sets = promising(star)
    found = _linked(good, sets, num, den)
    drop(good, sets)

    old = [part, star]
    part = part.select("gram", "doc", "n", "pos")
    if not all_links:
        comp1 = materialize(connected_components(found, "hub", "doc"))
        part = materialize(part.join(comp1.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
        mixed = materialize(part.groupBy("gram").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("gram"))
        old += [comp1, part, mixed]
        part = materialize(part.join(mixed, "gram", "left_semi").select("gram", "doc", "n", "pos", "component"))
        old.append(part)
    left = part.select("gram", *[F.col(c).alias(f"{c}_l") for c in part.columns if c != "gram"])
    cond = (left["gram"] == part["gram"]) & (F.col("doc_l") < F.col("doc"))
    if not all_links:
        cond = cond & (F.col("component_l") != F.col("component"))
    rest = left.join(part, cond & may(F.col("n_l"), F.col("pos_l"), *me)).select(F.col("doc_l").alias("hub"), "doc").distinct()
    rest, good, sets = promising(rest.join(star, ["hub", "doc"], "left_anti"))
    drop(*old, rest)
    release(spark)
    more = _linked(good, sets, num, den)
    links = found.union(more)
    drop(good, sets)
    comp = materialize(connected_components(links, "hub", "doc"))
    degree = links.select(F.col("hub").alias("node")).union(links.select("doc")).groupBy("node").agg(F.count("*").alias("n_links"))
    by_class = classes.select("node", "sig", "cid").join(comp, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_class = materialize(by_class.select("sig", "cid", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    drop(classes, comp, found, more)
    release(spark)
    ids = by_class.groupBy("component").agg(F.min("cid").alias("component_id"))
    by_class = by_class.join(ids, "component").select("sig", "component_id", "n_links")
    return every.select("doc_id", "n", "sig").join(by_class, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.lit(all_links), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near copies: of each group only rows with its smallest doc_id stay, and of equal rows one.

    A row with an empty set stays; so does one without doc_id, unless it repeats another's text. All columns of
    ``docs`` are returned.
    """
    gone = jaccard_components(docs, n, num, den, all_links=False).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by four-word shingles, similarity 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100, all_links=False).drop("n_links")


def op1_ngram_links(spark, sf_dir: str) -> DataFrame:
    """op1_ngram_join with the number of links, which is no column of its SQL."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS cid FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS sig FROM g GROUP BY doc_id)),
gr AS (SELECT g.doc_id, g.s FROM g JOIN cls ON cls.doc_id = g.doc_id AND cls.cid = g.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gr a JOIN gr b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 85 * (cx.n + cy.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, root) AS (SELECT DISTINCT cid, cid FROM cls UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id LEFT JOIN m ON m.node = cls.cid
"""
