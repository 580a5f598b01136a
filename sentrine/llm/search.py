"""Ranked lexical search over an index that is stratified by document length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.llm.pieces import slices
from sentrine.operators.metrics import global_rank
from sentrine.storage import drop, materialize

#: Bytes of terms (digits, letters, everything beyond ASCII), and A-Z as a-z.
_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NO_ID = (1 << 63) - 1  # stands for a null doc_id, which ranks behind all others


def raw_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ``texts`` (none null) and where each begins in them, with one bound more."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0] :], at - at[0]


def runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Maximal runs of ``inside`` bytes, A-Z in lower case, none across the bounds ``at``; and where in ``raw`` each begins."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = inside[begins]
    ends = np.append((np.cumsum(inside, dtype=np.int32) - 1)[first], np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]]))
    return words, np.flatnonzero(first)


def terms(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of ``texts`` one after the other, and how many each text has."""
    raw, at = raw_bytes(texts)
    found, begins = runs(raw, at, _IN_TERM[raw])
    return found, np.diff(np.searchsorted(begins, at))


def forward_table(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, codes, tfs``: of every document with terms, their number, and how often it holds each of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)):
                found, n = terms(batch.column("text").slice(lo, hi - lo))
                codes = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(hi - lo, dtype=np.int64), n)[codes >= 0]
                pair, tf = np.unique(doc * len(known) + codes[codes >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(hi - lo + 1, dtype=np.int64) * len(known)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % max(1, len(known)), tf)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), *lists], names=["doc_id", "n", "codes", "tfs"])
                yield out.filter(pa.array(n > 0))

    text = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


def stratified_index(forward: DataFrame, documents: int, length: int, cell_docs: int = 512) -> DataFrame:
    """Cells of the index: ``cell, m, docs`` and postings ``codes, tfs, ends, at``.

    Documents of equal normaliser ``m`` form a stratum, which is stored as cells of at most ``cell_docs`` documents,
    so that a length that many documents share is spread over tasks. Within a cell postings are grouped by term and,
    ascending, by tf: the i-th group has the term ``codes[i]``, the frequency ``tfs[i]`` and the documents at the
    places ``at[ends[i - 1]:ends[i]]`` of ``docs``.
    """
    m = F.expr(f"25 + CAST((CAST(75 * n AS DECIMAL(20, 0)) * CAST({documents} AS DECIMAL(18, 0))) div CAST({max(1, length)} AS DECIMAL(20, 0)) AS LONG)")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms = batch.column("m").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(ms, prepend=-1)), len(ms))
            bounds = [(x, min(x + cell_docs, hi)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for x in range(lo, hi, cell_docs)]
            rows = []
            for lo, hi in bounds:
                part = batch.slice(lo, hi - lo)
                sizes = pc.list_value_length(part.column("codes")).to_numpy(zero_copy_only=False)
                code, tf = (part.column(c).flatten().to_numpy() for c in ("codes", "tfs"))
                at = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes)
                order = np.lexsort((tf, code))
                code, tf, at = code[order], tf[order], at[order]
                turn = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
                ends = np.append(turn[1:], len(code))[: len(turn)].astype(np.int32)
                rows.append((int(ms[lo]), part.column("doc_id").to_numpy(), code[turn], tf[turn], ends, at))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            lists = [pa.array(c, pa.list_(t)) for c, t in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *lists], names=["m", "docs", "codes", "tfs", "ends", "at"])

    dealt = forward.withColumn("m", m).hint("rebalance", F.col("m")).sortWithinPartitions("m", "doc_id")
    cells = dealt.mapInArrow(build, "m long, docs array<long>, codes array<int>, tfs array<int>, ends array<int>, at array<int>")
    return cells.withColumn("cell", F.monotonically_increasing_id())


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Queries:
    """Items as flat arrays: ``code, weight`` of all their different terms, item ``i`` at ``at[i]:at[i + 1]``; weights include repeats."""

    def __init__(self, items: list[Counter], vocabulary: list[str], weights: np.ndarray):
        place = {t: i for i, t in enumerate(vocabulary)}
        self.at = np.cumsum([0, *map(len, items)])
        self.code = np.array([place[t] for c in items for t in c], np.int64)
        self.weight = np.array([r for c in items for r in c.values()], np.int64) * weights[self.code] if len(self.code) else np.zeros(0, np.int64)
        self.terms = len(vocabulary)
        # a sum of products below 2 ** 53 is exact in doubles; an impact is below 10 ** 6
        self.exact = [self.weight[a:b].sum() < 9_000_000_000 for a, b in zip(self.at[:-1], self.at[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.at) - 1

    def bounds(self, m: int, code: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """For every item a bound of what any document of a cell can score: the impact of each term's largest tf there."""
        most = np.zeros(self.terms + 1, np.int64)
        most[code] = impacts(tf, m)  # groups of a term come by tf, so the largest stays
        sums = np.concatenate([[0], np.cumsum(self.weight * most[self.code])])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def scores(self, wanted: np.ndarray, m: int, docs: int, code: np.ndarray, tf: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of all documents of a cell for each wanted item. The impact of a (term, tf) is computed once."""
        sizes = np.diff(ends, prepend=0)
        present, row = np.unique(code, return_inverse=True)
        table = np.zeros((len(present), docs))
        table[np.repeat(row, sizes), at] = np.repeat(impacts(tf, m), sizes)
        place = np.full(self.terms + 1, -1, np.int64)
        place[present] = np.arange(len(present))
        for q in wanted.tolist():
            rows, w = place[self.code[self.at[q] : self.at[q + 1]]], self.weight[self.at[q] : self.at[q + 1]]
            rows, w = rows[rows >= 0], w[rows >= 0]
            yield q, (w.astype(float) @ table[rows]).astype(np.int64) if self.exact[q] else (w[:, None] * table[rows].astype(np.int64)).sum(axis=0)


def best(scores: np.ndarray, docs: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest of the scores above 0 and not below ``floor``, equal ones by ascending id."""
    keep = np.flatnonzero(scores >= max(1, floor))
    order = keep[np.lexsort((docs[keep], -scores[keep]))][:k]
    return scores[order], docs[order]


def _visit(index: DataFrame, queries: Queries, k: int, floors: np.ndarray, only: dict[int, list[int]] | None = None) -> DataFrame:
    """``q, doc_id, score``: of each task the best for every item. A cell whose bound is below what is sure for an item is not opened for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure, found = floors.copy(), {}
        for batch in batches:
            cells = []
            for i in range(batch.num_rows):
                m, code, tf = batch.column("m")[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in ("codes", "tfs"))
                bound = queries.bounds(m, code, tf)
                if only is not None:
                    mine = np.zeros(len(bound), bool)
                    mine[only[batch.column("cell")[i].as_py()]] = True
                    bound = np.where(mine, bound, 0)
                cells.append((i, m, code, tf, bound))
            cells.sort(key=lambda c: -int(c[4].max(initial=0)))  # strata of high bounds first, so that floors rise early
            for i, m, code, tf, bound in cells:
                wanted = np.flatnonzero((bound > 0) & (bound >= sure))
                if not len(wanted):
                    continue
                docs, ends, at = (batch.column(c)[i].values.to_numpy() for c in ("docs", "ends", "at"))
                for q, scores in queries.scores(wanted, m, len(docs), code, tf, ends, at):
                    got, ids = best(scores, docs, k, int(sure[q]))
                    if not len(got):
                        continue
                    if q in found:
                        got, ids = np.concatenate([found[q][0], got]), np.concatenate([found[q][1], ids])
                        got, ids = best(got, ids, k, 0)
                    found[q] = got, ids
                    if len(got) == k:
                        sure[q] = max(sure[q], got[-1])
        if found:
            q = np.repeat(np.fromiter(found, np.int64), [len(x[0]) for x in found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([x[j] for x in found.values()])) for j in (1, 0))], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, "q long, doc_id long, score long")


def _top_cells(index: DataFrame, queries: Queries, most: int) -> DataFrame:
    """``q, cell, bound``: of each task the cells of the highest bounds for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, len(queries)), np.int64), np.zeros((0, len(queries)), np.int64)
        for batch in batches:
            cell = np.repeat(batch.column("cell").to_numpy()[:, None], len(queries), axis=1)
            bound = np.array([queries.bounds(m.as_py(), c.values.to_numpy(), t.values.to_numpy()) for m, c, t in zip(*(batch.column(x) for x in ("m", "codes", "tfs")), strict=True)], np.int64).reshape(cell.shape)
            cell, bound = np.concatenate([kept[0], cell]), np.concatenate([kept[1], bound])
            top = np.argsort(-bound, axis=0, kind="stable")[:most]
            kept = np.take_along_axis(cell, top, 0), np.take_along_axis(bound, top, 0)
        q = np.broadcast_to(np.arange(len(queries)), kept[0].shape)[kept[1] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(x[kept[1] > 0]) for x in kept)], names=["q", "cell", "bound"])

    return index.select("cell", "m", "codes", "tfs").mapInArrow(run, "q long, cell long, bound long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple], k: int, cell_docs: int, seeds: int) -> DataFrame:
    spark = docs.sparkSession
    found, n = terms(pa.array([t for _, t in items], pa.string()))
    found, ends = found.to_pylist(), np.cumsum(n).tolist()
    counts = [Counter(found[b - a : b]) for a, b in zip(n.tolist(), ends, strict=True)]
    vocabulary = sorted(set(found))
    forward = materialize(forward_table(docs, vocabulary))
    size = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for code, count in forward.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # as many as the items' terms
        df[code] = count
    weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = Queries(counts, vocabulary, weights)
    index = materialize(stratified_index(forward, size["docs"], size["length"], cell_docs))
    drop(forward)
    near = Window.partitionBy("q").orderBy(F.desc("bound"), "cell")
    picked = _top_cells(index, queries, seeds).withColumn("r", F.row_number().over(near)).where(F.col("r") <= seeds).collect()  # a few for each item
    only: dict[int, list[int]] = {}
    for row in picked:
        only.setdefault(row["cell"], []).append(row["q"])
    floors = np.zeros(len(queries), np.int64)
    first = index.where(F.col("cell").isin([*only])) if only else index.limit(0)
    for q, score in _ranked(_visit(first, queries, k, floors, only), k).where(F.col("rank") == k).select("q", "score").collect():
        floors[q] = score
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "q long, item_id long")
    out = _ranked(_visit(index, queries, k, floors), k).join(F.broadcast(names), "q")  # at most one block of items
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block: int = 1024, cell_docs: int = 512, seeds: int = 4) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each of ``items`` (``item_id``, ``text``) its ``k`` best documents (``doc_id``, ``text``).

    Documents of one length share one normaliser, so within a stratum a term's weight depends on its tf alone. The
    bound of a stratum for an item takes the largest tf of each term; the few cells of the highest bounds give each item
    a score that ten documents reach, and then only cells whose bound is not below it are opened for it. Nothing is
    approximate. Items are taken in blocks of ``block``, each of which reads the documents once; a block's terms are all
    that reaches the driver.

    Null texts have no terms, as have empty ones; items without terms get no rows. Rows that repeat a doc_id are
    documents of their own; rows without one rank behind others of their score. Items that repeat an item_id are ranked
    each for itself. Further columns are not read.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ranked = materialize(global_rank(asked, "item_id", "text"))
    blocks = -(-ranked.count() // block)
    out = None
    for b in range(max(1, blocks)):
        part = ranked.where((F.col("rank") > b * block) & (F.col("rank") <= (b + 1) * block)).orderBy("rank").select("item_id", "text").collect()
        found = _search_block(docs, [tuple(r) for r in part], k, cell_docs, seeds)
        out = found if out is None else out.union(found)
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``; an empty table on either side gives no rows."""
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), dl AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM dl), dm AS (SELECT doc_id, 25 + (75 * n * docs) // length AS m FROM dl, z),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN dm USING (doc_id) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
