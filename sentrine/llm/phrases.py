"""Frequent phrases by relational mining (SETM), and which of them are collocations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.llm.pieces import slices
from sentrine.llm.search import raw_bytes, runs
from sentrine.operators.metrics import global_rank
from sentrine.storage import drop, materialize

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = np.zeros(256, bool)
_GAPS[list(b" \t")] = True
BLOCK = 16 << 20  # bytes of text in a block of the relation
RELATION = "block long, lang string, mask binary, breaks binary, codes binary, ids array<long>"


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of all word occurrences: ``block, lang, n, breaks, codes, words, counts``.

    A row is a block of texts of one language. ``codes`` has the words in order of piece and position, as places in
    ``words``, whose numbers of occurrences are ``counts``; ``breaks`` has a bit for each occurrence that starts a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, i))
                for lo, hi in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK):
                    raw, at = raw_bytes(texts.slice(lo, hi - lo))
                    ends = _ENDS[raw]
                    words, begins = runs(raw, at, ~(ends | _GAPS[raw]))
                    if not len(words):
                        continue
                    piece = np.cumsum(ends, dtype=np.int32)[begins] + np.searchsorted(at, begins, side="right")
                    coded = words.dictionary_encode()
                    codes = coded.indices.to_numpy()
                    counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
                    breaks = np.packbits(np.diff(piece, prepend=-1) != 0, bitorder="little")
                    row = [[lang], [len(codes)], [breaks.tobytes()], [codes.astype("<i4").tobytes()], [coded.dictionary], [counts]]
                    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names=["lang", "n", "breaks", "codes", "words", "counts"])

    given = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    out = given.mapInArrow(run, "lang string, n long, breaks binary, codes binary, words array<string>, counts array<int>")
    return out.withColumn("block", F.monotonically_increasing_id())


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n).astype(bool)


def _row(block: int, lang: str, mask: np.ndarray, breaks: bytes, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block of a relation: which positions have a group (``mask``), and of those the group, as a place in ``ids``."""
    row = [[block], [lang], [np.packbits(mask, bitorder="little").tobytes()], [breaks], [codes.astype("<i4").tobytes()], [ids]]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names=["block", "lang", "mask", "breaks", "codes", "ids"])


def _keep(block: int, lang: str, size: int, at: np.ndarray, breaks: bytes, local: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """The occurrences whose group was ``found`` (its id, else -1): ``local`` has each occurrence's place in ``found``, ``at`` its position."""
    ids = found[found >= 0]
    place = np.cumsum(found >= 0) - 1
    frequent = found[local] >= 0
    mask = np.zeros(size, bool)
    mask[at[frequent]] = True
    return _row(block, lang, mask, breaks, place[local[frequent]], ids)


def _merged(mask: bytes, breaks: bytes, codes: bytes, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Merge join of a block with itself on piece and adjacent position.

    Returns the different (left, right) pairs of groups, and of each pair of occurrences the position and which pair it is.
    """
    codes, size = np.frombuffer(codes, "<i4").astype(np.int64), 8 * len(mask)
    at = np.flatnonzero(_bits(mask, size))
    meet = np.diff(at) == 1
    if breaks:
        meet &= ~_bits(breaks, size)[at[1:]]
    meet = np.flatnonzero(meet)
    coded = pa.array(codes[meet] * groups + codes[meet + 1]).dictionary_encode()
    pair = coded.dictionary.to_numpy()
    return pair // max(1, groups), pair % max(1, groups), at[meet], coded.indices.to_numpy(), size


def candidates(relation: DataFrame) -> DataFrame:
    """``left, right, n``: within each block how often a group is followed by another at the next position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mask, breaks, codes, ids in zip(*(batch.column(c) for c in ("mask", "breaks", "codes", "ids")), strict=True):
                names = ids.values.to_numpy()
                left, right, _, which, _ = _merged(mask.as_py(), breaks.as_py(), codes.as_py(), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names[left]), pa.array(names[right]), pa.array(np.bincount(which, minlength=len(left)).astype(np.int64))], names=["left", "right", "n"])

    return relation.select("mask", "breaks", "codes", "ids").mapInArrow(run, "left long, right long, n long")


def _numbered(frequent: DataFrame, *order: str) -> DataFrame:
    """``id`` from 0 without gaps, in one order whatever the partitions."""
    return materialize(global_rank(frequent, *order).withColumn("id", F.col("rank") - 1).drop("rank"))


def extend(relation: DataFrame, frequent: DataFrame, most: int, packed: bool) -> DataFrame:
    """The relation of groups one word longer: pairs of adjacent occurrences whose group is in ``frequent`` (``left, right, id``).

    Up to ``most`` frequent groups are broadcast, 16 bytes each; beyond, each block's pairs meet them in a join, and
    the block is given its own. ``packed``: two ids fit 64 bits.
    """
    spark = relation.sparkSession
    if packed and frequent.count() <= most:
        t = frequent.select("left", "right", "id").toArrow()
        left, right, ids = (t[c].to_numpy() for c in ("left", "right", "id"))
        key = (left << 31) | right
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], ids[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, known = sent.value
            for batch in batches:
                for block, lang, mask, breaks, codes, names in zip(*(batch.column(c) for c in ("block", "lang", "mask", "breaks", "codes", "ids")), strict=True):
                    names = names.values.to_numpy()
                    left, right, at, local, size = _merged(mask.as_py(), breaks.as_py(), codes.as_py(), len(names))
                    want = (names[left] << 31) | names[right]
                    place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                    found = np.where(keys[place] == want, known[place], -1) if len(keys) else np.full(len(want), -1)
                    yield _keep(block.as_py(), lang.as_py(), size, at, b"", local, found)

        return materialize(relation.mapInArrow(run, RELATION))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, mask, breaks, codes, names in zip(*(batch.column(c) for c in ("block", "mask", "breaks", "codes", "ids")), strict=True):
                names = names.values.to_numpy()
                left, right, *_ = _merged(mask.as_py(), breaks.as_py(), codes.as_py(), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), block.as_py())), pa.array(np.arange(len(left))), pa.array(names[left]), pa.array(names[right])], names=["block", "place", "left", "right"])

    def give(mine: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in mine.itertuples(index=False):
            left, _, at, local, size = _merged(r.mask, r.breaks, r.codes, len(r.ids))
            found = np.full(len(left), -1, np.int64)
            found[have["place"].to_numpy(np.int64)] = have["id"].to_numpy(np.int64)
            out.append(_keep(r.block, r.lang, size, at, b"", local, found).to_pandas())
        return pd.concat(out) if out else pd.DataFrame(columns=["block", "lang", "mask", "breaks", "codes", "ids"])

    pairs = relation.mapInArrow(listed, "block long, place long, left long, right long").join(frequent.select("left", "right", "id"), ["left", "right"]).select(F.col("block").alias("of"), "place", "id")
    return materialize(relation.groupBy("block").cogroup(pairs.groupBy("of")).applyInPandas(give, RELATION))


def first_relation(words: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """The relation of the frequent words (``lang, word, id``); they reach the blocks as in ``extend``."""
    spark = words.sparkSession
    if frequent.count() <= most:
        t = frequent.select("lang", "word", "id").toArrow()
        tables = {lang: (part["word"].combine_chunks(), part["id"].to_numpy()) for lang in t["lang"].unique().to_pylist() if (part := t.filter(pc.equal(t["lang"], lang)))}
        sent = spark.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            for batch in batches:
                for block, lang, breaks, codes, own in zip(*(batch.column(c) for c in ("block", "lang", "breaks", "codes", "words")), strict=True):
                    known, ids = tables.get(lang.as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
                    place = pc.fill_null(pc.index_in(own.values, value_set=known), -1).to_numpy(zero_copy_only=False)
                    found = np.where(place >= 0, np.append(ids, -1)[place], -1)
                    local = np.frombuffer(codes.as_py(), "<i4")
                    yield _keep(block.as_py(), lang.as_py(), len(local), np.arange(len(local)), breaks.as_py(), local, found)

        return materialize(words.select("block", "lang", "breaks", "codes", "words").mapInArrow(run, RELATION))

    def give(mine: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in mine.itertuples(index=False):
            local = np.frombuffer(r.codes, "<i4")
            found = np.full(r.groups, -1, np.int64)
            found[have["place"].to_numpy(np.int64)] = have["id"].to_numpy(np.int64)
            out.append(_keep(r.block, r.lang, len(local), np.arange(len(local)), r.breaks, local, found).to_pandas())
        return pd.concat(out) if out else pd.DataFrame(columns=["block", "lang", "mask", "breaks", "codes", "ids"])

    listed = words.select("block", "lang", F.posexplode("words").alias("place", "word")).join(frequent.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "id")
    mine = words.select("block", "lang", "breaks", "codes", F.size("words").alias("groups"))
    return materialize(mine.groupBy("block").cogroup(listed.groupBy("of")).applyInPandas(give, RELATION))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 1_000_000) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 to ``longest`` a table ``id, lang, words, a`` of the phrases that occur ``least`` times, and ``lang, n`` of all words.

    Occurrences, overlapping ones included, stay in relations sorted by piece and position, one for each length. The
    next length comes from the merge join of a relation with itself on adjacent positions: pairs are counted over all
    blocks, and only occurrences of frequent groups go on.
    """
    words = materialize(occurrences(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    listed = words.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum(F.col("x.counts").cast("long")).alias("a"))
    known = _numbered(listed.where(F.col("a") >= least), "lang", "word")
    relation = first_relation(words, known, most)
    totals = materialize(totals)
    drop(words)
    out = [known.select("id", "lang", F.array("word").alias("words"), "a")]
    for _ in range(2, longest + 1):
        counted = candidates(relation).groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        frequent = _numbered(counted, "left", "right")
        heads = out[-1].select(F.col("id").alias("left"), "lang", "words")
        tails = out[-1].select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"))
        out.append(materialize(frequent.join(heads, "left").join(tails, "right").select("id", "lang", F.array_append("words", F.col("last")).alias("words"), "a")))
        if len(out) < longest:
            relation, was = extend(relation, frequent, most, packed=out[-2].count() < 1 << 31), relation
            drop(was)
        drop(frequent)
    drop(relation)
    return out, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, most: int = 1_000_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the ``top`` phrases of 2 to ``longest`` words, by their weakest cut.

    ``docs``: ``lang`` (null counts as ``und``) and ``text`` (null: empty). Repeated rows count as often as they
    occur; further columns are not read; without phrases that occur ``least`` times there are no rows. Phrases never
    cross a piece, and a text is never cut. All arithmetic is exact: products are decimals of 38 digits.
    """
    tables, totals = frequent_phrases(docs, least, longest, most)
    every = [t.select("lang", "words", "a") for t in tables]
    counted = every[0]
    for t in every[1:-1]:
        counted = counted.union(t)
    text = lambda c: F.array_join(c, " ")
    f = counted.select("lang", text("words").alias("part"), F.col("a").alias("f"))
    phrases = every[1]
    for t in every[2:]:
        phrases = phrases.union(t)
    phrases = phrases.select("lang", text("words").alias("phrase"), "words", "a")
    # each phrase one word shorter; what is as frequent as a longer one inside which it stands says nothing of its own
    longer = phrases.where(F.size("words") > 2)
    inner = longer.select("lang", F.explode(F.array(text(F.expr("slice(words, 1, size(words) - 1)")), text(F.expr("slice(words, 2, size(words) - 1)")))).alias("phrase"), F.col("a").alias("more"))
    phrases = phrases.join(inner.groupBy("lang", "phrase").agg(F.max("more").alias("more")), ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") < F.col("a")))
    cut = phrases.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cut = cut.select("lang", "phrase", "a", "k", text(F.expr("slice(words, 1, k)")).alias("head"), text(F.expr("slice(words, k + 1, size(words) - k)")).alias("tail"))
    cut = cut.join(f.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.join(totals, "lang").withColumn("score", F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.*").drop("k")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)  # a language is ranked by parts first
    weakest = weakest.withColumn("i", F.row_number().over(some)).where(F.col("i") <= top)
    ranked = weakest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``, of phrases that occur 100 times; an empty table gives none."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, i, generate_subscripts(ps, 1) AS j, unnest(ps) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE s + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT DISTINCT c.lang, c.phrase FROM f c JOIN f e ON e.lang = c.lang AND e.k > c.k AND contains(' ' || e.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * e.a >= 100 * c.a WHERE c.k >= 2),
c AS (SELECT f.*, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM x)),
u AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k),
s AS (SELECT u.lang, u.phrase, u.a, u.j, h.a AS l, t.a AS r, n.n, CAST((CAST(1000 AS HUGEINT) * u.a * n.n) // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
  FROM u JOIN f h ON h.lang = u.lang AND h.phrase = u.head JOIN f t ON t.lang = u.lang AND t.phrase = u.tail JOIN n ON n.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000"""
