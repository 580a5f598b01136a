"""Removal of repeated 100-byte strings by sorting suffix buckets with the ranks of a difference-cover sample.

Suffixes matter by their first 100 bytes only. They are dealt into buckets by content: of the 61 overlapping 40-grams
of a 100-byte string the one with the smallest hash, and 30 bytes beside it, name the bucket, so equal strings are
in the same one and no bucket needs another. Runs of neighbouring suffixes travel as one slice of text. A task sorts
one block of buckets at a time: first the strings at the places of a difference cover are ranked, then the suffixes
of the block are sorted by a few leading and closing bytes, and what ties there is told apart by the rank at the one
cover place that both suffixes reach. Memory is bounded by the block, not by the bucket range or the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrine.llm.common import BYTES, PIECE, mix, prefix_sums
from sentrine.storage import drop, materialize, release

WIDTH, GRAM = 100, 40
SPAN, SIDE = WIDTH - GRAM + 1, (WIDTH - GRAM) // 2
CHUNK = 1 << 21  # bytes of a text that are hashed at a time
BLOCK = 1 << 16  # suffixes that are sorted at a time
CROWD = 1 << 10  # slices of one bucket that one task sorts; more are dealt out
#: A perfect difference cover: every distance is the difference of two of its members modulo the period.
COVER, PERIOD = (0, 1, 3, 9), 13


# ---------------------------------------------------------------- sorting a block


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    x, n = text.astype(np.uint64), 1
    while n < 8:
        x = (x[:-n] << np.uint64(8 * n)) | x[n:]
        n *= 2
    return x


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by several columns, the first of which counts most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def first_equal(text: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each suffix in ``starts`` the index of the first one with the same ``width`` bytes; bytes are compared, not hashes.

    Strings of ``width - PERIOD + 1`` bytes at the cover places are ranked. Any two suffixes reach cover places after
    one distance below ``PERIOD``, so two with the same leading and closing ``PERIOD - 1`` bytes are equal if and
    only if their ranks at that distance are: every suffix is entered under each of its distances, and the least
    index of an entry goes to all of its suffixes.
    """
    if not len(starts):
        return np.empty(0, np.int64)
    core, words = width - PERIOD + 1, _words(text)
    reach = [[d for d in range(PERIOD) if (r + d) % PERIOD in COVER] for r in range(PERIOD)]
    delta = np.array(reach)[starts % PERIOD]  # as many distances for each as the cover has members
    places, at = np.unique(starts[:, None] + delta, return_inverse=True)
    steps = [*range(0, core - 8, 8), core - 8]
    rank = _dense([words[places + s] for s in steps])
    tie = _dense([words[starts], words[starts + PERIOD - 9], words[starts + core], words[starts + width - 8]])
    entry = (tie[:, None] * PERIOD + delta) * (len(places) + 1) + rank[at.reshape(delta.shape)]
    flat = entry.ravel()
    order = np.argsort(flat, kind="stable")  # the least index of an entry comes first
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    least = np.empty(len(flat), np.int64)
    least[order] = (order // delta.shape[1])[np.flatnonzero(new)][np.cumsum(new) - 1]
    return least.reshape(delta.shape).min(1)


# ---------------------------------------------------------------- runs


def _sliding(x: np.ndarray, span: int, pick) -> np.ndarray:
    n = 1
    while 2 * n <= span:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (span - n)], x[span - n :]) if span > n else x


def _minima(val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of ``SPAN`` values with the same leftmost minimum: first window, number, place of the minimum."""
    low = _sliding(val, SPAN, np.minimum)
    views = np.lib.stride_tricks.sliding_window_view(val, SPAN)
    lo = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    hi = np.concatenate([lo[1:], [len(low)]])
    at = lo + SPAN - 1
    old = np.flatnonzero(np.concatenate([[True], low[lo[1:]] > low[lo[1:] - 1]]))  # elsewhere a new value came in last
    at[old] = lo[old] + views[lo[old]].argmin(1)
    done = []
    for _ in range(8):
        done.append((lo, np.minimum(hi, at + 1) - lo, at))
        more = at + 1 < hi  # the same value comes again
        if not more.any():
            break
        lo, hi = at[more] + 1, hi[more]
        at = lo + views[lo].argmin(1)
    else:  # of a text that repeats a few bytes over and over: window by window
        each = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        place = np.concatenate([views[each[i : i + 4096]].argmin(1) for i in range(0, len(each), 4096)]) + each
        cut = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (each[1:] != each[:-1] + 1)) + 1])
        done.append((each[cut], np.diff(np.append(cut, len(each))), place[cut]))
    lo, n, at = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(lo)
    return lo[order], n[order], at[order]


def _pieces(docs: list, raws: list[bytes], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together in pieces of about ``PIECE`` bytes: bytes, and of each text its id, where it begins there, and from where in the text.

    A long text is cut so that each 100-byte string is in exactly one of its parts.
    """
    have, parts, ids, begin, base = 0, [], [], [], []
    for doc, raw in zip(docs, raws, strict=True):
        for lo in range(0, len(raw) - WIDTH + 1, chunk):
            part = raw[lo : lo + chunk + WIDTH - 1]
            parts.append(part)
            ids.append(doc)
            begin.append(have)
            base.append(lo)
            have += len(part)
            if have >= PIECE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ids, np.int64), np.array([*begin, have]), np.array(base)
                have, parts, ids, begin, base = 0, [], [], [], []
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ids, np.int64), np.array([*begin, have]), np.array(base)


def runs(docs: list, raws: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """For each run of suffixes: key (hash of the sample gram), context (hash of all its bytes), document and place.

    A place is one integer: the first start, the number of starts and how far the sample gram lies behind the first.
    """
    for text, ids, begin, base in _pieces(docs, raws, chunk):
        h, down = prefix_sums(text, BYTES)
        val = mix((h[GRAM:] - h[:-GRAM]) * down[: len(text) - GRAM + 1])
        lo, n, at = _minima(val)
        owner = np.searchsorted(begin, at, "right") - 1
        hi = np.minimum(lo + n, begin[owner + 1] - WIDTH + 1)  # strings that cross documents are none
        lo = np.maximum(lo, begin[owner])
        ok = lo < hi
        lo, hi, at, owner = lo[ok], hi[ok], at[ok], owner[ok]
        size = hi - lo + WIDTH - 1
        context = mix((h[lo + size] - h[lo]) * down[lo] + size.astype(np.uint64))
        yield val[at].view(np.int64), context.view(np.int64), ids[owner], ((lo - begin[owner] + base[owner]) << 16) | ((hi - lo) << 8) | (at - lo)


def _raw(text) -> bytes:
    return b"" if text is None else bytes(text)


def remove_repeats(docs: DataFrame, chunk: int = CHUNK, block_size: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (array of start, end).

    A byte goes if it lies in a 100-byte string of its document that also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Texts are UTF-8 bytes, null ones empty; strings are judged on the input.
    Rows without doc_id are reported as they are: they neither lose bytes nor make others lose any. Rows that repeat
    a doc_id have no order among themselves: what one of them holds at a place stands for all, and spans found in
    one are cut from each. No rows give no rows.

    First comes a count of sample grams, one number per run of suffixes; only runs whose gram occurs twice go on.
    Runs with equal gram and equal bytes (two 64-bit hashes) are settled as a whole, by a minimum that is combined
    before the shuffle; only one of each goes on, as two slices of text, and only where others share its bucket. A
    bucket of more than ``crowd`` slices is dealt out to several tasks, each of which sorts its part; what is first
    in its part meets again by its 100 bytes, in another minimum. So no bucket, however hot, meets in one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    known = docs.where("doc_id is not null")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, context, doc, place in runs(pdf["doc_id"].tolist(), [_raw(x) for x in pdf["raw"]], chunk):
                yield pd.DataFrame({"key": key, "context": context, "doc_id": doc, "place": place})

    schema = "key long, context long, doc_id long, place long"
    spark = docs.sparkSession
    twice = materialize(known.mapInPandas(scan, schema).select("key").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    release(spark)
    shared = materialize(known.mapInPandas(scan, schema).join(twice, "key"))
    drop(twice)
    release(spark)
    classes = materialize(shared.groupBy("key", "context").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("c")))
    many = materialize(classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    copies = shared.join(classes.where("c > 1").select("key", "context", "first"), ["key", "context"])
    size = F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long"))
    whole = copies.where(F.struct("doc_id", "place") != F.col("first")).select("doc_id", F.shiftright("place", 16).alias("lo"), size.cast("int").alias("n"))
    whole = materialize(whole)
    drop(shared)
    todo = materialize(classes.join(many, "key", "left_semi").select("first.doc_id", "first.place").groupBy("doc_id").agg(F.collect_list("place").alias("runs")))
    drop(classes, many)
    release(spark)

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each run in two halves: strings with at least 30 bytes before the sample gram, and the others. All of a half
        hold the same 70 bytes, whose hash is the bucket; ``w`` is the text of the half."""
        for pdf in batches:
            out = []
            for doc, raw, places in zip(pdf["doc_id"], pdf["raw"], pdf["runs"], strict=True):
                raw, places = _raw(raw), np.sort(np.asarray(places, np.int64))
                lo, n, a = places >> 16, places >> 8 & 255, places & 255
                early = np.clip(a - SIDE + 1, 0, n)
                for base in range(0, len(raw) - WIDTH + 1, chunk):
                    mine = (lo >= base) & (lo < base + chunk)
                    if not mine.any():
                        continue
                    h, down = prefix_sums(np.frombuffer(raw, np.uint8)[base : base + chunk + WIDTH - 1], BYTES)
                    for begin, count, core in ((lo, early, lo + a - SIDE), (lo + early, n - early, lo + a)):
                        some = mine & (count > 0)
                        c = core[some] - base
                        bucket = mix((h[c + GRAM + SIDE] - h[c]) * down[c]).view(np.int64).tolist()
                        out += [(b, doc, p, raw[p : p + m + WIDTH - 1]) for b, p, m in zip(bucket, begin[some].tolist(), count[some].tolist(), strict=True)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["bucket", "doc_id", "lo", "w"])
                    out = []
            yield pd.DataFrame(out, columns=["bucket", "doc_id", "lo", "w"]).astype({"bucket": "int64", "doc_id": "int64", "lo": "int64"})

    halves = materialize(known.join(todo, "doc_id").mapInPandas(slices, "bucket long, doc_id long, lo long, w binary"))
    drop(todo)
    release(spark)
    buckets = materialize(halves.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.ceil(F.col("c") / crowd).cast("int").alias("parts")))
    dealt = halves.join(buckets, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id", "lo"), F.col("parts")).cast("int"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One block of whole buckets (or parts of crowded ones) at a time: the suffixes that are not the first of their like, in runs."""

        def block(rows: list) -> pd.DataFrame:
            rows.sort(key=lambda r: (r[2], r[3]))
            text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            length = np.array([len(r[5]) for r in rows])
            n = length - WIDTH + 1
            row = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = (np.cumsum(length) - length)[row] + inside
            first = first_equal(text, starts)
            gone = first < np.arange(len(starts))
            # neighbours that go are one run
            edge = gone & ~(np.concatenate([[False], gone[:-1]]) & (inside > 0))
            at = np.flatnonzero(edge)
            count = np.bincount(np.cumsum(edge)[gone] - 1, minlength=len(at))
            doc, lo = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
            out = [pd.DataFrame({"doc_id": doc[row[at]], "lo": lo[row[at]] + inside[at], "n": count, "w": None})]
            crowded = np.array([r[4] > 1 for r in rows])
            if crowded.any():
                at = np.flatnonzero(~gone & crowded[row])
                raw = text.tobytes()
                out.append(pd.DataFrame({"doc_id": doc[row[at]], "lo": lo[row[at]] + inside[at], "n": 1, "w": [raw[s : s + WIDTH] for s in starts[at].tolist()]}))
            return pd.concat(out)

        rows, have = [], 0
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if have >= block_size and r[:2] != rows[-1][:2]:
                    yield block(rows)
                    rows, have = [], 0
                rows.append(r)
                have += len(r[5]) - WIDTH + 1
        if rows:
            yield block(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("bucket", "part", "doc_id", "lo", "parts", "w").repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part")
    sorted_ = materialize(dealt.mapInPandas(settle, "doc_id long, lo long, n int, w binary"))
    drop(halves, buckets)
    release(spark)
    met = sorted_.where("w is not null")
    least = met.groupBy("w").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count("*").alias("c")).where("c > 1").select("w", "first")
    again = met.join(least, "w").where(F.struct("doc_id", "lo") != F.col("first")).select("doc_id", "lo", "n")
    single = sorted_.where("w is null").select("doc_id", "lo", "n")
    found = materialize(whole.union(single).union(again).groupBy("doc_id").agg(F.collect_set(F.struct("lo", "n")).alias("found")))
    drop(whole, sorted_)
    release(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, raw, found_ in zip(pdf["doc_id"], pdf["raw"], pdf["found"], strict=True):
                raw, spans = _raw(raw), []
                for lo, end in sorted((r["lo"], min(len(raw), r["lo"] + r["n"] + WIDTH - 1)) for r in (found_ if found_ is not None else ())):
                    if lo >= end:
                        continue  # of another row with this doc_id
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([lo, end])
                kept, at = hashlib.sha256(), 0
                for lo, end in spans:
                    kept.update(raw[at:lo])
                    at = end
                kept.update(raw[at:])
                out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return docs.join(found, "doc_id", "left").mapInPandas(cut, result)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of ``documents``: how much of each text goes, and a digest of what stays."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
