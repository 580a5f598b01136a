"""Token ids of whole texts, and the two operators on them: hierarchical packing and directly addressable codes."""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrine.storage import materialize

_READY: dict[str, "Encoder"] = {}  # by path; a Python worker's tasks share one, whose table has a bound


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts_at_spaces(model) -> bool:
    """Whether a text may be cut before a white space that stands alone: byte-level pieces by the library's own pattern, and nothing changed before."""
    kind = json.loads(model.to_str())
    pre, merges = kind.get("pre_tokenizer") or {}, kind["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and kind.get("normalizer") is None and merges.get("type") == "BPE" and not merges.get("dropout")


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """Ids in bytes as lists of integers."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))


SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as the character of that number
UNPRINTED = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}  # the others follow from 256 on


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the library's ``encode`` of each whole text.

    Byte-level BPE merges nothing across the pieces that the text is cut into first, and a white space between two
    other characters always starts one. So texts without neighbouring white space are split there, and each distinct
    unit (a space or line feed and what follows it) of some texts is encoded once; ids are put back by position. A
    unit that ends with punctuation after a letter or digit is two, of which the first is often known. Units without
    their punctuation are remembered, the first ``most`` that come twice in a call, in two Arrow arrays of about 40
    bytes a unit.

    Other texts, and those that hold a special token's name, go to the library whole; such names become that token, as
    is the library's default. So does every text if the tokenizer is of another kind (``cuts_at_spaces``).
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.library, self.merge = partial(model.encode_batch_fast, add_special_tokens=False), model.model.tokenize
        self.cuts, self.most = cuts_at_spaces(model), most
        self.known, self.known_ids = pa.array([], pa.large_string()), id_lists([])
        self.special = [t.content for t in model.get_added_tokens_decoder().values()]
        self.spaces = f"{SPACE}(?:{SPACE}|$)"

    def odd(self, texts: pa.LargeStringArray) -> np.ndarray:
        """Whether each text goes to the library whole."""
        if not self.cuts:
            return np.full(len(texts), True)
        odd = pc.match_substring_regex(texts, self.spaces)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        return odd.to_numpy(zero_copy_only=False)

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library(texts)] if texts else []

    def words(self, words: pa.LargeStringArray) -> list[bytes]:
        """Ids of units by the library; those of Latin letters are one piece each and go straight to the merges."""
        letters = pc.match_substring_regex(words, "^[A-Za-zÀ-ÖØ-öø-ɏ]+$").to_numpy(zero_copy_only=False) if self.cuts else np.full(len(words), False)
        words, merge = words.to_pylist(), self.merge
        got = [array("I", [t.id for t in merge("Ġ" + (w if w.isascii() else w.encode().decode("latin-1").translate(UNPRINTED)))]).tobytes() if easy else None for w, easy in zip(words, letters.tolist(), strict=True)]
        hard = np.flatnonzero(~letters).tolist()
        for i, raw in zip(hard, self.plain([words[i] if words[i][:1] in ("", "\n") else " " + words[i] for i in hard]), strict=True):
            got[i] = raw
        return got

    def units(self, keys: pa.LargeStringArray, times: np.ndarray) -> pa.ListArray:
        """Lists of ids of distinct units, which come so many times. A key is what follows the space, or begins with its line feed."""
        stem = pc.utf8_rtrim(keys, ".,;:!?")
        two = pc.and_(pc.match_substring_regex(stem, r"^(?:[^ \n](?s:.*))?[\p{L}\p{N}]$"), pc.not_equal(stem, keys))
        words = pc.if_else(two, stem, keys).dictionary_encode()
        marks = pc.struct_field(pc.extract_regex(keys.filter(two), r"(?P<marks>[.,;:!?]+)$"), "marks").dictionary_encode()
        new_at = pc.index_in(words.dictionary, value_set=self.known)
        new = words.dictionary.filter(pc.is_null(new_at))
        new_ids = id_lists(self.words(new))
        table = pa.concat_arrays([self.known_ids, new_ids, id_lists([b"", *self.plain(marks.dictionary.to_pylist())])])
        known, empty = len(self.known), len(self.known) + len(new)
        at = new_at.to_numpy(zero_copy_only=False)
        missing = np.isnan(at)
        at = np.where(missing, 0, at).astype(np.int64)
        at[missing] = known + np.arange(len(new))
        pairs = np.full(2 * len(keys), empty, np.int64)
        code = words.indices.to_numpy()
        pairs[::2] = at[code]
        pairs[1::2][two.to_numpy(zero_copy_only=False)] = empty + 1 + marks.indices.to_numpy()
        both = table.take(pa.array(pairs))
        if (room := self.most - known) > 0:
            often = np.bincount(code, weights=times, minlength=len(at))[missing] > 1
            keep = pa.array(np.flatnonzero(often & (pc.binary_length(new).to_numpy() < 64))[:room])
            self.known, self.known_ids = pa.concat_arrays([self.known, new.take(keep)]), pa.concat_arrays([self.known_ids, new_ids.take(keep)])
        return pa.ListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            return self._ids([t or "" for t in texts])
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        arrow = pa.array(texts, pa.large_string())
        odd = self.odd(arrow)
        whole, parted = np.flatnonzero(odd).tolist(), np.flatnonzero(~odd).tolist()
        out = dict(zip(whole, self.plain([texts[i] for i in whole]), strict=True))
        cut = pc.split_pattern(pc.replace_substring(arrow.filter(pa.array(~odd)), "\n", " \n"), " ")
        if len(cut):
            sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
            ends, units = np.cumsum(sizes), cut.flatten()
            coded = units.dictionary_encode()
            codes, heads = coded.indices.to_numpy().copy(), units.take(pa.array(ends - sizes)).to_pylist()  # nothing stands before a head
            known = self.units(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)))
            codes[ends - sizes] = len(known) + np.arange(len(heads))
            del units, coded, cut
            ids = pa.concat_arrays([known, id_lists(self.plain(heads))]).take(pa.array(codes))
            flat, place = ids.flatten().to_numpy().tobytes(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy().astype(np.int64))]) * 4
            lo, hi = place[ends - sizes].tolist(), place[ends].tolist()
            out |= {i: flat[a:b] for i, a, b in zip(parted, lo, hi, strict=True)}
        return [out[i] for i in range(len(texts))]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def some(rows: list[tuple], most: int = 12 << 20) -> Iterator[list]:
    """Rows, whose second value is a text, in lists of about ``most`` characters."""
    at, have = 0, 0
    for i, r in enumerate(rows):
        have += len(r[1] or "")
        if have >= most:
            yield rows[at : i + 1]
            at, have = i + 1, 0
    if at < len(rows):
        yield rows[at:]


# ---------------------------------------------------------------- packing

WINDOWS = (256, 512, 1024, 2048)


def _fill(lengths: list[int], gap: int) -> list[int] | None:
    """Positions in ``lengths`` that sum to exactly ``gap``; None if there are none. Sums reached are bits of an integer."""
    if not gap:
        return []
    reach, used, full = [1], [], (1 << (gap + 1)) - 1
    for i, n in enumerate(lengths):
        if n <= gap:
            reach.append((reach[-1] | reach[-1] << n) & full)
            used.append(i)
            if reach[-1] >> gap & 1:
                break
    else:
        return None
    out = []
    for i, before in zip(reversed(used), reversed(reach[:-1])):
        if not before >> gap & 1:
            out.append(i)
            gap -= lengths[i]
    return out[::-1]


def _close(pool: list[list[int]], window: int) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sequences of exactly ``window`` tokens from whole pieces of the pool, and the pieces left over.

    Longest first, each piece is given the shorter ones that fill its sequence to the last token.
    """
    pool, done, left = sorted(pool, key=lambda x: (-x[2], x[0])), [], []
    while pool:
        first, *pool = pool
        fill = _fill([p[2] for p in pool], window - first[2])
        if fill is None:
            left.append(first)
            continue
        done.append([first, *(pool[i] for i in fill)])
        taken = set(fill)
        pool = [p for i, p in enumerate(pool) if i not in taken]
    return done, left


def _pack(pieces: list[list[int]], window: int) -> list[list[list[int]]]:
    """Sequences of pieces ``[piece, from, length]`` for one shard: tiers first, then gaps of the longest window.

    Pieces are routed to the smallest tier that holds them. From the shortest tier up, sequences of that power of
    two are closed from whole pieces of the tier and of shorter ones, so that they need no padding; what is left
    moves on to the next tier. What the last tier leaves is laid out longest first, each gap being filled from the
    shorter pieces that are left, the last of which is cut at the end of the window.
    """
    tiers = [w for w in WINDOWS if w < window] + [window]
    done, rest = [], []
    for below, w in zip([0, *tiers], tiers):
        closed, rest = _close(rest + [p for p in pieces if below < p[2] <= w], w)
        done += closed
    rest.sort(key=lambda x: (-x[2], x[0]))
    lo, hi, room, seq = 0, len(rest) - 1, window, []
    while lo <= hi:
        if not seq or rest[lo][2] <= room:
            take, lo = rest[lo], lo + 1
        else:
            take, hi = rest[hi], hi - 1
        if take[2] > room:
            seq.append([take[0], take[1], room])
            hi += 1
            rest[hi] = [take[0], take[1] + room, take[2] - room]
            room = 0
        else:
            seq.append(take)
            room -= take[2]
        if not room:
            done.append(seq)
            seq, room = [], window
    return [*done, seq] if seq else done


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, step: int = 32, shard_bytes: int = 1 << 21) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Input: ``doc_id``, ``text`` (null: empty; every document gets ``end_id`` at its end). Returns a row per piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, tier, step_group``.
    Repeated rows are packed each for itself; rows without doc_id too. No rows give no pieces. Which pieces share a
    sequence depends on how the input is partitioned; the pieces' contents do not.

    Whole windows of a document are sequences of their own and leave the document where it is read; only what
    remains of it moves, with its ids, to a shard. The number of shards follows the bytes of the input, so a shard
    stays small at any size, and each leaves one unfilled sequence at most. Within a shard sequences are ordered
    by size and dealt in turn to step groups of about ``step`` sequences, so that groups cost alike.
    """
    shards = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0] // shard_bytes + 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        for pdf in batches:
            for ids in some(list(zip(pdf["doc_id"], pdf["text"], strict=True))):
                out = []
                for (doc, _), raw in zip(ids, encode([t for _, t in ids]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    whole = n - n % window
                    out += [(doc, at, window, zlib.crc32(raw[at * 4 : (at + window) * 4]), n, None) for at in range(0, whole, window)]
                    if n > whole:
                        out.append((doc, whole, n - whole, None, n, raw[whole * 4 :]))
                yield pd.DataFrame(out, columns=["doc_id", "start", "length", "crc", "doc_tokens", "ids"]).astype({"doc_id": "Int64", "crc": "Int64"})

    schema = "doc_id long, start long, length long, crc long, doc_tokens long, ids binary"
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, schema)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))  # repeated rows are dealt out too

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "doc_tokens"], kind="stable", na_position="first").reset_index(drop=True)
        doc, start, total, ids, crc = (pdf[c].tolist() for c in ("doc_id", "start", "doc_tokens", "ids", "crc"))
        moved = [[i, 0, n] for i, (n, raw) in enumerate(zip(pdf["length"].tolist(), ids, strict=True)) if raw is not None]
        seqs = [[[i, 0, window]] for i, raw in enumerate(ids) if raw is None] + _pack(moved, window)
        sizes = [sum(p[2] for p in s) for s in seqs]
        groups = -(-len(seqs) // step)
        turn = {s: t for t, s in enumerate(sorted(range(len(seqs)), key=lambda s: (-sizes[s], s)))}
        out = []
        for s, seq in enumerate(seqs):
            offset = 0
            lap, at = divmod(turn[s], groups)
            for i, lo, n in seq:
                value = zlib.crc32(ids[i][lo * 4 : (lo + n) * 4]) if ids[i] is not None else crc[i]
                tier = next(w for w in (*WINDOWS, window) if sizes[s] <= w)
                out.append((doc[i], start[i] + lo, n, int(value), total[i], (int(key[0]) << 32) | s, offset, sizes[s], tier if sizes[s] == tier else window, (int(key[0]) << 32) | (at if lap % 2 == 0 else groups - 1 - at)))
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group"]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return pieces.groupBy("shard").applyInPandas(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier long, step_group long"
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` cut and packed into sequences of at most 2048 tokens, a row per piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


# ---------------------------------------------------------------- directly addressable codes

RANK_EVERY = 512  # bits between two entries of a rank directory


def dac_encode(ids: np.ndarray) -> bytes:
    """Bytes of ``ids``: level by level the low 8 bits, then a bitmap of which ids go on, then its rank directory."""
    levels, cur = [], ids.astype(np.uint64)
    while True:
        more = cur > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 8))
        ranks = np.concatenate([[0], np.cumsum(more.astype(np.int64))])[:: RANK_EVERY][: -(-len(cur) // RANK_EVERY)].astype("<u4")
        levels.append(struct.pack("<I", len(cur)) + (cur & np.uint64(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<I", len(levels)) + b"".join(levels)
        cur = cur[more] >> np.uint64(8)


class Dac:
    """Reads what ``dac_encode`` wrote: any id or range of ids, without decoding what lies before it."""

    def __init__(self, raw: bytes):
        (n,), at, self.levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            at += 4
            chunk = np.frombuffer(raw, np.uint8, size, at)
            at += size
            words = -(-(-(-size // 8)) // 8) * 8
            bits = np.frombuffer(raw, np.uint8, words, at)
            at += words
            k = -(-size // RANK_EVERY)
            self.levels.append((chunk, bits, np.frombuffer(raw, "<u4", k, at)))
            at += 4 * k

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        if not len(ranks):
            return 0
        b = min(i // RANK_EVERY, len(ranks) - 1)
        lo = b * RANK_EVERY
        return int(ranks[b]) + int(np.unpackbits(bits[lo // 8 : -(-i // 8)], bitorder="little")[: i - lo].sum())

    def slice(self, lo: int, hi: int) -> np.ndarray:
        out, at, shift = np.zeros(hi - lo, np.uint32), np.arange(hi - lo), 0
        for chunk, bits, ranks in self.levels:
            if hi <= lo:
                break
            out[at] |= chunk[lo:hi].astype(np.uint32) << np.uint32(shift)
            on = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            lo, hi = self._rank(bits, ranks, lo), self._rank(bits, ranks, hi)
            at, shift = at[on], shift + 8
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 19, part_bytes: int = 16 << 20) -> DataFrame:
    """Encode all documents in ascending doc_id order and write them as segments of directly addressable codes.

    Returns the written table as read back: ``first_doc, part, segment, doc_ids, lengths`` (little-endian 64- and
    32-bit), ``n_ids`` and ``payload``. A segment holds about ``segment_ids`` ids and always whole documents. Null
    text counts as empty. Rows without doc_id come first; rows that repeat a doc_id stand next to each other. An
    empty input gives an empty table. Documents are range-partitioned by doc_id, about ``part_bytes`` of text each, and
    sorted within partitions.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        docs_, parts, have, part, segment = [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            known = [-(1 << 63) if pd.isna(d) else d for d in docs_]
            row = (int(known[0]), part, segment, np.array(known, "<i8").tobytes(), np.array([len(p) // 4 for p in parts], "<u4").tobytes(), len(ids), dac_encode(ids))
            return pd.DataFrame([row], columns=["first_doc", "part", "segment", "doc_ids", "lengths", "n_ids", "payload"])

        for pdf in batches:
            for rows in some(list(zip(pdf["doc_id"], pdf["text"], pdf["part"], strict=True))):
                part = int(rows[0][2])
                for (doc, _, _), raw in zip(rows, enc([t for _, t, _ in rows]), strict=True):
                    docs_.append(doc)
                    parts.append(raw + end)
                    have += len(raw) // 4 + 1
                    if have >= segment_ids:
                        yield flush()
                        docs_, parts, have, segment = [], [], 0, segment + 1
        if docs_:
            yield flush()

    parts = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0] // part_bytes + 1
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))  # rows that repeat a doc_id, or have none, may fill several partitions
    dealt = dealt.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = "first_doc long, part long, segment long, doc_ids binary, lengths binary, n_ids long, payload binary"
    return materialize(dealt.mapInPandas(encode, schema))


def tokens_at(files: DataFrame, doc_id: int, first: int = 0, count: int = 1) -> list[int]:
    """``count`` ids of a written document from its ``first`` on, without decoding what lies before them.

    Of the written table only the segment that holds the document is read: the last one that begins with it or one
    before it. A document that is not there, and places beyond its end, give nothing.
    """
    row = files.where(F.col("first_doc") <= doc_id).orderBy(F.desc("first_doc"), F.desc("part"), F.desc("segment")).limit(1).collect()
    for r in row:
        docs, sizes = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<u4").astype(np.int64)
        at = np.flatnonzero(docs == doc_id)
        if len(at):
            begin, n = int(sizes[: at[0]].sum()), int(sizes[at[0]])
            return Dac(r["payload"]).slice(begin + min(first, n), begin + min(first + count, n)).tolist()
    return []


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the written segments.

    Where a segment starts is a running sum over the segments of its part, beyond a running sum over the parts (one
    row for each partition written); payloads stay where they are and are opened once.
    """
    earlier, within = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("part").orderBy("segment")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    begin = files.select("part", "segment", "n_ids").join(parts, "part").withColumn("begin", F.col("before") + F.sum("n_ids").over(within) - F.col("n_ids")).select("part", "segment", "begin")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, segment, docs_, lengths, payload in pdf.itertuples(index=False):
                dac, size = Dac(payload), np.frombuffer(lengths, "<u4").astype(np.int64)
                at = np.cumsum(size) - size
                ids = memoryview(dac.slice(0, len(dac)).astype("<u4").tobytes())  # all are read, so levels are joined once
                crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pd.DataFrame({"part": part, "segment": segment, "doc_id": np.frombuffer(docs_, "<i8"), "at": at, "n_tokens": size, "ids_crc32": crc})

    rows = files.select("part", "segment", "doc_ids", "lengths", "payload").mapInPandas(decode, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    out = rows.join(F.broadcast(begin) if files.count() < 100_000 else begin, ["part", "segment"])
    known = F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id"))
    return out.select(known.alias("doc_id"), (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """``documents`` written as token files in order of doc_id, and what reading them back gives for each document."""
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return read_token_files(files)
