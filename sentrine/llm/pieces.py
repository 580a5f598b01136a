"""Encoding and decoding with a sentencepiece model, by a table of distinct chunks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # how the library writes a space
SLICE = 4 << 20  # bytes of text that are cut at a time
_ODD = re.compile(r" +[^ ]+(?: +\Z)?| +")
_READY: dict[str, object] = {}  # models, which have a fixed size, by path


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    import sentencepiece

    if path not in _READY:
        _READY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _READY[path]


def cuts_at_marks(model) -> bool:
    """Whether texts may be segmented chunk by chunk: merges by rank, no piece with a mark after another character, spaces kept as they are.

    Ranks are whole numbers, where the scores of other kinds of models are logarithms.
    """
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    crosses = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in own)
    ranked = all(float(model.get_score(i)).is_integer() for i in own)
    probe = "  a  b c "
    kept = model.encode("a") != model.encode(" a") and model.decode(model.encode(probe)) == probe and model.encode(f"a{MARK}b") == model.encode("a b")
    return ranked and kept and not crosses and model.encode("") == []


class ChunkTable:
    """Ids of the distinct chunks that one task has met; each goes through the library once, while the first ``most`` are remembered.

    A chunk is a run of marks and what follows it up to the next mark, written without its first mark, which the
    library puts before every text.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.model, self.most, self.known = load(path), most, {}
        self.cuts = cuts_at_marks(self.model)

    def ids(self, chunks: list[str]) -> pa.ListArray:
        """Ids of distinct ``chunks``, in their order."""
        known = self.known
        raw = list(map(known.get, chunks))
        new = [i for i, r in enumerate(raw) if r is None]
        for i, got in zip(new, self.model.encode([chunks[i] for i in new], num_threads=1) if new else (), strict=True):
            raw[i] = array("i", got).tobytes()
        room = max(0, self.most - len(known))
        known.update((chunks[i], raw[i]) for i in new[:room] if len(chunks[i]) < 64)
        at = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4, out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks of ``texts`` one after the other, and how many each text has."""
        if not self.cuts:
            return texts, np.ones(len(texts), np.int64)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(texts, " ")
        if not len(odd):
            return cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64)
        lists = {int(i): [c[1:] for c in _ODD.findall(" " + texts[int(i)].as_py().replace(MARK, " "))] for i in odd}
        parts, sizes, at = [], pc.list_value_length(cut).to_numpy().astype(np.int64), 0
        for i, found in lists.items():
            parts += [cut.slice(at, i - at).flatten(), pa.array(found, pa.string())]
            sizes[i], at = len(found), i + 1
        return pa.concat_arrays([*parts, cut.slice(at).flatten()]), sizes

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text: distinct chunks are looked up and their ids put back by position."""
        chunks, sizes = self.chunks(texts)
        coded = chunks.dictionary_encode()
        ids = self.ids(coded.dictionary.to_pylist()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy().astype(np.int64))])
        at = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), ids.flatten())


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a larger row is one of its own."""
    lo, have = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if have and have + n > most:
            yield lo, i
            lo, have = i, 0
        have += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``), equal to the library's ``encode`` of the whole text.

    Null text counts as empty and has no ids. Rows are encoded each for itself, so a doc_id may be null or repeated;
    further columns are not read. No rows give none. Nothing is shuffled: each task has a table of the distinct chunks
    it meets. A model whose pieces may cross marks, or that changes spaces, is given whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                ids = table.encode(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), ids], names=["doc_id", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text``: what the library's ``decode`` makes of each row's ``ids``; null and empty lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in batches:
            ids = batch.column("ids")
            sizes = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            for lo, hi in slices(sizes, SLICE // 4):
                part = ids.slice(lo, hi - lo)
                texts = sp.decode([x or [] for x in part.to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), part, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` encoded and decoded again: number of ids, and digests of ids and of the decoded text.

    Null text counts as empty; repeated rows and rows without doc_id have a row each; an empty table gives none.
    """
    both = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model()), default_model())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
