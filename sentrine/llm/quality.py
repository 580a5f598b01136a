"""Quality by nearest-neighbour voting among latent-semantic vectors.

Terms are trigrams of character shapes (vowel, consonant, digit, mark, ...), which every text has, whatever its
language. Their counts are weighted by entropy over the labelled documents, so that terms found everywhere count
little, and a truncated singular value decomposition makes them vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of bytes, from 1; whatever is not named is class 0.
SHAPES = ("aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "0123456789", " ", "\n\t\r", ".,;:", "!?", "|", "'\"()[]-/")
WIDE = len(SHAPES) + 2  # and one for bytes beyond ASCII
SIZE = WIDE**3 + 6


def _table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[128:] = WIDE - 1
    for i, chars in enumerate(SHAPES, 1):
        for c in chars:
            t[ord(c)] = i
    return t


TABLE = _table()


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of shape trigrams in the whole text, and a few shares of words; zeros if empty."""
    out = np.zeros(SIZE, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    s = TABLE[np.frombuffer(raw, np.uint8)]
    if len(s) >= 3:
        n = np.bincount((s[:-2] * WIDE + s[1:-1]) * WIDE + s[2:], minlength=WIDE**3)
        out[: WIDE**3] = np.sqrt(n / (len(s) - 2))
    ws = raw.split()
    if ws:
        distinct = len(set(ws)) / len(ws)
        lines = raw.split(b"\n")
        out[WIDE**3 :] = np.array([distinct, 1 - distinct, len(set(lines)) / len(lines), min(len(raw) / len(ws) / 20, 1), min(len(ws) / 50, 1), 1 / (1 + len(ws) / 10)]) / 4
    return out


def fit(docs: DataFrame, labelled: DataFrame, rows: int = 3000, rank: int = 48, seed: int = 3):
    """Latent vectors of at most ``rows`` labelled documents (by hash of doc_id): ``(origin, basis, vectors, labels)``.

    ``labelled``: ``doc_id, label`` without nulls. The sample is what the driver sees of the corpus; its bound is
    ``rows``. Of several labels or texts of one doc_id the smallest counts. None if there is no labelled document.
    """
    chosen = labelled.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, value = [], []
            for x in map(features, pdf["text"]):  # most features of a text are 0
                at.append(np.flatnonzero(x).astype(np.uint16))
                value.append(x[at[-1]].tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": [a.tobytes() for a in at], "value": value})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).mapInPandas(describe, "doc_id long, label int, at binary, value binary").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    if not got:
        return None
    at, value = [np.frombuffer(r["at"], np.uint16) for r in got], [np.frombuffer(r["value"], np.float32).astype(np.float64) for r in got]
    return (*latent(at, value, rank), np.array([r["label"] for r in got], np.float32))


def latent(at: list[np.ndarray], value: list[np.ndarray], rank: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``origin, basis, vectors`` of texts given as the places and values of their features that are not 0.

    Dense matrices have the features that some text has, and at most ``block`` texts at a time.
    """
    n, places, values = len(at), np.concatenate(at).astype(np.int64), np.concatenate(value)
    used, places = np.unique(places, return_inverse=True)
    m, bound = len(used), np.cumsum([0, *map(len, at)])
    share = values**2
    share /= np.maximum(np.bincount(places, share, m), 1e-12)[places]
    weight = np.ones(m)
    if n > 1:
        grams = used < WIDE**3
        weight[grams] += np.bincount(places, share * np.log(np.maximum(share, 1e-12)), m)[grams] / np.log(n)
    values = values * weight[places]
    mean = np.bincount(places, values, m) / n

    def centred() -> Iterator[np.ndarray]:
        for lo in range(0, n, block):
            b = bound[lo : lo + block + 1]
            x = np.zeros((len(b) - 1, m))
            x[np.repeat(np.arange(len(x)), np.diff(b)), places[b[0] : b[-1]]] = values[b[0] : b[-1]]
            x -= mean
            yield x

    spread = np.zeros((m, m))
    for x in centred():
        spread += x.T @ x
    top = np.linalg.eigh(spread)[1][:, ::-1][:, : min(rank, n)].copy()
    del spread
    z = np.concatenate([x @ top for x in centred()])
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    basis = np.zeros((SIZE, top.shape[1]), np.float32)
    basis[used] = weight[:, None] * top
    return (mean @ top).astype(np.float32), basis, z.astype(np.float32)


def vote(x: np.ndarray, model, k: int = 15, power: float = 8.0) -> np.ndarray:
    """Share of label 1 among the k labelled vectors of highest cosine, weighted by a power of similarity."""
    origin, basis, known, labels = model
    z = x @ basis - origin
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    cos = z @ known.T
    k = min(k, len(labels))
    at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, at, 1).astype(np.float64), 1e-6) ** power
    return np.clip((w * labels[at]).sum(1) / w.sum(1), 0, 1)


def score_quality(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3, rows: int = 3000, block: int = 256, known: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= threshold).

    ``known`` are the documents to learn from (``doc_id, text``), by default ``docs``.

    Each document's whole text is compared, block by block, with every labelled vector (broadcast; at most ``rows``
    of them). Columns named score or predicted are replaced. Null and empty texts get the vote of the labelled
    texts nearest to an empty one. Without any labelled document every score is 1: nothing is known against any.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if known is None else known, labelled, rows))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.ones(len(texts))
            if model.value is not None:
                for i in range(0, len(texts), block):
                    out[i : i + block] = vote(np.array([features(t) for t in texts.iloc[i : i + block]]), model.value)
            yield pd.Series(out)

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def learnable(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learnt from."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    return ok.select("doc_id", F.col("quality").cast("int").alias("label"))


def op9_quality_votes(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document of ``documents``, learnt from four fifths of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_quality(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
