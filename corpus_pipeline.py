"""From raw documents to packed sequences, each stage one operator of sentrine.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrine.llm.line_dedup import dedup_lines
from sentrine.llm.mixing import mix_sources
from sentrine.llm.ngram_join import keep_one
from sentrine.llm.quality import learnable, score_quality
from sentrine.llm.tokens import default_tokenizer, pack_documents
from sentrine.storage import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours accept; without labels, all.

    Every row is judged by its text alone: null and empty texts like the labelled texts nearest to an empty one,
    repeated rows alike. Columns of any name come back.
    """
    labels = learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select(F.struct("*").alias("row"), "doc_id", "text"), labels, known=docs)
    return scored.where("predicted = 1").select("row.*")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before, and without documents of such lines alone; ``n_chars`` follows the text.

    Rows without doc_id or text, and texts of blank lines alone, stay as they are. Of repeated rows all keep the same
    lines, or all go if an earlier document has them.
    """
    out = dedup_lines(docs, keep_whole=False).where("n_lines = 0 or n_removed < n_lines").select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8. Of equal rows one stays; texts without words stay."""
    return keep_one(docs, n=5, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents not taken go, and so do those without a word.

    Rows that agree in doc_id, source and text are one document with as many copies as the mix takes of them all. Null
    ids and sources are values like others; columns of any name come back.
    """
    same = lambda a, b: a.eqNullSafe(b)
    mixed = mix_sources(docs).groupBy("doc_id", "source", "sig").agg(F.count("*").alias("rows"), F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    both = left.join(mixed, same(F.col("id"), F.col("doc_id")) & same(F.col("from"), F.col("source")) & (F.col("hash") == F.col("sig")))
    once = both.where("rows = 1").select("row", "copies").union(both.where("rows > 1").dropDuplicates(["id", "from", "hash"]).select("row", "copies"))
    return once.withColumn("turn", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. Null and empty texts are one token, the end; every row counts for itself."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram jaccard join", distinct_documents),
    ("mixing sources", mixed_sources),
    ("packing", packed),
]

#: Nearest-neighbour votes and knapsacks are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
