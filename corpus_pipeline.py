"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and reread before the next. The first three return the
columns of ``documents`` for the rows they keep; the last returns the pieces of the packed windows.

Defined results: rows with null or empty texts are not toxic, are not selected by the quality stage (they hold nothing
to rate), and so don't reach the later stages; repeated rows are judged alike, and of a group of near-duplicates the
row with the smallest id stays (rows that repeat an id are one document and stay or go together).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import near_dups, packing, quality, toxicity
from factloom.llm.shared import Cuts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below their language's threshold."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs.select(*COLUMNS), model).where("not flagged").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that probably have the highest grade."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs.select(*COLUMNS), model).where("selected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id; rows without words or id all stay."""
    docs = docs.select(*COLUMNS)
    gone = near_dups.find(docs, WORDS, PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: A trained classifier decides what reaches the later stages, so no SQL gives the rows; tests/llm compares each stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and reread."""
    cuts = Cuts(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = cuts.keep(stage(spark, docs, sf_dir))
        cuts.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
