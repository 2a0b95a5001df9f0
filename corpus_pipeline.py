"""Documents to tokens: five operators of fairlead.llm, each over all rows that the one before kept.

Every stage is written as Parquet and read again by the next. All but the last
return the columns of ``documents``; the last returns doc_id, n_tokens, tokens.
Documents without an id pass the stages that compare documents unchanged; empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm import decontaminate, jaccard, line_dedup, pieces, quality
from fairlead.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the labels, rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop long lines that at least five documents hold, but for the newest document."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 keep the smallest id."""
    return jaccard.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    encoded = pieces.encode(docs, pieces.load())
    n = F.coalesce(F.size("tokens"), F.lit(0)).cast("bigint")
    return encoded.select(F.col("id").alias("doc_id"), n.alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", deduplicate_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", tokenize),
]
#: SQL has neither the network nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
