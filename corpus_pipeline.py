"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; all but the last return the columns of documents.

Defined results, beside those that each operator's docstring gives. Null or empty texts pass every filter (nothing speaks
against them), are no near-duplicates of anything and have no tokens. Null doc_ids pass and are drawn like others. Repeated
rows of one doc_id and text are judged alike; near-dedup keeps one of them, mixing may draw it again. Very long texts are
whole in every stage. Ties in a draw stay together. Further columns of documents pass through all stages but the last under
any name. Empty tables give empty results, and a table of labels without rows rejects nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import bag_minhash, line_dedup, poisson_mix, resample, tree_bpe
from tracelight.llm.kit import discarded, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go; the others keep their row as it is."""
    return resample.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source's boilerplate lines go from its texts, from two pages on; n_chars follows, but where the text is null."""
    out = line_dedup.without_boilerplate(docs, least_pages=2)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; documents without words all do."""
    return bag_minhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to even weights; a document stands as often as it was drawn, a null source is one source."""
    return poisson_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each text, with digests of the ids and of the decoded bytes; one row a row."""
    return tree_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing", mixing), ("byte-level BPE", encoding)]

#: The stages hash, draw and link iteratively, which SQL does not express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if stage is not STAGES[0][1]:
            discarded(before)  # the table of the stage before has been read
    return STAGES[-1][1](spark, docs, sf_dir)
