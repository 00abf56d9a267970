"""The corpus pipeline: STAGES applied to documents, the rows of each written and reread as the next one's.

Every stage takes any columns, names of its own included, and all but the last return the columns of its input. Rows with null or
letterless text go in the first stage. A row without an id is kept by the others, is no one's near copy, and comes last where the
order of documents counts. Rows that repeat id and text stay together: the near-copy stage keeps all rows of the smallest id
of a group, and the suffix stage counts them as one document. Of texts that are tied the smallest id stays. Empty tables give
empty tables, and an empty benchmark contaminates nothing. Texts may be of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import byte_bpe, decontamination, jaccard_join, language_id, suffix_dedup
from meridian.llm.common import stored, table


#: Rows of a batch that goes to a Python worker: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is more likely than all others together, and that are no noise in it: at most twice the
    median bits per byte of that language's sample, and 512 bits more. Noise is left out of what the models learn."""
    _bounded(spark)
    return language_id.identified(docs, language_id.fit(docs, tell_noise=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on shingles of five words, keeps the one with the smallest id."""
    _bounded(spark)
    return jaccard_join.one_of_each(docs, size=5, percent=80).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts what also starts earlier, as strings of 100 bytes, and what is left empty."""
    _bounded(spark)
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of ten words of the benchmark."""
    _bounded(spark)
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the hash of their decoding."""
    _bounded(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remember=60_000)


STAGES = [
    ("language_id", identify),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]
#: Neither the language models nor the byte-pair merges are SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
