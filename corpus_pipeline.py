"""The training-corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes what its predecessor kept and writes what it keeps to shared storage.
What holds for all stages: ``docs`` has whole-number doc_id and text, is a stored table
and may have any other columns, which all stages but the last return as they are (names
that begin with two underscores are the operators' own and are dropped). A null text is
an empty one, of any length otherwise; texts are never cut. Rows that repeat are each a
row. An empty table gives an empty one. Ties are broken by doc_id, null last, then by the
order in which rows are read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from plinth.llm.common import forget, shared_dir, stored
from plinth.session import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: good ones that aren't toxic.

    Fitted on these documents and their labels of toxicity; without such labels nothing is
    toxic. Empty texts are judged like others (no words, no letters). Equal texts are
    judged alike, so a repeated row stays or goes as a whole.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are equal. Of rows that share text and doc_id, the one read last
    stays; a null doc_id ranks lowest.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near SimHashes, the one with the smallest doc_id.

    Null, empty and blank texts have the fingerprint 0 and are linked with one another.
    Four-word shingles and at most four differing bits, as in the operator's query: of
    pairs with a similarity of 0.8 it links few (README).
    """
    return simhash.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur, nor a whole item of fewer words.

    A text without words is clean; items without words are in no document. With an empty
    benchmark all stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (the tokens), n_tokens and whether decoding gave the text's bytes back; no other column.

    A null or empty text has no tokens and comes back as no bytes. One row for each row,
    those with a null doc_id too.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("round_trip"))


STAGES = [
    ("quality", classify),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", decontaminated),
    ("byte_bpe", tokens),
]

#: The fitted classifier, near copies and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the last stage's rows.

    Each stage's result is a Parquet folder in shared storage that is removed when the next
    one is written; the last one stays until the session ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            forget(spark, before)
        before = path
    return docs
