"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents, whatever they are. run() writes each stage's rows as Parquet
in the shared folder and reads them again, so that a lost executor costs at most one stage's tasks.

Defined results: a null or empty text, or one without a letter, goes in the first stage; texts of any length are handled
whole; rows that repeat a doc_id count as one document for the dedup stages and are mixed alike; rows without doc_id
keep their lines and have no near duplicates; of documents with equal texts the smallest doc_id stays; a document
whose lines all went stays with an empty text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import bpe, jaccard, langid, linededup, mixing
from lexspan.plans.runtime import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language stay: a text without a letter, or one whose best code is no shorter than
    a code that knows nothing (8 bits a byte), goes."""
    found = langid.identify(docs, langid.learn(docs), keep=[*docs.columns])
    pred, _, bits = found.columns[len(docs.columns) :]
    return found.filter((F.col(f"`{pred}`") != "und") & (F.col(f"`{bits}`") < langid.PLAIN_BITS)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go except in the smallest doc_id; n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five-word shingles, similarity 0.8) the document of the smallest doc_id stays."""
    found = jaccard.jaccard_components(docs, width=5, num=4, den=5)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix took."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has no form of the language model, the near-duplicate components or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and read again, then the stage before goes."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
