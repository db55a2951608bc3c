"""From documents to packed training windows: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyspan.llm import ngram_join, packing, quality, secret_scan, substring
from keyspan.llm.common import table
from keyspan.llm.queries import WORD_TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep; rejected ones go, the others' columns stay as they are.

    A null, empty or blank text has no words and goes; texts are measured whole, however long; equal
    rows are judged alike, and all of them stay or go; a null doc_id is judged like any other;
    an empty table stays empty; columns beside doc_id and text are not read, whatever their names.
    """
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word n-grams, similarity 0.8 or more) the row with the smallest doc_id.

    A null, empty or blank text is in a group of its own; texts are compared whole; of rows that are
    equal in doc_id and text one stays; rows that share a doc_id and have different texts are
    documents of their own; a null doc_id counts as the largest; an empty table stays empty; other
    columns stay as they are, whatever their names.
    """
    return ngram_join.one_of_each(docs, size=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that a document with a smaller doc_id has; those that are nothing else go.

    A null, empty or short text stays as it is; texts are compared whole; repeats within one
    doc_id stay, so do equal rows of one doc_id; rows that share a doc_id keep their own texts;
    a row with a null doc_id stays as it is and is compared with nothing; an empty table stays
    empty; n_chars is counted again for changed texts, other columns stay, whatever their names.
    """
    return substring.cleaned(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark; no row goes.

    A null or empty text stays as it is; texts are scanned whole; overlapping secrets give one
    mark; equal texts change alike; a null doc_id is scanned like any other; an empty table stays
    empty; n_chars is counted again, other columns stay, whatever their names.
    """
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids.

    A null or empty text gives its end id alone; texts are packed whole; equal rows are packed
    apart, each with its own pieces; a null doc_id stays null in its pieces; an empty table gives
    no rows; columns beside doc_id and text are not read, whatever their names.
    """
    return packing.packed(docs, WORD_TOKENIZER)


STAGES = [("quality", quality_stage), ("near_copies", near_copy_stage), ("passages", passage_stage), ("secrets", secret_stage), ("packing", packing_stage)]
#: SQL can express neither the forest nor the field nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/pipeline"
    docs, top = table(spark, sf_dir, "documents"), f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{top}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
