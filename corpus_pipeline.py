"""The corpus pipeline: from documents to packed sequences, in five stages that each call one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Repeated rows and rows without an id go through every
stage: rows are told apart by a hash of what they hold, never by their id alone. Columns beyond those of documents, whatever they
are called, are left behind by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.llm.common import cut, read
from lineweave.llm.jaccard_join import join_groups
from lineweave.llm.line_dedup import drop_boilerplate
from lineweave.llm.packing import pack_documents
from lineweave.llm.quality_rules import judge
from lineweave.llm.suffix_dedup import remove_repeats

#: A passage is what repeats over so many bytes and holds so many words. Of the passages of 51 words in the test tables 0.5
#: per cent are shorter than that, so hardly any is missed, and what repeats by chance in short words stays.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def _row_key() -> Column:
    """128 bits of what a row holds: among 10^12 rows no two different ones are expected to share it."""
    own = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    own += [c.isNull() for c in own]  # a hash passes over nulls
    return F.concat(F.hex(F.xxhash64(*own)), F.lit("-"), F.hex(F.xxhash64(F.lit("other half"), *reversed(own))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has too few words and goes; very long texts are judged
    whole; repeated rows share a verdict; an empty table gives an empty one; other columns don't come along."""
    keyed = docs.select(*COLUMNS).withColumn("row_key", _row_key())
    rejected = judge(keyed, "row_key").filter(~F.col("kept")).select("row_key").distinct()
    return keyed.join(rejected, "row_key", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a large share of their source's documents repeat. No document goes; a null text
    becomes empty; a null source is one of its own; shares at the limit stay; an empty table gives an empty one."""
    return _with_length(drop_boilerplate(docs.select(*COLUMNS), "source"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, then of the least hash of its row; one without an
    id only where no other is there. A text without words is no copy of anything, but equal rows are one. An empty table gives
    an empty one."""
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("row", _row_key())
    groups = cut(join_groups(keyed, "row_key").distinct(), "groups")
    least = keyed.select("doc_id", "row_key", "row").join(groups, "row_key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    stay = keyed.join(least.select("row").distinct(), "row", "left_semi")
    once = stay.withColumn("copy", F.row_number().over(W.partitionBy("row").orderBy("row")))  # rows alike in everything
    return once.filter("copy = 1").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of about 50 words or more that also stand elsewhere, every copy of them, the first one
    too. No document goes; a null text becomes empty; very long texts are searched whole; repeated rows repeat each
    other; an empty table gives an empty one."""
    cleaned = remove_repeats(docs, match=PASSAGE_BYTES, keep=("lang", "source"), give_text=True, min_words=PASSAGE_WORDS)
    return _with_length(cleaned.withColumnRenamed("kept_text", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null or empty text is one token, the end mark; long texts are
    cut into pieces; an empty table gives an empty one."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near copies", near_copies), ("repeats", repeats), ("packing", packing)]

#: Groups of near copies need reachability over all documents, repeats every 400-byte string, and packing a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
