"""A training corpus from documents: language ID, line dedup, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
table that is written and read again as the next one's docs. All but the last return the
columns of documents, with n_chars of the text as it then is.

Defined results: a null or empty text has no letter and goes at language ID; a null id comes
after all others and stays null; rows that repeat an id and a text are one document from
near-dedup on, the first by the other columns; of equal texts the smallest id stays; a very
long text goes whole through every stage; an empty table gives no pieces; columns beyond
those of documents are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bag_minhash import near_classes
from lodestone.llm.common import ordered_id, read_table, written
from lodestone.llm.language_id import UNDETERMINED, fit, held_out, identify
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.packing import pack_documents
from lodestone.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which no language has a third: mixtures of two languages stay, and of three in equal parts."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.33)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first."""
    return _counted(dedup_lines(docs))


def _without_repeats(docs: DataFrame) -> DataFrame:
    """docs with one of the rows that repeat an id and text, the first by the other columns. Only such rows are shuffled."""
    named = docs.withColumns({"doc": ordered_id("doc_id"), "th": F.xxhash64("text")})
    repeated = written(named.groupBy("doc", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc", "th"), "repeated-rows", narrow=True)
    if repeated.isEmpty():
        return docs
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    again = named.join(repeated, ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("row"))
    return written(named.join(repeated, ["doc", "th"], "left_anti").select(*COLUMNS).unionByName(again.select("row.*")), "distinct-rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, one with the smallest id."""
    return near_classes(_without_repeats(docs), one_text=True).where("kept").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every passage of 200 bytes or more the first copy stays."""
    return _counted(remove_repeats(docs, keep_first=True, as_text=True).withColumn("text", F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2, special_literals=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: No SQL expresses language ID, suffix-array dedup and packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
