"""Line dedup (native): lines that several documents hold stay in the first of them only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.
Keys meet as 128-bit hashes, so no text of a line is shuffled; a key in a third of all
documents is combined on the map side, and the join back to its lines is one that adaptive
execution splits. What comes back to a document is the list of its dropped positions.

Defined results: a null or empty text is one empty line; a null id counts as one document
after all others; rows that repeat an id count as one document; a very long text is split by
the task that holds it, and only its lines' hashes are dealt anew; an empty table gives an
empty table; of columns with the names of this operator's results, the input's go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ordered_id, text_or_empty

#: What is stripped at both ends of a line, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(STRIPPED))


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, text_hash, dropped): for each text with dropped lines, their positions from 0."""
    text = text_or_empty(text_col)
    # the text is hashed below the explosion, once and not for every line
    texts = docs.select(ordered_id(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    lines = texts.select("doc", "text_hash", F.posexplode("lines").alias("pos", "line"))
    keyed = (
        lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    if min_docs <= 2:
        repeated = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.lit(min_docs < 2) | (F.col("first") < F.col("last")))
    else:
        per_doc = keyed.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        repeated = per_doc.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # under complements, so that Spark deals both sides anew and can split a line that very many documents have
    found = repeated.select(F.bitwise_not("h1").alias("n1"), F.bitwise_not("h2").alias("n2"), "first")
    return (
        keyed.join(found, (F.col("h1") == F.bitwise_not("n1")) & (F.col("h2") == F.bitwise_not("n2")))
        .where(F.col("doc") != F.col("first"))
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))  # a text's own lines, however many rows repeat it
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text_col rid of repeated lines, and n_lines, n_dropped.

    Keys of at least min_chars code points found in at least min_docs documents lose all
    their lines except those in the smallest id.
    """
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0)).alias("row"), F.col(text_col).alias("text"), ordered_id(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"))
    # hashed on the short side, so that texts are not sorted
    joined = rows.join(dropped_positions(docs, id_col, text_col, min_chars, min_docs).hint("shuffle_hash"), ["doc", "text_hash"], "left")
    # lines and the positions that stay are columns of their own: inside the lambda they would be made again for every line
    cut = joined.select("row", "text", "dropped", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    cut = cut.withColumn("stays", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")))
    return cut.select(
        *[F.col("row").getField(c).alias(c) for c in others],
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("stays", lambda i: F.get("lines", i)), "\n")).alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
