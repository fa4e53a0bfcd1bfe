"""What the operators share: reading tables, row keys and tables that cut the lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import shared_dir, written

__all__ = ["NULL_ID", "ordered_id", "read_table", "shared_dir", "text_or_empty", "written"]

#: Stands for a null id where ids are ordered: after every real one.
NULL_ID = 2**63 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def ordered_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
