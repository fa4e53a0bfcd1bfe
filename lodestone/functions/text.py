"""Names, stems and dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters and names that Windows does not allow in a file's name, and what stands for no name.
INVALID_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]'
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]
UNNAMED = "Без имени"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Spark has no compatibility composition; names are few, and pass in Arrow batches."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def identifier(stem: Column) -> Column:
    """A name from a file's stem: compatibility-composed, without one leading index (digits, or one capital Latin letter, and space)."""
    s = squeezed(nfkc(stem))
    return F.when(s.rlike("^[0-9]+ ."), F.regexp_replace(s, "^[0-9]+ ", "")).otherwise(F.regexp_replace(s, "^[A-Z] (?=.)", ""))


def identity_key(name: Column) -> Column:
    """What equal names share: composition, white space, case and the letter yo do not count."""
    return F.translate(casefold(squeezed(nfkc(name))), "ё", "е")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def contains_run(text: Column, run: Column) -> Column:
    """Whether the words of run stand consecutively in text; both are separated by single spaces."""
    return (F.length(run) > 0) & (F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), run, F.lit(" "))) > 0)


def longest_common_run(a: Column, b: Column) -> Column:
    """struct(len, neg_start): of arrays of words, the longest run of a that b has too, the first of equals; null if none."""
    text = F.array_join(b, " ")
    n = F.size(a)
    runs = F.flatten(
        F.transform(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(k.alias("len"), (-i).alias("neg_start"), contains_run(text, F.array_join(F.slice(a, i, k), " ")).alias("hit"))),
        )
    )
    return F.array_max(F.transform(F.filter(runs, lambda r: r["hit"]), lambda r: F.struct(r["len"].alias("len"), r["neg_start"].alias("neg_start"))))


def sequence_number(stem: Column) -> Column:
    """The last run of digits anywhere in the stem; too long a number is null."""
    return F.nullif(F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("decimal(38,0)")


def sequence_prefix(stem: Column) -> Column:
    """The stem, lower-cased, without digits at its end: frames are only compared within one prefix and folder."""
    return F.lower(F.regexp_replace(stem, "[0-9]+$", ""))


def camera_time(text: Column) -> Column:
    """A capture time as cameras write it, with colons or hyphens in the date; null if it is neither."""
    head = F.substring(F.trim(text), 1, 19)
    return F.coalesce(F.try_to_timestamp(head, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")))


def folder_name(name: Column) -> Column:
    """A name that any file system takes."""
    blank = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    trim = lambda c: F.regexp_replace(c, r"^[ .]+|[ .]+$", "")
    clean = trim(F.regexp_replace(blank, INVALID_IN_NAMES, "_"))
    named = F.when(clean == "", F.lit(UNNAMED)).otherwise(clean)
    free = F.when(F.upper(F.substring_index(named, ".", 1)).isin(RESERVED_NAMES), F.concat(F.lit("_"), named)).otherwise(named)
    cut = F.regexp_replace(F.substring(free, 1, 120), r"[ .]+$", "")
    return F.when(cut == "", F.lit(UNNAMED)).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The last part of a path without its suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def inner_path(path: Column) -> Column:
    """A relative path with forward slashes and without . and ..; null if it leads outside or is empty."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside")),
        lambda s, p: F.struct(
            F.when(p != "..", F.concat(s["kept"], F.array(p))).otherwise(F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).alias("kept"),
            (s["inside"] & ((p != "..") | (F.size(s["kept"]) > 0))).alias("inside"),
        ),
    )
    absolute = F.translate(path, "\\", "/").rlike("^(/|[A-Za-z]:)")
    return F.when(~absolute & walked["inside"], F.nullif(F.array_join(walked["kept"], "/"), F.lit("")))
