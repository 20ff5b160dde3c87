"""Plain spellings: ids, categories, missing values. All are Column expressions that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The endings that sweep file names add to an event id.
ID_SUFFIXES = ("_n_sweep", "_sweep", "_metrics", "_result", "_out")

#: Unicode white space and invisible marks that str.strip would not all take off.
_BLANKS = r"[\s ​‎‏﻿]+"


def plain_id(c: Column) -> Column:
    """The plain event id: base name of a path, outer blanks and a file ending and known suffixes off, upper case.

    Null stays null; an id of only blanks becomes the empty string."""
    s = F.regexp_replace(c, rf"^{_BLANKS}|{_BLANKS}$", "")
    s = F.regexp_replace(s, r"^.*[/\\]", "")
    s = F.regexp_replace(s, r"(?i)\.(csv|txt|parquet|json)$", "")
    s = F.regexp_replace(s, rf"(?i)({'|'.join(ID_SUFFIXES)})$", "")
    return F.upper(s)


def letters_key(c: Column) -> Column:
    """A spelling key of a category name: letters and digits only, lower case; null and names without any are null."""
    s = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(s != "", s)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float column, in one projection."""
    return df.select(*[nan_to_null(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])
