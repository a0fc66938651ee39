"""Player-name text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def _fold_accents(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() if s else ""
    )


def normalise_name(name: Column) -> Column:
    """Accents folded, lower case, anything but letters a space, spaces collapsed."""
    letters = F.regexp_replace(F.lower(_fold_accents(name)), "[^a-z ]+", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def surname(normalised: Column) -> Column:
    """Last word of a normalised name, empty for an empty name."""
    return F.element_at(F.split(normalised, " "), -1)


def unescape_name(name: Column) -> Column:
    r"""Turn literal ``\uXXXX`` text into characters and leave every other byte alone."""
    safe = F.regexp_replace(name, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    safe = F.regexp_replace(safe, '"', r'\\"')
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), safe, F.lit('"}')), "$.v")
    return F.when(name.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(decoded, name)).otherwise(name)
