"""Building-id expressions. Ids stay strings throughout: leading zeros carry meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geomatch.constants import ID_PREFIX, MIN_ID_DIGITS, PADDED_ID_WIDTH

_DIGIT_RUN = "([0-9]{%d,})" % MIN_ID_DIGITS


def digit_run(id_: Column) -> Column:
    """First run of ten or more digits, NULL when the id has none."""
    return F.nullif(F.regexp_extract(id_, _DIGIT_RUN, 1), F.lit(""))


def numeric_id(id_: Column, fallback: str = "suffix") -> Column:
    """The digit run; without one, the text after the last ``_`` (``fallback='suffix'``) or the
    id itself (``fallback='raw'``)."""
    if fallback not in ("suffix", "raw"):
        raise ValueError(f"unknown fallback {fallback!r}")
    # substring_index(..., -1) is the whole text when there is no underscore.
    return F.coalesce(digit_run(id_), F.substring_index(id_, "_", -1) if fallback == "suffix" else id_)


def strip_prefix(id_: Column) -> Column:
    """Drop everything up to and including the first ``_``."""
    return F.regexp_replace(id_, "^[^_]*_", "")


def padding_variants(number: Column) -> Column:
    """``array(as is, without leading zeros, padded to 16)``; longer ids are never cut."""
    padded = F.when(F.length(number) < PADDED_ID_WIDTH, F.lpad(number, PADDED_ID_WIDTH, "0"))
    return F.array(number, F.ltrim(number, F.lit("0")), F.coalesce(padded, number))


def toggle_prefix(id_: Column) -> Column:
    """Remove a leading ``bag_`` if there is one, add it otherwise."""
    return F.when(
        id_.startswith(ID_PREFIX), F.substr(id_, F.lit(len(ID_PREFIX) + 1))
    ).otherwise(F.concat(F.lit(ID_PREFIX), id_))


def own_aliases(id_: Column) -> Column:
    """The id and, when it holds one that differs, its digit run."""
    return F.array_distinct(F.array_compact(F.array(id_, digit_run(id_))))


def display_aliases(id_: Column) -> Column:
    """``array<struct<alias, kind>>``: 0 the id, 1 its digit run, 2 the prefix toggled."""
    kinds = F.array(
        F.struct(id_.alias("alias"), F.lit(0).alias("kind")),
        F.struct(numeric_id(id_, "raw").alias("alias"), F.lit(1).alias("kind")),
        F.struct(toggle_prefix(id_).alias("alias"), F.lit(2).alias("kind")),
    )
    return F.filter(kinds, lambda k: (k["kind"] != 1) | (k["alias"] != id_))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
