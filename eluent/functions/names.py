"""Sample, ion and header names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ion modes and what they are written as.
ION_MODES = {"Positive": "P", "positive": "P", "P": "P", "Negative": "N", "negative": "N", "N": "N", "Hilic": "N", "hilic": "N"}


def ion_mode(mode: Column) -> Column:
    """P or N; null for an unknown mode."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in ION_MODES.items() for x in kv)), mode)


def polarity(sample: Column) -> Column:
    """The sample name up to its polarity mark: the first ``_P``, else ``_HN``, else ``_N`` where it has one."""
    cut = lambda mark: F.regexp_extract(sample, rf"^(.*?{mark})", 1)
    return F.when(sample.contains("_P"), cut("_P")).when(sample.contains("_HN"), cut("_HN")).when(sample.contains("_N"), cut("_N")).otherwise(sample)


def with_polarity(sample: Column, mode: Column) -> Column:
    """A name that ends in no polarity gets that of the ion mode."""
    return F.when(sample.rlike(r"_(P|N|HN)$"), sample).otherwise(F.concat(sample, F.lit("_"), mode))


def run_order(file: Column) -> Column:
    """The number in brackets in a file name, 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(file, r"\((\d+)\)", 1), F.lit("")).cast("int"), F.lit(1))


def without_run(file: Column) -> Column:
    return F.trim(F.regexp_replace(file, r"\s*\(.*$", ""))


def sample_of_file(file: Column) -> Column:
    """What stands after the last ``-`` of a file name, without its 5-character suffix and anything from a bracket on."""
    last = F.element_at(F.split(file, "-"), -1)
    return F.trim(F.split(F.substring(last, F.lit(1), F.greatest(F.length(last) - 5, F.lit(0))), r"\(")[0])


def attribute(text: Column, name: str) -> Column:
    """The value of ``name=`` up to the next blank; empty without one."""
    return F.regexp_extract(text, rf"{name}=([^ ]+)", 1)


def trailing_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long")


def clean_id(name: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(name), F.lit(""))


def natural_key(name: Column, digits: int = 12) -> Column:
    """Sorts runs of digits as numbers and text without case: each run is padded with zeros."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), digits, "0")).otherwise(p)), "")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes")


def normal_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())
