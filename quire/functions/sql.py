"""SQL over DataFrames, and SQL expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def query(text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL whose `{name}`s stand for the DataFrames given."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def normalized(x: str) -> str:
    """No white space, folded case: the form in which literal scores compare."""
    return rf"replace(lower(regexp_replace({x}, r'(?U)\s', '')), 'ß', 'ss')"


def content(x: str) -> str:
    """A text without punctuation, separators and white space."""
    return rf"regexp_replace({x}, r'(?U)[\p{{{{P}}}}\p{{{{Z}}}}\s]', '')"


def blank(x: str) -> str:
    return rf"(coalesce({x}, '') rlike r'(?U)^\s*$')"


def chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).', 0)"


def lower_words(x: str) -> str:
    return f"filter(split(lower({x}), '[ ,，、；;]+'), t -> t <> '')"
