"""Quality audit of generated text and of recognised pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.blocks import coverages
from ..functions.sql import content, query

LEAST_MISSING, LEAST_EXTRA, LEAST_COVERAGE = 12, 40, 0.5


def audit_punctuation(df: DataFrame, source: str, output: str) -> DataFrame:
    """Adds status and likeness; rows whose content is equal never reach the slower comparison's worst case."""

    @F.pandas_udf("struct<status: string, likeness: double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.audit_punctuation(x, y) for x, y in zip(a, b)], columns=["status", "likeness"])

    return df.withColumn("_a", run(source, output)).select("*", "_a.status", "_a.likeness").drop("_a")


def paragraphs_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, index, paragraph) split at blank lines, blank ones left out."""
    parts = f"filter(transform(split({column}, '\\n{{{{2,}}}}'), p -> regexp_replace(p, r'(?U)^\\s+|\\s+$', '')), p -> p <> '')"
    return query(f"SELECT {key}, posexplode({parts}) AS (index, paragraph) FROM {{d}}", d=df)


def paragraph_coverage(paragraphs: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """For each paragraph the share of its runs of eight content characters that the other text of its key holds.

    A key's paragraphs meet its other text once, in a row; both sides are hashed once.
    """

    @F.pandas_udf("array<double>")
    def covered(own: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([coverages([c or "" for c in x], y or "") for x, y in zip(own, other)], dtype=object)

    together = query(
        f"""SELECT p.{key}, p.parts, o.other FROM (SELECT {key}, collect_list(struct(index, paragraph, {content('paragraph')} AS own)) AS parts FROM {{p}} GROUP BY {key}) p
            JOIN (SELECT {key}, {content('text')} AS other FROM {{o}}) o ON p.{key} = o.{key}""",
        p=paragraphs,
        o=others,
    )
    found = together.withColumn("coverage", covered(F.col("parts.own"), "other")).select(key, F.explode(F.arrays_zip("parts", "coverage")).alias("x"))
    return found.select(key, "x.parts.index", "x.parts.paragraph", F.length("x.parts.own").alias("n"), "x.coverage")


def missing_extra_paragraphs(df: DataFrame, key: str, source: str, output: str) -> DataFrame:
    """Per row: how many source paragraphs the output lacks, how many of its own the source doesn't have, and how the first missing one begins."""
    ours = paragraph_coverage(paragraphs_of(df, key, source), df.selectExpr(key, f"{output} AS text"), key)
    theirs = paragraph_coverage(paragraphs_of(df, key, output), df.selectExpr(key, f"{source} AS text"), key)
    return query(
        f"""SELECT {key}, count_if(lost) AS missing, count_if(added) AS extra, min_by(left(paragraph, 20), index) FILTER (WHERE lost) AS first_missing
            FROM (SELECT {key}, index, paragraph, n >= {LEAST_MISSING} AND coverage < {LEAST_COVERAGE} AS lost, false AS added FROM {{a}}
                  UNION ALL SELECT {key}, index, paragraph, false, n >= {LEAST_EXTRA} AND coverage < {LEAST_COVERAGE} FROM {{b}}) GROUP BY {key}""",
        a=ours,
        b=theirs,
    )


def repair_paragraphs(df: DataFrame, source: str, output: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernels.repair_paragraphs(x, y) for x, y in zip(a, b)], dtype=object)

    return df.withColumn("repaired", run(source, output))


def ocr_page_quality(pages: DataFrame) -> DataFrame:
    """Mean and least confidence of a page's lines, and warnings. `pages`: page_id, lines array<double>, kinds array<string>."""
    found = "array_compact(lines)"
    kinds = [("table", "tables"), ("figure", "figures"), ("seal", "seals"), ("header", "headers"), ("footer", "footers"), ("footnote", "footnotes")]
    by_kind = ", ".join(f"if(array_contains(kinds, '{k}'), 'has {w}', NULL)" for k, w in kinds)
    return query(
        f"""SELECT page_id, if(size({found}) > 0, aggregate({found}, 0D, (a, x) -> a + x) / size({found}), NULL) AS mean_confidence, array_min({found}) AS min_confidence,
                   array_join(array_compact(array(if(size(lines) = 0, 'nothing recognised', NULL), if(size(lines) > 0 AND size({found}) = 0, 'no confidences', NULL), if(array_min({found}) < 0.75, 'low confidence', NULL), {by_kind})), ', ') AS warnings
            FROM {{p}}""",
        p=pages,
    )
