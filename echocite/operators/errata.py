"""Erratum tests on a (citing title, main title) pair of normalised titles.

All take columns that were normalised once per work. Cheap tests come first; the vector
is looked at only where they did not decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.functions.titles import has_errata_keyword, normalize_title

TITLE_THRESHOLD = 0.90  # fixed value: cosine from which titles count as the same


def with_title_forms(works: DataFrame, title: str = "title") -> DataFrame:
    """Add `title_norm` and `title_keyword`."""
    normalized = works.withColumn("title_norm", normalize_title(F.col(title)))
    return normalized.withColumn("title_keyword", has_errata_keyword(F.col("title_norm")))


def cheap_erratum(keyword: Column, citing_norm: Column, main_norm: Column) -> Column:
    """Keyword, or equal and not empty. Needs no model."""
    return keyword | ((citing_norm == main_norm) & (citing_norm != ""))


def library_erratum(
    keyword: Column, citing_norm: Column, main_norm: Column, similarity: Column, threshold: float = TITLE_THRESHOLD
) -> Column:
    """Keyword, or equal, or similarity (of `title_similarity`) at least the threshold."""
    return keyword | (citing_norm == main_norm) | F.coalesce(similarity >= threshold, F.lit(False))


def guarded_erratum(
    citing_title: Column,
    main_title: Column,
    keyword: Column,
    citing_norm: Column,
    main_norm: Column,
    similarity: Column | None = None,
    threshold: float = TITLE_THRESHOLD,
) -> Column:
    """The production test: never an erratum when either raw title is empty.

    Without `similarity` the two cheap tests alone decide.
    """
    both = (F.coalesce(citing_title, F.lit("")) != "") & (F.coalesce(main_title, F.lit("")) != "")
    if similarity is None:
        return both & (keyword | (citing_norm == main_norm))
    return both & library_erratum(keyword, citing_norm, main_norm, similarity, threshold)


def scored_erratum(
    keyword: Column, citing_norm: Column, main_norm: Column, cos: Column, threshold: float = TITLE_THRESHOLD
) -> Column:
    """struct(pred, score): (true, 1.0) by keyword or equality, otherwise by cosine alone."""
    sure = keyword | (citing_norm == main_norm)
    value = F.coalesce(cos, F.lit(0.0))
    return F.struct(
        (sure | (value >= threshold)).alias("pred"), F.when(sure, 1.0).otherwise(value).alias("score")
    )
