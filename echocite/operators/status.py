"""Edge classification: full view, detected-only view, ground-truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.functions.titles import has_errata_keyword, normalize_title
from echocite.operators.authors import AUTHOR_THRESHOLD

# Status and label words, and the note on an erratum.
ERRATUM = "ERRATUM"
AUTOCITATION = "AUTOCITATION"
NOT_AUTOCITATION_STATUS = "NOT AUTOCITATION"
NOT_AUTOCITATION_LABEL = "NOT_AUTOCITATION"
ERRATUM_NOTE = "Identifikované ako oprava na základe embedding podobnosti názvu s originálom"
HIGH = "HIGH"
NEEDS_REVIEW = "NEEDS_REVIEW"


def joined_names(authors: Column) -> Column:
    return F.array_join(authors["name"], "; ")


def full_status(judged: DataFrame, threshold: float = AUTHOR_THRESHOLD) -> DataFrame:
    """Every edge: erratum first, then self-citation by score or catalogue flag, else neither.

    Score, matches and authors are given for edges that are not errata, the note for those
    that are.
    """
    is_match = (F.col("score") >= threshold) | F.col("is_xml")
    other = ~F.col("is_erratum")
    return judged.select(
        "main_id",
        "citing_id",
        F.when(F.col("is_erratum"), ERRATUM)
        .when(is_match, AUTOCITATION)
        .otherwise(NOT_AUTOCITATION_STATUS)
        .alias("status"),
        "citing_title",
        F.when(other, F.col("score")).alias("score"),
        F.when(other, F.col("score4")).alias("score_rounded"),
        F.when(other, F.col("matches")).alias("matched_authors"),
        F.when(other, F.col("citing_authors")["name"]).alias("all_citation_authors"),
        F.when(F.col("is_erratum"), ERRATUM_NOTE).alias("note"),
    )


def detected_status(judged: DataFrame, threshold: float = AUTHOR_THRESHOLD) -> DataFrame:
    """The staging rows of the detected-only view.

    Errata are kept; other edges that the catalogue already flags are left out; the rest
    are self-citations by score alone, or neither.
    """
    kept = judged.filter(F.col("is_erratum") | ~F.col("is_xml"))
    other = ~F.col("is_erratum")
    return kept.select(
        "main_id",
        "citing_id",
        F.when(F.col("is_erratum"), ERRATUM)
        .when(F.col("score") >= threshold, AUTOCITATION)
        .otherwise(NOT_AUTOCITATION_STATUS)
        .alias("type"),
        "main_title",
        joined_names(F.col("main_authors")).alias("main_authors"),
        "citing_title",
        joined_names(F.col("citing_authors")).alias("citing_authors"),
        F.when(other, F.array_join("matches", "; ")).otherwise("").alias("matches"),
        F.when(other, F.col("score")).alias("score"),
        F.when(other, F.col("score4")).alias("score_rounded"),
    )


def to_confirm(staging: DataFrame) -> DataFrame:
    """The staging rows that are queued for confirmation: self-citations."""
    return staging.filter(F.col("type") == AUTOCITATION)


def work_queue(staging: DataFrame) -> DataFrame:
    """Self-citations to confirm, in the five columns of the hand-over file."""
    return to_confirm(staging).select(
        F.col("main_id").alias("mainArticleId"),
        F.col("main_title").alias("mainArticleTitle"),
        F.col("citing_id").alias("citingId"),
        F.col("citing_title").alias("citingTitle"),
        "matches",
    )


def truth_label(citing_title: Column, is_xml: Column) -> Column:
    """struct(label, confidence, reason) from sure signals only; no similarity enters."""
    keyword = has_errata_keyword(normalize_title(citing_title))
    flagged = F.coalesce(is_xml, F.lit(False))

    def choose(on_keyword: str, on_flag: str, rest: str | None) -> Column:
        return F.when(keyword, on_keyword).when(flagged, on_flag).otherwise(F.lit(rest))

    return F.struct(
        choose(ERRATUM, AUTOCITATION, None).alias("label"),
        choose(HIGH, HIGH, NEEDS_REVIEW).alias("confidence"),
        choose(
            "kľúčové slovo erraty v názve",
            "XML príznak autocitácie",
            "žiadny spoľahlivý signál — vyžaduje ručnú anotáciu",
        ).alias("reason"),
    )
