"""Detection: from works and citation edges to judged edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.functions.vectors import cosine, title_similarity, with_norm
from echocite.operators.authors import AUTHOR_THRESHOLD, author_scores, compare, match_texts
from echocite.operators.errata import TITLE_THRESHOLD, guarded_erratum, with_title_forms
from echocite.operators.shaping import since
from echocite.operators.skew import ROWS_PER_SALT, join_records
from echocite.operators.summaries import usable_works

DEFAULT_FROM = "2025-01-01"  # fixed value: lower date bound of a detection


SIDE_NAMES = {"work_id": "id", "title_norm": "norm", "title_keyword": "keyword", "title_vector": "vector"}


def _side(table: DataFrame, prefix: str, fields: list[str], others: tuple[str, ...] = ()) -> DataFrame:
    """`fields` under the names they have on one side of an edge, and `others` as they are."""
    return table.select(*others, *[F.col(c).alias(f"{prefix}_{SIDE_NAMES.get(c, c)}") for c in fields])


def _prepare(works: DataFrame) -> tuple[DataFrame, list[str]]:
    """Titles normalised once per record, with the lengths of vectors where there are any."""
    prepared, fields = with_title_forms(works), ["title", "title_norm", "authors"]
    if "title_vector" in works.columns:
        prepared = with_norm(prepared, "title_vector", "vector_norm")
        fields += ["title_vector", "vector_norm"]
    return prepared, fields


def attach_works(
    edges: DataFrame,
    works: DataFrame,
    usable_only: bool = True,
    rows_per_salt: int = ROWS_PER_SALT,
    salted: bool | None = None,
) -> DataFrame:
    """Edges with the fields of both records.

    With `title_vector` among the columns of `works`, both vectors and their lengths come along.
    """
    prepared, fields = _prepare(works)
    mains = usable_works(prepared) if usable_only else prepared
    sides = [
        (_side(mains, "main", ["work_id", *fields]), "main_id", "inner"),
        (_side(prepared, "citing", ["work_id", *fields, "title_keyword"]), "citing_id", "inner"),
    ]
    return join_records(edges, sides, rows_per_salt=rows_per_salt, salted=salted)


def attach_mains(
    citations: DataFrame, works: DataFrame, rows_per_salt: int = ROWS_PER_SALT, salted: bool | None = None
) -> DataFrame:
    """The same from harvested citations, whose rows hold the citing record already: one join."""
    prepared, fields = _prepare(citations)
    facts = _side(prepared, "citing", [*fields, "title_keyword"], ("main_id", "citing_id", "is_xml", "datestamp"))
    mains, main_fields = _prepare(usable_works(works))
    side = (_side(mains, "main", ["work_id", *main_fields]), "main_id", "inner")
    return join_records(facts, [side], rows_per_salt=rows_per_salt, salted=salted)


def edge_similarity(attached: DataFrame) -> Column | None:
    """Title similarity of an attached edge, or None without vectors."""
    if "main_vector" not in attached.columns:
        return None
    norms = F.col("citing_vector_norm"), F.col("main_vector_norm")
    cos = cosine(F.col("citing_vector"), F.col("main_vector"), *norms)
    return title_similarity(F.col("citing_norm"), F.col("main_norm"), cos)


def flag_errata(attached: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Add `is_erratum`, by vectors where there are any, and drop what only it needed."""
    verdict = guarded_erratum(
        F.col("citing_title"),
        F.col("main_title"),
        F.col("citing_keyword"),
        F.col("citing_norm"),
        F.col("main_norm"),
        edge_similarity(attached),
        threshold,
    )
    return attached.withColumn("is_erratum", verdict).drop(
        "citing_keyword",
        "citing_norm",
        "main_norm",
        "main_vector",
        "citing_vector",
        "main_vector_norm",
        "citing_vector_norm",
    )


def judge(
    attached: DataFrame,
    author_threshold: float = AUTHOR_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
    skip_flagged: bool = False,
) -> DataFrame:
    """Erratum flag, author score and match texts of attached edges.

    Authors of errata are not compared; with `skip_flagged` neither are those of edges
    the catalogue already flags. Such edges carry score 0.0 and no matches.
    """
    flagged = flag_errata(attached, title_threshold)
    decided = F.col("is_erratum") | F.col("is_xml") if skip_flagged else F.col("is_erratum")
    mains, citing = F.col("main_authors"), F.col("citing_authors")
    # Generated, not projected: a filter on what follows then stays above the scoring in place of repeating it.
    scores = compare(author_scores(author_threshold), mains, citing, unless=decided)
    scored = flagged.select("*", F.explode(F.array(scores)).alias("scores"))
    return scored.select(
        "main_id",
        "citing_id",
        "main_title",
        "citing_title",
        "main_authors",
        "citing_authors",
        "is_xml",
        "is_erratum",
        F.col("scores.dl").alias("score"),
        F.col("scores.dl4").alias("score4"),
        match_texts(F.col("scores.matches"), mains, citing).alias("matches"),
    )


def judge_edges(
    edges: DataFrame,
    works: DataFrame,
    from_date: str | None = None,
    salted: bool | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    **options,
) -> DataFrame:
    """`judge` over edges of ids, both of whose records are in `works`."""
    chosen = since(edges, from_date) if from_date else edges
    return judge(attach_works(chosen, works, True, rows_per_salt, salted), **options)


def judge_citations(
    citations: DataFrame,
    works: DataFrame,
    from_date: str | None = None,
    salted: bool | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    **options,
) -> DataFrame:
    """`judge` over harvested citations of the mains in `works`."""
    chosen = since(citations, from_date) if from_date else citations
    return judge(attach_mains(chosen, works, rows_per_salt, salted), **options)


def requested_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Edges of requested mains, each once however often it is requested."""
    wanted = requests.select(F.col("work_id").alias("main_id")).distinct()
    return join_records(edges, [(wanted, "main_id", "left_semi")])
