"""Vectors from the titles themselves: hashed TF-IDF, for erratum tests without an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.operators.errata import with_title_forms

SLOTS = 256


def slot_of(word: Column, slots: int = SLOTS) -> Column:
    """The component that a word adds to: the first 32 bits of its MD5, modulo the number of components."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % slots


def hashed_tfidf(titles: DataFrame, title: str = "title_norm", slots: int = SLOTS) -> DataFrame:
    """(title, title_vector) for each distinct normalised title that isn't empty.

    A word weighs its count in the title times ln((1 + titles) / (1 + titles with it)) + 1; words of the same slot add
    up. Word counts and document frequencies are map-side combined aggregations, and only (word, frequency) is joined
    back, which Spark broadcasts or splits by its size; no vector is shuffled before it is whole.
    """
    distinct = titles.select(title).filter(F.col(title) != "").distinct()
    words = distinct.select(title, F.explode(F.split(title, " ")).alias("word")).filter("word != ''")
    counts = words.groupBy(title, "word").agg(F.count(F.lit(1)).alias("uses"))
    found = counts.groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    total = distinct.count()
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("titles"))) + 1.0
    weighted = counts.join(found, "word").select(title, slot_of(F.col("word"), slots).alias("slot"), (F.col("uses") * idf).alias("w"))
    cells = weighted.groupBy(title, "slot").agg(F.sum("w").alias("w"))
    listed = cells.groupBy(title).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("cells"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    vector = F.transform(places, lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0.0)))
    return listed.select(title, vector.alias("title_vector"))


def with_title_vectors(works: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`works` with a `title_vector` from their titles, NULL where a title is empty."""
    formed = with_title_forms(works)
    vectors = hashed_tfidf(formed, slots=slots)
    return formed.join(vectors, "title_norm", "left").select(*works.columns, "title_vector")
