"""Cosine of title vectors and the hook that fills them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocite.functions.titles import strip


def dot(a: Column, b: Column) -> Column:
    """Sum of products in DOUBLE, in index order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def with_norm(df: DataFrame, vector: str, norm: str) -> DataFrame:
    """Add the Euclidean length of a vector column: once per work, not once per edge."""
    return df.withColumn(norm, F.sqrt(dot(F.col(vector), F.col(vector))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; NULL where one is missing or has length 0."""
    norm_a = F.sqrt(dot(a, a)) if norm_a is None else norm_a
    norm_b = F.sqrt(dot(b, b)) if norm_b is None else norm_b
    return F.try_divide(dot(a, b), norm_a * norm_b)


def title_similarity(norm_a: Column, norm_b: Column, cos: Column) -> Column:
    """Similarity of two normalised titles: an empty one scores 0, equal ones 1, others their cosine."""
    empty = (norm_a == "") | (norm_b == "")
    return F.when(empty, 0.0).when(norm_a == norm_b, 1.0).otherwise(F.coalesce(cos, F.lit(0.0)))


def text_similarity(text_a: Column, text_b: Column, cos: Column) -> Column:
    """The same for raw texts: empty as given, equal after lower-casing and stripping."""
    a, b = F.coalesce(text_a, F.lit("")), F.coalesce(text_b, F.lit(""))
    equal = F.lower(strip(a)) == F.lower(strip(b))
    return F.when((a == "") | (b == ""), 0.0).when(equal, 1.0).otherwise(F.coalesce(cos, F.lit(0.0)))


def embed_titles(
    works: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], title: str = "title_norm"
) -> DataFrame:
    """(title, title_vector) for each distinct title of `works`.

    `load` runs once per Python worker and returns a function from a list of titles to a
    list of vectors. Join the result back on the title.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for batch in batches:
            yield pa.array(encode(batch.to_pylist()), pa.list_(pa.float32()))

    # The annotations above are strings here; Spark reads the real types.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    vector = F.arrow_udf(run, T.ArrayType(T.FloatType()))
    return works.select(title).filter(F.col(title) != "").distinct().withColumn("title_vector", vector(F.col(title)))
