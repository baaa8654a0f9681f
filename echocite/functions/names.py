"""Person-name normalisation."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_name(name: str | None) -> str:
    """Compatibility-decompose, drop combining characters, lower-case, strip.

    The test is the canonical combining class, not the category `M`: marks of class 0
    stay, and letters without a decomposition stay as they are.
    """
    if not name:
        return ""
    if name.isascii():
        return name.lower().strip()
    kept = filter(lambda ch: unicodedata.combining(ch) == 0, unicodedata.normalize("NFKD", name))
    return "".join(kept).lower().strip()


@F.arrow_udf(T.StringType())
def normalize_name(names: pa.Array) -> pa.Array:
    """`plain_name` over a column, once per distinct name of the batch. NULL stays NULL."""
    coded = names.dictionary_encode()
    plain = pa.array([plain_name(n) for n in coded.dictionary.to_pylist()], pa.string())
    return plain.take(coded.indices)
