"""Title normalisation and the keyword test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an erratum, in English and Slovak.
ERRATA_KEYWORDS = ["erratum", "errata", "corrigendum", "correction", "oprava", "korekcia"]

# The dashes that become '-': hyphen, en dash, em dash.
DASHES = "‐–—"

# Unicode white space plus the four ASCII separators the regex class leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"


# Every character that Python's str.strip removes; all of them lie up to U+3000.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Cut white space of any kind from both ends; `trim` alone knows the space only."""
    return F.trim(text, F.lit(WHITE_SPACE))


def normalize_title(title: Column) -> Column:
    """Unify dashes, collapse white space, strip, lower-case; NULL becomes ''."""
    unified = F.translate(title, DASHES, "-" * len(DASHES))
    return F.coalesce(F.lower(F.trim(F.regexp_replace(unified, SPACES, " "))), F.lit(""))


def has_errata_keyword(normalized: Column) -> Column:
    """A whole space-delimited token of a normalised title is a keyword."""
    return F.arrays_overlap(F.split(normalized, " "), F.array(*map(F.lit, ERRATA_KEYWORDS)))
