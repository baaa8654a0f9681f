"""Cleaning of free-text citation strings and splitting them into fields, as a column job.

The literal rewrites and the order of the fields are given; the patterns that find a
field are this library's own, because no rule for them is published. All patterns avoid
look-around, so that they mean the same in other engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literal rewrites, applied in this order.
FIRST_REWRITES = [
    ("–", "-"),
    ("‐", "-"),
    (" a ", ","),
    (" l ", " 1 "),
    (" l,", " 1,"),
    (" l.", " 1."),
    (" l]", " 1]"),
    ("? ", ""),
    ("#", ""),
]
SECOND_REWRITES = [
    ("Číslo článku", "art.no."),
    ("neuvedebý", ""),
    ("neuvedený", ""),
    ("neuvedené", ""),
    ("(dvojčíslo)", ""),
    (" ", " "),
    ("]-", "-"),
    ("na CD", "[CD-ROM]"),
    ("a.n.", "art.no."),
    ("Dostupné na internete", "(online)"),
    ("dostupné na internete", "(online)"),
    ("Nno", "No"),
]
ABBREVIATIONS = [
    ("iv-v", "IV-V"),
    (" a ", " , "),
    ("iss.", "no."),
    ("s.", "p."),
    ("p. [", "p.["),
    ("Roč ", "Roč. "),
    ("Č ", "č. "),
]
LATE_REWRITES = [("no.no.", "no."), ("no.number", "no."), (".:", ".")]

# Field names of the result, in order.
FIELDS = [
    "volume",
    "issue",
    "month",
    "year",
    "isSpecialIssue",
    "articelNumber",
    "series",
    "format",
    "link",
    "page",
    "startPage",
    "endPage",
    "chapter",
    "doi",
    "date",
    "supplement",
    "info",
]
UNHANDLED = 10001  # fixed value: status when something is left over

# Own rules: (field, pattern, group). The whole match is taken out of the string.
EARLY_RULES = [
    ("link", r"(https?://[^\s,;]+)", 1),
    ("chapter", r"(?i)(?:kap\.|chap\.|chapter)\s*([0-9]+)", 1),
    ("format", r"(?i)[\[(](CD-ROM|DVD|USB|online)[\])]", 1),
    ("supplement", r"(?i)suppl(?:\.|ement)\s*([0-9]+)", 1),
    ("doi", r"(?i)(?:doi:?\s*)?(10\.[0-9]{4,9}/[^\s,;]+)", 1),
    ("series", r"(?i)(?:ser\.|series)\s*([0-9A-Z]+)", 1),
]
SPECIAL_ISSUE = r"(spec\.issue|specialissue|spec\.no\.|mimoriadnečíslo)"
DATE = ("date", r"([0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})", 1)
YEAR = ("year", r"\(?((?:19|20)[0-9]{2})\)", 1)
MONTH = ("month", r"\(?(jan|feb|mar|apr|máj|may|jún|jun|júl|jul|aug|sep|okt|oct|nov|dec)[a-zá]*[)/.]", 1)
LATE_RULES = [
    ("articelNumber", r"art\.no\.([0-9a-z]+)", 1),
    ("volume", r"(?:vol|roč)\.([0-9]+)", 1),
]
ISSUE = ("issue", r"(?:no|č)\.([0-9]+(?:[-/][0-9]+)?)", 1)
PAGE_RANGE = r"p{1,2}\.\[?([0-9]+)-([0-9]+)\]?"
SINGLE_PAGE = ("page", r"p{1,2}\.\[?([0-9]+)\]?", 1)
BARE_RANGE = r"([0-9]+)-([0-9]+)"
# For each field literals of which every match of its rule holds at least one; True: in any case of letters.
NEEDED = {
    "link": (False, ["http"]),
    "chapter": (True, ["kap.", "chap"]),
    "format": (True, ["cd-rom", "dvd", "usb", "online"]),
    "supplement": (True, ["suppl"]),
    "doi": (False, ["10."]),
    "series": (True, ["ser.", "series"]),
    "isSpecialIssue": (False, ["spec", "mimoriadne"]),
    "date": (False, [".19", ".20"]),
    "articelNumber": (False, ["art.no."]),
    "volume": (False, ["vol.", "roč."]),
    "issue": (False, ["no.", "č."]),
    "page": (False, ["p."]),
}
NOT_TEXT = r"[^\p{L}\p{N}]+"
MONTH_NUMBERS = [
    ("jan", "1"), ("feb", "2"), ("mar", "3"), ("apr", "4"), ("máj", "5"), ("may", "5"), ("jún", "6"), ("jun", "6"),
    ("júl", "7"), ("jul", "7"), ("aug", "8"), ("sep", "9"), ("okt", "10"), ("oct", "10"), ("nov", "11"), ("dec", "12"),
]


def rewrite(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def first_cleaning(text: Column) -> Column:
    """The form that is echoed as the input string."""
    return rewrite(F.coalesce(text, F.lit("")), FIRST_REWRITES)


def second_cleaning(text: Column) -> Column:
    cleaned = rewrite(text, SECOND_REWRITES)
    return F.when(cleaned.startswith("ol."), F.concat(F.lit("v"), cleaned)).otherwise(cleaned)


def unify_abbreviations(text: Column) -> Column:
    return F.replace(F.lower(rewrite(text, ABBREVIATIONS)), F.lit(" "), F.lit(""))


# Own rule: what stands before a numeral in volume or issue position, and numerals from I to MMMCMXCIX.
ROMAN_PLACES = ("vol.", "Vol.", "roč.", "Roč.", "no.", "No.", "č.", "Č.", "iss.")
ROMAN = "M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
ROMAN_LETTERS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(numeral: Column) -> Column:
    """The number of a Roman numeral in capitals: a letter before a greater one counts against it."""
    values = F.lit(None).cast("int")
    letters = F.split(numeral, "")

    def value(letter: Column) -> Column:
        own = values
        for name, number in ROMAN_LETTERS.items():
            own = F.when(letter == name, number).otherwise(own)
        return F.coalesce(own, F.lit(0))

    numbers = F.transform(letters, value)
    signed = F.transform(numbers, lambda x, k: F.when(x < F.coalesce(F.get(numbers, k + 1), F.lit(0)), -x).otherwise(x))
    return F.aggregate(signed, F.lit(0), lambda total, x: total + x)


def roman_number(text: Column, place: str) -> Column:
    """Own rule, since none is given: a Roman numeral in capitals right after the word for volume or issue becomes a
    number. Letters that are no numeral, or go on as a word, stay."""
    pattern = place.replace(".", "\\.") + f"\\s*({ROMAN})([^\\p{{L}}\\p{{N}}]|$)"
    numeral, after = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    number = F.concat(F.lit(place + " "), roman_value(numeral).cast("string"), after)
    changed = F.replace(text, F.regexp_extract(text, pattern, 0), number)
    capitals = F.regexp_like(text, F.lit("[IVXLCDM]"))
    return F.when(F.contains(text, F.lit(place)) & capitals & (numeral != ""), changed).otherwise(text)


def late_cleaning(text: Column) -> Column:
    return rewrite(text, LATE_REWRITES)


def clean(text: Column) -> Column:
    """All rewrites in order, with no field taken out in between."""
    short = unify_abbreviations(second_cleaning(first_cleaning(text)))
    return late_cleaning(F.replace(short, F.lit("[cit.]"), F.lit("")))


def _due(field: str) -> Column:
    """Whether `row` holds one of the literals without which a field's rule cannot match; told without an expression."""
    folded, literals = NEEDED[field]
    row = F.lower("row") if folded else F.col("row")
    return reduce(Column.__or__, (F.contains(row, F.lit(x)) for x in literals))


def _take(df: DataFrame, rule: tuple[str, str, int]) -> DataFrame:
    """Move what a rule finds in `row` to its field; NULL where it finds nothing."""
    field, pattern, group = rule
    found = F.nullif(F.regexp_extract("row", pattern, group), F.lit(""))
    found = F.when(_due(field), found) if field in NEEDED else found
    # Only rows with a find are searched a second time.
    rest = F.when(F.col(field).isNotNull(), F.regexp_replace("row", pattern, "")).otherwise(F.col("row"))
    return df.withColumn(field, found).withColumn("row", rest)


def _take_pages(df: DataFrame) -> DataFrame:
    """A marked page range, else a marked page, else an unmarked range."""

    def take_range(rows: DataFrame, pattern: str, only: Column) -> DataFrame:
        only = only & F.contains(F.col("row"), F.lit("-"))
        start = F.nullif(F.regexp_extract("row", pattern, 1), F.lit(""))
        end = F.nullif(F.regexp_extract("row", pattern, 2), F.lit(""))
        return rows.withColumns(
            {
                "startPage": F.coalesce("startPage", F.when(only, start)),
                "endPage": F.coalesce("endPage", F.when(only, end)),
                "row": F.when(only, F.regexp_replace("row", pattern, "")).otherwise(F.col("row")),
            }
        )

    none = F.lit(None).cast("string")
    ranged = take_range(df.withColumns({"startPage": none, "endPage": none}), PAGE_RANGE, F.lit(True))
    single = _take(ranged, SINGLE_PAGE)
    return take_range(single, BARE_RANGE, F.col("page").isNull() & F.col("startPage").isNull())


def split_fields(
    df: DataFrame,
    text: str = "inputString",
    excluded: list[str] | None = None,
    error: str | None = None,
    roman: bool = True,
) -> DataFrame:
    """Add `data` (JSON of the fields found), `errorCode`, `unhandledInput`; echo the input.

    `excluded` are remainders to ignore; `error` names a column with an earlier error code,
    which wins over the one for a remainder. Roman numbers of volumes and issues become Arabic ones, unless `roman`
    is false.
    """
    kept = [c for c in df.columns if c not in (text, error)]
    earlier = F.col(error).cast("int") if error else F.lit(None).cast("int")
    rows = df.select(*kept, earlier.alias("_error"), first_cleaning(F.col(text)).alias(text))
    rows = rows.withColumn("row", second_cleaning(F.col(text)))
    for rule in EARLY_RULES:
        rows = _take(rows, rule)
    if roman:
        for place in ROMAN_PLACES:
            rows = rows.withColumn("row", roman_number(F.col("row"), place))
    rows = rows.withColumn("row", unify_abbreviations(F.col("row")))
    rows = _take(rows, ("isSpecialIssue", SPECIAL_ISSUE, 1)).withColumn(
        "isSpecialIssue", F.when(F.col("isSpecialIssue").isNotNull(), "true")
    )
    rows = _take(rows, DATE).withColumn("row", F.replace("row", F.lit("[cit.]"), F.lit("")))
    rows = _take(_take(rows, YEAR), MONTH)
    for rule in LATE_RULES:
        rows = _take(rows, rule)
    rows = _take(rows.withColumn("row", late_cleaning(F.col("row"))), ISSUE)
    rows = _take_pages(rows).withColumn("row", F.regexp_replace("row", NOT_TEXT, ""))
    number = F.lit(None).cast("string")
    for name, value in MONTH_NUMBERS:
        number = F.when(F.col("month") == name, value).otherwise(number)
    worded = F.regexp_like("row", F.lit(r"^\p{L}+$"))
    rows = rows.withColumns(
        {
            "month": number,
            "info": F.when(worded & ~F.col("row").isin("no"), F.col("row")),
            "row": F.when(worded | (F.col("row") == ""), None).otherwise(F.col("row")),
        }
    )
    ignored = F.col("row").isin(*excluded) if excluded else F.lit(False)
    left_over = F.when(~ignored, F.col("row"))
    result = F.struct(
        F.to_json(F.struct(*FIELDS)).alias("data"),
        text,
        F.coalesce("_error", F.when(left_over.isNotNull(), UNHANDLED)).alias("errorCode"),
        left_over.alias("unhandledInput"),
    )
    # Generated, not projected: a filter on the result must not be pushed through the rules, each of which would repeat it.
    return rows.select(*kept, F.inline(F.array(result)))
