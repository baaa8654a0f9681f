"""Deletion of repeated lines and runs of them, in DataFrame functions only.

Lines that aren't blank are hashed, and of each window of grams (GRAM lines in a row) the one with the least hash is a
fingerprint. A fingerprint's first place, by id and position, is its anchor; at all later ones the lines repeat, and so do
the lines around them as far as they agree with those around the anchor. A window's length is as far as that need go, since
a run that agrees further has its next fingerprint by then. Any repeated run of GRAM + WINDOW - 1 lines or more has a
fingerprint, so most of what repeats is found from few rows, and what these runs cover is done with.

The lines that are left, each a fingerprint of its own, are compared one by one: no line's first place is ever covered, so
they tell shorter runs and single repeated lines exactly. Runs of repeated lines that follow each other (blank lines
aside) are joined, and those of MIN_CHARS or more are deleted: the first of any equal lines is always kept, and a later
one of MIN_CHARS or more always goes, whatever is around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echocite.llm.common import fresh, once, row_key
from echocite.session import settle

GRAM = 2  # lines that make a gram
WINDOW = 4  # grams; any run of GRAM + WINDOW - 1 lines has a fingerprint
MIN_CHARS = 40  # that a deleted run has at least
BLANKS = " \t\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _full_lines(text: str) -> dict[str, Column]:
    """The numbers of the lines that aren't blank, in order, with the hashes and lengths of their trimmed text."""
    trimmed = F.transform(
        _lines(text),
        lambda x, k: F.struct(k.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")),
    )
    full = F.filter(trimmed, lambda x: x["line"] != "")
    return {
        "full": F.transform(
            full,
            lambda x: F.struct(
                x["at"].alias("at"), F.xxhash64(x["line"]).alias("hash"), F.length(x["line"]).alias("chars")
            ),
        )
    }


def _alike(a: str, b: Column) -> Column:
    """How many elements agree from the start of two arrays on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text_hash, h): the hashes of each row's lines that aren't blank, in order; settled."""
    narrow = docs.select(row_key(id_col, text_col).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col))
    marked = once(narrow, **_full_lines(text_col)).select("key", "text_hash", F.col("full.hash").alias("h"))
    return settle(marked.filter(F.size("h") > 0), "line-hashes")


def fingerprints(marked: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(print, key, text_hash, at, before, after) for every selected gram: its hash, its place among the lines that
    aren't blank, and the line hashes around it, nearest first, as many as a window is long less one."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size("h") - gram),
        lambda k: F.struct(F.xxhash64(F.slice(F.col("h"), k + 1, F.lit(gram))).alias("print"), (-k).alias("minus")),
    )
    listed = once(marked.filter(F.size("h") >= gram), grams=grams)
    least = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("grams") - window, F.lit(0))),
        lambda k: F.array_min(F.slice(F.col("grams"), k + 1, F.lit(window))),
    )
    return _around(listed.select("key", "text_hash", "h", F.inline(F.array_distinct(least))), gram, window)


def _around(chosen: DataFrame, gram: int, window: int) -> DataFrame:
    """Selected grams with the line hashes around them."""
    at, reach = -F.col("minus"), F.lit(window - 1)
    left = F.least(at, reach)
    before = F.reverse(F.slice("h", at - left + 1, left))
    after = F.slice("h", at + gram + 1, reach)
    return chosen.select("print", "key", "text_hash", at.alias("at"), before.alias("before"), after.alias("after"))


def _later(found: DataFrame, name: str, carry: Column) -> DataFrame:
    """Rows of `found` whose `name` has an earlier place, with the `carry` of the first one as `anchor`.

    The first places are written, so that the join reads both its sides from shuffles and one value with very many
    places can be split. Repeats of one row have one place.
    """
    place = F.struct("key", "text_hash", "at")
    spot = F.struct(place.alias("place"), carry.alias("carry"))
    first = found.groupBy(name).agg(F.min(spot).alias("anchor"), F.max(place).alias("last"))
    first = first.filter(F.col("anchor.place") != F.col("last")).select(name, "anchor")
    pairs = found.join(settle(first, f"first-{name}"), name).filter(place != F.col("anchor.place"))
    return pairs.withColumn("anchor", F.col("anchor.carry"))


def _joined(spans: DataFrame) -> DataFrame:
    """(key, text_hash, runs): spans (first, end) that meet or overlap as one, in order; at most one for each line."""
    order = Window.partitionBy("key", "text_hash").orderBy("first", F.desc("end"))
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("first") <= reached, 0).otherwise(1)
    spans = spans.distinct().withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    runs = spans.groupBy("key", "text_hash", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    listed = runs.groupBy("key", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    return listed.select("key", "text_hash", F.sort_array("runs").alias("runs"))


def gram_runs(marked: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, text_hash, runs): the runs that fingerprints of grams find, extended both ways."""
    found = fingerprints(marked, gram, window)
    pairs = _later(found, "print", F.struct("before", "after"))
    left, right = _alike("before", F.col("anchor.before")), _alike("after", F.col("anchor.after"))
    first, end = (F.col("at") - left).alias("first"), (F.col("at") + gram + right).alias("end")
    return _joined(pairs.select("key", "text_hash", first, end))


def _left_over(marked: DataFrame, runs: DataFrame) -> DataFrame:
    """(hash, key, text_hash, at) of the lines outside the runs."""
    joined = marked.join(runs, ["key", "text_hash"], "left")
    cut = F.coalesce("runs", F.array().cast("array<struct<first:int,end:int>>"))
    joined = joined.select("key", "text_hash", "h", F.size("h").alias("size"), cut.alias("runs"))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get("runs", k - 1)["end"]).alias("first"),
            F.coalesce(F.get("runs", k)["first"], F.col("size")).alias("end"),
        ),
    )
    gaps = joined.select("key", "text_hash", "h", F.inline(gaps)).filter("first < end")
    own = F.slice("h", F.col("first") + 1, F.col("end") - F.col("first"))
    listed = gaps.select("key", "text_hash", "first", F.posexplode(own).alias("k", "line"))
    return listed.select("line", "key", "text_hash", (F.col("first") + F.col("k")).alias("at"))


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """(key, text_hash, runs): for each row with repeated lines the runs (first, end) of them, as numbers of lines that
    aren't blank, from 0, in order and apart from each other."""
    marked = line_hashes(docs, id_col, text_col)
    covered = settle(gram_runs(marked, gram, window), "gram-runs")
    single = _later(_left_over(marked, covered), "line", F.lit(None))
    spans = single.select("key", "text_hash", F.col("at").alias("first"), (F.col("at") + 1).alias("end"))
    return _joined(spans.unionByName(covered.select("key", "text_hash", F.inline("runs"))))


def without_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    window: int = WINDOW,
    min_chars: int = MIN_CHARS,
) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with three columns more, and their names: the text that is kept, the number of lines that are deleted, and
    the deleted runs as (first, last) numbers of lines from 0. Blank lines within a run go with it.

    Rows with the same id and text are one document: each gets the same result, and they don't count as repeats of
    each other. Of rows with the same id and different texts the first is the one whose text has the least hash. Rows
    without id come after all others. A missing text stays missing. An empty table gives an empty result.
    """
    names = {n: fresh(docs, n) for n in ("kept_text", "n_deleted", "deleted", "row_key", "text_hash", "runs")}
    runs = repeated_runs(docs, id_col, text_col, gram, window)
    runs = runs.toDF(names["row_key"], names["text_hash"], names["runs"])
    keyed = docs.withColumn(names["row_key"], row_key(id_col, text_col))
    keyed = keyed.withColumn(names["text_hash"], F.xxhash64(text_col))
    joined = keyed.join(runs, [names["row_key"], names["text_hash"]], "left")
    part = joined.select(
        F.struct(*docs.columns).alias("row"),
        F.col(names["runs"]).alias("runs"),
        F.when(F.col(names["runs"]).isNotNull(), F.col(text_col)).alias("text"),
    )
    part = once(part, whole=_lines("text"), **_full_lines("text"))
    full, whole = F.col("full"), F.col("whole")

    def chars(run: Column) -> Column:
        own = F.slice(full, run["first"] + 1, run["end"] - run["first"])
        return F.aggregate(own, F.lit(0), lambda n, x: n + x["chars"])

    long_runs = F.filter("runs", lambda run: chars(run) >= min_chars)
    spans = F.transform(
        long_runs,
        lambda run: F.struct(
            F.get(full, run["first"])["at"].alias("first"), F.get(full, run["end"] - 1)["at"].alias("last")
        ),
    )
    part = once(part, cut=F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>")))
    cut = F.col("cut")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get(cut, k - 1)["last"] + 1).alias("first"),
            F.when(k == F.size(cut), F.size(whole)).otherwise(F.get(cut, k)["first"]).alias("end"),
        ),
    )
    lines = F.flatten(F.transform(kept, lambda s: F.slice(whole, s["first"] + 1, s["end"] - s["first"])))
    deleted = F.aggregate(cut, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    text = F.when(F.size(cut) > 0, F.array_join(lines, "\n")).otherwise(F.col("row")[text_col])
    out = part.select(
        "row.*",
        text.alias(names["kept_text"]),
        deleted.alias(names["n_deleted"]),
        cut.alias(names["deleted"]),
    )
    return out, names


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated runs deleted from the texts; a row of which nothing is left is dropped."""
    cut, names = without_runs(docs, id_col, text_col)
    left = (F.col(names["n_deleted"]) == 0) | (F.btrim(names["kept_text"], F.lit(BLANKS + "\n")) != "")
    columns = [F.col(names["kept_text"]).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return cut.filter(left).select(*columns)
