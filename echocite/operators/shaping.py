"""From a harvested record to identifier, title, authors and self-citation flags.

Everything here is a column expression over one record's own nested fields or its text, so
shaping is a narrow job: no shuffle, however many records or authors there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.functions.titles import strip
from echocite.operators.raw import record_facts_of

# Roles that count as authorship.
AUTHOR_ROLES = ["author", "author_corporation"]


def text_of(value: Column) -> Column:
    """Stripped text, '' for NULL."""
    return F.coalesce(strip(value), F.lit(""))


def first_text(values: Column) -> Column:
    """Text of the first of several children, '' when there is none."""
    return text_of(F.get(values, F.lit(0)))


def last_text(values: Column) -> Column:
    """Text of the last of several children, '' when there is none."""
    return text_of(F.try_element_at(values, F.lit(-1)))


def citing_id(identifier: Column) -> Column:
    """What follows the last slash of a protocol identifier."""
    return F.substring_index(identifier, "/", -1)


def live_records(records: DataFrame) -> DataFrame:
    """Records with a header, not deleted, with an identifier."""
    identifier = F.get(F.col("header.identifier"), F.lit(0))
    not_deleted = F.col("header._status").isNull() | (F.col("header._status") != "deleted")
    return records.filter(F.col("header").isNotNull() & not_deleted & (F.length(identifier) > 0))


def since(records: DataFrame, from_date: str, datestamp: str = "datestamp") -> DataFrame:
    """Inclusive lower bound on the record date; records without a readable date are kept."""
    return records.filter(F.col(datestamp).isNull() | (F.col(datestamp) >= F.lit(from_date).cast("timestamp")))


def _flat(arrays: Column) -> Column:
    """Flatten an array of arrays, skipping missing ones."""
    return F.flatten(F.filter(arrays, lambda a: a.isNotNull()))


def full_name(last: Column, first: Column, label: Column) -> Column:
    """`last first` when there is a last name, otherwise the label."""
    return F.when(last != "", strip(F.concat(last, F.lit(" "), first))).otherwise(label)


def person_index(entries: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """The same rule over a flat table: longest name per `keys`, the first by `order` among equally long.

    One aggregation, combined map-side, so a person repeated in a third of all rows costs
    no more than any other. `order` are numeric columns.
    """
    earliest = [(-F.col(c)).alias(c) for c in order]
    best = F.max(F.struct(F.length(name).alias("size"), *earliest, F.col(name).alias("name")))
    return entries.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.name").alias(name))


def drop_repeated_authors(df: DataFrame, column: str = "authors") -> DataFrame:
    """Drop repeats by id, or by exact name for authors without id; keep first and order.

    The keys are a column of their own, so that they are built once per record and not
    again for every author.
    """
    by_id, by_name = (lambda a: F.concat(F.lit("i:"), a["id"])), (lambda a: F.concat(F.lit("n:"), a["name"]))
    keys = F.transform(column, lambda a: F.when(a["id"] != "", by_id(a)).otherwise(by_name(a)))
    first = F.transform(
        F.array_distinct("_keys"),
        lambda key: F.get(F.col(column), (F.array_position("_keys", key) - 1).cast("int")),
    )
    return df.withColumn("_keys", keys).withColumn(column, first).drop("_keys")


def with_authors(df: DataFrame, biblio: Column) -> DataFrame:
    """Add the `authors` of each record.

    A bond may hold several persons: the last one gives the id, and each name part comes
    from the last person that states it. A name is built from last and first name, or is
    the label, or is looked up by id among all persons that the record's text (`record_xml`)
    states at any depth; unnamed ones are dropped.
    """
    bonds = F.filter(F.coalesce(biblio["cross_biblio_person"], F.array()), lambda b: b["_role"].isin(AUTHOR_ROLES))

    def stated(bond: Column) -> Column:
        people = bond["rec_person"]
        last, first, label = (
            last_text(_flat(F.transform(people, lambda p: p[field]))) for field in ("lastname", "firstname", "labelname")
        )
        person_id = text_of(F.try_element_at(people, F.lit(-1))["_id"])
        return F.struct(full_name(last, first, label).alias("name"), person_id.alias("id"))

    def looked_up(author: Column) -> Column:
        known = F.coalesce(F.try_element_at("_persons", author["id"]), F.lit(""))
        return F.struct(F.when(author["name"] != "", author["name"]).otherwise(known).alias("name"), author["id"].alias("id"))

    # The text is read for persons only where an identified author lacks a name, once for all authors of the record.
    unnamed = F.exists("_stated", lambda a: (a["name"] == "") & (a["id"] != ""))
    staged = df.withColumn("_stated", F.transform(bonds, stated))
    facts = record_facts_of(F.when(unnamed, F.col("record_xml")))["persons"]
    staged = staged.select("*", F.explode(F.array(facts)).alias("_persons"))
    named = F.when(F.col("_persons").isNotNull(), F.transform("_stated", looked_up)).otherwise(F.col("_stated"))
    listed = staged.withColumn("authors", F.filter(named, lambda a: a["name"] != ""))
    return drop_repeated_authors(listed.drop("_stated", "_persons"))


def _flagged_targets(bonds: Column) -> Column:
    """Ids that bonds marked as self-citation point at."""
    marked = F.filter(bonds, lambda b: F.lower(first_text(b["autocitation"])) == "true")
    return F.transform(_flat(F.transform(marked, lambda b: b["rec_biblio"])), lambda r: text_of(r["_id"]))


def flagged_targets(biblio: Column) -> Column:
    """Strict form: self-citation bonds that are direct children of the record."""
    return F.coalesce(_flagged_targets(biblio["cross_biblio_biblio"]), F.array())


def _biblio_path(wrapper: str) -> str:
    return f"metadata.{wrapper}.rec_biblio" if wrapper else "metadata.rec_biblio"


def shape_citations(records: DataFrame, target: str, wrapper: str = "xml", loose: bool = False) -> DataFrame:
    """Citing records of `target` (a column of `records`): id, title, authors, flag, date.

    The flag's strict form looks at self-citation bonds that are direct children of the first record; `loose` looks
    at those of all records of the entry, at any depth. A stamp that is no date is NULL.
    """
    biblios = F.col(_biblio_path(wrapper))
    biblio, main = F.get(biblios, F.lit(0)), strip(F.col(target).cast("string"))
    targets = record_facts_of(F.col("record_xml"))["flagged"] if loose else flagged_targets(biblio)
    # Short rows go past the reader of persons, not whole parsed records.
    shaped = live_records(records).select(
        main.alias("main_id"),
        citing_id(F.get(F.col("header.identifier"), F.lit(0))).alias("citing_id"),
        F.try_to_timestamp("header.datestamp").alias("datestamp"),
        text_of(F.get(biblio["title"], F.lit(0))["_VALUE"]).alias("title"),
        F.coalesce(F.array_contains(targets, main), F.lit(False)).alias("is_xml"),
        "record_xml",
        biblio.alias("_biblio"),
    )
    return with_authors(shaped, F.col("_biblio")).select("main_id", "citing_id", "datestamp", "title", "authors", "is_xml")


def shape_works(records: DataFrame, wrapper: str = "xml") -> DataFrame:
    """Main records: id, title, authors, date. An entry without a record is absent."""
    biblio = F.get(F.col(_biblio_path(wrapper)), F.lit(0))
    stated_id = citing_id(F.get(F.col("header.identifier"), F.lit(0)))
    return with_authors(records.filter(biblio.isNotNull()), biblio).select(
        F.coalesce(stated_id, text_of(biblio["_id"])).alias("work_id"),
        text_of(F.get(biblio["title"], F.lit(0))["_VALUE"]).alias("title"),
        "authors",
        F.try_to_timestamp("header.datestamp").alias("datestamp"),
    )


def _newest(rows: DataFrame, keys: list[str], others: list) -> DataFrame:
    """One row for each key: title and authors of the newest, undated ones last, and then the greatest title."""
    stamp = F.col("datestamp") if "datestamp" in rows.columns else F.lit(None).cast("timestamp")
    best = F.max(F.struct(stamp.alias("datestamp"), "title", "authors")).alias("best")
    return rows.groupBy(*keys).agg(best, *others)


def newest_works(works: DataFrame) -> DataFrame:
    """`works` with one row for each work_id, however often it was harvested. Other columns are left out."""
    return _newest(works, ["work_id"], []).select("work_id", "best.title", "best.authors")


def merge_citations(citations: DataFrame) -> DataFrame:
    """Citations of overlapping harvests as one row for each pair: flagged if any is, as new as the newest."""
    merged = _newest(citations, ["main_id", "citing_id"], [F.max("is_xml").alias("is_xml")])
    return merged.select("main_id", "citing_id", "best.datestamp", "best.title", "best.authors", "is_xml")


def coerce_authors(authors: Column) -> Column:
    """Author structs from a list of variants: objects, or bare values taken as a name."""

    def one(entry: Column) -> Column:
        is_object = F.schema_of_variant(entry).startswith("OBJECT")
        name = F.when(is_object, F.try_variant_get(entry, "$.name", "string")).otherwise(
            F.try_variant_get(entry, "$", "string")
        )
        person = F.when(is_object, F.try_variant_get(entry, "$.id", "string"))
        return F.struct(F.coalesce(name, F.lit("")).alias("name"), text_of(person).alias("id"))

    return F.transform(authors, one)
