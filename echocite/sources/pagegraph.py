"""The given tables as works, authors and citation edges.

A web page is a record: its title element is the title, its navigation words read two by
two are the authors' last and first names, and a plain lower-case link is the first
word's person id. An order line is a citation of the page its order key falls on by the
page its part key falls on. Every row of `pages` and `lineitem` takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.operators.shaping import drop_repeated_authors

TITLE = "<title>([^<]*)</title>"
PAIR = '<li><a href="([^"]*)">([^<]*)</a></li>(?:<li><a href="[^"]*">([^<]*)</a></li>)?'
SITE = "://([^/]+)/"
FIRST_ID = 100000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_id(page: Column) -> Column:
    return (F.lit(FIRST_ID) + page).cast("string")


def author_entries(html: Column) -> Column:
    """Author structs of a page before repeats are dropped."""

    def entry(pair: Column) -> Column:
        link, last, first = (F.regexp_extract(pair, PAIR, group) for group in (1, 2, 3))
        person = F.when(link.rlike("^/[a-z]+$"), F.substring(link, F.lit(2), F.length(link))).otherwise("")
        return F.struct(F.trim(F.concat(last, F.lit(" "), first)).alias("name"), person.alias("id"))

    return F.transform(F.regexp_extract_all(html, F.lit(PAIR), F.lit(0)), entry)


def works(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """work_id, title, authors, site; with `vectors` also the embedding of the same number."""
    marker = F.when(F.col("url").endswith("#top"), "Correction to ").when(
        F.col("url").endswith("utm_source=feed"), "Erratum: "
    ).otherwise("")
    pages = table(spark, sf_dir, "pages")
    shaped = pages.select(
        work_id(F.col("page_id")).alias("work_id"),
        F.concat(marker, F.regexp_extract("html", TITLE, 1)).alias("title"),
        author_entries(F.col("html")).alias("authors"),
        F.regexp_extract("url", SITE, 1).alias("site"),
    )
    shaped = drop_repeated_authors(shaped)
    if not vectors:
        return shaped
    embeddings = table(spark, sf_dir, "embeddings").select(
        work_id(F.col("vec_id")).alias("work_id"), F.col("embedding").alias("title_vector"), "label"
    )
    return shaped.join(embeddings, "work_id", "left")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main_id, citing_id, is_xml, datestamp; repeated citations of a pair are one edge."""
    pages = table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).scalar()
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % pages).alias("main"),
        (F.col("l_partkey") % pages).alias("citing"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("is_xml"),
        F.col("l_shipdate").alias("datestamp"),
    )
    merged = (
        lines.filter(F.col("main") != F.col("citing"))
        .groupBy("main", "citing")
        .agg(F.max("is_xml").alias("is_xml"), F.max("datestamp").alias("datestamp"))
    )
    return merged.select(
        work_id(F.col("main")).alias("main_id"), work_id(F.col("citing")).alias("citing_id"), "is_xml", "datestamp"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, request text: one per order, naming the numbers of its customer and order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat_ws(
            " ",
            F.col("o_orderstatus"),
            (F.lit(FIRST_ID) + F.col("o_custkey")).cast("string"),
            F.lit("; page"),
            (F.lit(FIRST_ID) + F.col("o_orderkey")).cast("string"),
            F.col("o_orderpriority"),
        ).alias("request"),
    )
