"""Named queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.functions import editing
from echocite.functions.names import normalize_name
from echocite.functions.title_terms import with_title_vectors
from echocite.functions.titles import has_errata_keyword, normalize_title
from echocite.functions.vectors import cosine, dot, with_norm
from echocite.operators import citation_strings as strings
from echocite.operators import evaluation, raw, status, summaries
from echocite.operators.authors import AUTHOR_THRESHOLD, author_scores, compare
from echocite.operators.errata import TITLE_THRESHOLD, cheap_erratum, guarded_erratum, library_erratum
from echocite.operators.shaping import citing_id, merge_citations, person_index, shape_citations, shape_works, since
from echocite.operators.skew import hot_keys, join_records
from echocite.plans import dataset, detect, experiments
from echocite.session import scratch_path, settle, spread_scan
from echocite.sources import harvest, harvest_source, labelled, pagegraph, runlog, sinks
from echocite.sources.committed import read_committed, write_committed
from echocite.sources.pagegraph import table
from echocite.sources.requests import read_ids, request_ids
from echocite.streaming import incremental, waiting

SINCE = "1998-01-01"

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {}


def query(function: Query) -> Query:
    CATALOG[function.__name__] = function
    return function


def joined(array: Column | str) -> Column:
    return F.array_join(array, "; ")


def author_text(authors: Column) -> Column:
    return joined(F.transform(authors, lambda a: F.concat(a["name"], F.lit("|"), a["id"])))


# Text functions


@query
def works_titles_normalized(spark, sf_dir):
    """Every page title and every document's whole text, normalised and tested for keywords."""
    titles = pagegraph.works(spark, sf_dir).select("work_id", "title")
    documents = spread_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts = documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("work_id"), F.col("text").alias("title")
    )
    rows = titles.unionByName(texts).withColumn("title_norm", normalize_title(F.col("title")))
    return rows.select("work_id", "title_norm", has_errata_keyword(F.col("title_norm")).alias("keyword"))


@query
def authors_normalized(spark, sf_dir):
    """Every author of every page with the normalised name."""
    authors = pagegraph.works(spark, sf_dir).select("work_id", F.posexplode("authors").alias("pos", "a"))
    return authors.select("work_id", "pos", "a.name", "a.id", normalize_name(F.col("a.name")).alias("plain"))


@query
def words_normalized(spark, sf_dir):
    """Name normalisation over every word of every document, counted per result."""
    texts = spread_scan(table(spark, sf_dir, "documents").select("text"))
    words = texts.select(F.explode(F.split("text", r"[ \n]")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    plain = counted.select(normalize_name(F.col("word")).alias("plain"), "uses")
    return plain.groupBy("plain").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("spellings"))


@query
def authors_dedup(spark, sf_dir):
    """Author lists after repeats by id, or by name without id, are dropped."""
    works = pagegraph.works(spark, sf_dir)
    return works.select("work_id", F.size("authors").alias("n_authors"), author_text(F.col("authors")).alias("authors"))


@query
def person_index_longest(spark, sf_dir):
    """Longest name of every person id per site and overall position, first among equals."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", pagegraph.SITE, 1).alias("site"), "html"
    )
    entries = pages.select(
        "site", "page_id", F.posexplode(pagegraph.author_entries(F.col("html"))).alias("pos", "a")
    ).select("site", F.col("a.id").alias("person_id"), F.col("a.name").alias("name"), "page_id", "pos")
    known = entries.filter((F.col("person_id") != "") & (F.col("name") != ""))
    return person_index(known, ["site", "person_id"], "name", ["page_id", "pos"])


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each author name with the next one of the same page, and each title with its page's URL."""
    works = pagegraph.works(spark, sf_dir)
    names = F.col("authors")["name"]
    following = F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
    pairs = works.select("work_id", F.posexplode(F.arrays_zip(names.alias("a"), following.alias("b"))).alias("pos", "p"))
    return pairs.filter(F.col("p.b").isNotNull()).select("work_id", "pos", "p.a", "p.b")


@query
def name_edit_distance(spark, sf_dir):
    """Edit distance and similarity of neighbouring authors, raw and normalised."""
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select(
        "work_id",
        "pos",
        editing.osa_distance(a, b).alias("distance"),
        editing.dl_similarity(a, b).alias("similarity"),
        editing.name_dl(a, b).alias("name_similarity"),
    )


@query
def name_jaro_winkler(spark, sf_dir):
    """Jaro and Jaro-Winkler of neighbouring authors, raw and normalised."""
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf_dir).select(
        "work_id",
        "pos",
        editing.jaro_similarity(a, b).alias("jaro"),
        editing.jaro_winkler_similarity(a, b).alias("jaro_winkler"),
        editing.name_jaro_winkler(a, b).alias("name_jaro_winkler"),
    )


# Sources and record shaping


@query
def request_ids_found(spark, sf_dir):
    """Every run of four or more digits in every order's request and every document."""
    orders = request_ids(pagegraph.requests(spark, sf_dir), keep=["request_id"])
    texts = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("request_id"), "text")
    return orders.unionByName(request_ids(texts, "text", keep=["request_id"]))


@query
def edges_since(spark, sf_dir):
    """Edges from a date on, with the citing identifier cut from its protocol form."""
    edges = since(pagegraph.edges(spark, sf_dir), SINCE)
    protocol = F.concat(F.lit("oai:example:biblio/"), F.col("citing_id"))
    return edges.select("main_id", citing_id(protocol).alias("citing_id"), "is_xml", "datestamp")


def _xml_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _person_xml(author: Column, named: bool) -> Column:
    """A person element; an identified one may leave its name to the person index."""
    last = F.substring_index(author["name"], " ", 1)
    first = F.substring(author["name"], F.length(last) + 2, F.length(author["name"]))
    names = F.concat(
        F.lit("<lastname>"), _xml_text(last), F.lit("</lastname><firstname>"), _xml_text(first), F.lit("</firstname>")
    )
    body = names if named else F.when(author["id"] != "", "").otherwise(names)
    return F.concat(F.lit('<n:rec_person id="'), author["id"], F.lit('">'), body, F.lit("</n:rec_person>"))


def _bond_xml(author: Column, role: str, named: bool) -> Column:
    return F.concat(
        F.lit(f'<n:cross_biblio_person role="{role}">'), _person_xml(author, named), F.lit("</n:cross_biblio_person>")
    )


def _record_xml(works: DataFrame) -> DataFrame:
    """(work_id, title, head, tail): record XML up to and after its citation bond.

    Identified authors are named only by an editor's label (their last name) and, in full,
    inside a bonded record, so reading them back takes the person index.
    """
    authors = F.col("authors")
    label = lambda a: F.concat(
        F.lit('<n:cross_biblio_person role="editor"><n:rec_person id="'),
        a["id"],
        F.lit('"><labelname>'),
        _xml_text(F.substring_index(a["name"], " ", 1)),
        F.lit("</labelname></n:rec_person></n:cross_biblio_person>"),
    )
    listed = F.concat_ws("", F.transform(authors, lambda a: _bond_xml(a, "author", False)))
    labels = F.concat_ws("", F.transform(F.filter(authors, lambda a: a["id"] != ""), label))
    in_full = F.concat_ws("", F.transform(authors, lambda a: _bond_xml(a, "editor", True)))
    head = F.concat(
        F.lit('<record xmlns="urn:protocol"><header><identifier>oai:example:biblio/'),
        F.col("work_id"),
        F.lit(
            "</identifier><datestamp>2001-01-01</datestamp></header>"
            '<metadata><xml xmlns:n="urn:records"><n:rec_biblio id="'
        ),
        F.col("work_id"),
        F.lit('"><title lang="und">'),
        _xml_text(F.col("title")),
        F.lit("</title>"),
        listed,
        labels,
        F.lit("<n:cross_biblio_biblio><autocitation>false</autocitation><n:rec_biblio>"),
        in_full,
        F.lit("</n:rec_biblio></n:cross_biblio_biblio>"),
    )
    return works.select("work_id", "title", head.alias("head"))


RECORD_TAIL = "</n:rec_biblio></xml></metadata></record>"


@query
def main_records(spark, sf_dir):
    """Every page written as a protocol record and shaped back into a work."""
    written = _record_xml(pagegraph.works(spark, sf_dir)).select(F.concat("head", F.lit(RECORD_TAIL)).alias("xml"))
    shaped = shape_works(harvest.parse_records(written))
    return shaped.select("work_id", "title", author_text(F.col("authors")).alias("authors"))


PARSED_ROWS = 25_000  # records that a task parses


def _harvested(spark, sf_dir) -> DataFrame:
    """Every edge written as a harvested record, with its bond, and shaped back."""
    heads = _record_xml(pagegraph.works(spark, sf_dir)).select(F.col("work_id").alias("citing_id"), "head")
    bond = F.concat(
        F.lit("<n:cross_biblio_biblio><autocitation>"),
        F.when(F.col("is_xml"), "True").otherwise("no"),
        F.lit('</autocitation><n:rec_biblio id=" '),
        F.col("main_id"),
        F.lit('"/></n:cross_biblio_biblio>'),
    )
    rows = join_records(pagegraph.edges(spark, sf_dir), [(heads, "citing_id", "inner")], rows_per_task=PARSED_ROWS)
    written = rows.select(
        F.col("main_id").alias("set"), F.concat("head", bond, F.lit(RECORD_TAIL)).alias("xml")
    )
    return shape_citations(harvest.parse_records(written), "set")


@query
def citing_records(spark, sf_dir):
    return _harvested(spark, sf_dir).select(
        "main_id", "citing_id", "title", author_text(F.col("authors")).alias("authors"), "is_xml"
    )


# Short, so that the given tables' files have records on either side of many bounds and across them.
SPLIT_BYTES = 100_000
PROTOCOL = ("record", "header", "identifier", "datestamp", "metadata")


def _page_xml(record: Column, prefixed: Column) -> Column:
    """A response page around a record; where `prefixed`, with a prefix for the protocol's tags."""
    own = F.regexp_replace(record, f"<(/?)({'|'.join(PROTOCOL)})([ >])", "<$1o:$2$3")
    spaced = F.concat(F.lit('<o:ListRecords xmlns:o="urn:protocol">'), own, F.lit("</o:ListRecords >"))
    plain = F.concat(F.lit("<ListRecords>"), record, F.lit("</ListRecords>"))
    return F.concat(F.lit('<?xml version="1.0"?>'), F.when(prefixed, spaced).otherwise(plain))


def _dealt_by_set(rows: DataFrame, counted: DataFrame, others: str) -> DataFrame:
    """`rows` dealt to tasks of about PARSED_ROWS by `set`, a set with more rows than that also by `others`.

    Sets are counted from `counted`, which has short rows: range bounds would take computing all rows a second time.
    """
    spark, hot = rows.sparkSession, hot_keys(counted, "set", PARSED_ROWS)
    tasks = max(spark.sparkContext.defaultParallelism, ceil(counted.count() / PARSED_ROWS))
    salt = F.pmod(F.xxhash64(others), F.coalesce("salts", F.lit(1)))
    return rows.join(F.broadcast(hot), "set", "left").repartition(tasks, "set", salt).drop("salts")


def _write_pages(rows: DataFrame, path: str, counted: DataFrame, *folders: str) -> str:
    """Files of response pages in a folder for each set, and in it for `folders`, from (set, id, xml); odd sets have
    prefixed tags. `counted` has the sets of all rows. Tasks move their own files into place, not the driver all of them."""
    page = _page_xml(F.col("xml"), F.col("set").cast("long") % 2 == 1).alias("value")
    pages = _dealt_by_set(rows.select("set", *folders, "id", "xml"), counted, "id").select("set", *folders, page)
    writer = pages.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("set", *folders).text(path)
    return path


def _citing_pages(spark, sf_dir, edges: DataFrame) -> DataFrame:
    """(set, id, xml, datestamp) of every edge as a harvested record with its bond and its own date."""
    heads = _record_xml(pagegraph.works(spark, sf_dir)).select(F.col("work_id").alias("citing_id"), "head")
    rows = join_records(edges, [(heads, "citing_id", "inner")])
    bond = F.concat(
        F.lit("<n:cross_biblio_biblio><autocitation>"), F.when(F.col("is_xml"), "True").otherwise("no"),
        F.lit('</autocitation><n:rec_biblio id=" '), F.col("main_id"), F.lit('"/></n:cross_biblio_biblio>'),
    )
    day = F.concat(F.lit("<datestamp>"), F.date_format("datestamp", "yyyy-MM-dd"), F.lit("</datestamp>"))
    head = F.replace(F.col("head"), F.lit("<datestamp>2001-01-01</datestamp>"), day)
    xml = F.concat(head, bond, F.lit(RECORD_TAIL)).alias("xml")
    return rows.select(F.col("main_id").alias("set"), F.col("citing_id").alias("id"), xml, "datestamp")


def _write_citing(spark, sf_dir) -> str:
    edges = settle(pagegraph.edges(spark, sf_dir), "edges")  # read for their records and for their sets
    sets = edges.select(F.col("main_id").alias("set"))
    return _write_pages(_citing_pages(spark, sf_dir, edges), scratch_path(spark, "citing"), sets)


@query
def harvested_mains(spark, sf_dir):
    """Every page as a main record in a file of response pages, read back and shaped into a work."""
    written = _record_xml(pagegraph.works(spark, sf_dir))
    xml = F.concat("head", F.lit(RECORD_TAIL)).alias("xml")
    rows = written.select(F.lit("1").alias("set"), F.col("work_id").alias("id"), xml)
    path = _write_pages(rows, scratch_path(spark, "mains"), rows.select("set"))
    shaped = shape_works(harvest_source.parsed(harvest_source.read_harvest(spark, path, SPLIT_BYTES)))
    return shaped.select("work_id", "title", author_text(F.col("authors")).alias("authors"))


@query
def harvested_pages(spark, sf_dir):
    """Every edge as a citing record in files of response pages, a folder for each main, read back and shaped."""
    path = _write_citing(spark, sf_dir)
    read = harvest_source.read_harvest(spark, path, SPLIT_BYTES)
    shaped = shape_citations(harvest_source.parsed(read), "set")
    return shaped.select("main_id", "citing_id", "title", author_text(F.col("authors")).alias("authors"), "is_xml")


@query
def harvested_since(spark, sf_dir):
    """The citing records from a date on, the bound left to the source of the files."""
    path = _write_citing(spark, sf_dir)
    read = harvest_source.read_harvest(spark, path, SPLIT_BYTES).filter((F.col("stamp") >= SINCE) & ~F.col("deleted"))
    shaped = shape_citations(harvest_source.parsed(read), "set")
    return shaped.select("main_id", "citing_id", "is_xml", "datestamp")


@query
def harvest_stream(spark, sf_dir):
    """A stream of harvested files: two deliveries to every set and three starts of the query, the last for nothing."""
    inbox, out, state = (scratch_path(spark, name) for name in ("inbox", "shaped", "state"))
    edges = settle(pagegraph.edges(spark, sf_dir), "edges")
    early = F.col("datestamp") < F.lit(SINCE).cast("timestamp")
    for number, own in enumerate((edges.filter(early), edges.filter(~early), edges.limit(0))):
        rows = _citing_pages(spark, sf_dir, own).withColumn("delivery", F.lit(number))
        _write_pages(rows, inbox, own.select(F.col("main_id").alias("set")), "delivery")
        arrived = harvest_source.parsed(harvest_source.stream_harvest(spark, inbox, SPLIT_BYTES))
        shaped = shape_citations(arrived, "set").select("main_id", "citing_id", "is_xml", "datestamp")
        writer = shaped.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _faulty(spark, sf_dir) -> DataFrame:
    """(set, xml) of every edge in two overlapping harvests: flagged edges are deleted records, those of January have
    no date, those of February none at all, and the second harvest repeats the first under a newer title."""
    works, edges = pagegraph.works(spark, sf_dir), pagegraph.edges(spark, sf_dir)
    titles = works.select(F.col("work_id").alias("citing_id"), "title")
    rows = join_records(edges, [(titles, "citing_id", "inner")], rows_per_task=PARSED_ROWS)
    month, day = F.month("datestamp"), F.date_format("datestamp", "yyyy-MM-dd")

    def harvest_of(stamp: Column, mark: str) -> DataFrame:
        status_text = F.when(F.col("is_xml"), ' status="deleted"').otherwise("")
        stamped = F.when(month == 1, "<datestamp>2025-13-45</datestamp>").when(month == 2, "")
        stamped = stamped.otherwise(F.concat(F.lit("<datestamp>"), stamp, F.lit("</datestamp>")))
        xml = F.concat(
            F.lit("<record><header"), status_text, F.lit("><identifier>oai:example:biblio/"), F.col("citing_id"),
            F.lit("</identifier>"), stamped, F.lit('</header><metadata><xml><rec_biblio id="'), F.col("citing_id"),
            F.lit('"><title>'), _xml_text(F.col("title")), F.lit(f"{mark}</title></rec_biblio></xml></metadata></record>"),
        )
        return rows.select(F.col("main_id").alias("set"), xml.alias("xml"))

    return harvest_of(F.lit("1990-01-01"), "").unionByName(harvest_of(day, " II"))


@query
def harvest_faults(spark, sf_dir):
    """Citations from overlapping harvests with deleted, undated and misdated records, merged, from a date on."""
    shaped = shape_citations(harvest.parse_records(_faulty(spark, sf_dir)), "set")
    return since(merge_citations(shaped), SINCE).select("main_id", "citing_id", "datestamp", "title")


@query
def deep_records(spark, sf_dir):
    """Authors named, and self-citations marked, five records deep and on a path of their own.

    Every page is a record whose identified authors have no names of their own. Their last names are stated by an
    editor of the record, their full names within bonds five levels deep, and an equally long name, with the letters a to z
    in capitals, comes after that below an element that is no bond. The deepest bond is marked as a self-citation of the page itself.
    """
    works = pagegraph.works(spark, sf_dir)
    authors = F.filter("authors", lambda a: a["id"] != "")
    bare = F.concat_ws("", F.transform(authors, lambda a: _bond_xml(a, "author", False)))
    full = F.concat_ws("", F.transform(authors, lambda a: _bond_xml(a, "editor", True)))
    small = "abcdefghijklmnopqrstuvwxyz"
    loud = lambda a: F.struct(F.translate(a["name"], small, small.upper()).alias("name"), a["id"].alias("id"))
    late = F.concat_ws("", F.transform(authors, lambda a: _person_xml(loud(a), True)))
    deep = full
    for level in range(5):
        mark = "true" if level == 0 else "false"
        target = F.concat(F.lit('<n:rec_biblio id="'), F.col("work_id") if level == 0 else F.lit(""), F.lit('">'))
        deep = F.concat(
            F.lit(f"<n:cross_biblio_biblio><autocitation>{mark}</autocitation>"), target, deep,
            F.lit("</n:rec_biblio></n:cross_biblio_biblio>"),
        )
    xml = F.concat(
        F.lit("<record><header><identifier>oai:example:biblio/"), F.col("work_id"), F.lit("</identifier></header>"),
        F.lit('<metadata><xml xmlns:n="urn:records"><n:rec_biblio id="'), F.col("work_id"), F.lit('"><title>'),
        _xml_text(F.col("title")), F.lit("</title>"), bare, deep, F.lit("<n:note>"), late, F.lit("</n:note>"),
        F.lit(RECORD_TAIL),
    )
    records = harvest.parse_records(works.select(F.col("work_id").alias("set"), xml.alias("xml")))
    strict, loose = (shape_citations(records, "set", loose=loose) for loose in (False, True))
    flags = loose.select("citing_id", F.col("is_xml").alias("loose"))
    shaped = strict.select("citing_id", author_text(F.col("authors")).alias("authors"), F.col("is_xml").alias("strict"))
    return shaped.join(flags, "citing_id")


@query
def raw_export(spark, sf_dir):
    """Requested mains with their raw record as nested JSON, an error object where there is none."""
    written = _record_xml(pagegraph.works(spark, sf_dir))
    records = raw.as_json(
        written.select(F.col("work_id").alias("record_id"), F.concat("head", F.lit(RECORD_TAIL)).alias("xml"))
    )
    requests = request_ids(pagegraph.requests(spark, sf_dir), keep=["request_id"])
    mains = raw.export_mains(requests.select("work_id").distinct(), records)
    fields = F.from_json("full_record", "id string, title struct<lang:string,value:string>, error string")
    return mains.select(
        "main_id", fields["id"].alias("id"), fields["title"]["value"].alias("title"), fields["error"].alias("error")
    )


@query
def raw_export_citations(spark, sf_dir):
    """Citing records of every main as nested JSON, a row each."""
    written = _record_xml(pagegraph.works(spark, sf_dir))
    records = raw.as_json(
        written.select(F.col("work_id").alias("record_id"), F.concat("head", F.lit(RECORD_TAIL)).alias("xml"))
    )
    exported = raw.export_citations(pagegraph.edges(spark, sf_dir), records)
    fields = F.from_json("full_record", "id string, title struct<lang:string,value:string>")
    return exported.select(
        "main_id",
        "citing_id",
        fields["id"].alias("id"),
        fields["title"]["value"].alias("title"),
        fields["title"]["lang"].alias("lang"),
    )


# Errata


def _works_with_vectors(spark, sf_dir) -> DataFrame:
    """Works and their vectors, written once: both sides of every edge read them."""
    return settle(pagegraph.works(spark, sf_dir, vectors=True), "works")


@query
def errata_tests(spark, sf_dir):
    """All model-free erratum tests on every edge."""
    attached = detect.attach_works(pagegraph.edges(spark, sf_dir), pagegraph.works(spark, sf_dir), usable_only=False)
    norms = (F.col("citing_keyword"), F.col("citing_norm"), F.col("main_norm"))
    return attached.select(
        "main_id",
        "citing_id",
        cheap_erratum(*norms).alias("cheap"),
        guarded_erratum(F.col("citing_title"), F.col("main_title"), *norms).alias("guarded"),
    )


@query
def errata_by_vector(spark, sf_dir):
    """Guarded and unguarded erratum tests with the titles' vectors."""
    attached = detect.attach_works(
        pagegraph.edges(spark, sf_dir),
        _works_with_vectors(spark, sf_dir).drop("label", "site"),
        usable_only=False,
    )
    norms = (F.col("citing_keyword"), F.col("citing_norm"), F.col("main_norm"))
    titles, similarity = (F.col("citing_title"), F.col("main_title")), F.col("similarity")
    return attached.withColumn("similarity", detect.edge_similarity(attached)).select(
        "main_id",
        "citing_id",
        F.round(similarity, 9).alias("similarity"),
        guarded_erratum(*titles, *norms, similarity, threshold=VECTOR_CUT).alias("guarded"),
        library_erratum(*norms, similarity, threshold=VECTOR_CUT).alias("library"),
    )


# The given vectors are not title embeddings, so their cut-off is lower than that for titles.
VECTOR_CUT = 0.6


@query
def title_cosine_pairs(spark, sf_dir):
    """Cosine of the vectors that each order line's keys fall on, over all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sized = vectors.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    n = vectors.agg(F.count(F.lit(1))).scalar()
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % n).alias("a_id"), (F.col("l_partkey") % n).alias("b_id")
    ).distinct()

    def side(name: str) -> DataFrame:
        return sized.select(
            F.col("vec_id").alias(f"{name}_id"), F.col("embedding").alias(f"{name}_vector"), F.col("norm").alias(f"{name}_norm")
        )

    both = join_records(lines, [(side("a"), "a_id", "inner"), (side("b"), "b_id", "inner")])
    cos = cosine(F.col("a_vector"), F.col("b_vector"), F.col("a_norm"), F.col("b_norm"))
    return both.select("a_id", "b_id", F.round(cos, 9).alias("cosine"))


# Detection


def _judged(spark, sf_dir, **options) -> DataFrame:
    return detect.judge_edges(pagegraph.edges(spark, sf_dir), pagegraph.works(spark, sf_dir), **options)


@query
def author_best_scores(spark, sf_dir):
    """Best author score of every edge by both methods, with authors or without."""
    attached = detect.attach_works(pagegraph.edges(spark, sf_dir), pagegraph.works(spark, sf_dir), usable_only=False)
    scores = compare(author_scores(jaro_winkler=True), F.col("main_authors"), F.col("citing_authors"))
    scored = attached.select("main_id", "citing_id", scores.alias("s"))
    return scored.select(
        "main_id", "citing_id", F.col("s.dl").alias("dl"), F.col("s.jw").alias("jw"), F.size("s.matches").alias("n_matches")
    )


@query
def edge_matches(spark, sf_dir):
    """Match texts of every edge that is compared, main author first."""
    judged = _judged(spark, sf_dir)
    return judged.filter(~F.col("is_erratum")).select("main_id", "citing_id", joined("matches").alias("matches"))


@query
def edge_status_full(spark, sf_dir):
    """Status of every edge of a usable main."""
    rows = status.full_status(_judged(spark, sf_dir))
    return rows.select(
        "main_id",
        "citing_id",
        "status",
        "citing_title",
        "score",
        joined("matched_authors").alias("matched_authors"),
        joined("all_citation_authors").alias("all_citation_authors"),
        "note",
    )


def _judged_by_vector(spark, sf_dir, cut: float, **options) -> DataFrame:
    works = _works_with_vectors(spark, sf_dir).drop("label", "site")
    return detect.judge_edges(pagegraph.edges(spark, sf_dir), works, title_threshold=cut, **options)


def _at_both_cuts(edges: DataFrame, works: DataFrame) -> list[tuple[float, DataFrame]]:
    """Every edge judged at two cuts; the works are attached once, so both read the same shuffles."""
    attached = detect.attach_works(edges, works)
    return [(cut, status.full_status(detect.judge(attached, title_threshold=cut))) for cut in (VECTOR_CUT, TITLE_THRESHOLD)]


@query
def edge_status_by_vector(spark, sf_dir):
    """Status of every edge of a usable main, titles compared by vector as well, at two cuts."""
    works = _works_with_vectors(spark, sf_dir).drop("label", "site")
    rows = [
        judged.select(
            F.lit(cut).alias("cut"), "main_id", "citing_id", "status", "score", joined("matched_authors").alias("matches")
        )
        for cut, judged in _at_both_cuts(pagegraph.edges(spark, sf_dir), works)
    ]
    return rows[0].unionByName(rows[1])


@query
def edge_status_by_title(spark, sf_dir):
    """Status of every edge where errata are found by vectors made from the titles, at two cuts."""
    works = settle(with_title_vectors(pagegraph.works(spark, sf_dir)), "titled")
    rows = [
        judged.select(F.lit(cut).alias("cut"), "main_id", "citing_id", "status", "score")
        for cut, judged in _at_both_cuts(pagegraph.edges(spark, sf_dir), works)
    ]
    return rows[0].unionByName(rows[1])


@query
def work_queue_by_vector(spark, sf_dir):
    """The work queue where errata are found by vector as well."""
    return status.work_queue(status.detected_status(_judged_by_vector(spark, sf_dir, VECTOR_CUT, skip_flagged=True)))


@query
def article_summary_by_vector(spark, sf_dir):
    rows = status.full_status(_judged_by_vector(spark, sf_dir, VECTOR_CUT))
    return summaries.per_article(pagegraph.works(spark, sf_dir), summaries.count_full(rows))


@query
def harvested_status(spark, sf_dir):
    """From harvested XML to the status of every citation."""
    judged = detect.judge_citations(_harvested(spark, sf_dir), pagegraph.works(spark, sf_dir))
    rows = status.full_status(judged)
    return rows.select("main_id", "citing_id", "status", "score", joined("matched_authors").alias("matched_authors"))


@query
def incremental_status(spark, sf_dir):
    """Statuses from a stream: edges and works arrive in two deliveries, so some edges come before their works."""
    inbox, out, state = (scratch_path(spark, name) for name in ("edges", "judged", "state"))
    works, edges = pagegraph.works(spark, sf_dir), pagegraph.edges(spark, sf_dir)
    since(edges, SINCE).write.parquet(inbox)
    incremental.judge_new_edges(works.filter(F.col("title") < "M"), inbox, out, state).awaitTermination()
    edges.write.mode("append").parquet(inbox)
    incremental.judge_new_edges(works, inbox, out, state).awaitTermination()
    return incremental.judged(spark, out).select("main_id", "citing_id", "status", "score")


@query
def stateful_status(spark, sf_dir):
    """Statuses from streams of works and edges: three deliveries, the second with edges again, the third with late works."""
    works_dir, edges_dir, out, state = (scratch_path(spark, name) for name in ("works", "edges", "judged", "state"))
    works = pagegraph.works(spark, sf_dir).select("work_id", "title", "authors")
    edges = pagegraph.edges(spark, sf_dir).withColumn("datestamp", F.col("datestamp").cast("timestamp"))
    early = F.col("title") < "M"
    deliveries = [(works.filter(early), since(edges, SINCE)), (works.limit(0), edges), (works.filter(~early), edges.limit(0))]
    for own_works, own_edges in deliveries:
        own_works.write.mode("append").parquet(works_dir)
        own_edges.write.mode("append").parquet(edges_dir)
        waiting.judge_streams(spark, works_dir, edges_dir, out, state).awaitTermination()
    return spark.read.parquet(out).select("main_id", "citing_id", "status", "score")


@query
def edge_status_detected(spark, sf_dir):
    """Staging rows of the detected-only view."""
    return status.detected_status(_judged(spark, sf_dir, skip_flagged=True)).drop("score_rounded")


@query
def work_queue(spark, sf_dir):
    return status.work_queue(status.detected_status(_judged(spark, sf_dir, skip_flagged=True)))


@query
def article_summary_full(spark, sf_dir):
    works = pagegraph.works(spark, sf_dir)
    rows = status.full_status(detect.judge_edges(pagegraph.edges(spark, sf_dir), works))
    return summaries.per_article(works, summaries.count_full(rows))


@query
def article_summary_detected(spark, sf_dir):
    works = pagegraph.works(spark, sf_dir)
    judged = detect.judge_edges(pagegraph.edges(spark, sf_dir), works, skip_flagged=True)
    return summaries.per_article(works, summaries.count_detected(judged, AUTHOR_THRESHOLD))


@query
def article_entries(spark, sf_dir):
    """Detected entries of every article, a row each."""
    staging = status.detected_status(_judged(spark, sf_dir, skip_flagged=True))
    return summaries.detected_entries(staging).select("main_id", "citing_id", "type", "citing_title", "matches")


def _requests(spark, sf_dir) -> DataFrame:
    return request_ids(pagegraph.requests(spark, sf_dir), keep=["request_id"])


@query
def request_answers(spark, sf_dir):
    """One row per requested id, repeats included, with counts or the error."""
    works, requests = pagegraph.works(spark, sf_dir), _requests(spark, sf_dir)
    edges = detect.requested_edges(pagegraph.edges(spark, sf_dir), requests)
    rows = status.full_status(detect.judge_edges(edges, works, from_date=SINCE))
    return summaries.answer_requests(requests, summaries.per_article(works, summaries.count_full(rows)))


@query
def unavailable_mains(spark, sf_dir):
    return summaries.unavailable(_requests(spark, sf_dir), pagegraph.works(spark, sf_dir))


@query
def run_totals(spark, sf_dir):
    """Requests and queued rows of one run."""
    requests = _requests(spark, sf_dir)
    edges = detect.requested_edges(pagegraph.edges(spark, sf_dir), requests)
    judged = detect.judge_edges(edges, pagegraph.works(spark, sf_dir), skip_flagged=True)
    queued = status.to_confirm(status.detected_status(judged)).select("main_id", "type")  # all that is counted
    return summaries.run_totals(requests, summaries.as_often_as_asked(queued, requests))


@query
def requested_queue(spark, sf_dir):
    """The work queue of a run, written to its file and read back; articles asked for twice are in it twice."""
    path = scratch_path(spark, "queue")
    requests = _requests(spark, sf_dir)
    edges = detect.requested_edges(pagegraph.edges(spark, sf_dir), requests)
    judged = detect.judge_edges(edges, pagegraph.works(spark, sf_dir), skip_flagged=True)
    queued = status.to_confirm(status.detected_status(judged)).drop("main_authors", "citing_authors", "score", "score_rounded")
    staging = summaries.as_often_as_asked(queued, requests)
    sinks.write_work_queue(status.work_queue(staging), path)
    return spark.read.options(**sinks.CSV_OPTIONS).csv(path)


@query
def ids_from_file(spark, sf_dir):
    """Customers' article numbers, written one a line with blank lines between, and read back as requests."""
    path = scratch_path(spark, "ids")
    number = F.concat(F.lit(" "), (F.col("c_custkey") + pagegraph.FIRST_ID).cast("string"), F.lit(" "))
    lines = table(spark, sf_dir, "customer").select(F.explode(F.array(number, F.lit("  "))).alias("value"))
    lines.write.text(path)
    return read_ids(spark, path)


@query
def run_log_append(spark, sf_dir):
    """Two runs appended to a new log and read back."""
    path = scratch_path(spark, "run-log")
    works, edges = pagegraph.works(spark, sf_dir), pagegraph.edges(spark, sf_dir)
    for start, stamp in ((None, "2026-01-01 08:00:00"), (SINCE, "2026-01-02 08:00:00")):
        rows = status.full_status(detect.judge_edges(edges, works, from_date=start))
        summary = summaries.per_article(works, summaries.count_full(rows))
        runlog.append_run(summary, path, F.lit(stamp).cast("timestamp"))
    return runlog.read_runs(spark, path).drop("run_date", "error")


@query
def run_log_committed(spark, sf_dir):
    """Two runs committed to a log of JSON lines, and read back."""
    path = scratch_path(spark, "run-log")
    works, edges = pagegraph.works(spark, sf_dir), pagegraph.edges(spark, sf_dir)
    for start, stamp in ((None, "2026-01-01 08:00:00"), (SINCE, "2026-01-02 08:00:00")):
        rows = status.full_status(detect.judge_edges(edges, works, from_date=start))
        summary = summaries.per_article(works, summaries.count_full(rows))
        runlog.commit_run(summary, path, F.lit(stamp).cast("timestamp"))
    return read_committed(spark, path).drop("run_date", "error")


# Dataset and evaluation


def _annotations(spark, sf_dir, edges: DataFrame) -> DataFrame:
    """A label for every one of `edges`: same vector class is an erratum, same site a self-citation."""
    works = _works_with_vectors(spark, sf_dir).select("work_id", "site", "label")

    def side(name: str) -> DataFrame:
        return works.select(*[F.col(c).alias(f"{name}_{c.removeprefix('work_')}") for c in works.columns])

    joined_edges = join_records(
        edges.select("main_id", "citing_id"),
        [(side("main"), "main_id", "inner"), (side("citing"), "citing_id", "inner")],
    )
    label = (
        F.when(F.col("main_label") == F.col("citing_label"), status.ERRATUM)
        .when(F.col("main_site") == F.col("citing_site"), status.AUTOCITATION)
        .otherwise(status.NOT_AUTOCITATION_LABEL)
    )
    return joined_edges.select("main_id", "citing_id", label.alias("label"))


def _labelled(spark, sf_dir) -> DataFrame:
    return dataset.label_edges(pagegraph.edges(spark, sf_dir), pagegraph.works(spark, sf_dir), SINCE)


def _annotated(spark, sf_dir) -> DataFrame:
    edges = settle(pagegraph.edges(spark, sf_dir), "edges")  # read by their labels and by their records
    records = dataset.label_edges(edges, pagegraph.works(spark, sf_dir), SINCE, _annotations(spark, sf_dir, edges))
    return dataset.evaluation_records(records)


@query
def ground_truth_labels(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.select(
        F.col("_main_article_id").alias("main_id"), "id", "true_label", "_confidence", "_reason", "is_xml_autocitation"
    )


@query
def label_stats(spark, sf_dir):
    """Counts per label, and requested mains that were not found."""
    return dataset.label_stats(_labelled(spark, sf_dir), _requests(spark, sf_dir), pagegraph.works(spark, sf_dir))


@query
def labelled_roundtrip(spark, sf_dir):
    """The dataset written as JSON and read back with the loader's rules."""
    path = scratch_path(spark, "labelled")
    sinks.write_labelled(_labelled(spark, sf_dir), path)
    records = labelled.usable_records(labelled.read_labelled(spark, path))
    return records.select(
        "main_id",
        "id",
        "citing_title",
        author_text(F.col("main_authors")).alias("main_authors"),
        author_text(F.col("citing_authors")).alias("citing_authors"),
        "true_label",
    )


@query
def annotated_labels(spark, sf_dir):
    return _annotated(spark, sf_dir).groupBy("true_label", "is_xml_autocitation").agg(F.count(F.lit(1)).alias("records"))


@query
def scored_records(spark, sf_dir):
    """Erratum flag and both author scores of every labelled record."""
    return experiments.score_records(_annotated(spark, sf_dir))


@query
def sweep_dl(spark, sf_dir):
    return experiments.threshold_sweep(experiments.score_records(_annotated(spark, sf_dir)))


@query
def sweep_methods(spark, sf_dir):
    return experiments.method_sweep(experiments.score_records(_annotated(spark, sf_dir)))


@query
def sweep_file(spark, sf_dir):
    """The single sweep, written to its file and read back: thresholds and counts."""
    path = scratch_path(spark, "sweep")
    sinks.write_sweep(sweep_dl(spark, sf_dir), path)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = {header: column for column, header in sinks.SWEEP_HEADER.items()}
    return rows.select(*[F.col(f"`{h}`").alias(names[h]) for h in names if names[h] not in evaluation.METRICS])


@query
def sweep_committed(spark, sf_dir):
    """The single sweep, committed to a CSV file and read back whole, metrics to 4 digits."""
    path = scratch_path(spark, "sweep")
    write_committed(sinks.sweep_table(sweep_dl(spark, sf_dir)), path)
    return sinks.from_headers(read_committed(spark, path), sinks.SWEEP_HEADER)


@query
def method_sweep_committed(spark, sf_dir):
    """Both methods' sweep, committed to a CSV file and read back whole."""
    path = scratch_path(spark, "methods")
    write_committed(sinks.method_table(sweep_methods(spark, sf_dir)), path)
    return sinks.from_headers(read_committed(spark, path), sinks.METHOD_HEADER)


@query
def experiments_combined(spark, sf_dir):
    """The combined file of all three experiments, committed as JSON and read back whole, a row for each matrix in it."""
    path = scratch_path(spark, "combined")
    models = sinks.model_reports(evaluation.model_matrix(_model_rows(spark, sf_dir)), VECTOR_CUT)
    scored = settle(experiments.score_records(_annotated(spark, sf_dir)).drop("main_id", "id"), "scored")
    sweeps = experiments.threshold_sweep(scored), experiments.method_sweep(scored)
    write_committed(sinks.experiments_report(models, *sweeps), path, "json")
    report = read_committed(spark, path)
    a = report.select(F.inline("experiment_A_errata_models")).select(
        F.lit("A").alias("experiment"), F.col("model_name").alias("name"), "threshold", "metrics.*", "confusion_matrix.*"
    )
    b = report.select(F.inline("experiment_B_dl_sweep"))
    b = b.select(F.lit("B"), F.lit("dl"), "dl_threshold", "metrics.*", "confusion_matrix.*")
    c = report.select(F.inline("experiment_C_method_comparison"))
    for method in ("jaro_winkler", "damerau_levenshtein"):
        own = c.select(F.lit("C"), F.lit(method), "threshold", f"{method}.*")
        b = b.unionAll(own.select("C", method, "threshold", *evaluation.METRICS, "confusion_matrix.*"))
    return a.unionAll(b)


@query
def experiment_files(spark, sf_dir):
    """All experiments run and written; the models' matrices and numbers of errors read back from their files."""
    out = scratch_path(spark, "experiments")
    records = settle(_annotated(spark, sf_dir), "labelled")
    # Scored before vectors are attached, so that author lists don't go through their joins; those repeat rows alike.
    keys = [(side.select(key), key, how) for side, key, how in _model_sides(spark, sf_dir)]
    scored = join_records(experiments.score_records(records), keys)
    experiments.run_experiments(_model_records(spark, sf_dir, records), _models(), out, VECTOR_CUT, scored)
    models = spark.read.json(f"{out}/errata_model_comparison").select(F.col("model_name").alias("model"), "confusion_matrix.*")
    errors = spark.read.json(f"{out}/errata_errors").groupBy("model").agg(F.count(F.lit(1)).alias("errors"))
    return models.join(errors, "model", "left").select("model", "tp", "fp", "tn", "fn", "errors")


@query
def best_threshold(spark, sf_dir):
    """The sweep's row with the highest F1, the lowest threshold among equals."""
    return evaluation.best_row(sweep_dl(spark, sf_dir), "f1", "threshold")


@query
def method_winner(spark, sf_dir):
    return evaluation.method_winner(sweep_methods(spark, sf_dir))


def _model_slices(vector: str) -> dict[str, Column]:
    """Three models of the same titles: the whole vector, its first half, and the rest."""
    size = F.size(vector)
    half = F.floor(size / 2).cast("int")
    return {"all": F.col(vector), "first": F.slice(vector, F.lit(1), half), "last": F.slice(vector, half + 1, size - half)}


MODEL_NAMES = ("all", "first", "last")


def _model_sides(spark, sf_dir) -> list[tuple[DataFrame, str, str]]:
    """The vectors of both titles in every model, as tables to join."""
    vectors = table(spark, sf_dir, "embeddings").select(
        pagegraph.work_id(F.col("vec_id")).alias("work_id"),
        *[part.alias(f"{model}_vector") for model, part in _model_slices("embedding").items()],
    )
    for model in MODEL_NAMES:
        vectors = with_norm(vectors, f"{model}_vector", f"{model}_norm")
    fields = [c for c in vectors.columns if c != "work_id"]

    def side(key: str, prefix: str) -> DataFrame:
        return vectors.select(F.col("work_id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in fields])

    return [(side("main_id", "main"), "main_id", "left"), (side("id", "citing"), "id", "left")]


def _model_records(spark, sf_dir, records: DataFrame | None = None) -> DataFrame:
    """Labelled records with the vectors of both titles in every model."""
    records = _annotated(spark, sf_dir) if records is None else records
    return join_records(records.drop("main_authors", "citing_authors"), _model_sides(spark, sf_dir))


def _models() -> dict[str, Column]:
    def cos(model: str) -> Column:
        return cosine(*[F.col(f"{side}_{model}_{part}") for part in ("vector", "norm") for side in ("citing", "main")])

    return {model: cos(model) for model in MODEL_NAMES}


def _model_rows(spark, sf_dir) -> DataFrame:
    return experiments.model_predictions(_model_records(spark, sf_dir), _models(), VECTOR_CUT)


@query
def embedding_model_compare(spark, sf_dir):
    return evaluation.model_matrix(_model_rows(spark, sf_dir)).drop("ord")


@query
def embedding_errors(spark, sf_dir):
    errors = evaluation.model_errors(_model_rows(spark, sf_dir))
    return errors.select("model", "main_id", "id", "type", F.round("score", 9).alias("score"))


@query
def best_model(spark, sf_dir):
    """The model with the highest F1, the first listed among equals."""
    return evaluation.best_row(evaluation.model_matrix(_model_rows(spark, sf_dir)), "f1", "ord").select("model", "f1")


# Citation strings


def _citation_strings(spark, sf_dir, *others: str) -> DataFrame:
    """A citation string for every order line, with `others` of its columns."""
    extra = (
        F.when(F.col("l_returnflag") == "R", " na CD")
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(" Dostupné na internete http://example.org/"), "l_orderkey"))
        .otherwise(F.concat(F.lit(" doi 10.1000/"), F.col("l_orderkey").cast("string"), F.lit(" a ser. B")))
    )
    text = F.concat(
        F.when(F.col("l_linestatus") == "O", "ol. ").otherwise("Roč "),
        F.when(F.col("l_linenumber") == 1, "l").otherwise(F.col("l_linenumber").cast("string")),
        F.lit(", iss. "),
        F.col("l_suppkey").cast("string"),
        F.lit(" ("),
        F.year("l_shipdate").cast("string"),
        F.lit("), s. "),
        F.col("l_partkey").cast("string"),
        F.lit("–"),
        (F.col("l_partkey") + F.col("l_linenumber")).cast("string"),
        F.when(F.col("l_tax") > 0.05, " [cit.] #").otherwise(", neuvedené"),
        extra,
    )
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("inputString"), *others
    )
    return spread_scan(rows)


@query
def citation_string_clean(spark, sf_dir):
    """Both cleaned forms of every citation string."""
    rows = _citation_strings(spark, sf_dir)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        strings.first_cleaning(F.col("inputString")).alias("echoed"),
        strings.clean(F.col("inputString")).alias("cleaned"),
    )


@query
def citation_fields(spark, sf_dir):
    """Fields, remainder and status of every citation string."""
    return strings.split_fields(_citation_strings(spark, sf_dir), excluded=["1"])


def _roman(number: Column) -> Column:
    """A number below 4000 in Roman digits, from tables of its decimal places."""
    digits = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    letters = [("M", "?", "?"), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")]
    parts = []
    for place, (one, five, ten) in zip((1000, 100, 10, 1), letters):
        own = [d.replace("X", "t").replace("V", five).replace("I", one).replace("t", ten) for d in digits]
        parts.append(F.get(F.array(*map(F.lit, own)), (F.floor(number / place) % 10).cast("int")))
    return F.concat(*parts)


@query
def citation_roman(spark, sf_dir):
    """Volume and issue of a citation string for every order line, written in Roman numbers."""
    lines = table(spark, sf_dir, "lineitem")
    volume, issue = F.col("l_partkey") % 3999 + 1, F.col("l_suppkey") % 40 + 1
    text = F.concat(F.lit("Mix of vol. "), _roman(volume), F.lit(", no. "), _roman(issue), F.lit(", p. 12"))
    rows = strings.split_fields(lines.select("l_orderkey", "l_linenumber", text.alias("inputString")))
    fields = F.from_json("data", "volume string, issue string, page string")
    return rows.select("l_orderkey", "l_linenumber", fields["volume"].alias("volume"), fields["issue"].alias("issue"))


@query
def citation_errors(spark, sf_dir):
    """Citation strings with an error: a remainder, or an earlier code; a remainder that is excluded is none."""
    rows = _citation_strings(spark, sf_dir, "l_quantity", "l_discount")
    more = F.when(F.col("l_quantity") > 45, " x7y").when(F.col("l_quantity") < 5, " x9z").otherwise("")
    rows = rows.withColumn("inputString", F.concat("inputString", more))
    rows = rows.withColumn("earlier", F.when(F.col("l_discount") >= 0.1, 7)).drop("l_quantity", "l_discount")
    split = strings.split_fields(rows, excluded=["x9z"], error="earlier")
    return split.filter(F.col("errorCode").isNotNull()).drop("data", "inputString")
