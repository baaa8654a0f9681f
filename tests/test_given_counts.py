"""The counts that FIXTURES.md states for its own projection of the tables.

That projection takes the first words of a text as names and its opening as the title;
it serves only here, as a second, independent set of expected values.
"""

import pytest
from pyspark.sql import functions as F

from echocite.operators.status import full_status
from echocite.plans.detect import judge_edges
from echocite.plans.experiments import score_records, threshold_sweep
from echocite.plans.dataset import label_edges
from tests.conftest import DATA

WORKS = """
select doc_id as work_id, concat(case when doc_id % 17 = 5 then 'Erratum: ' when doc_id % 19 = 3 then 'Correction to '
  else '' end, substr(replace(text, chr(10), ' '), cast(1 + (doc_id % 3) * 4 as int), 60)) as title from documents
"""
AUTHORS = """
select doc_id as work_id, i as pos, concat(get(tok,2*i),' ',get(tok,2*i+1)) as name,
  case when (doc_id+i)%3=0 then '' else substr(md5(concat(get(tok,2*i),' ',get(tok,2*i+1))),1,8) end as person_id
from (select doc_id, split(replace(text, chr(10), ' '),' ') as tok from documents) t
lateral view explode(array(0, 1, 2, 3)) v as i where i <= doc_id%4 and get(tok,2*i) is not null and get(tok,2*i+1) is not null
"""
EDGES = """
select main_id, citing_id, max(is_copy) as is_copy, max(is_xml) as is_xml, max(datestamp) as datestamp from (
select l_orderkey % (select count(*) from documents) as main_id, l_partkey % (select count(*) from documents) as citing_id, 0 as is_copy,
  case when l_returnflag='R' and l_linenumber=2 and l_linestatus='F' then 1 else 0 end as is_xml, l_shipdate as datestamp
from lineitem where l_linenumber <= 2 and l_shipdate >= timestamp '2001-01-01'
union all
select m.main_id, d.doc_id as citing_id, 1 as is_copy, 0 as is_xml, timestamp '2001-06-01 00:00:00' as datestamp
from (select substr(text,1,60) as k, min(doc_id) as main_id from documents group by substr(text,1,60)) m
join documents d on substr(d.text,1,60)=m.k and d.doc_id<>m.main_id) u
where main_id<>citing_id group by main_id, citing_id
"""

STATUS_COUNTS = {
    "0.001": {"ERRATUM": 17, "AUTOCITATION": 34, "NOT AUTOCITATION": 204},
    "0.01": {"ERRATUM": 136, "AUTOCITATION": 296, "NOT AUTOCITATION": 1788},
    "0.1": {"ERRATUM": 1516, "AUTOCITATION": 2904, "NOT AUTOCITATION": 18045},
}
SWEEP_COUNTS = {
    "0.001": {0.3: (17, 65, 156, 0), 0.5: (17, 9, 212, 0), 0.65: (17, 3, 218, 0), 0.8: (17, 0, 221, 0), 0.95: (17, 0, 221, 0)},
    "0.01": {0.3: (93, 573, 1424, 0), 0.5: (93, 68, 1929, 0), 0.65: (93, 18, 1979, 0), 0.8: (93, 11, 1986, 0), 0.95: (93, 10, 1987, 0)},
    "0.1": {
        0.3: (1062, 5583, 14342, 2), 0.5: (1062, 625, 19300, 2), 0.65: (1062, 142, 19783, 2),
        0.8: (1062, 99, 19826, 2), 0.95: (1062, 98, 19827, 2),
    },
}


def model(spark, sf):
    for name in ("documents", "lineitem"):
        spark.read.parquet(f"{DATA}/sf{sf}/{name}.parquet").createOrReplaceTempView(name)
    lists = spark.sql(AUTHORS).groupBy("work_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", F.col("person_id").alias("id")))).alias("a")
    )
    authors = F.coalesce(F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["id"].alias("id"))), F.array())
    works = spark.sql(WORKS).join(lists, "work_id", "left").select("work_id", "title", authors.alias("authors"))
    edges = spark.sql(EDGES).withColumn("is_xml", F.col("is_xml") == 1)
    return works, edges


@pytest.mark.parametrize("sf", list(STATUS_COUNTS))
def test_status_counts(spark, sf):
    works, edges = model(spark, sf)
    counts = full_status(judge_edges(edges, works)).groupBy("status").count()
    assert {r.status: r["count"] for r in counts.collect()} == STATUS_COUNTS[sf]


@pytest.mark.parametrize("sf", list(SWEEP_COUNTS))
def test_sweep_counts(spark, sf):
    works, edges = model(spark, sf)
    truth = F.when(F.col("is_copy") == 1, "AUTOCITATION").otherwise("NOT_AUTOCITATION")
    copies = edges.select(F.col("main_id").alias("_main_article_id"), F.col("citing_id").alias("id"), truth.alias("truth"))
    records = label_edges(edges, works).drop("true_label").join(copies, ["_main_article_id", "id"])
    labelled = records.withColumnRenamed("truth", "true_label").withColumnRenamed("_main_article_id", "main_id")
    # The stated counts keep records with an empty title, which the sweep's own erratum test may drop.
    guard = labelled.select("main_id", "id", ((F.col("main_title") != "") & (F.col("citing_title") != "")).alias("titled"))
    scored = score_records(labelled).join(guard, ["main_id", "id"])
    swept = threshold_sweep(scored.withColumn("is_errata", F.col("is_errata") & F.col("titled")))
    found = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in swept.collect()}
    assert len(found) == 14
    assert {t: found[t] for t in SWEEP_COUNTS[sf]} == SWEEP_COUNTS[sf]
