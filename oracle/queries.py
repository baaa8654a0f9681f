"""One SQL query per named query, for DuckDB, over the same tables."""

from oracle.model import (
    ATTACHED,
    EDGES,
    JARO,
    OSA,
    PAIR_NAMES,
    PAIR_SCORES,
    PAIRS,
    SCORED,
    STAGING,
    STATUSES,
    WORKS,
    query,
)

KEYWORDS = "['erratum','errata','corrigendum','correction','oprava','korekcia']"
NORMALIZED = r"lower(trim(regexp_replace(translate({0}, '‐–—', '---'), '\s+', ' ', 'g')))"
HAS_KEYWORD = f"len(list_filter(string_split({{0}}, ' '), lambda w: list_contains({KEYWORDS}, w))) > 0"

NEIGHBOURS = """
neighbours as (
  select a.work_id, a.pos, a.name as a, b.name as b, a.plain as pa, b.plain as pb
  from authors a join authors b on a.work_id = b.work_id and b.pos = a.pos + 1)"""

AUTHOR_TEXT = """
author_texts as (
  select work_id, string_agg(concat(name, '|', id), '; ' order by pos) as authors, count(*) as n
  from authors group by work_id)"""

REQUESTS = r"""
requests as (
  select o_orderkey as request_id, unnest(range(0, len(ids))) as pos, unnest(ids) as work_id
  from (select o_orderkey, regexp_extract_all(concat(o_orderstatus, ' ', 100000 + o_custkey, ' ; page ',
          100000 + o_orderkey, ' ', o_orderpriority), '(\d{4,})', 1) as ids from orders))"""

RECENT = f"""{EDGES.replace("edges as (", "all_edges as (")},
edges as (select * from all_edges where datestamp >= timestamp '1998-01-01')"""

ARTICLES = """
articles as (
  select t.work_id as main_id, t.title as main_title, t.names as main_authors,
         coalesce(c.total_processed, 0) as total_processed, coalesce(c.autocitations_found, 0) as autocitations_found
  from titled t left join (
    select main_id, count(*) as total_processed,
           count(*) filter (where status = 'AUTOCITATION') as autocitations_found
    from statuses group by main_id) c on t.work_id = c.main_id
  where t.n_authors > 0)"""

LABELS = """
labels_given as (
  select *, case when keyword then 'ERRATUM' when is_xml then 'AUTOCITATION' end as sure
  from attached),
vector_labels as (select cast(100000 + vec_id as varchar) as work_id, label from embeddings),
annotated as (
  select g.*, coalesce(sure, case when m.label = c.label then 'ERRATUM' when main_site = citing_site then 'AUTOCITATION'
                                  else 'NOT_AUTOCITATION' end) as true_label
  from labels_given g left join vector_labels m on g.main_id = m.work_id
                      left join vector_labels c on g.citing_id = c.work_id)"""

JARO_NAMES = """
jaro_input as (select distinct mplain as a, cplain as b from author_pairs where not by_id and mplain <> cplain)"""

BOTH_SCORES = """
best_both as (
  select p.main_id, p.citing_id, max(p.score) as dl, count(*) filter (where p.score >= 0.65::double) as n_matches,
         max(case when p.by_id then p.score when p.mplain = p.cplain then 1.0::double else j.jw end) as jw
  from pair_scores p left join jaro j on not p.by_id and p.mplain = j.a and p.cplain = j.b
  group by p.main_id, p.citing_id)"""

SCORED_RECORDS = """
scored_records as (
  select a.main_id, a.citing_id as id, a.true_label, a.cheap as is_errata,
         case when a.cheap then 0.0::double else coalesce(s.dl, 0.0::double) end as dl_score,
         case when a.cheap then 0.0::double else coalesce(s.jw, 0.0::double) end as jw_score
  from annotated a left join best_both s on a.main_id = s.main_id and a.citing_id = s.citing_id)"""

METRICS = """
  coalesce(tp::double / nullif(tp + fp, 0), 0.0::double) as precision,
  coalesce(tp::double / nullif(tp + fn, 0), 0.0::double) as recall,
  coalesce((tp + tn)::double / nullif(tp + fp + tn + fn, 0), 0.0::double) as accuracy"""

F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::double) as f1"


def swept(name: str, score: str) -> str:
    return f"""
{name} as (
  select *, {F1} from (
    select threshold, tp, fp, tn, fn, {METRICS} from (
      select round(0.3::double + k * 0.05::double, 2) as threshold,
             count(*) filter (where truth and {score} >= round(0.3::double + k * 0.05::double, 2)) as tp,
             count(*) filter (where not truth and {score} >= round(0.3::double + k * 0.05::double, 2)) as fp,
             count(*) filter (where not truth and {score} < round(0.3::double + k * 0.05::double, 2)) as tn,
             count(*) filter (where truth and {score} < round(0.3::double + k * 0.05::double, 2)) as fn
      from (select *, true_label = 'AUTOCITATION' as truth from scored_records
            where not is_errata and true_label <> 'ERRATUM'), range(0, 14) t(k)
      group by k)))"""


EVALUATED = (
    WORKS, RECENT, ATTACHED, LABELS, PAIRS, PAIR_NAMES, OSA, PAIR_SCORES, JARO_NAMES, JARO, BOTH_SCORES, SCORED_RECORDS,
)

SIDE_BY_SIDE = "side_by_side as (select j.threshold, " + ", ".join(
    [f"round({m}.{c}, 4) as {m}_{c}" for m in ("jw", "dl") for c in ("precision", "recall", "f1", "accuracy")]
    + [f"{m}.{c} as {m}_{c}" for m in ("jw", "dl") for c in ("tp", "fp", "tn", "fn")]
).replace("jw.", "j.").replace("dl.", "d.") + " from jw_sweep j join dl_sweep d on j.threshold = d.threshold)"

DOT = """list_reduce(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::double * {1}[i]::double),
                    lambda t, p: t + p, 0.0::double)"""


def cosine(a: str, b: str) -> str:
    return f"{DOT.format(a, b)} / (sqrt({DOT.format(a, a)}) * sqrt({DOT.format(b, b)}))"


def by_vector(cut: float) -> str:
    """Edges whose erratum test looks at the titles' vectors as well."""
    return f"""
by_title as (select * from plain_attached),
attached as (
  select a.* exclude (guarded), guarded or (citing_title <> '' and main_title <> '' and citing_norm <> '' and main_norm <> ''
    and coalesce({cosine('m.embedding', 'c.embedding')}, 0.0::double) >= {cut}::double) as guarded
  from by_title a left join vectors m on a.main_id = m.work_id left join vectors c on a.citing_id = c.work_id)"""


VECTORS = "vectors as (select cast(100000 + vec_id as varchar) as work_id, embedding from embeddings)"

MODELS = f"""
model_scores as (
  select a.main_id, a.citing_id as id, a.true_label = 'ERRATUM' as truth, model, ord,
         a.keyword or a.citing_norm = a.main_norm as sure,
         case ord when 0 then {cosine('m.embedding', 'c.embedding')}
                  when 1 then {cosine('m.embedding[1:len(m.embedding)//2]', 'c.embedding[1:len(c.embedding)//2]')}
                  else {cosine('m.embedding[len(m.embedding)//2+1:]', 'c.embedding[len(c.embedding)//2+1:]')} end as cos
  from annotated a left join vectors m on a.main_id = m.work_id left join vectors c on a.citing_id = c.work_id,
       (values (0, 'all'), (1, 'first'), (2, 'last')) v(ord, model)
  where a.true_label in ('ERRATUM', 'NOT_AUTOCITATION')),
model_rows as (
  select *, sure or coalesce(cos, 0) >= 0.6::double as pred,
         case when sure then 1.0::double else coalesce(cos, 0.0::double) end as score from model_scores),
model_matrix as (
  select *, {F1} from (select ord, model, tp, fp, tn, fn, {METRICS} from (
    select ord, model, count(*) filter (where truth and pred) as tp, count(*) filter (where not truth and pred) as fp,
           count(*) filter (where not truth and not pred) as tn, count(*) filter (where truth and not pred) as fn
    from model_rows group by ord, model)))"""

PLAIN_ATTACHED = ATTACHED.replace("attached as (", "plain_attached as (")
SCORED_BY_VECTOR = tuple(
    part for p in SCORED for part in ((PLAIN_ATTACHED, VECTORS, by_vector(0.6)) if p is ATTACHED else (p,))
)
AT_TWO_CUTS = (
    *SCORED_BY_VECTOR,
    STATUSES,
    by_vector(0.9).replace("by_title as", "by_title_90 as").replace("from by_title a", "from by_title_90 a")
    .replace("attached as (\n  select a.*", "attached_90 as (\n  select a.*"),
    """
judged_90 as (
  select a.*, coalesce(s.best, 0.0::double) as score, coalesce(s.matches, '') as matches
  from attached_90 a left join edge_scores s using (main_id, citing_id) where a.main_n > 0)""",
    STATUSES.replace("statuses as (", "statuses_90 as (").replace("from judged)", "from judged_90)"),
)

MODELLED = (WORKS, RECENT, ATTACHED, LABELS, VECTORS, MODELS)

CITATION_STRINGS = """
citation_strings as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_tax,
    concat(case when l_linestatus = 'O' then 'ol. ' else 'Roč ' end,
           case when l_linenumber = 1 then 'l' else cast(l_linenumber as varchar) end, ', iss. ', l_suppkey, ' (',
           year(l_shipdate), '), s. ', l_partkey, '–', l_partkey + l_linenumber,
           case when l_tax > 0.05 then ' [cit.] #' else ', neuvedené' end,
           case when l_returnflag = 'R' then ' na CD'
                when l_returnflag = 'A' then concat(' Dostupné na internete http://example.org/', l_orderkey)
                else concat(' doi 10.1000/', l_orderkey, ' a ser. B') end) as s
  from lineitem)"""


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


FIRST = [("–", "-"), ("‐", "-"), (" a ", ","), (" l ", " 1 "), (" l,", " 1,"), (" l.", " 1."), (" l]", " 1]"), ("? ", ""), ("#", "")]
SECOND = [
    ("Číslo článku", "art.no."), ("neuvedebý", ""), ("neuvedený", ""), ("neuvedené", ""), ("(dvojčíslo)", ""),
    (" ", " "), ("]-", "-"), ("na CD", "[CD-ROM]"), ("a.n.", "art.no."), ("Dostupné na internete", "(online)"),
    ("dostupné na internete", "(online)"), ("Nno", "No"),
]
SHORT = [("iv-v", "IV-V"), (" a ", " , "), ("iss.", "no."), ("s.", "p."), ("p. [", "p.["), ("Roč ", "Roč. "), ("Č ", "č. ")]
LATE = [("no.no.", "no."), ("no.number", "no."), (".:", ".")]

CLEANED = f"""
first_form as (select *, {replaced('s', FIRST)} as echoed from citation_strings),
second_form as (
  select *, case when starts_with(t, 'ol.') then concat('vol.', substr(t, 4)) else t end as opened
  from (select *, {replaced('echoed', SECOND)} as t from first_form)),
cleaned as (
  select *, {replaced(f"replace(replace(lower({replaced('opened', SHORT)}), ' ', ''), '[cit.]', '')", LATE)} as cleaned
  from second_form)"""

# The strings have a known make-up, so their fields are stated from the columns.
FIELDS = """
expected as (
  select *, concat('{"volume":"', l_linenumber, '","issue":"', l_suppkey, '","year":"', year(l_shipdate), '"',
      case when l_returnflag = 'N' then ',"series":"B"' else '' end,
      case when l_returnflag = 'R' then ',"format":"CD-ROM"' when l_returnflag = 'A' then ',"format":"online"' else '' end,
      case when l_returnflag = 'A' then concat(',"link":"http://example.org/', l_orderkey, '"') else '' end,
      ',"startPage":"', l_partkey, '","endPage":"', l_partkey + l_linenumber, '"',
      case when l_returnflag = 'N' then concat(',"doi":"10.1000/', l_orderkey, '"') else '' end, '}') as data
  from first_form)"""

STATUS_COLUMNS = """
  main_id, citing_id, status, citing_title, case when not guarded then score end as score,
  case when not guarded then matches end as matched_authors, case when not guarded then citing_names end as all_citation_authors,
  case when guarded then 'Identifikované ako oprava na základe embedding podobnosti názvu s originálom' end as note"""

ORACLES: dict[str, str] = {
    "works_titles_normalized": query(
        f"""
select work_id, norm as title_norm, keyword from worded
union all
select concat('d', doc_id), t, {HAS_KEYWORD.format('t')} from (select doc_id, {NORMALIZED.format('text')} as t from documents)""",
        WORKS,
    ),
    "authors_normalized": query("select work_id, pos, name, id, plain from authors", WORKS),
    "words_normalized": r"""
select plain, sum(uses)::bigint as uses, count(*) as spellings
from (select word, trim(lower(strip_accents(word))) as plain, count(*) as uses
      from (select unnest(regexp_split_to_array(text, '[ \n]')) as word from documents) group by word)
group by plain""",
    "authors_dedup": query(
        """
select w.work_id, coalesce(n, 0)::integer as n_authors, coalesce(authors, '') as authors
from works w left join author_texts using (work_id)""",
        WORKS,
        AUTHOR_TEXT,
    ),
    "person_index_longest": query(
        """
select site, person_id, name from (
  select w.site, e.id as person_id, e.name,
         row_number() over (partition by w.site, e.id order by length(e.name) desc, e.page_id, e.entry) as nth
  from author_entries e join works w using (page_id) where e.id <> '' and e.name <> '') where nth = 1""",
        WORKS,
    ),
    "name_edit_distance": query(
        """
select n.work_id, n.pos, r.dist as distance,
       case when greatest(length(n.a), length(n.b)) = 0 then 1.0::double
            else 1.0::double - r.dist::double / greatest(length(n.a), length(n.b)) end as similarity,
       case when greatest(length(pa), length(pb)) = 0 then 1.0::double
            else 1.0::double - p.dist::double / greatest(length(pa), length(pb)) end as name_similarity
from neighbours n join osa r on n.a = r.a and n.b = r.b join osa p on n.pa = p.a and n.pb = p.b""",
        WORKS,
        NEIGHBOURS,
        "osa_input as (select a, b from neighbours union select pa, pb from neighbours)",
        OSA,
    ),
    "name_jaro_winkler": query(
        """
select n.work_id, n.pos, r.jaro, r.jw as jaro_winkler, p.jw as name_jaro_winkler
from neighbours n join jaro r on n.a = r.a and n.b = r.b join jaro p on n.pa = p.a and n.pb = p.b""",
        WORKS,
        NEIGHBOURS,
        "jaro_input as (select a, b from neighbours union select pa, pb from neighbours)",
        JARO,
    ),
    "request_ids_found": query(
        r"""
select * from requests union all
select -doc_id - 1, unnest(range(0, len(ids))), unnest(ids)
from (select doc_id, regexp_extract_all(text, '(\d{4,})', 1) as ids from documents)""",
        REQUESTS,
    ),
    "edges_since": query("select main_id, citing_id, is_xml, datestamp from edges", RECENT),
    "main_records": query(
        """
select w.work_id, trim(w.title) as title, coalesce(authors, '') as authors
from works w left join author_texts using (work_id)""",
        WORKS,
        AUTHOR_TEXT,
    ),
    "citing_records": query(
        """
select e.main_id, e.citing_id, trim(w.title) as title, coalesce(authors, '') as authors, e.is_xml
from edges e join works w on e.citing_id = w.work_id left join author_texts a on a.work_id = w.work_id""",
        WORKS,
        EDGES,
        AUTHOR_TEXT,
    ),
    "raw_export": query(
        """
select r.work_id as main_id, w.work_id as id, trim(w.title) as title,
       case when w.work_id is null then 'Záznam nedostupný' end as error
from (select distinct work_id from requests) r left join works w using (work_id)""",
        WORKS,
        REQUESTS,
    ),
    "raw_export_citations": query(
        """
select e.main_id, e.citing_id, e.citing_id as id, trim(w.title) as title, 'und' as lang
from edges e join works w on e.citing_id = w.work_id""",
        WORKS,
        EDGES,
    ),
    "harvest_faults": query(
        """
select main_id, citing_id, case when month(datestamp) > 2 then datestamp::timestamp end as datestamp,
       trim(concat(title, ' II')) as title
from edges e join works w on e.citing_id = w.work_id
where not is_xml and (month(datestamp) <= 2 or datestamp >= timestamp '1998-01-01')""",
        WORKS,
        EDGES,
    ),
    "deep_records": query(
        """
select w.work_id as citing_id, coalesce(t.authors, '') as authors, false as strict, true as loose
from works w left join (
  select work_id, string_agg(concat(name, '|', id), '; ' order by pos) as authors
  from authors where id <> '' group by work_id) t using (work_id)""",
        WORKS,
    ),
    "errata_tests": query("select main_id, citing_id, cheap, guarded from attached", WORKS, EDGES, ATTACHED),
    "errata_by_vector": query(
        f"""
select main_id, citing_id, round(similarity, 9) as similarity,
       citing_title <> '' and main_title <> '' and (keyword or citing_norm = main_norm or similarity >= 0.6::double) as guarded,
       keyword or citing_norm = main_norm or similarity >= 0.6::double as library
from (select a.*, case when citing_norm = '' or main_norm = '' then 0.0::double when citing_norm = main_norm then 1.0::double
                       else coalesce({cosine('m.embedding', 'c.embedding')}, 0.0::double) end as similarity
      from attached a left join vectors m on a.main_id = m.work_id left join vectors c on a.citing_id = c.work_id)""",
        WORKS,
        EDGES,
        ATTACHED,
        VECTORS,
    ),
    "title_cosine_pairs": f"""
select a_id, b_id, round({cosine('a.embedding', 'b.embedding')}, 9) as cosine
from (select distinct l_orderkey % n as a_id, l_partkey % n as b_id from lineitem, (select count(*) as n from embeddings) c) p
join embeddings a on a.vec_id = a_id join embeddings b on b.vec_id = b_id""",
    "author_best_scores": query(
        """
select e.main_id, e.citing_id, coalesce(s.dl, 0.0::double) as dl, coalesce(s.jw, 0.0::double) as jw,
       coalesce(n_matches, 0)::integer as n_matches
from edges e left join best_both s using (main_id, citing_id)""",
        WORKS,
        EDGES,
        PAIRS,
        PAIR_NAMES,
        OSA,
        PAIR_SCORES,
        JARO_NAMES,
        JARO,
        BOTH_SCORES,
    ),
    "edge_matches": query("select main_id, citing_id, matches from judged where not guarded", *SCORED),
    "edge_status_full": query(f"select {STATUS_COLUMNS} from statuses", *SCORED, STATUSES),
    "edge_status_by_vector": query(
        """
select cut, main_id, citing_id, status, case when not guarded then score end as score,
       case when not guarded then matches end as matches
from (select 0.6::double as cut, * from statuses union all by name select 0.9::double as cut, * from statuses_90)""",
        *AT_TWO_CUTS,
    ),
    "work_queue_by_vector": query(
        """
select main_id as "mainArticleId", main_title as "mainArticleTitle", citing_id as "citingId",
       citing_title as "citingTitle", matches from staging where type = 'AUTOCITATION'""",
        *SCORED_BY_VECTOR,
        STAGING,
    ),
    "article_summary_by_vector": query("select * from articles", *SCORED_BY_VECTOR, STATUSES, ARTICLES),
    "harvested_status": query(
        """
select main_id, citing_id, status, case when not guarded then score end as score,
       case when not guarded then matches end as matched_authors from statuses""",
        *SCORED,
        STATUSES,
    ),
    "incremental_status": query(
        "select main_id, citing_id, status, case when not guarded then score end as score from statuses", *SCORED, STATUSES
    ),
    "edge_status_detected": query(
        """
select main_id, citing_id, type, main_title, main_names as main_authors, citing_title, citing_names as citing_authors,
       case when guarded then '' else matches end as matches, case when not guarded then score end as score
from staging""",
        *SCORED,
        STAGING,
    ),
    "work_queue": query(
        """
select main_id as "mainArticleId", main_title as "mainArticleTitle", citing_id as "citingId",
       citing_title as "citingTitle", matches from staging where type = 'AUTOCITATION'""",
        *SCORED,
        STAGING,
    ),
    "article_summary_full": query("select * from articles", *SCORED, STATUSES, ARTICLES),
    "article_summary_detected": query(
        """
select t.work_id as main_id, t.title as main_title, t.names as main_authors,
       coalesce(c.total_processed, 0) as total_processed, coalesce(c.entries_detected, 0) as entries_detected
from titled t left join (
  select main_id, count(*) as total_processed,
         count(*) filter (where guarded or (not is_xml and score >= 0.65::double)) as entries_detected
  from judged group by main_id) c on t.work_id = c.main_id
where t.n_authors > 0""",
        *SCORED,
    ),
    "article_entries": query(
        """
select main_id, citing_id, type, citing_title, case when guarded then '' else matches end as matches
from staging where type in ('ERRATUM', 'AUTOCITATION')""",
        *SCORED,
        STAGING,
    ),
    "request_answers": query(
        """
select r.request_id, r.pos, r.work_id as main_id, a.main_title, a.main_authors, a.total_processed, a.autocitations_found,
       case when a.main_id is null then 'Záznam nenájdený alebo bez autorov' end as error
from requests r left join articles a on r.work_id = a.main_id""",
        WORKS,
        RECENT,
        *SCORED[2:],
        STATUSES,
        ARTICLES,
        REQUESTS,
    ),
    "unavailable_mains": query(
        """
select r.request_id, r.pos, r.work_id, 'Záznam nenájdený alebo bez autorov' as error
from requests r left join titled t on r.work_id = t.work_id and t.n_authors > 0 where t.work_id is null""",
        WORKS,
        REQUESTS,
    ),
    "run_totals": query(
        """
select (select count(*) from requests) as total_requests,
       (select count(*) from staging s join requests r on s.main_id = r.work_id where type = 'AUTOCITATION') as autocitations_queued""",
        *SCORED,
        STAGING,
        REQUESTS,
    ),
    "requested_queue": query(
        """
select main_id as "mainArticleId", main_title as "mainArticleTitle", citing_id as "citingId",
       citing_title as "citingTitle", matches
from staging s join requests r on s.main_id = r.work_id where type = 'AUTOCITATION'""",
        *SCORED,
        STAGING,
        REQUESTS,
    ),
    "ids_from_file": "select cast(100000 + c_custkey as varchar) as work_id from customer",
    "sweep_file": query("select threshold, tp, fp, tn, fn from dl_sweep", *EVALUATED, swept("dl_sweep", "dl_score")),
    "experiment_files": query(
        """
select model, tp, fp, tn, fn, nullif(fp + fn, 0) as errors from model_matrix""",
        *MODELLED,
    ),
    "run_log_append": query(
        """
select timestamp '2026-01-01 08:00:00' as run_ts, main_id, main_title, total_processed, autocitations_found from articles
union all
select timestamp '2026-01-02 08:00:00', t.work_id, t.title, count(s.main_id),
       count(s.main_id) filter (where s.status = 'AUTOCITATION')
from titled t left join (select * from statuses where datestamp >= timestamp '1998-01-01') s on s.main_id = t.work_id
where t.n_authors > 0 group by t.work_id, t.title""",
        *SCORED,
        STATUSES,
        ARTICLES,
    ),
    "ground_truth_labels": query(
        """
select main_id, citing_id as id, sure as true_label, case when sure is null then 'NEEDS_REVIEW' else 'HIGH' end as _confidence,
       case when keyword then 'kľúčové slovo erraty v názve' when is_xml then 'XML príznak autocitácie'
            else 'žiadny spoľahlivý signál — vyžaduje ručnú anotáciu' end as _reason, is_xml as is_xml_autocitation
from labels_given""",
        WORKS,
        RECENT,
        ATTACHED,
        LABELS,
    ),
    "label_stats": query(
        """
select count(*) as total, count(*) filter (where sure = 'ERRATUM') as erratum,
       count(*) filter (where sure = 'AUTOCITATION') as autocitation_xml,
       count(*) filter (where sure is null) as needs_review,
       (select count(*) from requests where work_id not in (select work_id from works)) as skipped
from labels_given""",
        WORKS,
        RECENT,
        ATTACHED,
        LABELS,
        REQUESTS,
    ),
    "labelled_roundtrip": query(
        """
select g.main_id, g.citing_id as id, g.citing_title, coalesce(m.authors, '') as main_authors,
       coalesce(c.authors, '') as citing_authors, g.sure as true_label
from labels_given g left join author_texts m on g.main_id = m.work_id left join author_texts c on g.citing_id = c.work_id
where g.sure is not null""",
        WORKS,
        RECENT,
        ATTACHED,
        LABELS,
        AUTHOR_TEXT,
    ),
    "annotated_labels": query(
        "select true_label, is_xml as is_xml_autocitation, count(*) as records from annotated group by true_label, is_xml",
        WORKS,
        RECENT,
        ATTACHED,
        LABELS,
    ),
    "scored_records": query("select * from scored_records", *EVALUATED),
    "sweep_dl": query("select * from dl_sweep", *EVALUATED, swept("dl_sweep", "dl_score")),
    "sweep_methods": query(
        "select * from side_by_side",
        *EVALUATED,
        swept("dl_sweep", "dl_score"),
        swept("jw_sweep", "jw_score"),
        SIDE_BY_SIDE,
    ),
    "best_threshold": query(
        "select * from dl_sweep order by f1 desc, threshold limit 1", *EVALUATED, swept("dl_sweep", "dl_score")
    ),
    "method_winner": query(
        """
select j.threshold as jw_threshold, j.jw_f1, d.threshold as dl_threshold, d.dl_f1,
       case when j.jw_f1 >= d.dl_f1 then 'Jaro-Winkler' else 'Damerau-Levenshtein' end as winner, abs(j.jw_f1 - d.dl_f1) as gap
from (select * from side_by_side order by jw_f1 desc, threshold limit 1) j,
     (select * from side_by_side order by dl_f1 desc, threshold limit 1) d""",
        *EVALUATED,
        swept("dl_sweep", "dl_score"),
        swept("jw_sweep", "jw_score"),
        SIDE_BY_SIDE,
    ),
    "embedding_model_compare": query("select * exclude (ord) from model_matrix", *MODELLED),
    "embedding_errors": query(
        """
select model, main_id, id, case when truth then 'FN_ERRATA' else 'FP_ERRATA' end as type, round(score, 9) as score
from model_rows where truth <> pred""",
        *MODELLED,
    ),
    "best_model": query("select model, f1 from model_matrix order by f1 desc, ord limit 1", *MODELLED),
    "citation_string_clean": query(
        "select l_orderkey, l_linenumber, l_partkey, l_suppkey, echoed, cleaned from cleaned", CITATION_STRINGS, CLEANED
    ),
    "citation_fields": query(
        """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, data, echoed as "inputString",
       cast(null as integer) as "errorCode", cast(null as varchar) as "unhandledInput" from expected""",
        CITATION_STRINGS,
        CLEANED,
        FIELDS,
    ),
    "citation_errors": """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when l_discount >= 0.1 then 7 else 10001 end::integer as "errorCode",
       case when l_quantity > 45 then 'x7y' end as "unhandledInput"
from lineitem where l_discount >= 0.1 or l_quantity > 45""",
}

# The same rows, read back from files.
ORACLES["harvested_mains"] = ORACLES["main_records"]
ORACLES["harvested_pages"] = ORACLES["citing_records"]
ORACLES["harvested_since"] = ORACLES["edges_since"]
ORACLES["harvest_stream"] = query("select main_id, citing_id, is_xml, datestamp from edges", EDGES)
ORACLES["stateful_status"] = ORACLES["incremental_status"]
ORACLES["run_log_committed"] = ORACLES["run_log_append"]
ORACLES["method_sweep_committed"] = ORACLES["sweep_methods"]

ROUNDED = ", ".join(f"round_even({m}, 4) as {m}" for m in ("precision", "recall", "f1", "accuracy"))
ORACLES["sweep_committed"] = query(
    f"select threshold, {ROUNDED}, tp, fp, tn, fn from dl_sweep", *EVALUATED, swept("dl_sweep", "dl_score")
)
ORACLES["experiments_combined"] = query(
    f"""
select 'A' as experiment, model as name, 0.6::double as threshold, {ROUNDED}, tp, fp, tn, fn from model_matrix
union all select 'B', 'dl', threshold, {ROUNDED}, tp, fp, tn, fn from dl_sweep
union all select 'C', 'jaro_winkler', threshold, jw_precision, jw_recall, jw_f1, jw_accuracy, jw_tp, jw_fp, jw_tn, jw_fn
from side_by_side
union all select 'C', 'damerau_levenshtein', threshold, dl_precision, dl_recall, dl_f1, dl_accuracy, dl_tp, dl_fp, dl_tn, dl_fn
from side_by_side""",
    *dict.fromkeys(
        [*EVALUATED, swept("dl_sweep", "dl_score"), swept("jw_sweep", "jw_score"), SIDE_BY_SIDE, *MODELLED]
    ),
)

TITLE_VECTORS = """
title_words as (
  select norm, word, count(*) as uses from (select norm, unnest(string_split(norm, ' ')) as word from (select distinct norm from titled))
  where word <> '' group by norm, word),
title_cells as (
  select norm, slot, sum(w) as w from (
    select t.norm, ('0x' || substr(md5(t.word), 1, 8))::bigint % 256 as slot,
           uses * (ln((1.0::double + (select count(distinct norm) from titled where norm <> '')) / (1.0::double + n)) + 1.0::double) as w
    from title_words t join (select word, count(*) as n from title_words group by word) using (word)) group by norm, slot),
vectors as (
  select w.work_id, v.embedding from titled w join (
    select norm, list(coalesce(w, 0.0::double) order by slot) as embedding
    from (select distinct norm from title_cells) cross join (select range as slot from range(256)) left join title_cells using (norm, slot)
    group by norm) v using (norm))"""
ORACLES["edge_status_by_title"] = query(
    """
select cut, main_id, citing_id, status, case when not guarded then score end as score
from (select 0.6::double as cut, * from statuses union all by name select 0.9::double as cut, * from statuses_90)""",
    *(TITLE_VECTORS if part is VECTORS else part for part in AT_TWO_CUTS),
)
ORACLES["citation_roman"] = """
select l_orderkey, l_linenumber, cast(l_partkey % 3999 + 1 as varchar) as volume, cast(l_suppkey % 40 + 1 as varchar) as issue
from lineitem"""
