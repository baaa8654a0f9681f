"""Secrets in texts by a trigram index, in DataFrame functions only.

A regular expression tells which trigrams every match must hold: where it goes on letter by letter its strings are known,
and alternatives are joined by OR. So a rule has a Boolean query over trigrams, kept as alternatives of sets. The index
has a posting for each trigram of the rules that a text holds, in lower case, one column-pruned and sorted table; a rule
reads only its own trigrams' postings, and a text that has all of one alternative is a candidate. Candidates, and all texts
for rules that need no trigram, are verified by the expression itself, which also gives the places of its matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.llm.common import once, row_key
from echocite.session import settle

CLASS_LETTERS = 8  # a set of more letters counts as any letter, which only makes a query weaker
STRINGS = 64  # so does a longer list of strings
GRAM = 3
STEP = 64  # matches whose lengths are summed at a time


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, left to right without overlap, whose `group` has `least` letters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Runs of letters from one set end where no such letter follows, so a least length in the pattern keeps the same matches
# as dropping shorter ones later.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub_token", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.~%+-]{1,64}@"),
)

Query = frozenset  # of alternatives, each a frozenset of trigrams; one without trigrams says nothing
ANY: Query = frozenset([frozenset()])


def _least_sets(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    joined = _least_sets(frozenset(x | y for x in a for y in b))
    return joined if len(joined) <= STRINGS else min(a, b, key=len)


def _grams(strings: set[str]) -> Query:
    sets = (frozenset(s[i : i + GRAM] for i in range(len(s) - GRAM + 1)) for s in strings)
    return _least_sets(frozenset(sets))


def _letters(items: list) -> set[str] | None:
    """The letters of a set, in lower case, or None where they are too many or not listed."""
    found: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < CLASS_LETTERS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= CLASS_LETTERS else None


def _part(kind: str, value) -> tuple[set[str] | None, Query]:
    """What one element matches: all its strings, or None and a query that each of its matches meets."""
    if kind == "LITERAL":
        return {chr(value).lower()}, ANY
    if kind == "IN":
        return _letters(value), ANY
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, ANY
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ANY
        queries = [q if s is None else _grams(s) for s, q in parts]
        return None, _least_sets(frozenset().union(*queries))
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (int(least), int(most)) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and least == most and len(strings) ** int(most) <= STRINGS:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(int(most)), {""}), ANY
        if not least:
            return None, ANY
        return None, query if strings is None else _grams(strings)
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANY, True
    for kind, value in items:
        strings, own = _part(str(kind), value)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(query, _grams(run))
        whole, run = False, strings if strings is not None else {""}
        query = _both(query, own)
    return (run, ANY) if whole else (None, _both(query, _grams(run)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams of which every match has all of at least one; `ANY` where none is needed."""
    strings, query = _sequence(re._parser.parse(pattern))
    return query if strings is None else _grams(strings)


def query_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(gram, rule, choice, bit, all_bits): a row for each trigram of each alternative of each rule that needs any.
    rule is the rule's bit, bit the trigram's within its alternative."""
    rows = []
    for number, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        for choice, grams in enumerate(sorted(map(sorted, query)) if query != ANY else []):
            rows += [(g, 1 << number, choice, 1 << k, (1 << len(grams)) - 1) for k, g in enumerate(grams[:62])]
    return spark.createDataFrame(rows, "gram string, rule long, choice int, bit long, all_bits long")


def build_index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key, text_hash): which of `grams` each text of (key, text_hash, text) holds, in lower case, settled.

    Postings are sorted by trigram within each file, so that a reader of few trigrams skips the others.
    """
    lowered = once(texts.select("key", "text_hash", "text"), lowered=F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams]))
    postings = lowered.select(F.explode(held).alias("gram"), "key", "text_hash")
    return settle(postings.sortWithinPartitions("gram"), "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, text_hash, rules): a bit for each rule whose trigram query a text meets; texts without any are left out."""
    wanted = query_table(index.sparkSession, rules)
    own = index.join(F.broadcast(wanted), "gram")  # a few rows for each rule
    met = own.groupBy("key", "text_hash", "rule", "choice", "all_bits").agg(F.bit_or("bit").alias("bits"))
    met = met.filter("bits = all_bits")
    return met.groupBy("key", "text_hash").agg(F.bit_or("rule").alias("rules"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_spans(df: DataFrame, rule: Rule, number: int, text: str, due: Column, name: str) -> DataFrame:
    """`df` with a column of (start, kind number, end, kind) for each match of a rule, where `due`.

    What lies between matches and the matches themselves make the text, so a match starts at the sum of the lengths
    before it. Sums go by steps of STEP matches, so that a text full of matches takes no quadratic time.
    """
    columns = df.columns
    text = F.when(due, F.col(text))
    pattern = F.lit(rule.pattern)
    found = df.withColumns(
        {
            "_gaps": F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long")),
            "_sizes": F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long")),
            "_checked": F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)),
        }
    )
    found = once(found, _ways=F.zip_with(F.slice("_gaps", F.lit(1), F.size("_sizes")), "_sizes", lambda a, b: a + b))
    steps = F.sequence(F.lit(0), F.floor(F.size("_ways") / STEP).cast("int"))
    found = once(found, _sums=F.transform(steps, lambda k: _total(F.slice("_ways", k * STEP + 1, F.lit(STEP)))))
    found = once(found, _before=F.transform(steps, lambda k: _total(F.slice("_sums", F.lit(1), k))))

    def span(size: Column, k: Column) -> Column:
        step = F.floor(k / STEP).cast("int")
        start = F.get("_before", step) + _total(F.slice("_ways", step * STEP + 1, k - step * STEP)) + F.get("_gaps", k)
        ok = F.get("_checked", k) >= rule.least
        kind = [F.lit(number).alias("number"), (start + size).alias("end"), F.lit(rule.kind).alias("kind")]
        return F.when(ok, F.struct(start.alias("start"), *kind))

    spans = F.coalesce(F.array_compact(F.transform("_sizes", span)), F.array().cast(SPANS))
    return found.select(*columns, spans.alias(name))


SPANS = "array<struct<start:long,number:int,end:long,kind:string>>"


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, spans) of every row: (start, number, end, kind) of each match, in code points, by start and rule.

    A missing text is empty, an empty one has no spans. Rows with the same id and text are looked up once and each get
    the result; rows with the same id and other texts, and rows without id, are told apart by their texts. Columns
    other than the two don't matter. An empty table gives an empty result.
    """
    known = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col).alias("key"),
        F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grams = sorted({g for r in rules for choice in trigram_query(r.pattern) for g in choice})
    found = candidates(build_index(known, grams), rules)
    marked = known.join(found, ["key", "text_hash"], "left")
    names = []
    for number, rule in enumerate(rules):
        flag = F.coalesce(F.getbit("rules", F.lit(number)) == 1, F.lit(False))
        due = F.lit(True) if trigram_query(rule.pattern) == ANY else flag
        names.append(f"_spans{number}")
        marked = _with_spans(marked, rule, number, "text", due, names[-1])
    return marked.select("doc_id", F.sort_array(F.concat(*names)).alias("spans"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["number"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in range(len(BASE))]
    named = [c.cast("long").alias(f"n_{r.kind}") for c, r in zip(counts, BASE)]
    digest = F.sha2(_text_of(base), 256).alias("base_sha256")
    return find_secrets(docs).select("doc_id", *named, digest, _text_of(F.col("spans")).alias("spans"))


def _sql_pattern(pattern: str) -> str:
    """The pattern for an engine whose (?i) goes beyond ASCII: letters outside sets in both cases."""
    if pattern.startswith("(?i)"):
        head, *rest = re.split(r"(\[[^\]]*\]|\\x..)", pattern.removeprefix("(?i)"))
        pieces = [head, *rest]
        pattern = "".join(
            p if p.startswith(("[", "\\")) else re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", p) for p in pieces
        )
    return pattern.replace("'", "''")


def _sql_spans(number: int, rule: Rule) -> str:
    p = _sql_pattern(rule.pattern)
    return f"""
    select id, {number} as number, '{rule.kind}' as kind, unnest(range(1, len(sizes) + 1)) as k,
        [length(x) for x in string_split_regex(body, '{p}')] as gaps, sizes,
        [length(x) for x in regexp_extract_all(body, '{p}', {rule.group})] as checked, {rule.least} as least
    from (select id, body, [length(x) for x in regexp_extract_all(body, '{p}')] as sizes from texts)"""


ORACLE = f"""
with texts as (select doc_id, coalesce(text, '') as body, row_number() over () as id from documents
), found as ({" union all ".join(_sql_spans(n, r) for n, r in enumerate(BASE + ADDED))}
), spans as (
    select id, number, kind, sizes[k] as size, (list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1 : k - 1]), 0))::bigint as first
    from found where checked[k] >= least
), listed as (
    select id, count(*) filter (number = 0) as a, count(*) filter (number = 1) as b, count(*) filter (number = 2) as c,
        string_agg(kind || ':' || first || ':' || (first + size), ',' order by first, number)
            filter (number < {len(BASE)}) as base,
        string_agg(kind || ':' || first || ':' || (first + size), ',' order by first, number) as every
    from spans group by id
)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans
from texts left join listed using (id)
"""
