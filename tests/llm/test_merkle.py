import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from echocite.llm import merkle, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, steps string, node string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes, arity):
    """The root, and for each node the siblings on its way as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, path in enumerate(paths):
            start = at[own] // arity * arity
            path.append((nodes[start : at[own]], nodes[at[own] + 1 : start + arity]))
            at[own] //= arity
        nodes = [digest(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows, arity=2):
    made = []
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        leaf = digest(*map(field, row))
        false = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            false = digest(*map(field, (doc_id, source, lang, n_chars + 1, text)))
        made.append((doc_id, lang, leaf, false))
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    langs = sorted({r[1] for r in made}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([r[2] for r in made if r[1] == lang], arity) for lang in langs}
    root, upper = plain_tree([trees[lang][0] for lang in langs], arity) if langs else (None, [])
    out = []
    for lang, above in zip(langs, upper):
        for (doc_id, _, leaf, own), path in zip([r for r in made if r[1] == lang], trees[lang][1]):
            for left, right in path + above:
                own = digest(*left, own, *right)
            proof = digest(*(d for left, right in path + above for d in left + right))
            out.append((doc_id, leaf, trees[lang][0], root, proof, own, own == root))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 9, "steps", "node") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.document_proofs(docs).collect()), key=repr)


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, "s", "en", 1, "x"),
        (3, "s", "en", 1, "x"),
        (3, "s", "en", 1, "x"),
        (3, "s", "en", 1, "y"),
        (-4, "", "", 0, ""),
        (5, "s", "dé", 2, "ä\U0001f600"),
        (6, "s", "de", None, "long " * 30_000),
        (7, "s", "z", 3, None),
    ] + [(k, "s", "en", k, f"text {k}") for k in range(100, 140)]
    mine = found(spark, rows)
    assert mine == plain_manifest(rows)
    assert {r[6] for r in mine} == {True, False}


def test_empty_table_and_single_rows(spark):
    assert found(spark, []) == []
    rows = [(8, "s", "en", 1, "only")]
    assert found(spark, rows) == plain_manifest(rows)
    assert found(spark, rows)[0][4] == digest()


@pytest.mark.parametrize("n", [255, 256, 257, 513, 1100])
def test_groups_around_the_size_of_a_block(spark, n):
    rows = [(k, None, "big", k, "t") for k in range(n)] + [(k, None, "small", k, "t") for k in range(n, n + 3)]
    assert found(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("arity", [3, 16])
def test_other_arities(spark, arity):
    rows = [(k, f"s{k}", f"l{k % 5}", k, "t") for k in range(900)]
    docs = spark.createDataFrame([(*r, 9, "steps", "node") for r in rows], SCHEMA)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    mine = merkle.verified(merkle.manifest(docs, columns, arity=arity).proofs())
    wanted = {(r[0], r[1], r[2], r[3], r[4]) for r in plain_manifest(rows, arity)}
    assert {tuple(r) for r in mine.select("id", "leaf", "subroot", "root", "proof_sha256").collect()} == wanted
    assert mine.filter("verified").count() == len(rows)


def test_many_groups_make_a_tall_crown(spark):
    rows = [(k, "s", f"lang {k // 2}", k, "t") for k in range(1200)]
    docs = spark.createDataFrame([(*r, 9, "steps", "node") for r in rows], SCHEMA)
    built = merkle.manifest(docs, [F.col("doc_id")])
    assert len(built.crown) == 2
    subroots = built.subroots().collect()
    assert len(subroots) == 600 and len({r.root for r in subroots}) == 1
    assert merkle.verified(built.proofs()).filter("verified").count() == 1200


def test_a_changed_row_changes_only_the_roots_above_it(spark):
    rows = [(k, "s", f"l{k % 2}", k, "t") for k in range(50)]
    before = {r[0]: r for r in found(spark, rows)}
    rows[4] = (4, "s", "l0", 4, "other")
    after = {r[0]: r for r in found(spark, rows)}
    assert {k for k in before if before[k][1] != after[k][1]} == {4}
    assert {before[1][2] == after[1][2], before[0][2] == after[0][2]} == {True, False}
    assert before[1][3] != after[1][3]


def test_numbers_within_groups_of_any_size(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(40)}", rnd.choice([None, 1, 2, 3, rnd.randrange(10**6)])) for _ in range(5000)]
    mine = ranks.ranked(spark.createDataFrame(rows, "g string, part long"), "g", ["part"]).collect()
    groups = {}
    for r in mine:
        groups.setdefault(r.g, []).append((r.place, r.part))
    for g, placed in groups.items():
        placed.sort()
        assert [p for p, _ in placed] == list(range(len(placed)))
        values = [v for _, v in placed]
        assert values == sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v or 0))
