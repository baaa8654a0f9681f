"""Deletion of lines against a direct comparison of all lines, without fingerprints or anchors."""

import random

import pytest
from pyspark.sql import functions as F

from echocite.llm import lines, queries

SCHEMA = "doc_id long, text string"
BLANKS = " \t\x0b\x0c\r"
LONG = [f"licence line number {k} that is shared by a great many documents" for k in range(12)]
SHORT = [f"short {k}" for k in range(6)]


def brute(docs):
    """{id: kept text}: a line goes if it was seen before and lies in a run of such lines of 40 characters or more."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        held = text.split("\n")
        full = [(k, x.strip(BLANKS)) for k, x in enumerate(held) if x.strip(BLANKS)]
        cut, run = set(), []
        for k, line in [*full, (None, None)]:
            if line is not None and line in seen:
                run.append((k, line))
                continue
            if sum(len(x) for _, x in run) >= 40:
                cut.update(range(run[0][0], run[-1][0] + 1))
            run = []
            seen.add(line)
        out[i] = "\n".join(x for k, x in enumerate(held) if k not in cut)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_single_and_paired_lines_leave_no_repeat(spark, seed):
    rnd, docs = random.Random(seed), []
    for i in range(80):
        own = [rnd.choice([rnd.choice(LONG), rnd.choice(SHORT), f"own {rnd.random()}", ""]) for _ in range(rnd.randint(1, 8))]
        docs.append((i, "\n".join(own)))
    docs += [(100 + k, line) for k, line in enumerate(LONG)]  # documents of one line
    docs += [(200, LONG[0] + " "), (201, f"head\n{LONG[1]}\n{LONG[2]}\ntail")]
    cut, names = lines.without_runs(spark.createDataFrame(docs, SCHEMA))
    wanted = brute(docs)
    assert {r.doc_id: r[names["kept_text"]] for r in cut.collect()} == wanted
    kept = {r.doc_id: r.text for r in lines.drop_repeated_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == {i: t for i, t in wanted.items() if t.strip(BLANKS + "\n") or t == dict(docs)[i]}
    assert not {100, 200} & kept.keys()


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op9_lines(spark, sf_dir).select("doc_id", "kept_sha256").collect()
    wanted = spark.createDataFrame(list(brute(docs).items()), SCHEMA).select("doc_id", F.sha2("text", 256).alias("sha"))
    assert {r.doc_id: r.kept_sha256 for r in found} == {r.doc_id: r.sha for r in wanted.collect()}
