"""Linked vectors against all pairs."""

import random

import numpy as np
import pytest

from echocite.llm import neighbours, queries
from echocite.llm.graph_index import build

SCHEMA = "vec_id long, embedding array<float>, node string, vector string, shard int, n_links string"


def unit(v):
    return v / np.linalg.norm(v)


def plain(rows, threshold=0.95):
    """[(id, links, smallest id reachable)] by comparing all pairs in double precision."""
    good = [
        k for k, (_, v) in enumerate(rows)
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    near = {k: [] for k in range(len(rows))}
    units = {k: unit(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    for a in good:
        for b in good:
            if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                near[a].append(b)
    out = []
    for k in range(len(rows)):
        seen, edge = {k}, [k]
        while edge:
            edge = [b for a in edge for b in near[a] if b not in seen]
            seen.update(edge)
        out.append((rows[k][0], len(near[k]), min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)))
    return sorted(out, key=str)


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op10_embeddings(spark, sf_dir).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_awkward_rows_and_clashing_columns(spark):
    rnd = np.random.default_rng(1)
    base = [unit(rnd.normal(size=8)).tolist() for _ in range(4)]
    chain = [[float(np.cos(a)), float(np.sin(a))] for a in np.arange(0, 1.2, 0.2)]
    rows = [(9, base[0]), (4, base[0]), (4, base[1]), (5, [2 * x for x in base[1]]), (6, [-x for x in base[1]])]
    rows += [(20 + k, v) for k, v in enumerate(chain)]
    rows += [(1, None), (2, [0.0] * 8), (3, [None] + base[0][1:]), (7, [float("nan")] + base[0][1:])]
    rows += [(8, [float("inf")] + base[0][1:]), (10, []), (11, []), (None, base[2]), (12, base[2]), (None, base[3])]
    rows += [(13, [1e-30] * 8), (14, [1e30] * 8), (15, [-0.0, 1.0] + [0.0] * 6), (16, [0.0, 1.0] + [-0.0] * 6)]
    rows += [(17, base[0]), (17, base[0])]
    frame = spark.createDataFrame([(i, v, "n", "v", 1, "l") for i, v in rows], SCHEMA)
    found = neighbours.near_duplicates(frame).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in found), key=str) == plain(rows)
    assert all(r.kept == (r.id == r.component_id) for r in found if r.id is not None)


def test_empty_table(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_with_large_groups(spark):
    """Groups of one to several hundred near copies; at least 0.99 of all links, and none below the threshold."""
    rnd, rows = np.random.default_rng(2), []
    for size in (700, 150, 40, *[2] * 60, *[1] * 900):
        centre = unit(rnd.normal(size=24))
        rows += [(centre + 0.02 * rnd.normal(size=24)).tolist() for _ in range(size)]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    rows = [(i, rows[k]) for i, k in enumerate(order)]
    frame = spark.createDataFrame([(i, v, "n", "v", 1, "l") for i, v in rows], SCHEMA)
    found = {r.id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(frame).collect()}
    units = np.array([unit(np.array(v, np.float32).astype(float)) for _, v in rows])
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    mine = np.array([found[i][0] for i, _ in rows])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    wanted = {i: c for i, _, c in plain_components(units)}
    assert np.mean([found[i][1] == wanted[i] for i in wanted]) > 0.999


def plain_components(units):
    near = units @ units.T >= 0.95
    low = np.arange(len(units))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            return [(i, None, int(c)) for i, c in enumerate(low)]
        low = new


@pytest.mark.parametrize("size", [1, 2, 3, 50, 129, 1500])
def test_every_node_is_found_by_itself(size):
    rnd = np.random.default_rng(size)
    vectors = rnd.normal(size=(size, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    nodes, sims = build(vectors).search(vectors, min(32, size))
    assert (nodes[:, 0] == np.arange(size)).mean() >= 0.995
    assert np.allclose(sims[nodes[:, 0] == np.arange(size), 0], 1)
