"""What a task holds grows with its shard and block, not with the pairs of a large group."""

import tracemalloc

import numpy as np
import pyarrow as pa

from echocite.llm import graph_index, neighbours
from echocite.llm.components import spanning_links
from tests.llm.test_neighbour_audits import Blind, grouped


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pairs_of_a_large_group_are_not_held_at_once(monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS", 10_000)
    vectors = grouped(np.random.default_rng(6), [900, *[1] * 100])
    pieces = list(neighbours.linked_pieces(Blind(vectors, [], 0), vectors, None, 0.95))
    assert sum(len(r) for r, _ in pieces) == (vectors @ vectors.T >= 0.95).sum()
    assert max(len(r) for r, _ in pieces) <= 10_000


def test_spanning_links_are_those_of_the_plain_version():
    rnd = np.random.default_rng(7)
    for n, m in ((0, 1), (1, 5), (400, 300), (5000, 200), (300, 5000)):
        links = rnd.integers(-(2**62), 2**62, m)[rnd.integers(0, m, (n, 2))]
        found = neighbours.spanning(links)
        nodes, roots = spanning_links(links[:, 0].tolist(), links[:, 1].tolist())
        assert sorted(map(tuple, found.tolist())) == sorted(zip(nodes, roots))


def test_building_does_not_copy_vectors_for_every_link():
    vectors = grouped(np.random.default_rng(8), [1] * 3000, dim=256)
    assert peak(lambda: graph_index.build(vectors)) < 24 * vectors.nbytes


def _shard(vectors):
    offsets = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32))
    column = pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float64).ravel()))
    nodes = np.arange(len(vectors))
    return pa.table({"node": nodes, "size": nodes % 3 + 1, "vector": column})


def test_an_index_goes_to_its_blocks_in_short_rows(monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_PIECE", 10_000)
    rnd = np.random.default_rng(9)
    for kind in (np.float32, np.float64):
        vectors = rnd.normal(size=(1000, 32)).astype(kind)
        rows = neighbours._build((pa.scalar(3), pa.scalar(32)), _shard(vectors))
        assert max(map(len, rows.column("data").to_pylist())) <= 10_000
        # Single precision stays so, and upper layers have the rows of their own nodes only.
        assert sum(map(len, rows.column("data").to_pylist())) < vectors.nbytes + 1000 * (24 + 2 * 12 + 8) * 4
        back, nodes, sizes = neighbours.unpacked_index(b"".join(rows.column("data").to_pylist()))
        plain = vectors.astype(np.float64)
        plain = plain / np.abs(plain).max(axis=1, keepdims=True)
        plain = plain / np.linalg.norm(plain, axis=1, keepdims=True)
        graph = graph_index.build(plain)
        assert (back.vectors == plain).all() and (back.levels == graph.levels).all() and back.entry == graph.entry
        assert [x.tolist() for x in back.layers] == [x.tolist() for x in graph.layers]
        assert (nodes == np.arange(1000)).all() and (sizes == nodes % 3 + 1).all()


def test_building_holds_less_than_all_links_of_a_batch():
    vectors = grouped(np.random.default_rng(10), [1] * 8000, dim=16)
    assert peak(lambda: graph_index.build(vectors)) < 50 << 20
