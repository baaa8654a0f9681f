"""Beams are widened for links that a search misses, whatever the size of their group."""

import numpy as np
import pytest

from echocite.llm import neighbours
from echocite.llm.graph_index import build


class Blind:
    """A graph whose search finds a group only with a beam of `least` or more, and otherwise all there is."""

    def __init__(self, vectors, hidden, least):
        self.vectors, self.hidden, self.least = vectors, hidden, least

    def search(self, queries, beam, layer=0):
        sims = queries @ self.vectors.T
        if beam < self.least:
            sims[:, self.hidden] = -1
        order = np.argsort(-sims, axis=1)[:, :beam]
        return order, np.take_along_axis(sims, order, axis=1)


def grouped(rnd, sizes, dim=24):
    centres = rnd.normal(size=(len(sizes), dim))
    rows = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), sizes, axis=0)
    rows = rows + 0.02 * rnd.normal(size=rows.shape)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def found_in(graph, queries, selves):
    beam = neighbours.chosen_beam(graph, queries, selves, 0.95)
    r, c = neighbours.linked(graph, queries, beam, 0.95)
    return np.bincount(r, minlength=len(queries))


@pytest.mark.parametrize("least", [17, 100, 10_000])
def test_a_group_that_a_narrow_beam_does_not_reach(least):
    vectors = grouped(np.random.default_rng(3), [200, *[1] * 1000])
    found = found_in(Blind(vectors, np.arange(200), least), vectors, np.arange(len(vectors)))
    assert (found == (vectors @ vectors.T >= 0.95).sum(axis=1)).all()


def test_a_few_links_are_not_judged_by_a_narrow_beam():
    vectors = grouped(np.random.default_rng(4), [2, *[1] * 3000])
    found = found_in(Blind(vectors, np.arange(2), 100), vectors, np.arange(len(vectors)))
    assert (found == (vectors @ vectors.T >= 0.95).sum(axis=1)).all()


def test_recall_in_a_large_shard():
    rnd = np.random.default_rng(5)
    vectors = grouped(rnd, [3000, 400, 50, *[3] * 500, *[1] * 15_050])
    order = rnd.permutation(len(vectors))
    vectors = vectors[order]
    some = np.sort(rnd.choice(len(vectors), 4096, replace=False))
    found = found_in(build(vectors), vectors[some], some)
    wanted = np.array([(vectors @ vectors[i] >= 0.95).sum() for i in some])
    assert len(vectors) == 20_000
    assert (found <= wanted).all() and (found - 1).sum() >= 0.999 * (wanted - 1).sum()
