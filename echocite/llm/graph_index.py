"""A hierarchical navigable small-world graph over one shard of unit vectors, searched for many queries at a time.

Every step of a search takes one node for each query of a block, so the work is done by numpy on whole blocks.
"""

from __future__ import annotations

import numpy as np

LINKS = 12  # of a node on the upper layers; twice as many at the bottom
BUILD_BEAM = 40
BLOCK = 256  # queries that move in step
PIECE = 1 << 14  # links that are compared at a time
PART = 4096  # nodes whose links are pruned at a time
FIRST = 128  # nodes that are linked by comparing all of them


class Graph:
    """Vectors and, layer by layer, each node's neighbours (-1: none); built by insertion in growing batches."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.levels, self.layers = vectors, levels, layers
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    def _descend(self, queries: np.ndarray, entry: int, below: int) -> np.ndarray:
        """For each query the best node found greedily on the layers from the top down to above `below`."""
        at = np.full(len(queries), entry)
        best = queries @ self.vectors[entry]
        for layer in range(len(self.layers) - 1, below, -1):
            moving = np.arange(len(queries))
            while len(moving):
                near = self.layers[layer][at[moving]]
                sims = np.einsum("qd,qnd->qn", queries[moving], self.vectors[near])
                sims[near < 0] = -np.inf
                pick = np.argmax(sims, axis=1)
                value = sims[np.arange(len(moving)), pick]
                better = value > best[moving]
                at[moving[better]] = near[np.arange(len(moving)), pick][better]
                best[moving[better]] = value[better]
                moving = moving[better]
        return at

    def search(self, queries: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, of a beam search from the entry; -1 where a beam isn't full."""
        nodes = np.full((len(queries), beam), -1)
        sims = np.full((len(queries), beam), -np.inf)
        for k in range(0, len(queries), BLOCK):
            nodes[k : k + BLOCK], sims[k : k + BLOCK] = self._search_block(queries[k : k + BLOCK], beam, layer)
        return nodes, sims

    def _search_block(self, queries: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        n, near_of = len(queries), self.layers[layer]
        at = self._descend(queries, self.entry, layer)
        seen = np.zeros((n, len(self.vectors)), bool)
        seen[np.arange(n), at] = True
        nodes, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf)
        todo = np.full((n, beam), -np.inf)  # similarities of those not expanded
        nodes[:, 0], sims[:, 0] = at, np.einsum("qd,qd->q", queries, self.vectors[at])
        todo[:, 0] = sims[:, 0]
        active = np.arange(n)
        while len(active):
            pick = np.argmax(todo[active], axis=1)
            going = todo[active, pick] > -np.inf
            active, pick = active[going], pick[going]
            if not len(active):
                break
            todo[active, pick] = -np.inf
            near = near_of[nodes[active, pick]]
            new = (near >= 0) & ~seen[active[:, None], near]
            some = new.any(axis=1)
            rows, near, new = active[some], near[some], new[some]
            if not len(rows):
                continue
            r, c = np.nonzero(new)
            seen[rows[r], near[r, c]] = True
            found = np.full(near.shape, -np.inf)
            found[r, c] = np.einsum("kd,kd->k", queries[rows[r]], self.vectors[near[r, c]])
            all_sims = np.concatenate([sims[rows], found], axis=1)
            order = np.argsort(-all_sims, axis=1)[:, :beam]
            take = np.arange(len(rows))[:, None]
            sims[rows] = all_sims[take, order]
            nodes[rows] = np.concatenate([nodes[rows], np.where(new, near, -1)], axis=1)[take, order]
            todo[rows] = np.concatenate([todo[rows], found], axis=1)[take, order]
        order = np.argsort(-sims, axis=1)
        take = np.arange(n)[:, None]
        return nodes[take, order], sims[take, order]


def _diverse(graph: Graph, others: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (best first, -1 for none) those nearer to the row's node than to any taken before
    them, filled up with the best of the rest, `most` at most."""
    n, width = others.shape
    out = np.full((n, most), -1, np.int32)
    for at in range(0, n, BLOCK):
        part, own = others[at : at + BLOCK], sims[at : at + BLOCK]
        vectors = graph.vectors[part]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(part.shape, bool)
        for k in range(width):
            nearer = (between[:, k, :] < own[:, k, None]) | ~taken
            taken[:, k] = (part[:, k] >= 0) & nearer.all(axis=1) & (taken.sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(part >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        rows = np.arange(len(part))[:, None]
        out[at : at + BLOCK, : order.shape[1]] = np.where(rank[rows, order] < 2, part[rows, order], -1)
    return out


def _best_first(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(distinct ids, candidates, similarities): the best `most` of each id's (other, similarity) rows, without repeats."""
    order = np.lexsort((others, -sims, ids))
    ids, others, sims = ids[order], others[order], sims[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, sims = ids[fresh], others[fresh], sims[fresh]
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    sizes = np.diff(np.append(heads, len(ids)))
    place = np.arange(len(ids)) - np.repeat(heads, sizes)
    keep = place < most
    row = np.repeat(np.arange(len(heads)), sizes)[keep]
    table, values = np.full((len(heads), most), -1), np.full((len(heads), most), -np.inf)
    table[row, place[keep]], values[row, place[keep]] = others[keep], sims[keep]
    return ids[heads], table, values


def _link(graph: Graph, layer: int, new: np.ndarray, others: np.ndarray, sims: np.ndarray) -> None:
    """Neighbours of new nodes, and links back, pruned where a neighbour has too many."""
    table = graph.layers[layer]
    most, vectors = table.shape[1], graph.vectors
    table[new] = mine = _diverse(graph, others, sims, most)
    r, c = np.nonzero(mine >= 0)
    order = np.argsort(mine[r, c], kind="stable")
    targets, sources = mine[r, c][order].astype(int), new[r][order]
    back = np.unique(targets)
    for k in range(0, len(back), PART):  # a batch touches up to all nodes, whose links are not held at once
        part = back[k : k + PART]
        own = slice(*np.searchsorted(targets, (part[0], part[-1] + 1)))
        held_r, held_c = np.nonzero(table[part] >= 0)
        ids = np.concatenate([targets[own], part[held_r]])
        to = np.concatenate([sources[own], table[part[held_r], held_c]]).astype(int)
        values = np.empty(len(ids))
        for at in range(0, len(ids), PIECE):
            one, two = vectors[ids[at : at + PIECE]], vectors[to[at : at + PIECE]]
            values[at : at + PIECE] = np.einsum("kd,kd->k", one, two)
        ids, others, sims = _best_first(ids, to, values, most + BUILD_BEAM)
        table[ids] = _diverse(graph, others, sims, most)


def _reach(graph: Graph) -> None:
    """Extra links at the bottom, so that every node can be reached from the entry: each node out of reach gets one
    from its nearest neighbour, or else from the entry, in a column of its own if need be."""
    n = len(graph.vectors)
    while True:
        table = graph.layers[0]
        seen, edge = np.zeros(n, bool), np.array([graph.entry])
        seen[edge] = True
        while len(edge):
            near = np.unique(table[edge])
            edge = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
            seen[edge] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return
        near = np.where(table[lost] >= 0, table[lost], graph.entry)
        bridge = seen[near]
        source = np.where(bridge.any(axis=1), near[np.arange(len(lost)), np.argmax(bridge, axis=1)], -1)
        if (source < 0).all():
            source[0] = graph.entry
        lost, source = lost[source >= 0], source[source >= 0]
        order = np.argsort(source, kind="stable")
        lost, source = lost[order], source[order]
        heads = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
        place = np.arange(len(source)) - np.repeat(heads, np.diff(np.append(heads, len(source))))
        used = (table >= 0).sum(axis=1)[source] + place
        wider = int(used.max()) + 1 - table.shape[1]
        if wider > 0:
            table = np.concatenate([table, np.full((n, wider), -1, np.int32)], axis=1)
        table[source, used] = lost
        graph.layers[0] = table


def _nearest(queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities) of each query's `most` nearest others; itself, at -inf, where there are too few."""
    nearest = np.empty((len(queries), min(most, len(queries))), int)
    sims = np.empty(nearest.shape)
    for k in range(0, len(queries), BLOCK):
        inside = queries[k : k + BLOCK] @ queries.T
        inside[np.arange(len(inside)), np.arange(k, k + len(inside))] = -np.inf
        nearest[k : k + BLOCK] = np.argsort(-inside, axis=1)[:, :most]
        sims[k : k + BLOCK] = np.take_along_axis(inside, nearest[k : k + BLOCK], axis=1)
    return nearest, sims


def build(vectors: np.ndarray, seed: int = 1, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
    """A graph over unit vectors. Batches double, so most nodes find their neighbours by searching the graph so far;
    nodes of a batch are also compared with each other."""
    n = len(vectors)
    draw = np.random.default_rng(seed).random(n)
    levels = np.minimum(np.floor(-np.log(1 - draw) / np.log(links)), 6).astype(int)
    tops = int(levels.max()) + 1 if n else 1
    graph = Graph(vectors, levels, [np.full((n, links * (1 if k else 2)), -1, np.int32) for k in range(tops)])
    order = np.argsort(-levels, kind="stable")  # upper layers first, so that every search starts from the top
    graph.entry = int(order[0]) if n else -1
    done = 0
    while done < n:
        batch = order[done : done + min(max(FIRST, done), 2048)]
        queries = vectors[batch]
        for layer in range(int(levels[batch].max()), -1, -1):
            own = np.flatnonzero(levels[batch] >= layer)
            nearest, sims = _nearest(queries[own], beam)
            others = batch[own[nearest]]
            if done and (levels[order[:done]] >= layer).any():
                nodes, values = graph.search(queries[own], beam, layer)
                others, sims = np.concatenate([others, nodes], axis=1), np.concatenate([sims, values], axis=1)
            others = np.where(np.isfinite(sims), others, -1)
            by = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            others, sims = np.take_along_axis(others, by, axis=1), np.take_along_axis(sims, by, axis=1)
            if len(own) > 1 or done:
                _link(graph, layer, batch[own], others, sims)
        done += len(batch)
    if n:
        _reach(graph)
    return graph
