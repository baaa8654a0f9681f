"""Near-duplicate embeddings: a navigable small-world graph for each shard, every shard searched for every vector.

Equal vectors are one class and are searched once. A class's queries visit all shards in blocks. In each block some
queries, chosen by their number, and some that are known to have links are also compared with the whole shard; while they
miss a link the block's beam is doubled, and where they have too few links to judge it is wide from the start. A query whose beam is full of links is searched again with a wider one until it isn't, or else compared with
the whole shard, so large groups lose nothing. Each block counts its links and hands on a spanning forest of them, not
the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import NO_ID, id_of
from echocite.llm.components import components
from echocite.llm.graph_index import Graph, build
from echocite.session import settle

THRESHOLD = 0.95
SHARDS = 12  # at least; more where a shard would have more than SHARD_ROWS vectors
SHARD_ROWS = 50_000
QUERY_ROWS = 16_384  # of a block
BEAM = 16
WIDEST = 128  # beam of a query whose beam is full of links, before it is compared with the whole shard
AUDITS = 64  # queries of a block that are compared with the whole shard
RECALL = 0.999  # of the audits' links
JUDGED = 32  # links that audits need to judge a beam
PART = 2048  # queries that are searched at a time
PAIRS = 1 << 20  # pairs of queries and vectors that are compared, or linked, at a time

INDEX_PIECE = 1 << 20  # bytes of an index in a row; a whole one can be more than a row should hold

INDEX = "shard long, dim int, piece int, data binary"


def usable(vector: str) -> Column:
    """True for vectors that aren't NULL or zero and have only finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _raw(table: pa.Table, dim: int) -> np.ndarray:
    """Vectors as they are, in single precision if that holds them exactly."""
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):  # components beyond single precision stay as they are
        short = flat.astype(np.float32)
    return (short if np.array_equal(short, flat) else flat.astype(np.float64)).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    vectors = raw.astype(np.float64)
    for k in range(0, len(vectors), PART):
        part = vectors[k : k + PART]
        # Scaled by the greatest component first, so that squares neither overflow nor vanish.
        part /= np.abs(part).max(axis=1, keepdims=True)
        part /= np.linalg.norm(part, axis=1, keepdims=True)
    return vectors


def packed_index(raw: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, graph: Graph) -> bytes:
    """An index as bytes: vectors as they came, and of each layer only the rows of nodes that it has."""
    held = {f"layer{k}": x[graph.levels >= k] for k, x in enumerate(graph.layers)}
    out = BytesIO()
    np.savez(out, raw=raw, nodes=nodes, sizes=sizes, levels=graph.levels.astype(np.int32), **held)
    return out.getvalue()


def unpacked_index(data: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
    """(graph, nodes, sizes) from the bytes of an index."""
    with np.load(BytesIO(data)) as held:
        levels, layers = held["levels"], []
        for k in range(sum(name.startswith("layer") for name in held.files)):
            rows = held[f"layer{k}"]
            layers.append(np.full((len(levels), rows.shape[1]), -1, np.int32))
            layers[-1][levels >= k] = rows
        return Graph(_unit(held["raw"]), levels, layers), held["nodes"], held["sizes"]


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """Rows with the pieces of a shard's index."""
    shard, dim = (k.as_py() for k in key)
    table = table.sort_by("node")
    raw = _raw(table, dim)
    nodes, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "size"))
    del table
    data = packed_index(raw, nodes, sizes, build(_unit(raw)))
    pieces = [data[k : k + INDEX_PIECE] for k in range(0, len(data), INDEX_PIECE)]
    kind = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())])
    columns = [[shard] * len(pieces), [dim] * len(pieces), range(len(pieces)), pieces]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def chosen_beam(graph: Graph, queries: np.ndarray, selves: np.ndarray, threshold: float) -> int | None:
    """The beam with which a block's audits miss nothing, or None if the block has to be compared with the whole shard.

    Audited are every so many-th query and as many that are known to have links; `selves` are the queries' own nodes
    (-1: none), which don't count. A query whose beam is full of links is searched again in any case and says nothing.
    Where the others have too few links to judge by, the beam is as wide as it gets.
    """
    size, beam = len(graph.vectors), min(BEAM, len(graph.vectors))
    audits = np.linspace(0, len(queries) - 1, min(AUDITS, len(queries))).astype(int)
    known: list[int] = []
    for k in range(0, len(queries), PART):
        found, sims = graph.search(queries[k : k + PART], beam)
        others = (sims >= threshold) & (found >= 0) & (found != selves[k : k + PART, None])
        known += (np.flatnonzero(others.any(axis=1)) + k).tolist()
        if len(known) >= AUDITS:
            known = [known[i] for i in np.linspace(0, len(known) - 1, AUDITS).astype(int)]
            break
    audits = np.union1d(audits, np.array(known, int))
    truth = queries[audits] @ graph.vectors.T >= threshold
    inside = np.flatnonzero(selves[audits] >= 0)
    truth[inside, selves[audits][inside]] = False
    while beam < size:
        found, sims = graph.search(queries[audits], beam)
        hit = (sims >= threshold) & (found >= 0)
        mine = np.zeros_like(truth)
        r, c = np.nonzero(hit)
        mine[r, found[r, c]] = True
        judged = ~hit.all(axis=1)
        want, got = truth[judged].sum(), (mine & truth)[judged].sum()
        if got >= RECALL * want:
            return beam if want >= JUDGED else min(max(beam, WIDEST), size)
        beam = 2 * beam
        if beam > 4 * WIDEST:
            break
    return None


def linked_pieces(
    graph: Graph, queries: np.ndarray, beam: int | None, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of similarity `threshold` or more, by beams of `beam`; None: all compared with the shard.

    Pairs come in pieces of about PAIRS at most, so that a large group's are never held at once.
    """
    size, left = len(graph.vectors), np.arange(len(queries))
    while beam is not None and beam < size and len(left):
        full = np.zeros(len(left), bool)
        step = max(1, PAIRS // beam)
        for k in range(0, len(left), step):
            own = left[k : k + step]
            found, sims = graph.search(queries[own], beam)
            hit = (sims >= threshold) & (found >= 0)
            full[k : k + step] = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[k : k + step, None])
            yield own[r], found[r, c]
        left = left[full]
        beam = 4 * beam
        if beam > WIDEST or 4 * beam >= size:
            break
    step = max(1, min(64, PAIRS // max(1, size)))
    for k in range(0, len(left), step):  # the exact way for the rest, in pieces
        r, c = np.nonzero(queries[left[k : k + step]] @ graph.vectors.T >= threshold)
        yield left[k : k + step][r], c


def linked(graph: Graph, queries: np.ndarray, beam: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of `linked_pieces` at once, for few queries."""
    rows, nodes = zip(*linked_pieces(graph, queries, beam, threshold))
    return np.concatenate(rows), np.concatenate(nodes)


def spanning(links: np.ndarray) -> np.ndarray:
    """Rows (node, smallest node of its group) that keep the same nodes connected, one fewer than nodes for each group."""
    names, own = np.unique(links, return_inverse=True)
    own = own.reshape(links.shape)
    low = np.arange(len(names))  # by position, which is in order of the names
    while True:
        one, two = low[own[:, 0]], low[own[:, 1]]
        apart = one != two
        if not apart.any():
            break
        one, two = one[apart], two[apart]
        np.minimum.at(low, np.maximum(one, two), np.minimum(one, two))
        while (low != low[low]).any():
            low = low[low]
    moved = np.flatnonzero(low != np.arange(len(names)))
    return np.stack([names[moved], names[low[moved]]], axis=1)


def _query(threshold: float):
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(key: tuple, index: pa.Table, block: pa.Table) -> pa.Table:
        """(a, b, links): links of query a that are counted here, or a link (a, b) of the spanning forest."""
        if not index.num_rows or not block.num_rows:
            return pa.Table.from_pylist([], schema=kind)
        index = index.sort_by("piece")
        graph, nodes, sizes = unpacked_index(b"".join(x.as_buffer() for x in index.column("data")))
        del index
        block = block.sort_by("node")
        own = block.column("node").to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        selves = np.where(nodes[at] == own, at, -1)
        queries, counts = _unit(_raw(block, key[1].as_py())), np.zeros(len(own), np.int64)
        forest, due, held = np.empty((0, 2), np.int64), [], 0
        beam = chosen_beam(graph, queries, selves, threshold)
        for k in range(0, len(own), PART):
            for r, c in linked_pieces(graph, queries[k : k + PART], beam, threshold):
                r = r + k
                other = own[r] != nodes[c]
                r, c = r[other], c[other]
                np.add.at(counts, r, sizes[c])
                due.append(np.stack([own[r], nodes[c]], axis=1))
                held += len(r)
                if held >= PAIRS:
                    forest, due, held = spanning(np.concatenate([forest, *due])), [], 0
        forest = spanning(np.concatenate([forest, *due]))
        some = np.flatnonzero(counts)
        a = np.concatenate([own[some], forest[:, 0]])
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(forest[:, 1], pa.int64())])
        links = np.concatenate([counts[some], np.zeros(len(forest), np.int64)])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), b, pa.array(links, pa.int64())], schema=kind)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, key, n_links, component_id, kept) of every row, repeated rows included.

    Two rows are linked if the cosine of their vectors, in double precision, is at least `threshold`; rows with equal
    vectors always are. Vectors that are NULL, zero, or hold NULL or non-finite components are linked with nothing, and
    vectors of different lengths not with each other. n_links counts the other rows linked directly; component_id is
    the smallest id reachable, NULL where only rows without id are; kept marks the first row of each component.
    """
    spark = vectors.sparkSession
    held = F.col(vector_col).cast("array<double>")
    stand_in = F.xxhash64(held).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), stand_in).alias("key"),
        held.alias("vector"),
    )
    rows = rows.withColumn("vector", F.when(usable("vector"), F.col("vector")))
    classes = rows.filter("vector is not null").groupBy("vector")
    classes = classes.agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("size"))
    classes = classes.withColumn("dim", F.size("vector"))
    # Rows of different vectors may share an id; a class's node must be its own.
    classes = classes.withColumn("label", F.col("node"))
    classes = classes.withColumn("node", F.xxhash64("vector"))
    classes = settle(classes, "vector-classes")
    n = classes.count()
    shards, blocks = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // QUERY_ROWS))

    index = classes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)))
    index = index.groupBy("shard", "dim").applyInArrow(_build, INDEX)
    index = settle(index, "graphs").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = classes.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int"))
    queries = queries.select("shard", "dim", "block", "node", "vector")
    keys = ["shard", "dim", "block"]
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys))
    found = settle(found.applyInArrow(_query(threshold), "a long, b long, links long"), "vector-links")

    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null"))
    named = classes.select("vector", "node", "label", "size").join(counts, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("label").alias("first"))
    n_links = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    named = named.join(lowest, "root").select("vector", n_links.alias("n_links"), "first")
    joined = rows.join(named, "vector", "left").withColumn("first", F.coalesce("first", "key"))
    return joined.select(
        "id",
        "key",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        id_of("first").alias("component_id"),
        (F.col("key") == F.col("first")).alias("kept"),
    )


def keep_one(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id) of the rows that stay: one for each component."""
    return near_duplicates(vectors, id_col, vector_col).filter("kept").select("key", "id").dropDuplicates(["key"]).select("id")
