"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.session import settle


def spanning_links(nodes: list[int], others: list[int]) -> tuple[list[int], list[int]]:
    """Links that keep the same nodes connected, one fewer than nodes for each group: (node, smallest of its group)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(nodes, others):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return [x for x, _ in found], [r for _, r in found]


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node it can reach; roots themselves are left out.

    Every round joins and groups links by node, nothing larger than the links, and writes them, so that a lost
    executor costs one step. Links with NULL and of a node to itself are ignored. A chain of n nodes takes about
    log(n) rounds; more than `rounds` is an error, not a wrong result.
    """
    pairs = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    now = settle(pairs.filter("node > root and root is not null").distinct(), "links")
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before:
            return now
        before = state
        low = now.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("low"))
        large = now.join(low, "root", "left").select("node", F.coalesce("low", "root").alias("root")).distinct()
        large = settle(large, "links")
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        with_low = large.join(low, "node")
        moved = with_low.filter("root > low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        now = settle(low.select("node", F.col("low").alias("root")).union(moved).distinct(), "links")
    raise RuntimeError(f"components did not settle within {rounds} rounds")


LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
