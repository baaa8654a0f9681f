"""A Merkle manifest of a dataset: hash trees over the rows of each group, and one over the groups' roots.

Nodes are hexadecimal digests. A tree's nodes are dealt into aligned blocks; a block keeps each of its levels as one
string of digests, so fixed-width substrings are the runs whose hashes make the next level, and the substrings on either
side of a node within its run are its siblings. The blocks' last levels are the nodes of the next round, which runs
likewise until every group has one node left; the groups' roots then are the nodes of one more tree. Proofs go back down:
a block's own proof is looked up once and handed to its members. No step takes more than a block's nodes into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.llm.ranks import ranked
from echocite.session import settle

ARITY = 2
BLOCK_NODES = 256  # that a block has at most; it has the greatest power of the arity within that
WIDTH = 64  # digits of a digest
GROUP = "group"
NODE = "struct<place:long,digest:string,id:long,note:string>"
STEP = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself, so that no two rows read alike; `-` if missing."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _block_depth(arity: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= BLOCK_NODES:
        depth += 1
    return depth


def _parents(level: Column, arity: int) -> Column:
    """The next level: the hash of every run of `arity` digests, the last run as long as it is."""
    run = arity * WIDTH
    starts = F.sequence(F.lit(1), F.octet_length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda at: F.sha2(F.substring(level, at, F.lit(run)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """(group, block, members, levels, top): the aligned blocks of one round, bottom level first.

    Where a group has several blocks all of them go up the same number of levels; a group's only block goes up until one
    node remains, so a group that is done stays as it is.
    """
    depth = _block_depth(arity)
    size = arity**depth
    member = F.struct("place", "digest", "id", "note").cast(NODE)
    blocks = nodes.groupBy(GROUP, F.floor(F.col("place") / size).alias("block"))
    blocks = blocks.agg(F.sort_array(F.collect_list(member)).alias("members"))  # at most `size` nodes
    counts = nodes.groupBy(GROUP).agg(F.max("place").alias("last"))
    blocks = blocks.join(counts, GROUP)
    own = F.lit(0)
    for level in range(depth):
        own = own + (F.size("members") > arity**level).cast("int")
    blocks = blocks.withColumn("depth", F.when(F.col("last") >= size, depth).otherwise(own))
    lowest = F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary")
    ups = F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda k: k <= F.col("depth"))
    levels = F.aggregate(
        ups, F.array(lowest), lambda held, _: F.concat(held, F.array(_parents(F.element_at(held, -1), arity)))
    )
    blocks = blocks.withColumn("levels", levels)
    return blocks.select(GROUP, "block", "members", "levels", F.element_at("levels", -1).cast("string").alias("top"))


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The settled blocks of every round from (group, place, digest, id, note), until each group has one block."""
    rounds = []
    while True:
        blocks = settle(_blocks(nodes, arity), f"merkle-{len(rounds)}")
        rounds.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return rounds
        own = [F.col("block").alias("place"), F.col("top").alias("digest")]
        nodes = blocks.select(GROUP, *own, F.lit(None).alias("id"), F.lit(None).alias("note"))


def _steps(levels: str, at: Column, arity: int) -> Column:
    """The siblings of a block's node number `at`, left and right of it, on every level below the last."""

    def step(level: Column, up: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(arity)), up)).cast("int")
        start = F.floor(own / arity).cast("int") * arity
        left = F.substring(level, start * WIDTH + 1, (own - start) * WIDTH)
        right = F.substring(level, (own + 1) * WIDTH + 1, (start + arity - 1 - own) * WIDTH)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step).cast(STEP)


def _descend(rounds: list[DataFrame], above: DataFrame | None, arity: int) -> DataFrame:
    """(group, node, top, steps, and what `above` has besides) for every node of the first round.

    `above` has (group, steps): the steps from a group's top node on. A round's blocks are joined with the steps of the
    nodes that they are in the round after, then dealt out to their members.
    """
    extra = [c for c in above.columns if c not in (GROUP, "steps")] if above is not None else []
    upper = None
    for blocks in reversed(rounds):
        if upper is not None:
            blocks = blocks.drop("top").join(upper, [GROUP, "block"])
        elif above is not None:
            blocks = blocks.join(above, GROUP)
        else:
            blocks = blocks.withColumn("steps", F.array().cast(STEP))
        dealt = blocks.select(GROUP, "levels", "steps", "top", *extra, F.posexplode("members").alias("at", "node"))
        steps = F.concat(_steps("levels", F.col("at"), arity), F.col("steps"))
        nodes = dealt.select(GROUP, "node", "top", steps.alias("steps"), *extra)
        upper = nodes.select(GROUP, F.col("node.place").alias("block"), "top", "steps", *extra)
    return nodes


def folded(digest: Column, steps: str) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, digest, lambda own, s: F.sha2(F.concat(s["left"], own.cast("binary"), s["right"]), 256))


def proof_digest(steps: str) -> Column:
    """The hash of all siblings, bottom level first and left to right."""
    parts = F.transform(steps, lambda s: F.concat(s["left"], s["right"]).cast("string"))
    return F.sha2(F.array_join(parts, ""), 256)


@dataclass(frozen=True)
class Manifest:
    """The settled rounds of blocks of the groups' trees, and of the tree over their roots."""

    trees: list[DataFrame]
    crown: list[DataFrame]
    arity: int

    def subroots(self) -> DataFrame:
        """(group, subroot, root) of every group; a group is `=` and its name, or empty for a missing one."""
        found = _descend(self.crown, None, self.arity)
        return found.select(F.col("node.note").alias(GROUP), F.col("node.digest").alias("subroot"), F.col("top").alias("root"))

    def proofs(self) -> DataFrame:
        """(id, leaf, note, subroot, root, steps) of every row: steps are the siblings up to the root."""
        above = _descend(self.crown, None, self.arity)
        above = above.select(F.col("node.note").alias(GROUP), "steps", F.col("top").alias("root"))
        found = _descend(self.trees, above, self.arity)
        return found.select(
            F.col("node.id").alias("id"),
            F.col("node.digest").alias("leaf"),
            F.col("node.note").alias("note"),
            F.col("top").alias("subroot"),
            "root",
            "steps",
        )


def manifest(
    rows: DataFrame,
    fields: list[Column],
    group: str = "lang",
    id_col: str = "doc_id",
    note: Column | None = None,
    arity: int = ARITY,
) -> Manifest:
    """Trees over the leaves of `fields`, one for each value of `group`, by ascending id, and one over their roots.

    Rows without id come first, rows with the same id are ordered by their leaves, and every repeat is a leaf of its
    own. A missing group is a group, the first; the others are ordered bytewise. Columns that aren't named play no
    part. `note` is a text that is handed through to a row's proof. An empty table has no root and no proofs.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    given = F.lit(None) if note is None else note
    ids, digest = F.col(id_col).cast("long").alias("id"), leaf(fields).alias("digest")
    leaves = rows.select(key.alias(GROUP), ids, digest, given.cast("string").alias("note"))
    trees = _climb(ranked(leaves, GROUP, ["id", "digest"]), arity)
    roots = trees[-1].select(F.lit("").alias(GROUP), F.col("top").alias("digest"), F.col(GROUP).alias("note"))
    named = ranked(roots, GROUP, ["note"]).withColumn("id", F.lit(None))
    return Manifest(trees, _climb(named, arity), arity)


def verified(found: DataFrame) -> DataFrame:
    """`proofs()` with proof_sha256, folded_root (from the note where there is one, else from the leaf) and verified."""
    held = found.withColumn("proof_sha256", proof_digest("steps"))
    held = held.withColumn("folded_root", folded(F.coalesce("note", "leaf"), "steps"))
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    Where 7 divides the CRC-32 of the id a text tells of one character more than there is (a missing count stays), so
    its leaf no longer leads to the root.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    false = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    note = F.when(tampered & F.col("n_chars").isNotNull(), leaf(false))
    found = verified(manifest(docs, [F.col(c) for c in columns], note=note).proofs())
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return found.select(F.col("id").alias("doc_id"), *names)


ORACLE = """
with recursive leaves as (
    select doc_id, lang, coalesce('=' || lang, '') as grp,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as tail, n_chars,
        list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint),
            lambda c, x: list_reduce([xor(c, x)] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0],
                lambda r, _: xor(r >> 1, (r & 1) * 3988292384::ubigint))) as crc
    from documents
), hashed as (
    select *, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
        sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as changed
    from leaves
), placed as (
    select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place from hashed
), tree(grp, level, place, node, n) as (
    select grp, 0, place, leaf, count(*) over (partition by grp) from placed
    union all
    select grp, level + 1, place // 2, sha256(string_agg(node, '' order by place)), any_value((n + 1) // 2)
    from tree where n > 1 group by grp, level, place // 2
), subroots as (
    select grp, node, level as height, row_number() over (order by grp) - 1 as place from tree where n = 1
), crown(level, place, node, n) as (
    select 0, place, node, count(*) over () from subroots
    union all
    select level + 1, place // 2, sha256(string_agg(node, '' order by place)), any_value((n + 1) // 2)
    from crown where n > 1 group by level, place // 2
), nodes as (
    select grp, level, place, node, n from tree
    union all
    select s.grp, s.height + 1 + c.level, c.place, c.node, c.n from subroots s, crown c
), walk(doc_id, leaf, grp, level, place, siblings, own) as (
    select doc_id, leaf, grp, 0, place, '',
        case when (4294967295 - crc) % 7 = 0 and n_chars is not null then changed else leaf end
    from placed
    union all
    select w.doc_id, w.leaf, w.grp, w.level + 1,
        case when me.n = 1 then s.place else w.place // 2 end,
        w.siblings || case when me.n = 1 then '' else coalesce(o.node, '') end,
        case when me.n = 1 then w.own
            else sha256(case when w.place % 2 = 1 then o.node || w.own else w.own || coalesce(o.node, '') end) end
    from walk w join nodes me on me.grp = w.grp and me.level = w.level and me.place = w.place
    join subroots s on s.grp = w.grp
    left join nodes o on o.grp = w.grp and o.level = w.level and o.place = xor(w.place, 1) and me.n > 1
    where me.n > 1 or w.level = s.height
)
select w.doc_id, w.leaf, s.node as subroot, r.node as root, sha256(w.siblings) as proof_sha256,
    w.own as folded_root, w.own = r.node as verified
from walk w join subroots s on s.grp = w.grp join nodes r on r.grp = w.grp and r.level = w.level and r.n = 1
where w.level > s.height
"""
