"""Joins of a large fact table with a table of records, safe against hot keys."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.session import fits_broadcast, settle

ROWS_PER_SALT = 500_000  # fact rows of one key that one task should see
LEAST_SHARE = 10_000  # a key with less than one in so many of all rows isn't hot, so there are at most so many hot keys
NULL_SALTS = 1000  # NULL keys match nothing, so their rows are dealt out over so many salts
KEY_GROUPS = 8192  # keys are counted by groups first, and one by one only in groups with enough rows for a hot one
CELL_ROWS = 1_000_000  # fact rows of a cell
CELL_BYTES = 48 << 20  # of records that a cell holds, for each of its two tables, as JSON


def hot_keys(facts: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(key, salts) for every key of `facts` with more rows than one task should take, written once.

    The bound is `rows_per_salt` or a ten-thousandth of all rows, whichever is more, so the list is short whatever
    the size of `facts`. Groups of keys by hash are counted first, so without a hot key nothing longer than their list
    is shuffled. Which keys are salted never changes a join's result, only how its rows are spread.
    """
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).alias("group")
    groups = settle(facts.groupBy(group).agg(F.count(F.lit(1)).alias("rows")), "key-groups")
    least = max(rows_per_salt, (groups.agg(F.sum("rows")).first()[0] or 0) // LEAST_SHARE)
    full = groups.filter(F.col("rows") > least).select("group")
    if full.isEmpty():
        return facts.select(key, F.lit(1).alias("salts")).limit(0)
    counted = facts.select(key, group).join(F.broadcast(full), "group", "left_semi")
    counts = counted.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    hot = counts.filter((F.col("rows") > least) & F.col(key).isNotNull())
    # Both sides of a join must see the same salts, whatever is computed again.
    return settle(hot.select(key, F.ceil(F.col("rows") / least).cast("int").alias("salts")), "hot-keys")


def copy_per_salt(records: DataFrame, hot: DataFrame, key: str, salt: str) -> DataFrame:
    """One copy of a record for each salt of its key: a single one unless the key is hot."""
    last = F.coalesce(F.col("salts") - 1, F.lit(0))
    joined = records.join(F.broadcast(hot), key, "left")
    return joined.withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop("salts")


def join_records(
    facts: DataFrame,
    records: list[tuple[DataFrame, str, str]],
    rows_per_salt: int = ROWS_PER_SALT,
    salted: bool | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join `facts` with each (records, key, how) in turn; every key is a column of both.

    `how` is inner, left, left_semi or left_anti. Where Spark estimates the records within its broadcast threshold the
    join is left to Spark. For larger ones the facts are written once, the hot keys are counted from there, and the
    join is on (key, salt); with no hot key it is Spark's own join. The salt is a hash of the row's other columns, so
    a row computed again gets the same one; rows that have none are counted and joined once. All keys are counted
    before the first join, so no join is repeated for it. Two large tables of records are joined cell by cell where
    that moves fewer rows (`_join_in_cells`). `salted` overrides the size check: True always looks for hot keys, False
    never.

    With `rows_per_task` the joined rows are about to be worked on at length, such as parsed: the short facts are dealt
    to as many tasks as that takes, before records are attached. Spark would size those tasks by the facts' few bytes.
    """
    for _, _, how in records:
        if how not in ("inner", "left", "left_semi", "left_anti"):
            raise ValueError(f"a {how} join would repeat salted records")
    large = [salted is True or salted is None and not fits_broadcast(table) for table, _, _ in records]
    if len(facts.columns) == 1 and any(large):
        n = "_n" if facts.columns[0] != "_n" else "__n"
        unique = facts.groupBy(*facts.columns).agg(F.count(F.lit(1)).alias(n))
        joined = join_records(unique, records, rows_per_salt, False)
        return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(n)
    if rows_per_task or any(large) and salted is None:
        facts = settle(facts, "facts")
    tasks = _tasks(facts, rows_per_task) if rows_per_task else None
    if tasks and not any(large):
        facts = facts.repartition(tasks, *[F.col(c) for c in facts.columns if _hashable(facts, c)])
    if any(large) and salted is None:
        if sum(large) == 2:
            records = [(settle(r[0], "records"), *r[1:]) if is_large else r for r, is_large in zip(records, large)]
            both = [r for r, is_large in zip(records, large) if is_large]
            shape = _cells(facts, *(table for table, _, _ in both))
            if shape:
                joined = _join_in_cells(facts, both, shape, rows_per_salt)
                for (table, key, how), is_large in zip(records, large):
                    joined = joined if is_large else joined.join(F.broadcast(table), key, how)
                return joined
    plans = []
    spread = facts
    for position, ((table, key, how), salt_it) in enumerate(zip(records, large)):
        hot = hot_keys(facts, key, rows_per_salt) if salt_it else None
        if hot is None or hot.isEmpty():
            plans.append((table, [key], how))
            continue
        salt = f"_salt{position}"
        salts = F.when(F.col(key).isNull(), NULL_SALTS).otherwise(F.coalesce("salts", F.lit(1)))
        others = [F.col(c) for c in facts.columns if c != key and _hashable(facts, c)]
        joined = spread.join(F.broadcast(hot), key, "left")
        spread = joined.withColumn(salt, F.pmod(F.xxhash64(*others), salts).cast("int")).drop("salts")
        copies = copy_per_salt(table, hot, key, salt)
        plans.append((copies.repartition(key, salt), [key, salt], how))  # by both, also if the table is dealt by its key
    for position, (table, keys, how) in enumerate(plans):
        if salted is None:  # written facts can be few bytes in files and very many rows: Spark must not send them out
            table = table.hint("merge" if large[position] else "broadcast")
        if tasks and large[position] and not any(large[position + 1 :]):  # the last join that deals the facts out
            spread, table = spread.repartition(tasks, *keys), table.repartition(tasks, *keys).hint("merge")
        spread = spread.join(table, keys, how).drop(*keys[1:])
    return spread


def _tasks(facts: DataFrame, rows_per_task: int) -> int:
    return max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(facts.count() / rows_per_task))


def _cells(facts: DataFrame, a: DataFrame, b: DataFrame) -> tuple[int, int] | None:
    """Numbers of blocks of two tables of records, or None where their copies would be more rows than the facts.

    A record of `a` is copied for each block of `b`, and the other way round. Blocks hold at most about CELL_BYTES, and
    there are enough pairs of blocks for the facts to be dealt out in parts of CELL_ROWS, and to all cores twice. More
    blocks than that would only make more copies, so the number of shuffle partitions doesn't raise it further.
    """
    spark, n = facts.sparkSession, facts.count()
    rows, blocks = [], []
    for table in (a, b):
        text = F.length(F.to_json(F.struct(*table.columns)))
        own = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(text).alias("bytes")).first()
        rows.append(own["rows"])
        blocks.append(max(1, ceil((own["bytes"] or 0) / CELL_BYTES)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(partitions, 2 * spark.sparkContext.defaultParallelism), n // CELL_ROWS)
    while blocks[0] * blocks[1] < tasks:
        blocks[0 if rows[1] * blocks[0] <= rows[0] * blocks[1] else 1] += 1
    return (blocks[0], blocks[1]) if rows[0] * blocks[1] + rows[1] * blocks[0] < n else None


def _join_in_cells(
    facts: DataFrame, records: list[tuple[DataFrame, str, str]], shape: tuple[int, int], rows_per_salt: int
) -> DataFrame:
    """Join `facts` with two tables of records in one shuffle of the short facts, without records attached.

    Keys of either table are dealt to blocks by hash, and each pair of blocks is a cell, a partition of its own. It gets
    the facts whose keys fall in both blocks, and a copy of both blocks' records, which it looks the facts up in. A fact
    moves once and a record as often as the other table has blocks; joined one after another, every fact would carry
    the first record through the second join's shuffle. A key with so many facts that its row of cells would be
    overfull goes by the other columns' hash, and its record to all cells.
    """
    spark, n = facts.sparkSession, shape[0] * shape[1]
    # Facts and copies are dealt by cell alone, which is enough for a join by cell and key.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows, spread = facts.count(), facts
    tables = []
    for side, ((table, key, _), own) in enumerate(zip(records, shape)):
        block, hot = f"_block{side}", hot_keys(facts, key, max(rows_per_salt, rows // (2 * own)))
        others = [F.col(c) for c in facts.columns if c != key and _hashable(facts, c)]
        by_key, by_rest = (F.pmod(F.xxhash64(*c), F.lit(own)).cast("int") for c in ([F.col(key)], others or [F.lit(0)]))
        place = own_block = F.when(F.col(key).isNull(), by_rest).otherwise(by_key)
        step, width = (shape[1], 1) if side == 0 else (1, shape[1])
        cells = F.transform(F.sequence(F.lit(0), F.lit(n // own - 1)), lambda k: by_key * step + k * width)
        if not hot.isEmpty():
            marked = F.broadcast(hot)
            spread = spread.join(marked, key, "left")
            place = F.when(F.col("salts").isNotNull(), by_rest).otherwise(own_block)
            table = table.join(marked, key, "left")
            cells = F.when(F.col("salts").isNotNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(cells)
        spread = spread.withColumn(block, place).drop("salts")
        tables.append(table.withColumn("_cell", F.explode(cells)).drop("salts"))
    cell = (F.col("_block0") * shape[1] + F.col("_block1")).alias("_cell")
    spread = spread.select(*facts.columns, cell).repartitionById(n, F.col("_cell"))
    for copies, (_, key, how) in zip(tables, records):
        copies = copies.repartitionById(n, F.col("_cell"))
        spread = spread.join(copies.hint("shuffle_hash"), ["_cell", key], how)
    return spread.drop("_cell")


def _hashable(df: DataFrame, name: str) -> bool:
    text = df.schema[name].dataType.simpleString()
    return "map<" not in text and "variant" not in text
