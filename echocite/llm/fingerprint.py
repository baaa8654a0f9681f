"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words, each weighted by how often it occurs. For every word and sample number a hash gives
fixed variates: r and c from a gamma distribution of shape 2, which is -ln(u v) of two uniforms, and a uniform b. A word of
weight S scores c / (y e^r) with t = floor(ln S / r + b) and y = exp(r (t - b)); the sample is the word with the least score
together with its t. Two documents agree on a sample with a probability equal to their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones, so the share of equal samples estimates it.

The words of a text are counted in its own row, so no word is shuffled: texts move once, into blocks of neighbouring
ids, where a window finds each document's successor. Words then become rows only within a task. Words that occur once both
in a text and in its edited form are scored once for the two.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echocite.llm.common import once, row_key

SAMPLES = 64
BLOCK_ROWS = 50_000
MOST_BLOCKS = 65_536  # so the bounds between blocks take half a megabyte; in larger tables blocks are longer
BLANKS = " \t\n\x0b\x0c\r"
SCORE_SCALE = float(1 << 26)  # scores as whole numbers: no score is above 20.8, so they take 31 bits
LOW = (1 << 32) - 1
OWN, EDITED, BEYOND, SHARED = range(4)  # whose words a row has: the text's, its edited form's, the next text's, both's


def _bits(h: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)).cast("double")


def _log_product(h: Column, at: int, width: int) -> Column:
    """-ln(u v) of two numbers strictly between 0 and 1, from so many bits each."""
    u, v = _bits(h, at, width), _bits(h, at + width, width)
    return -F.log((u + 0.5) * (v + 0.5) * 4.0**-width)


def sample_seed(number: int) -> int:
    """What a word's hash is combined with for one sample."""
    return int.from_bytes(xxhash.xxh64_digest(number.to_bytes(4, "big")), "big", signed=True)


def _sample(term: Column, log_weight: Column, number: int) -> Column:
    """Score (high 32 bits) and identity (low 32 bits) of a weighted word for one sample; the least is the sample."""
    h = F.xxhash64(term.bitwiseXOR(F.lit(sample_seed(number))))
    b, r, c = _bits(h, 0, 10) * 2.0**-10, _log_product(h, 10, 13), _log_product(h, 36, 14)
    t = F.when(log_weight == 0, F.lit(0).cast("long")).otherwise(F.floor(log_weight / r + b))
    score = c * F.exp(r * (b - 1.0 - t.cast("double")))
    return F.shiftleft((score * SCORE_SCALE).cast("long"), 32).bitwiseOR(h.bitwiseXOR(t).bitwiseAND(F.lit(LOW)))


def weighted_words(text: Column) -> Column:
    """The sorted hashes of a text's words; a text without words has one empty word."""
    words = F.split(F.btrim(text, F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _with_bags(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """`rows` with an array of (term, weight), the distinct words of a text, for each of `texts`; NULL for NULL."""
    names = list(texts)
    held = once(rows, **{f"{n}_words": F.when(t.isNotNull(), weighted_words(t)) for n, t in texts.items()})

    def starts(name: str) -> Column:
        words = F.col(f"{name}_words")
        places = F.sequence(F.lit(0), F.size(words) - 1)
        return F.filter(places, lambda p: (p == 0) | (F.get(words, p) != F.get(words, p - 1)))

    held = once(held, **{f"{n}_starts": F.when(F.col(f"{n}_words").isNotNull(), starts(n)) for n in names})

    def bag(name: str) -> Column:
        words, at = F.col(f"{name}_words"), F.col(f"{name}_starts")
        return F.transform(
            at,
            lambda p, k: F.struct(
                F.get(words, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(words)) - p).alias("weight")
            ),
        )

    return once(held, **{n: bag(n) for n in names}).select(*rows.columns, *names)


def least_samples(terms: DataFrame, keys: list[str], carry: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys`, `carry` (whole numbers that are the same for all rows of a key) and `least`: the packed least sample of
    each number over the rows (term, weight) of a key. Where rows are partitioned by some of `keys` nothing is shuffled."""
    terms = terms.withColumn("log_weight", F.when(F.col("weight") == 1, 0.0).otherwise(F.log(F.col("weight"))))
    scored = [F.min(_sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)]
    least = terms.groupBy(*keys).agg(*[F.min(c).alias(c) for c in carry], *scored)
    return least.select(*keys, *carry, F.array(*[f"s{k}" for k in range(samples)]).alias("least"))


def _lesser(a: Column, b: Column) -> Column:
    """Samples of the words of both; either may be missing."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: F.least(x, y)), a, b)


def _identities(least: Column) -> Column:
    return F.transform(least, lambda x: x.bitwiseAND(F.lit(LOW)))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two signatures."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x).cast("double") / F.size(a)


def text_of(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _bounds(keys: DataFrame, blocks: int) -> list[float]:
    """Quantiles of `key` that part the rows into so many ranges; at most `MOST_BLOCKS` numbers come to the driver."""
    shares = [k / blocks for k in range(1, blocks)]
    found = keys.agg(F.percentile_approx("key", shares, 20 * blocks)).first()[0] if shares else None
    return sorted(set(map(float, found or [])))


def with_block(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """`rows` with `block`: how many of the bounds are at most the row's `key`. The bounds go to the tasks beside the
    plan, which stays as short as it is whatever their number."""
    if not bounds:
        return rows.withColumn("block", F.lit(0))
    splits = [-math.inf, *bounds, math.inf]
    held = rows.withColumn("near_key", F.col("key").cast("double"))
    held = Bucketizer(splits=splits, inputCol="near_key", outputCol="block").transform(held)
    return held.withColumn("block", F.col("block").cast("int")).drop("near_key")


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, place, doc_id, text, next, last): every row with the text of the next one by id, after the last the
    first. A block is a range of ids of about `BLOCK_ROWS` rows or fewer; `last` marks the last row of a block."""
    spark = docs.sparkSession
    key = row_key(id_col, text_col).alias("key")
    keys = docs.select(key)
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // BLOCK_ROWS))
    named = docs.select(
        key,
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    named = with_block(named, _bounds(keys, min(blocks, MOST_BLOCKS)))
    order = Window.partitionBy("block").orderBy("key", "text_hash")
    placed = named.withColumn("place", F.row_number().over(order)).withColumn("following", F.lead("text").over(order))

    heads = named.groupBy("block").agg(F.min(F.struct("key", "text_hash")).alias("head"))
    around = Window.orderBy("block")  # one row for each block
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("block", F.coalesce(F.lead("head").over(around), first).alias("head"))
    heads = heads.select("block", "head.key", "head.text_hash")
    heads = F.broadcast(heads)  # as many rows of three numbers as there are blocks
    texts = named.select("key", "text_hash", F.col("text").alias("next")).join(heads, ["key", "text_hash"])
    texts = texts.select("block", "next").dropDuplicates(["block"])
    at_end = (placed["block"] == texts["block"]) & placed["following"].isNull()
    joined = placed.join(texts, at_end, "left")
    return joined.select(
        placed["block"],
        "place",
        "doc_id",
        "text",
        F.coalesce("following", "next").alias("next"),
        F.col("following").isNull().alias("last"),
    )


def _halves(digest: Column) -> list[Column]:
    """A 64-digit hexadecimal string as five whole numbers of at most 52 bits."""
    return [F.conv(F.substring(digest, 1 + 13 * k, 13), 16, 10).cast("long") for k in range(5)]


def _digits(names: list[str]) -> Column:
    widths = [13, 13, 13, 13, 12]
    return F.concat(*[F.lower(F.lpad(F.hex(n), w, "0")) for n, w in zip(names, widths)])


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last half of the text's code points replaced by as many from the next row's text, by
    ascending id; rows with the same id follow each other by a hash of their text, rows without id come last. A
    missing text is empty. A single row is its own successor. An empty table gives an empty result.
    """
    rows = with_successor(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    n_chars = F.length("text").cast("long").alias("n_chars")
    rows = rows.select("block", "place", "doc_id", n_chars, "text", "next", "last", edited.alias("changed"))
    digests = [f"digest{k}" for k in range(5)]
    rows = once(rows, digest=F.sha2("changed", 256))
    rows = rows.select("*", *[c.alias(n) for c, n in zip(_halves(F.col("digest")), digests)])
    texts = {"own": F.col("text"), "edited": F.col("changed"), "beyond": F.when(F.col("last"), F.col("next"))}
    carry = ["doc_id", "n_chars", *digests]
    bags = _with_bags(rows, texts).select("block", "place", *carry, *texts)

    def single(name: str) -> Column:
        return F.transform(F.filter(name, lambda x: x["weight"] == 1), lambda x: x["term"])

    bags = once(bags, shared=F.array_intersect(single("own"), single("edited")))

    def weighted(terms: Column) -> Column:
        return F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(1).alias("weight")))

    def alone(name: str) -> Column:
        more = F.filter(name, lambda x: x["weight"] > 1)
        return F.concat(more, weighted(F.array_except(single(name), F.col("shared"))))

    sides = {OWN: alone("own"), EDITED: alone("edited"), BEYOND: F.col("beyond"), SHARED: weighted(F.col("shared"))}
    listed = F.array(*[F.struct(F.lit(k).alias("side"), terms.alias("terms")) for k, terms in sides.items()])
    parts = bags.select("block", "place", *carry, F.inline(listed))
    terms = parts.select("block", "place", *carry, "side", F.inline("terms"))
    made = least_samples(terms, ["block", "place", "side"], carry, samples)

    def of(side: int) -> Column:
        return F.first(F.when(F.col("side") == side, F.col("least")), ignorenulls=True)

    wide = made.groupBy("block", "place").agg(
        *[F.min(c).alias(c) for c in carry],
        *[of(side).alias(name) for side, name in ((OWN, "own"), (EDITED, "edited"), (BEYOND, "beyond"), (SHARED, "shared"))],
    )
    whole = {n: _identities(_lesser(F.col(n), F.col("shared"))) for n in ("own", "edited")}
    wide = wide.withColumns({**whole, "beyond": _identities(F.col("beyond"))})
    order = Window.partitionBy("block").orderBy("place")
    wide = wide.withColumn("next", F.coalesce("beyond", F.lead("own").over(order)))
    return wide.select(
        "doc_id",
        "n_chars",
        _digits(digests).alias("edited_sha256"),
        text_of("own").alias("fingerprint"),
        text_of("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
