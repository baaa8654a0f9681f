"""Packing: every id in one piece, gapless sequences, and little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echocite.llm import packing, queries
from echocite.llm.byte_tokens import byte_tokens

SCHEMA = "doc_id long, text string, piece string, size int, rank long, sequence_id long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, library):
    """Whole and well packed; the number of padding ids."""
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in docs]
    wanted, given, sequences = Counter(), Counter(), defaultdict(list)
    for i, a in ids:
        wanted[i] += len(a)
    own = defaultdict(list)
    for i, a in ids:
        own[i].append(a)
    for r in rows:
        assert any(
            len(a) == r.doc_tokens and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            for a in own[r.doc_id]
        )
        given[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert given == wanted
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_given_documents(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op2_packing(spark, sf_dir).collect()
    assert check(rows, docs, library) <= 2048
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
    for pieces in spans.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length


def test_awkward_rows_and_clashing_columns(spark, library):
    long = "word " * 9000
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, long), (4, long), (4, "other " * 3000), (None, "no id"), (None, None)]
    docs += [(10 + k, "x y z " * (50 + 40 * k)) for k in range(20)]
    frame = spark.createDataFrame([(i, t, "p", 1, 2, 3) for i, t in docs], SCHEMA)
    check(packing.pack(frame).collect(), docs, library)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "b" * 50_000)], [(1, "one two"), (2, "one two")]])
def test_tiny_tables(spark, library, docs):
    frame = spark.createDataFrame([(i, t, "p", 1, 2, 3) for i, t in docs], SCHEMA)
    check(packing.pack(frame).collect(), docs, library)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_item_once_and_few_sequences(seed):
    rnd = random.Random(seed)
    counts = {size: rnd.choice([0, 1, 7, 500, 20_000]) for size in rnd.sample(range(1, 65), rnd.randint(1, 64))}
    used = packing.patterns(counts, 64)
    given = Counter()
    for pattern, times in used.items():
        assert sum(pattern) <= 64
        for size in pattern:
            given[size] += times
    assert given == Counter({s: n for s, n in counts.items() if n})
    # No packing needs fewer than the items' total size, or than the items over half the room.
    least = max(-(-sum(s * n for s, n in counts.items()) // 64), sum(n for s, n in counts.items() if s > 32))
    assert sum(used.values()) >= least
    if all(n for n in counts.values()) and len(counts) > 20:
        assert sum(used.values()) <= least * 1.02 + 10


def test_ids_are_those_of_the_library(library):
    rnd = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "the", "'s", "É", "中", "12", "!", "²", "\x1c", " ", "🙂", "<|endoftext|>", " \n", "\x85"]
    tokens = byte_tokens()
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))
        ids = np.frombuffer(tokens.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
