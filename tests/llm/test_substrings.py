"""Content-defined chunks and the passages they find, against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from echocite.llm import queries, substrings

SCHEMA = "doc_id long, text string, place int, spans string, row_key string, kept_text string, digest long"


def plain_cuts(text):
    """Cuts from a gear hash that is shifted byte by byte."""
    gears = [xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)]
    out, last, h, blank = [0], 0, 0, -1
    for k in range(len(text)):
        blank = k if text[k] in b" \t\n\x0b\x0c\r" else blank
        h = (h << 1) + gears[text[k]] & 0xFFFFFFFF
        at = k + 1
        if at == len(text):
            break
        word = text[k] in b" \t\n\x0b\x0c\r" and text[at] not in b" \t\n\x0b\x0c\r" and h < int(substrings.AT_WORD)
        if word or (text[at] & 0xC0) != 0x80 and h < int(substrings.IN_WORD) and k - blank >= substrings.LONG_WORD:
            forced = forced_to(text, out, last, at)
            last = forced
            if at - last >= substrings.MIN_CHUNK:
                out.append(at)
                last = at
    if text:
        last = forced_to(text, out, last, len(text))
        out.append(len(text))
    return out


def forced_to(text, out, last, at):
    while at - last > substrings.MAX_CHUNK:
        last += substrings.MAX_CHUNK
        while (text[last] & 0xC0) == 0x80:
            last -= 1
        out.append(last)
    return last


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(docs):
    """{(id, text): [(start, length)]} by walking over all chunks in order."""
    places = {}
    for i, text in set(docs):
        h = signed(42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42))
        key = i if i is not None else (h & ((1 << 62) - 1)) + (1 << 62)
        places[(key, h)] = (i, text)
    seen, out = set(), {}
    for place in sorted(places):
        data = (places[place][1] or "").encode()
        at, runs = plain_cuts(data), []
        for a, b in zip(at, at[1:]):
            piece = data[a:b]
            if piece in seen:
                if runs and sum(runs[-1]) == a:
                    runs[-1][1] += b - a
                else:
                    runs.append([a, b - a])
            seen.add(piece)
        out[places[place]] = [tuple(r) for r in runs if r[1] >= substrings.MIN_RUN]
    return out


def compare(spark, docs):
    frame = spark.createDataFrame([(i, t, 1, "s", "k", "x", 2) for i, t in docs], SCHEMA)
    wanted = plain(docs)
    found = substrings.repeated_passages(frame).collect()
    assert sorted((r.start, r.length) for r in found) == sorted(s for spans in wanted.values() for s in spans)
    kept = substrings.drop_passages(frame)
    assert kept.columns == frame.columns
    left = []
    for i, t in docs:
        text = substrings.without(t, [{"start": a, "length": n} for a, n in wanted[(i, t)]])
        if not wanted[(i, t)] or text.strip(" \t\n\x0b\x0c\r"):
            left.append((i, text))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(left, key=str)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = plain(docs)
    found = queries.op6_substrings(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in found) == sorted(
        (d[0], *s) for d, spans in wanted.items() for s in spans
    )
    assert all(r.first_doc_id <= r.doc_id for r in found)


def test_awkward_rows_and_clashing_columns(spark):
    rnd = random.Random(1)
    passage, other = words(rnd, 80), words(rnd, 60)
    docs = [
        (1, None), (2, ""), (3, " \n"), (4, passage), (5, f"{words(rnd, 9)} {passage} {words(rnd, 9)}"), (5, passage),
        (6, passage), (6, passage), (None, passage), (None, None), (7, f"{other} {other} {other}"), (8, "x" * 5000),
        (9, "x" * 5000), (10, "é" * 3000), (11, "word " * 30_000), (12, "中文字" * 900), (13, other[:100]),
    ]
    compare(spark, docs)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert substrings.repeated_passages(frame).collect() == [] and substrings.drop_passages(frame).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_fifty_words_are_caught_and_clean_documents_left(spark, seed):
    rnd = random.Random(seed)
    passages = [words(rnd, 52) for _ in range(20)]
    docs = [(i, f"{words(rnd, 40)} {passages[i % 20]} {words(rnd, 40)}") for i in range(60)]
    docs += [(100 + i, words(rnd, 150)) for i in range(60)]
    found = plain(docs)
    caught = [d for d in docs if found[d]]
    assert all(20 <= i < 60 for i, _ in caught) and len(caught) >= 39
    for i, text in caught:
        start = len(text.encode()[: text.find(passages[i % 20])])
        for a, n in found[(i, text)]:
            assert start - 1 <= a and a + n <= start + len(passages[i % 20]) + 1
    if not seed:
        compare(spark, docs)


@pytest.mark.parametrize("size", [0, 1, 5, 31, 32, 33, 700, 20_000])
def test_cuts_equal_the_plain_ones(size):
    rnd = random.Random(size)
    text = "".join(rnd.choice(["a", "b", " ", "\n", "é", "中", "word ", "q" * 90, "中" * 400]) for _ in range(size)).encode()
    assert substrings.cuts(text) == plain_cuts(text)
    parts = [text[a:b] for a, b in zip(substrings.cuts(text), substrings.cuts(text)[1:])]
    assert b"".join(parts) == text and all(len(p) <= substrings.MAX_CHUNK for p in parts)
    for part in parts:
        part.decode()


def test_an_insertion_moves_only_near_chunks():
    rnd = random.Random(9)
    text = words(rnd, 4000).encode()
    parts = lambda t: {t[a:b] for a, b in zip(substrings.cuts(t), substrings.cuts(t)[1:])}
    changed = text[:9000] + b"an insertion " + text[9000:]
    assert len(parts(changed) - parts(text)) <= 6


def test_gears_of_a_single_byte_run():
    data = np.zeros(64, np.uint8)
    assert len(set(substrings.gear_hashes(data)[31:].tolist())) == 1


def test_ordinary_words_are_never_cut():
    rnd = random.Random(4)
    text = words(rnd, 60_000).encode()
    assert all(a == 0 or text[a - 1 : a] == b" " for a in substrings.cuts(text)[:-1])
