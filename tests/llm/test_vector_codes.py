import hashlib
import random

import numpy as np
import pytest

from echocite.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def plain(rows):
    """(vec_id, code, error, label_error, digest) in whole Python numbers, one distance after another."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 16
    parts = [[[int(np.floor(256 * float(np.float32(x)))) for x in r[1][p * size : p * size + size]] for p in range(16)] for r in kept]
    books = [[list(v[p]) for v in parts[:64]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(2):
        for p in range(16):
            own = {}
            for v in parts:
                own.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for e, held in own.items():
                books[p][e] = [sum(column) // len(held) for column in zip(*held)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for r, v in zip(kept, parts):
        best = [nearest(v[p], books[p]) for p in range(16)]
        coded.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]))
    return sorted(((i, c, e, sum(x[2] for x in coded if x[3] == y), digest) for i, c, e, y in coded), key=repr)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes.code_errors(frame).collect()), key=repr)


def vectors(seed, n, size, scale=1.0):
    rnd = random.Random(seed)
    return [(k, [rnd.choice([0.0, rnd.gauss(0, scale)]) for _ in range(size)], rnd.choice([None, 0, 1])) for k in range(n)]


@pytest.mark.parametrize("n,size,scale", [(1, 16, 1), (40, 32, 1), (200, 32, 0.02), (150, 64, 300.0)])
def test_equals_the_plain_version(spark, n, size, scale):
    rows = vectors(n, n, size, scale)
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = vectors(3, 90, 16)
    rows += [(None, [0.5] * 16, 1), (None, [0.25] * 16, None), (5, [0.1] * 16, 1), (5, [0.1] * 16, 1), (5, [0.2] * 16, 1)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] * 16, 1), (-1, [float("inf")] * 16, 0)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] == found(spark, [(1, None, None)])


def test_lengths_that_do_not_fit_are_an_error(spark):
    for rows in ([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [0.0] * 17, 1)]):
        with pytest.raises(ValueError):
            found(spark, rows)


@pytest.mark.parametrize("bits", [3, 20, 26, 29])
@pytest.mark.parametrize("size", [1, 4, 7])
def test_products_are_exact(bits, size):
    rnd = random.Random(bits * size)
    edge = [-(1 << bits), (1 << bits) - 1, 0, -1]
    draw = lambda n: [[rnd.choice([*edge, rnd.randrange(-(1 << bits), 1 << bits)]) for _ in range(size)] for _ in range(n)]
    x, c = draw(50), draw(20)
    wanted = [[sum(a * b for a, b in zip(u, v)) for v in c] for u in x]
    assert vector_codes.dot_products(np.array(x), np.array(c)).tolist() == wanted


def test_limbs_stay_below_the_mantissa():
    for terms in range(1, 300):
        bits = vector_codes.limb_bits(terms)
        assert terms * (1 << bits) ** 2 <= 1 << 53


def test_decoded_vectors_are_as_near_as_the_errors_say(spark):
    rows = vectors(8, 300, 32, 0.1)
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    books = vector_codes.train(frame)
    decoded = vector_codes.decode(vector_codes.encode(frame, books), books).collect()
    own = {r[0]: r[1] for r in rows}
    for r in decoded:
        whole = np.floor(256 * np.array(own[r["id"]], np.float32).astype(float))
        assert int(((whole - np.floor(256 * np.array(r["decoded"]))) ** 2).sum()) == r["error"]
