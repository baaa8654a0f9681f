"""Roman numbers of volumes and issues against a table of all of them, and words that look like them."""

import json

from pyspark.sql import functions as F

from echocite.operators.citation_strings import roman_number, roman_value, split_fields

DIGITS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n):
    out = ""
    for value, letters in DIGITS:
        while n >= value:
            out, n = out + letters, n - value
    return out


def test_every_number(spark):
    rows = [(n, roman(n), f"vol. {roman(n)}, no. {roman(n % 50 + 1)}(2001)") for n in range(1, 4000)]
    frame = spark.createDataFrame(rows, "n int, roman string, inputString string")
    assert frame.filter(roman_value(F.col("roman")) != F.col("n")).isEmpty()
    found = split_fields(frame).collect()
    assert all((json.loads(r.data)["volume"], json.loads(r.data)["issue"]) == (str(r.n), str(r.n % 50 + 1)) for r in found)
    kept = json.loads(split_fields(frame.filter("n = 4"), roman=False).first().data)
    assert "volume" not in kept


def test_words_and_impossible_numerals_stay(spark):
    texts = ["Mix and MIX of vol. mix", "vol. IIII", "vol. IVX", "vol. VItal", "vol. X2", "vol. MMMM", "MIX", "vol.", "no. ", "Vi. vol. é", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in frame.select(roman_number(F.col("t"), "vol.").alias("t")).collect()] == texts
    frame = spark.createDataFrame([("vol.XII", "vol. 12"), ("a vol.  IX/2, vol. X", "a vol. 9/2, vol. X")], "t string, w string")
    assert frame.filter(roman_number(F.col("t"), "vol.") != F.col("w")).isEmpty()
