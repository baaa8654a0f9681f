"""The pipeline's stages one after another, and its whole result against plain Python stages."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from echocite.llm import toxicity
from tests.llm import test_simhash, test_single_lines, test_substrings
from tests.llm.test_classifiers import plain_segments

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (None, None), (4, "one two three four five " * 400)]
BLANKS = " \t\n\x0b\x0c\r"


def test_stages_hand_on_the_columns(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k", "p") for i, t in AWKWARD], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        stage(spark, docs, sf_dir).collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "simhash", "substrings", "packing"]


def toxic(model, text):
    """The score's definition, with segments by a plain search."""
    words = text.lower().split()
    scores = []
    for word in words:
        core = toxicity._EDGES.sub("", word)
        scores.append(next((model.scores[t] for t in toxicity.tokens_of(core) if t in model.scores), -toxicity.DRIFT))
    places = [k for k, s in enumerate(scores) if s > 0]
    near = scores[places[0] : places[-1] + 1] if places else []
    evidence = sum(np.logaddexp(0, model.rate * s - model.log_k - np.log(max(len(words), 1))) for *_, s in plain_segments(near))
    a, b = model.curve
    return 1 / (1 + np.exp(-(a * np.log1p(evidence) + b))) >= 0.5


def plain_run(docs, model):
    """{doc_id: text} that packing gets, by direct comparison of all lines, fingerprints and passages."""
    kept = {i: t for i, t in docs.items() if not toxic(model, t)}
    cut = test_single_lines.brute(list(kept.items()))
    kept = {i: t for i, t in cut.items() if t == kept[i] or t.strip(BLANKS)}
    first = {i: component for i, _, component in test_simhash.plain_groups(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if first[i] == i}
    spans = test_substrings.plain(list(kept.items()))
    out = {}
    for i, text in kept.items():
        data, own = bytearray(text.encode()), spans[(i, text)]
        for a, n in reversed(own):
            del data[a : a + n]
        if not own or data.decode().strip(BLANKS):
            out[i] = data.decode()
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    """Documents of the given tables with planted copies, lines and passages, so that every stage has work."""
    rnd = random.Random(1)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 6000 and doc_id < 400")
    rows = {r.doc_id: r.text for r in given.collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    passage = test_substrings.words(rnd, 70)
    for k in range(12):
        base = rows[rnd.choice(sorted(i for i in rows if i < 400))]
        rows[1000 + 4 * k] = base + " and one more"
        rows[1001 + 4 * k] = f"{test_substrings.words(rnd, 30)} {passage} {test_substrings.words(rnd, 30)}"
        rows[1002 + 4 * k] = "a line that very many of these documents share, word by word\n" + test_substrings.words(rnd, 40)
        rows[1003 + 4 * k] = base
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], DOCUMENTS)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(docs, labels)
    wanted = plain_run(rows, model)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in wanted.items()}
    assert {r.doc_id for r in found} == ids.keys()
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        assert r.doc_tokens == len(ids[r.doc_id])
    for i, own in pieces.items():
        at = 0
        for start, length, crc in sorted(own):
            assert start == at and zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids[i])
    gone = rows.keys() - wanted.keys()
    assert any(toxic(model, rows[i]) for i in gone) and any(i >= 1000 for i in gone)
    assert docs.filter(F.col("doc_id").isin(*gone)).count() == len(gone)
