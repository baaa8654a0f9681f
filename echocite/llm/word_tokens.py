"""Token ids of whole texts under a vocabulary of lower-case words with word ends, and back to text.

Frequent words come from a lexicon built of the corpus's own word counts; all other words are merged pair by pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echocite.llm.common import fresh, small_batches, strings
from echocite.llm.lexicon import Lexicon, build
from echocite.session import settle

VOCABULARY = "word_bpe_49k.json"
EXACT_COUNTS = 1000
LEXICON_WORDS = 60_000  # at most so many words, the most frequent ones, are compiled: a few MB
COUNTED = 300_000  # distinct words that a task counts before it hands its counts on
HELD_CHUNKS = 150_000  # chunks whose ids a worker remembers
HELD_LENGTH = 40

# Letters that the library's steps treat one by one: neither composed nor lower-cased with their neighbours.
_PLAIN = re.compile("[\t\n\r !-~¡-¬®-įĲ-ňŊ-ž]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # space to Python's split(), not to the library


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Merges:
    """Exact ids of one word: the pair of lowest rank is merged until no pair has a rank.

    A merge's result is numbered after all earlier ones, so a library that merges bytes by the rank of the result does
    the same; the word's end is a byte of its own, which merges with the letter before it first of all.
    """

    END = b"\0"  # stands for the end of a word, and so can't be in one

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(vocab[a + b] != 512 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError(f"{path}: ids are not in the order of merges")
        bytes_of = {letter: b for b, letter in byte_letters().items()}
        ranks = {}
        for text, number in vocab.items():
            letters = text.removesuffix(end)
            ranks[bytes(bytes_of[c] for c in letters) + (self.END if letters != text else b"")] = number
        self.merged = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        self.texts = {number: text for text, number in vocab.items()}

    def ids(self, word: bytes) -> list[int]:
        return self.merged._encode_single_piece(word + self.END)


class _Chunks(dict):
    """(ids, decoded text) of a text without white space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        found = self.encode(chunk)
        if len(self) < HELD_CHUNKS and len(chunk) <= HELD_LENGTH:
            self[chunk] = found
        return found


class WordTokens:
    """Encoding and decoding with a lexicon file (None: every word is merged)."""

    def __init__(self, path: str, lexicon: str | None = None):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merges = Merges(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.chunks = _Chunks(self._of_chunk)

    def _of_chunk(self, chunk: str) -> tuple[bytes, str]:
        if not _PLAIN.fullmatch(chunk):
            return self._by_library(chunk)
        ids: list[int] = []
        for word in _WORD.findall(chunk.lower()):
            data = word.encode()
            found = self.lexicon.get(data) if self.lexicon else None
            ids.extend(self.merges.ids(data) if found is None else found)
        return np.array(ids, "<u4").tobytes(), " ".join([self.merges.texts[i] for i in ids])

    def _by_library(self, text: str) -> tuple[bytes, str]:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.library.decode(ids, skip_special_tokens=False)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
        if any(s in text for s in self.special) or _ODD_SPACE.search(text):
            return self._by_library(text)
        held = self.chunks
        found = [held[c] for c in text.split()]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])


@functools.cache
def word_tokens(path: str | None = None, lexicon: str | None = None) -> WordTokens:
    """Loaded once for each Python worker; `lexicon` is the name of a file that Spark has sent."""
    return WordTokens(path or public_tokenizers.path(VOCABULARY), lexicon and SparkFiles.get(lexicon))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def handed() -> pa.RecordBatch:
        words: Counter = Counter()
        for chunk, n in counts.items():
            if _PLAIN.fullmatch(chunk):
                for word in _WORD.findall(chunk.lower()):
                    words[word] += n
        held = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(held, ["word", "n"])

    for batch in batches:
        for text in strings(batch.column(0)):
            counts.update(text.split())
            if len(counts) > COUNTED:
                yield handed()
                counts.clear()
    if counts:
        yield handed()


def frequent_words(counts: DataFrame, words: int) -> DataFrame:
    """The rows of (word, n) with the greatest counts, at most `words` of them, equal counts all or none."""
    step = F.when(F.col("n") <= EXACT_COUNTS, F.col("n"))  # counts above are told apart by their size to a hundredth
    step = step.otherwise(EXACT_COUNTS + F.floor(100 * F.log(F.col("n") / float(EXACT_COUNTS))))
    steps = counts.groupBy(step.cast("long").alias("step")).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
    least, total = None, 0
    for r in steps.orderBy(F.desc("step")).collect():  # a row for each step, a few thousand at most
        total += r["held"]
        if total > words:
            break
        least = r["n"]
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least)


def send_lexicon(docs: DataFrame, path: str | None, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the corpus's most frequent words, send the file to all executors, and return its name.

    All texts are counted. The driver sees at most `words` words, once: those with at least the least count that no more
    words have, which a histogram of counts tells before. Executors that join later fetch the file as well; it lies below
    the driver's folder for files that Spark sends, which is not shared and need not be.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    counted = docs.select(text_col).mapInArrow(_count_words, "word string, n long")
    counts = counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    frequent = frequent_words(settle(counts, "word-counts"), words)
    merges = Merges(path or public_tokenizers.path(VOCABULARY))
    data = build({w: merges.ids(w) for w in (r["word"].encode() for r in frequent.select("word").collect())})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    # Below the folder that Spark itself keeps for files to be sent and removes at its end.
    folder = os.path.join(SparkFiles.getRootDirectory(), "lexicons")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as file:
        file.write(data)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def _encode(path: str | None, lexicon: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sha = word_tokens(path, lexicon), hashlib.sha256
        for batch in batches:
            rows = []
            for text in strings(batch.column(1)):
                ids, decoded = tokens.encode(text)
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(decoded.encode()).hexdigest()))
            n_tokens, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            held = [pa.array(n_tokens, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *held], names)

    return run


def encode_digests(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a missing text is empty. `path` names the
    vocabulary. Repeated rows give repeated results, an empty table an empty one."""
    small_batches(docs.sparkSession)
    lexicon = send_lexicon(docs, path, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(_encode(path, lexicon), kind)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with a column token_ids (or, if there is one, _token_ids): the ids of each whole text."""
    small_batches(docs.sparkSession)
    lexicon = send_lexicon(docs, path, text_col)

    @F.pandas_udf("array<int>")
    def ids(texts):
        tokens = word_tokens(path, lexicon)
        return texts.map(lambda t: np.frombuffer(tokens.encode(t or "")[0], "<i4"))

    return docs.withColumn(fresh(docs, "token_ids"), ids(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str, path: str | None = None) -> DataFrame:
    """`docs` with a column decoded (or _decoded): the texts that `ids_col` stands for."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(column):
        library = word_tokens(path).library
        return column.map(lambda x: "" if x is None else library.decode(list(x), skip_special_tokens=False))

    return docs.withColumn(fresh(docs, "decoded"), texts(F.col(ids_col)))
