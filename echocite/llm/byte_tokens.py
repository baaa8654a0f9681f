"""Token ids of whole texts under a byte-level vocabulary, with a bounded memory of chunks seen before."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
HELD_CHUNKS = 250_000  # chunks whose ids a worker remembers
HELD_LENGTH = 40


class _Irregular(Exception):
    """A chunk whose ids depend on the white space around it."""


class _Chunks(dict):
    """Ids (little-endian unsigned 32-bit) of a chunk between single spaces, the space before it included."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Irregular
        ids = self.encode(" " + chunk)
        if len(self) < HELD_CHUNKS and len(chunk) <= HELD_LENGTH:
            self[chunk] = ids
        return ids


class ByteTokens:
    """Ids of texts as the tokenizers library gives them without adding special tokens.

    A space before anything but white space always starts a new piece, so where each space stands alone a text's ids
    are those of its chunks one after another. Other texts are encoded whole by the rank file of the same vocabulary,
    and texts that hold a special token's string by the library itself.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.ranks = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.chunks = _Chunks(self._of_piece)

    def _of_piece(self, text: str) -> bytes:
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            held = self.chunks
            return b"".join([self._of_piece(first), *[held[c] for c in rest]])
        except _Irregular:
            return self._of_piece(text)


@functools.cache
def byte_tokens(path: str | None = None) -> ByteTokens:
    """The vocabulary, loaded once for each Python worker."""
    return ByteTokens(path or public_tokenizers.path(VOCABULARY))
