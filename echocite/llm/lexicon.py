"""A lexicon of frequent words as a minimal acyclic transducer from letters to token ids, in one memory-mapped file.

Words that share an ending share its states. Each arc carries the number of words that come before it, so the sum
along a word's path is the word's number, and its ids are the output at that number.
"""

from __future__ import annotations

import mmap
import struct

MAGIC = b"LEX1"


def build(words: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for words (UTF-8) and their ids. The words are added in sorted order, and a state that no
    later word can change is replaced by an equal one made before, which keeps the automaton minimal throughout."""
    finals: list[bool] = [False]
    arcs: list[dict[int, int]] = [{}]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, letter, next) of the last word, not yet replaced

    def settle_to(depth: int) -> None:
        while len(path) > depth:
            state, letter, last = path.pop()
            shape = (finals[last], tuple(sorted(arcs[last].items())))
            arcs[state][letter] = known.setdefault(shape, last)

    before = b""
    for word in sorted(words):
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle_to(shared)
        state = path[-1][2] if path else 0
        for letter in word[shared:]:
            finals.append(False)
            arcs.append({})
            arcs[state][letter] = len(arcs) - 1
            path.append((state, letter, len(arcs) - 1))
            state = len(arcs) - 1
        finals[state] = True
        before = word
    settle_to(0)

    numbers, order = {}, []  # states in an order in which targets come before sources
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            numbers[state] = len(order)
            order.append(state)
        elif state not in numbers:
            numbers[state] = -1
            stack.append((state, True))
            stack.extend((t, False) for t in arcs[state].values() if t not in numbers)
    below: dict[int, int] = {}
    first, letters, targets, skips = [0], bytearray(), [], []
    for state in order:
        count = int(finals[state])
        for letter, target in sorted(arcs[state].items()):
            letters.append(letter)
            targets.append(numbers[target])
            skips.append(count)
            count += below[target]
        below[state] = count
        first.append(len(letters))
    outputs, at = [0], []
    for word in sorted(words):
        at.extend(words[word])
        outputs.append(len(at))
    letters.extend(bytes(-len(letters) % 4))
    head = struct.pack("<4s4I", MAGIC, len(order), len(targets), len(words), len(at))
    final = bytes(finals[s] for s in order)
    final += bytes(-len(final) % 4)
    numbers_of = [first, targets, skips, outputs, at]
    return head + b"".join(struct.pack(f"<{len(x)}I", *x) for x in numbers_of) + bytes(letters) + final


class Lexicon:
    """Word lookups in a lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, words, ids = struct.unpack_from("<4s4I", self.map)
        if magic != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view, at = memoryview(self.map), 20
        parts = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.skips, self.outputs, self.ids = parts
        self.letters, self.finals, self.root = at, at + arcs + -arcs % 4, states - 1

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        find, start, first = self.map.find, self.letters, self.first
        state, number = self.root, 0
        for k in range(len(word)):
            arc = find(word[k : k + 1], start + first[state], start + first[state + 1])
            if arc < 0:
                return None
            arc -= start
            number += self.skips[arc]
            state = self.targets[arc]
        if not self.map[self.finals + state]:
            return None
        return self.ids[self.outputs[number] : self.outputs[number + 1]].tolist()
