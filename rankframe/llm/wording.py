"""Words as numbers, for the operators that work inside tasks."""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Python also splits at these; a word is a run of anything but ASCII white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile("[\x20\x09-\x0d]+")
# What a table of words may take, and what an entry takes beside its word.
ROOM, ENTRY = 64 << 20, 180


class WordTable(dict):
    """Values of words, worked out once, in two halves of ``room`` bytes together:
    when the newer half is full it becomes the older one, from which a word is to
    be taken back as it is met. Words of over 64 characters are not kept."""

    def __init__(self, room: int = ROOM):
        self.room, self.held, self.older = room, 0, {}

    def keep(self, word, value, size: int = 0):
        if len(word) <= 64:
            self.held += len(word) + size + ENTRY
            if self.held > self.room // 2:
                self.older = dict(self)
                self.clear()
                self.held = len(word) + size + ENTRY
            self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.held, self.older = 0, {}


class _Hashes(WordTable):
    def __missing__(self, word: str) -> int:
        value = self.older.get(word)
        return self.keep(word, xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) if value is None else value)


_HASHES = _Hashes()
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy() -> None:
    """Give back what a worker, which lives on, holds between partitions."""
    _HASHES.forget()
    pa.default_memory_pool().release_unused()


def tidied(work: Work) -> Work:
    """The same work, tidied up after at the end of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            tidy()

    return run


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if ODD_SPACE.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input touches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
