"""Best-fit packing by hierarchical residual packing.

Documents are tokenised and only those longer than a sequence are cut. Each
task best-fits its pieces, longest first, and emits the bins that are nearly
full; the underfull ones are items of the next round, where fewer tasks
best-fit them together, up the tree until one task is left. A task passes on
no more bins than its share of one task of the next round, the emptiest first
(two bins over half full never merge), and emits the rest as they are, so no
task of any round holds more than ``per_task`` items.

Defined results: a null or empty text is the end token alone; a text of any
length is tokenised whole; rows that repeat an id are packed as often as they
come; a null id is carried along; an empty table gives no rows; further columns
are left alone.
"""

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled
from rankframe.llm.wording import WordTable

CAPACITY, END, NEARLY_FULL, PER_TASK, FAN = 4096, 1, 0.995, 50_000, 8
# Bytes of words a worker remembers the ids of, and words it looks up at once.
ROOM, AT_ONCE = 96 << 20, 100_000
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\x20\x09-\x0d]+")
_MARKS = "".join(c for c in map(chr, range(256)) if not c.isalnum() and not c.isspace())


class _Words(WordTable):
    """The packed ids of a word, worked out once. The tokenizer drops white space
    and no token crosses it, nor the step from a letter to a mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(ROOM)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _keep(self, word: str, packed: bytes) -> bytes:
        return self.keep(word, packed, len(packed))

    def __missing__(self, word: str) -> bytes:
        if (known := self.older.get(word)) is not None:
            return self._keep(word, known)
        core = word.rstrip(_MARKS)
        if core != word and core.isalpha() and _latin(word):
            return self._keep(word, self[core] + self[word[len(core) :]])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return self._keep(word, b"".join(i.to_bytes(4, "little") for i in ids))

    def _unknown(self, words: set[str]) -> list[str]:
        # Each word is looked up: a difference of sets walks the whole table.
        return [w for w in words if w not in self and w not in self.older]

    def learn(self, words: set[str]) -> None:
        """Encode what is unknown, many plain words in one call: each ends with a
        token that only ends words."""
        cores = {w.rstrip(_MARKS) for w in self._unknown(words)}
        plain = [w for w in self._unknown(cores) if w.isalpha() and len(w) <= 64 and _latin(w)]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            packed = np.array(ids, "<u4")
            bounds = [0, *(4 * (np.flatnonzero(self.ends[packed]) + 1)).tolist()]
            if len(bounds) == len(some) + 1:
                whole = packed.tobytes()
                for word, start, end in zip(some, bounds, bounds[1:]):
                    self._keep(word, whole[start:end])


def _latin(text: str) -> bool:
    """Only characters that lower-casing and composing treat one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


def _split(text: str | None) -> list[str]:
    if not text:
        return []
    if "<|" not in text and _latin(text):
        text = text.lower()
    # Python also splits at these; the tokenizer does not.
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


def token_bytes(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    known = _words(path)
    held, fresh, n = [], set(), 0
    for text in texts:
        words = _split(text)
        held.append(words)
        fresh.update(words)
        n += len(words)
        if n >= AT_ONCE:
            known.learn(fresh)
            for some in held:
                yield b"".join(map(known.__getitem__, some))
            held, fresh, n = [], set(), 0
    known.learn(fresh)
    for some in held:
        yield b"".join(map(known.__getitem__, some))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32: one row per piece of a document."""
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, lengths, sums = [], [], [], [], []
            texts = (text.as_py() for text in batch.column(1))
            for key, tokens in zip(batch.column(0).to_pylist(), token_bytes(texts, tokenizer)):
                packed = memoryview(tokens + last)
                for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[at : at + 4 * capacity]
                    ids.append(key)
                    numbers.append(n)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the given order: bins as lists of places in ``lengths``."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with room r is open
    bins: list[list[int]] = []
    for item, length in enumerate(lengths):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - length
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins


def _round(level: int, capacity: int, nearly_full: int, pass_on: int, kind: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, members = [], []
        for batch in batches:
            lengths += batch.column("length").to_pylist()
            members += batch.column("members").to_pylist()
        bins = best_fit(lengths, capacity)
        filled = [sum(lengths[i] for i in b) for b in bins]
        under = sorted((f, b) for b, f in enumerate(filled) if f < nearly_full)
        passed = {b for _, b in under[:pass_on]}
        base = (level << 56) | (TaskContext.get().partitionId() << 28)
        for at in range(0, len(bins), 2000):
            some = range(at, min(at + 2000, len(bins)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([filled[b] for b in some], pa.int64()),
                    pa.array([[m for i in bins[b] for m in members[i]] for b in some], kind),
                    pa.array([base | b for b in some], pa.int64()),
                    pa.array([b in passed for b in some]),
                ],
                names=["length", "members", "sequence_id", "underfull"],
            )

    return pack


def packed(
    items: DataFrame,
    capacity: int = CAPACITY,
    nearly_full: float = NEARLY_FULL,
    per_task: int = PER_TASK,
    fan: int = FAN,
) -> DataFrame:
    """Items with a ``length`` of 1 to ``capacity`` and any other columns, each
    with its ``sequence_id`` and ``offset``."""
    from pyspark.sql.pandas.types import to_arrow_type

    items = settled(items, "pieces")
    names = items.columns
    item = F.struct(*[F.col(f"`{c}`") for c in names])
    # A full piece is a sequence of its own, and takes part in no round.
    bins = items.select("length", F.array(item).alias("members"))
    schema = "length long, members {}, sequence_id long, underfull boolean".format(bins.schema["members"].dataType.simpleString())
    kind = to_arrow_type(bins.schema["members"].dataType)
    tasks = max(1, math.ceil(items.count() / per_task))
    done, level = [], 0
    while True:
        last = tasks == 1
        after = math.ceil(tasks / fan)
        pass_on = 0 if last else max(1, per_task * after // tasks)
        # Sorted to the last column, so a task that is done again does the same.
        dealt = bins.repartition(tasks).sortWithinPartitions(F.col("length").desc(), "members")
        made = dealt.mapInArrow(_round(level, capacity, math.ceil(nearly_full * capacity), pass_on, kind), schema)
        made = settled(made, f"round{level}")
        done.append(made.where("NOT underfull"))
        if last:
            break
        bins, tasks, level = made.where("underfull").select("length", "members"), after, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    rows = out.select("sequence_id", F.posexplode("members").alias("__at", "__item"), "members")
    before = F.aggregate(F.slice("members", F.lit(1), F.col("__at")), F.lit(0).cast("long"), lambda a, m: a + m["length"])
    return rows.select("__item.*", "sequence_id", before.alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, **how) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place."""
    return packed(pieces(docs, tokenizer, id_col, text_col, capacity, end), capacity, **how)
