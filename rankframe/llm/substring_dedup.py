"""Repeated passages by line hashing: units are normalised, their digests are
grouped over all documents, the earliest ranked occurrence stays, the others go.

A unit is a line, or a sentence of a line of several; a sentence of more than
``LONG`` words is cut at its commas, colons and semicolons, so that a passage put
in the middle of a sentence still has units of its own; what is longer still is
cut after words chosen by their own and their neighbours' hashes, at least
``LEAST_UNIT`` words from either end. In scripts without spaces each character
is a word of half the size. Words count in lower case, in compatibility form and without punctuation around them. Every line of
``SHORT_LINE`` words or more is also a unit as a whole, beside its sentences,
and a line that was there before is removed whatever its length. Within a line,
sentences of fewer than ``LEAST_UNIT`` words are not looked up; between two
repeated units they go with them. Neighbouring repeated units make a run, and a
run is removed where it has ``least_words`` words, or consists of whole lines of
``least_line`` words. What was removed, and what stays, is given in the
original's code points.

Defined results: occurrences rank by id, then by their place; a null id ranks
first and loses nothing; rows that repeat an id lose what any of them loses at
that place, and rows that repeat text and id count as one; a null text has no
units and stays null; texts of any length are read whole; an empty table gives
no rows; further columns are left alone.
"""

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled
from rankframe.llm.wording import ODD_SPACE, WordTable, mixed_bits

# Sizes are in words; a word has ``HALVES``, a character of a script without spaces one.
HALVES = 2
LONG, LEAST_UNIT, LEAST_WORDS, LEAST_LINE, SHORT_LINE = 16, 4, 10, 5, 2
_WORD = re.compile("[^\x20\x09-\x0d]+")
# Scripts without spaces: South-East Asian, Tibetan, Chinese and Japanese.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_WORD = re.compile(rf"[{_DENSE}][^\w{_DENSE}\x20\x09-\x0d\u3000]*|[^{_DENSE}\x20\x09-\x0d\u3000]+")
_LIGHT = re.compile(f"[{_DENSE}\u3000-\u303f]")
_NOBODY = object()
_STEP, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(3 * 0x9E3779B97F4A7C15 % (1 << 64))
# What a word ends: nothing, a clause or a sentence.
_ENDS = dict.fromkeys(",;:،؛、，；：､፣፤፥၊᠂", 1) | dict.fromkeys(".!?…。．！？｡؟۔।॥።፧։׃။។៕།༎᠃", 2)
REMOVED = "array<struct<start:int,end:int,first_id:{},n_words:int>>"


def _inner(c: str) -> bool:
    """Letters, digits, and the marks that many scripts write vowels with."""
    return c.isalnum() or (unicodedata.category(c)[0] == "M" and not "\ufe00" <= c <= "\ufe0f")


def _plain(word: str) -> str:
    word = unicodedata.normalize("NFKC", word).lower()
    a, b = 0, len(word)
    while a < b and not _inner(word[a]):
        a += 1
    while a < b and not _inner(word[b - 1]):
        b -= 1
    return word[a:b]


class _Known(WordTable):
    """A word's hash in normal form, with what it ends in the two lowest bits and its size in the next two."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if (known := self.older.get(word)) is not None:
            return self.keep(word, known)
        plain = _plain(word)
        value = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) & ~15
        value |= _ENDS.get(word.rstrip("\"'»”’)]」』）】》〉］")[-1:], 0)
        value |= (1 if _LIGHT.match(word) else HALVES) << 2
        return self.keep(word, value)


_KNOWN = _Known(96 << 20)


def _words_by(text: str) -> re.Pattern:
    return _DENSE_WORD if not text.isascii() and _HAS_DENSE.search(text) else _WORD


def _worded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The marks of all words, and the words before the end of each line."""
    cut = str.split if (pattern := _words_by(text)) is _WORD and not ODD_SPACE.search(text) else pattern.findall
    lines = [cut(x) for x in text.split("\n")]
    counts = np.cumsum([len(x) for x in lines])
    words = [w for x in lines for w in x]
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words)), counts


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in code points."""
    if (pattern := _words_by(text)) is not _WORD:
        spans = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]
    plain = text.isascii()
    codes = np.frombuffer(text.encode() if plain else text.encode("utf-32-le", "surrogatepass"), np.uint8 if plain else np.uint32)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _nowhere() -> Spans:
    return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2


def _digested(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Spans:
    """Start and end (in words) of some spans, and two 64-bit digests of each."""
    if not len(starts):
        return _nowhere()
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(first, sizes)
    plain = mixed_bits((marks[np.repeat(starts, sizes) + inside] >> np.uint64(4)) + inside.astype(np.uint64) * _STEP)
    one = mixed_bits(np.add.reduceat(plain, first))
    two = mixed_bits(np.add.reduceat(mixed_bits(plain ^ _STEP), first))
    return starts, ends, one, two


def _chosen(marks: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether a word's hash, taken with the two words before it, is the least within
    ``LEAST_UNIT`` words around. The cuts depend on these words alone, lie at least so
    far apart, and so far (sizes ``before`` and ``after``) from the ends of their stretch."""
    words = marks >> np.uint64(4)
    sizes = (marks >> np.uint64(2)) & np.uint64(3)
    value = words.copy()
    for d, step in ((1, _STEP), (2, _FAR)):
        value[d:] += mixed_bits(words[:-d] + step)
    value = mixed_bits(value)
    ok = (before >= LEAST_UNIT * HALVES) & (after >= LEAST_UNIT * HALVES)
    light = sizes < HALVES
    for d in range(1, LEAST_UNIT * HALVES + 1 if light.any() else LEAST_UNIT + 1):
        # Beyond ``LEAST_UNIT`` places only characters are compared.
        held = np.ones(len(marks), bool) if d <= LEAST_UNIT else light
        ok[:-d] &= ~held[:-d] | (value[:-d] < value[d:])
        ok[d:] &= ~held[d:] | (value[d:] <= value[:-d])
    return ok


Bounds = tuple[np.ndarray, np.ndarray]


def _cut_up(text: str | None) -> tuple[np.ndarray, Bounds, Bounds, np.ndarray]:
    """The marks of a text's words, start and end of its units and of its lines, and
    the size of all words before each word, in halves."""
    nothing = np.empty(0, np.uint64), _nowhere()[:2], _nowhere()[:2], np.zeros(1, np.int64)
    if not text:
        return nothing
    marks, line_ends = _worded(text)
    if not len(marks):
        return nothing
    size = np.concatenate([[0], np.cumsum(((marks >> np.uint64(2)) & np.uint64(3)).astype(np.int64))])
    line_ends = np.unique(line_ends[line_ends > 0])
    kind = (marks & np.uint64(3)).astype(np.int8)
    kind[line_ends - 1] = 2
    ends = np.flatnonzero(kind == 2) + 1
    starts = np.concatenate([[0], ends[:-1]])
    # Cut the long sentences at the clauses inside them.
    long = np.repeat(size[ends] - size[starts] > LONG * HALVES, ends - starts)
    cut = (kind == 2) | ((kind == 1) & long)
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])
    # What is still long is cut by its content.
    still = size[ends] - size[starts] > LONG * HALVES
    if still.any():
        at = np.flatnonzero(np.repeat(still, ends - starts))
        lengths = (ends - starts)[still]
        before = size[at + 1] - np.repeat(size[starts[still]], lengths)
        after = np.repeat(size[ends[still]], lengths) - size[at + 1]
        cut[at[_chosen(marks[at], before, after)]] = True
        ends = np.flatnonzero(cut) + 1
    return marks, (np.concatenate([[0], ends[:-1]]), ends), (np.concatenate([[0], line_ends[:-1]]), line_ends), size


def units(text: str | None) -> Spans:
    """Start and end (in words) of each unit, and its two 64-bit digests."""
    marks, found, _, _ = _cut_up(text)
    return _digested(marks, *found)


def _looked_up(text: str | None) -> list[np.ndarray]:
    """Units and whole lines whose digests are compared, each span once."""
    marks, found, lines, size = _cut_up(text)
    keep = size[found[1]] - size[found[0]] >= LEAST_UNIT * HALVES
    # A line of one unit is that unit.
    at = np.searchsorted(found[0], lines[0])
    known = (found[1][at] == lines[1]) & keep[at] if len(at) else np.empty(0, bool)
    more = (size[lines[1]] - size[lines[0]] >= SHORT_LINE * HALVES) & ~known
    return list(_digested(marks, *[np.concatenate([x[keep], y[more]]) for x, y in zip(found, lines)]))


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, parts, held = [], [], 0
        for i, text in enumerate(batch.column(1)):
            parts.append(_looked_up(text.as_py()))
            which.append(np.full(len(parts[-1][0]), i))
            held += len(which[-1])
            if held > 50_000 or i == len(batch) - 1:
                at, to, one, two = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(which))),
                        pa.array(at, pa.int32()),
                        pa.array(to, pa.int32()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                    ],
                    names=["id", "at", "to", "one", "two"],
                )
                which, parts, held = [], [], 0


def _runs(text: str, repeated: dict[tuple[int, int], object], least_words: int, least_line: int) -> list[tuple]:
    """Removed spans of a text; ``repeated`` has its repeated units and lines, and who keeps each."""
    _, found, lines, size = _cut_up(text)
    size = size.tolist()
    begins, ceases = _places(text)
    out, run = [], []
    line_end = dict(zip(lines[0].tolist(), lines[1].tolist()))

    def removed(part: list[tuple]) -> tuple:
        a, b = part[0][0], part[-1][1]
        return int(begins[a]), int(ceases[b - 1]), part[0][2], -((size[a] - size[b]) // HALVES)

    def close() -> None:
        while run and run[-1][2] is _NOBODY:
            run.pop()  # a short unit goes only between repeated ones
        if not run:
            return
        start, end, _, n = whole = removed(run)
        line = not text[text.rfind("\n", 0, start) + 1 : start].strip() and not text[end:].split("\n", 1)[0].strip()
        if n >= least_words or (line and n >= least_line):
            out.append(whole)
            return
        # Whole lines go without what is beside them.
        for is_line, part in groupby(run, key=lambda x: x[3]):
            if is_line:
                out.append(removed(list(part)))

    upto = 0
    for a, b in zip(found[0].tolist(), found[1].tolist()):
        if a < upto:
            continue  # within a repeated line
        end = line_end.get(a, a)
        if size[end] - size[a] >= SHORT_LINE * HALVES and (a, end) in repeated:
            run.append((a, end, repeated[a, end], True))
            upto = end
        elif (a, b) in repeated:
            run.append((a, b, repeated[a, b], False))
        elif run and size[b] - size[a] < LEAST_UNIT * HALVES:
            run.append((a, b, _NOBODY, False))
        else:
            close()
            run = []
    close()
    return out


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_line: int = LEAST_LINE,
) -> DataFrame:
    """One row per document: id, the ``text`` that stays, ``removed`` spans (with
    the id of the document that keeps the run's first unit), ``kept`` spans and ``n_removed`` words."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = settled(texts.mapInArrow(_unit_rows, f"id {kind}, at int, to int, one long, two long"), "units")
    place = F.struct(F.col("id"), F.col("at"))
    many = rows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    many = settled(many.where("NOT first <=> last").select("one", "two", "first"), "repeated")
    later = rows.join(many, ["one", "two"]).where(~F.col("first").eqNullSafe(place) & F.col("id").isNotNull())
    found = later.groupBy("id").agg(F.collect_set(F.struct("at", "to", F.col("first.id").alias("by"))).alias("u"))
    # Plain arrays side by side are light to hand over.
    found = settled(found.select("id", *[F.col(f"u.{f}").alias(f) for f in ("at", "to", "by")]), "found")
    joined = texts.join(found, "id", "left").select("id", "text", "at", "to", "by")
    schema = f"`{id_col}` {kind}, text string, removed {REMOVED.format(kind)}, kept array<struct<start:int,end:int>>, n_removed int"
    return joined.mapInArrow(_cut(id_col, least_words, least_line), schema)


def _cut(id_col: str, least_words: int, least_line: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.schema.field(0).type
            numbers = [("start", pa.int32()), ("end", pa.int32())]
            removed = pa.list_(pa.struct([*numbers, ("first_id", own), ("n_words", pa.int32())]))
            left, gone, kept, count = [], [], [], []
            for i in range(len(batch)):
                text, at = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                runs = []
                if text and at:
                    units_ = zip(at, batch.column(3)[i].as_py())
                    runs = _runs(text, dict(zip(units_, batch.column(4)[i].as_py())), least_words, least_line)
                edges = [0, *[x for run in runs for x in run[:2]], len(text or "")]
                spans = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                left.append(text if not runs else "".join(text[a:b] for a, b in spans))
                gone.append([dict(zip(("start", "end", "first_id", "n_words"), run)) for run in runs])
                kept.append([{"start": a, "end": b} for a, b in spans])
                count.append(sum(run[3] for run in runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.string()), pa.array(gone, removed), pa.array(kept, pa.list_(pa.struct(numbers))), pa.array(count, pa.int32())],
                names=[id_col, "text", "removed", "kept", "n_removed"],
            )

    return cut
