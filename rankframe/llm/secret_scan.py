"""Secret scan by corpus-wide ownership: what looks like a credential is hashed,
and its hash counted by distinct repositories and owners. A value that several
owners hold, or that is spread over many repositories of one, is a copied
example; one that a single owner holds in few repositories, and that looks
random, looks live.

Base spans come from fixed patterns and always stay. Besides them, random-looking
tokens are candidates; those held by one owner only, in few repositories, are
added as spans of the kind ``key``.

Defined results: a null or empty text has no candidates; a null repository or
owner is one like any other; rows that repeat are judged alike and each has its
own row; a null id is carried along; texts of any length are read whole; an
empty table gives no rows; further columns are left alone.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled

# Fixed patterns of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates of the method: long tokens of letters and digits.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
LEAST_VALUE, LEAST_BITS, EXAMPLE_OWNERS = 6, 2.5, 3
# A single owner's value is live in so many repositories at most, and an example from so many on.
LIVE_REPOSITORIES, EXAMPLE_REPOSITORIES = 3, 10


def bits(value: str) -> float:
    """Entropy of the value's characters, in bits each."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and not overlapping within a kind."""
    out = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        out += [("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def key_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens that no base span touches."""
    out = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and bits(value) >= 3.5:
            if not any(a < m.end() and m.start() < b for _, a, b, _ in base):
                out.append(("key", *m.span(), value))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


CANDIDATE = "struct<kind:string,start:int,end:int,hash:binary,random:boolean>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        found = []
        for text in batch.column(3):
            text = text.as_py() or ""
            base = base_spans(text)
            found.append([
                {"kind": k, "start": a, "end": b, "hash": xxhash.xxh3_128_digest(v.encode()), "random": bits(v) >= LEAST_BITS}
                for k, a, b, v in base + key_spans(text, base)
            ])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(3)], pa.array(found, kind)], names=["id", "repository", "owner", "found"]
        )


def _live(mark: dict | None) -> bool:
    return mark is not None and mark["owners"] == 1 and mark["repositories"] <= LIVE_REPOSITORIES


def _example(mark: dict | None) -> bool:
    return mark is not None and (mark["owners"] >= EXAMPLE_OWNERS or mark["repositories"] >= EXAMPLE_REPOSITORIES)


def _verdict(found: pd.Series, live: pd.Series) -> pd.DataFrame:
    out = []
    for spans, marks in zip(found, live):
        marks = {} if marks is None else {bytes(m["hash"]): m for m in marks}
        spans = [(s["kind"], s["start"], s["end"], marks.get(bytes(s["hash"])), s["random"]) for s in (spans if spans is not None else [])]
        base = [s for s in spans if s[0] in KINDS]
        added = [s for s in spans if s[0] == "key" and _live(s[3])]
        every = sorted(base + added, key=lambda s: (s[1], (*KINDS, "key").index(s[0])))
        count = Counter(s[0] for s in base)
        out.append((
            *[count[k] for k in KINDS], sha256(joined(base).encode()).hexdigest(), joined(every),
            sum(_live(s[3]) and s[4] for s in every), sum(_example(s[3]) for s in every),
            *[[(s[3] or {}).get(c, 0) for s in every] for c in ("repositories", "owners")],
        ))
    return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "repositories", "owners"])


def ownership(found: DataFrame) -> DataFrame:
    """(repository, owner, hash) to one row per hash: distinct repositories and
    owners. Each grouping is reduced before its shuffle, and a hash that a third
    of all rows hold is spread by repository and owner first."""
    once = found.select("hash", "owner", "repository").distinct()
    per_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per document: its spans, how many of them look live (one owner,
    ``LIVE_REPOSITORIES`` at most) or copied (``EXAMPLE_OWNERS`` owners or
    ``EXAMPLE_REPOSITORIES`` repositories or more), and the distinct repositories
    and owners of each span's value, in the order of ``spans``."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(repository_col).alias("repository"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text")
    )
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "repository", "owner")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", found array<{CANDIDATE}>"
    found = settled(rows.mapInArrow(_scanned, schema), "candidates")
    each = found.where(F.size("found") > 0).select("id", "repository", "owner", F.explode("found").alias("c"))
    counts = settled(ownership(each.select("repository", "owner", F.col("c.hash").alias("hash"))), "owners")
    marks = each.select("id", F.col("c.hash").alias("hash")).distinct().join(counts, "hash")
    marks = marks.groupBy(F.col("id").alias("held_by")).agg(F.collect_list(F.struct("hash", "repositories", "owners")).alias("marks"))
    verdict = F.pandas_udf(
        _verdict,
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_example long, repositories array<long>, owners array<long>",
    )
    whole = found.join(marks, F.col("id").eqNullSafe(F.col("held_by")), "left").select("id", verdict("found", "marks").alias("v"))
    return whole.select(F.col("id").alias(id_col), "v.*")
