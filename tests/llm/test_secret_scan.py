import hashlib
import random
import re

from rankframe.llm import secret_scan as S

from . import cases

WORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = [
    ("assign", WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
]


def brute(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p, n, g) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))
    return *(sum(o[2] == k for o in out) for k, *_ in BASE), hashlib.sha256(spans.encode()).hexdigest(), spans


def base(r):
    return r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("key:"))


def test_base_as_brute_force(spark):
    r = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "😀", "ſecret", "K", "\n", "/", "."]
    texts = [None, "", "password: token = abcdefgh", "secret=token=abcdef"] + ["".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(2000)]
    frame = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for row in S.scanned(frame).collect():
        assert base(row) == brute(texts[row.doc_id]), texts[row.doc_id]


def test_owners_tell_copied_from_live(spark):
    live, copied = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "0123456789abcdef0123456789abcdef"
    key = "Zk3vQ9xT7mB2nL5pR8sW1yC4"
    records = [(i, f"example {copied} end", f"s{i % 5}") for i in range(50)] + [(100, f"mine {live} and {key}.", "s1"), (101, f"{live}", "s1"), (102, f"{key}1 shared", "a"), (103, f"{key}1 shared", "b")]
    rows = {r.doc_id: r for r in S.scanned(spark.createDataFrame(records, "doc_id long, text string, source string")).collect()}
    assert (rows[0].n_live, rows[0].n_example) == (0, 1) and (rows[101].n_live, rows[101].n_example) == (1, 0)
    assert rows[100].spans == "hex:5:37,key:42:66" and rows[100].n_live == 2
    assert rows[102].spans == ""  # two owners: neither an example nor added


def test_copies_within_one_owner_are_examples(spark):
    key, pair, some = "Zk3vQ9xT7mB2nL5pR8sW1yC4", "Hq8wE2rT6yU1iO5pA9sD3fG7", "Jx4cV8bN2mQ6wE1rT5yU9iO3"
    records = [(i, f"copied {key} end", "hot") for i in range(1000)] + [(2000 + i, f"mine {pair} end", "hot") for i in range(2)] + [(3000 + i, f"token={some}", "hot") for i in range(5)]
    rows = {r.doc_id: r for r in S.scanned(spark.createDataFrame(records, "doc_id long, text string, source string")).collect()}
    assert all((rows[i].spans, rows[i].n_live) == ("", 0) for i in range(1000))
    assert (rows[2000].n_live, rows[2000].n_example, rows[2000].repositories, rows[2000].owners) == (1, 0, [2], [1])
    assert (rows[3000].n_live, rows[3000].n_example, rows[3000].repositories, rows[3000].owners) == (0, 0, [5], [1])
    told = S.scanned(spark.createDataFrame([(i, f"secret={key}", "hot") for i in range(1000)], "doc_id long, text string, source string")).collect()
    assert all((r.n_live, r.n_example, r.repositories, r.owners) == (0, 1, [1000], [1]) for r in told)


def test_ownership(spark):
    found = [("r1", "o1", b"h"), ("r1", "o1", b"h"), ("r2", "o1", b"h"), ("r3", "o2", b"h"), (None, None, b"i"), (None, None, b"i")]
    got = {bytes(r.hash): (r.repositories, r.owners) for r in S.ownership(spark.createDataFrame(found, "repository string, owner string, hash binary")).collect()}
    assert got == {b"h": (3, 2), b"i": (1, 1)}


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = S.scanned(docs).collect()
    assert len(rows) == docs.count() and all(base(r) == brute("") for r in rows)
    assert S.scanned(cases.table(spark, [])).collect() == []
