import hashlib
import random
import re
import time

from rankframe.llm import personal_data as P

from . import cases

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in BASE.items()}
    spans = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
    return *(len(found[k]) for k in BASE), hashlib.sha256(spans.encode()).hexdigest(), spans


def base(r):
    spans = ",".join(s for s in r.spans.split(",") if not s.startswith("context:"))
    return r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, spans


def test_base_as_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", "a@b.c_d@e.f", "a@b.c@d.e 1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112"]
    texts += ["".join(r.choice("a1234567890.@+- ()😀é\n%_") for _ in range(r.randint(1, 120))) for _ in range(600)]
    texts += ["".join(r.choice("0123456789 -") for _ in range(r.randint(10, 60))) for _ in range(400)]
    texts += [" ".join(f"u{i}@h.com" for i in range(1500))]  # more than one chunk of places
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in P.personal_data(frame).collect():
        assert base(row) == brute(texts[row.doc_id])


def test_contexts_find_what_no_pattern_does(spark):
    seeds = [(i, f"please call my phone: +1 (988) 555-{1000 + i} now thanks") for i in range(20)]
    others = [(100, "please call my phone: 5552-1234-77 now thanks"), (101, "the value 5552-1234-78 here is")]
    rows = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(seeds + others, "doc_id long, text string")).collect()}
    assert rows[100].spans == "context:22:34" and rows[101].spans == "" and rows[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(rows[i].n_context == 0 for i in range(20))


def words(side):
    return [w for w in re.split("[ \t-\r]+", side.lower()) if w and not re.search("[0-9@]", w)]


def patterns(text, start, end):
    left, right = words(text[:start][-P.AROUND :]), words(text[end:][: P.AROUND])
    return [f"{left[-2]} {left[-1]} _"] * (len(left) > 1) + [f"{left[-1]} _ {right[0]}"] * bool(left and right)


def instance(value):
    value = value.lower()
    return value if re.search("[a-z@]", value) else re.sub("[ ()-]+", "", value)


def brute_contexts(texts):
    """Context spans of each text, by plain loops over all mentions."""
    edges, candidates, bases = {}, [], {}
    for i, text in texts.items():
        bases[i] = [m.span() for k, p in BASE.items() for m in re.finditer(p, text) if holds(k, m[0])]
        for a, b in bases[i]:
            for p in patterns(text, a, b):
                edges[p, instance(text[a:b])] = True
        for m in re.finditer(P.TOKEN, text):
            value = m[0]
            lead = len(re.match(P.LEAD, value)[0])
            trail = re.search(P.TRAIL, value)
            core = value[lead : trail.start() if trail else None]
            own = instance(core)
            if 6 <= len(own) <= 64 and (len(re.findall("[0-9]", own)) >= 4 or "@" in own):
                found = patterns(text, *m.span())
                candidates.append((i, m.start() + lead, m.start() + lead + len(core), found))
                for p in found:
                    edges.setdefault((p, own), False)
    seeds = {v for (_, v), seed in edges.items() if seed}
    score = {e: 1.0 if e[1] in seeds else 0.0 for e in edges}
    for n in range(P.ROUNDS):
        held = {}
        for p, v in edges:
            held.setdefault(p, []).append(score[p, v])
        sure = {p: sum(x) / (len(x) + 1) for p, x in held.items()}
        known = {p: sum(y > 0.5 for y in x) for p, x in held.items()}
        unsure = {}
        for p, v in edges:
            unsure[v] = unsure.get(v, 1.0) * (1 - min(sure[p], 0.999))
        if n < P.ROUNDS - 1:
            score = {(p, v): 1.0 if v in seeds else 1 - unsure[v] for p, v in edges}
    good = {p for p in sure if sure[p] >= P.CONFIDENCE and known[p] >= P.LEAST_SEEDS}
    out = {i: set() for i in texts}
    for i, a, b, found in candidates:
        if good & set(found) and not any(x < b and a < y for x, y in bases[i]):
            out[i].add((a, b))
    return {i: [f"context:{a}:{b}" for a, b in sorted(x)] for i, x in out.items()}


def contexts(frame):
    return {r.doc_id: [s for s in r.spans.split(",") if s.startswith("context:")] for r in P.personal_data(frame).collect()}


def test_grouped_and_neighbouring_identifiers(spark):
    texts = {i: f"please call account holder +44 20 7946 {1000 + i} now thanks" for i in range(20)}
    new = ["020 7946 0958", "02079460958", "(555) 123-4567", "GB82 WEST 1234 5698 7654 32", "1234567890 0987654321", "A-123456, B-654321"]
    for n, value in enumerate(new):
        texts[100 + n] = f"please call account holder {value} now thanks"
        other = value.translate(str.maketrans("0123456789", "1357902468"))
        texts[200 + n] = f"the long list holds {other} and more"
    got = contexts(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    assert got == brute_contexts(texts)
    read = {i: [texts[i][slice(*map(int, s.split(":")[1:]))] for s in x] for i, x in got.items()}
    assert [read[100 + n] for n in range(6)] == [[v] for v in new[:4]] + [["1234567890", "0987654321"], ["A-123456", "B-654321"]]
    assert not any(read[200 + n] for n in range(6))


def test_contexts_as_brute_force(spark):
    r = random.Random(11)
    names = ["account holder", "call me", "my id is", "see page", "in the year", "order no."]
    kinds = [lambda: f"+{r.randrange(10**9, 10**10)}", lambda: f"u{r.randrange(50)}@h.org", lambda: f"{r.randrange(10**4, 10**8)}", lambda: f"{r.randrange(900)} {r.randrange(1000, 9999)} {r.randrange(1000, 9999)}", lambda: f"(0{r.randrange(99)}) {r.randrange(10**5, 10**7)},", lambda: "plain"]
    texts = {}
    for i in range(400):
        parts = []
        for _ in range(r.randint(1, 4)):
            name = r.randrange(len(names))
            kind = kinds[r.choice([name % 3, name % 3, name % 3, r.randrange(6)])]
            parts.append(f"{names[name]} {kind()} {r.choice(['now', 'and', 'so', 'éà 😀'])} " + " ".join(r.choice(["w", "x", "yes"]) for _ in range(r.randint(0, 15))))
        texts[i] = " ".join(parts)
    got = contexts(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    want = brute_contexts(texts)
    assert got == want and sum(map(len, want.values())) > 20


def test_long_texts_are_read_in_proportion(spark):
    texts = ["ab." * 300_000, "1" * 500_000, "+1 " * 100_000, "1.2." * 100_000, "a@b.c " * 20_000]
    began = time.time()
    rows = P.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_ip) for r in rows} == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 50_000), 4: (20_000, 0)}
    assert time.time() - began < 60


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = P.personal_data(docs).collect()
    assert len(rows) == docs.count() and all(base(r) == brute("") for r in rows)
    assert P.personal_data(cases.table(spark, [])).collect() == []
    mail = cases.table(spark, cases.rows(["me@a.org", None]) * 2)
    assert sorted((r.doc_id, r.spans) for r in P.personal_data(mail).collect()) == [(0, "email:0:8")] * 2 + [(1, "")] * 2


def test_the_plan_is_native(spark):
    plan = P._spans_of(spark.createDataFrame([(1, "a@b.c")], "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
