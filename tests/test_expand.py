"""Formats and macros."""

import pytest

from rankframe.operators.expand import FormatError, expand_queries, parse_format


def made(spark, formats, queries):
    rows = spark.createDataFrame(list(enumerate(queries)), "ordinal long, text string")
    got = expand_queries(rows, formats).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(len(got)))
    return [r.query for r in got]


@pytest.mark.parametrize("formats, queries, want", [
    ([], ["a", "b", "a"], ["a", "b"]), (["{query}", "site:{QERY}"], ["x"], ["x", "site:x"]),
    (["{query} {num:9:11}"], ["x"], ["x 9", "x 10", "x 11"]), (["{query}{num:-1:1}"], ["x"], ["x-1", "x0", "x1"]),
    (["{ABC:a:c:2} {query}"], ["x"], [w + " x" for w in "a b c aa ab ac ba bb bc ca cb cc".split()]),
    (["{query} {abc:а:б:1}-{num:1:2}"], ["x"], ["x а-1", "x а-2", "x б-1", "x б-2"]),
    (["{query} {x} {num:1} {"], ["q"], ["q {x} {num:1} {"]), (["{query}", "{query} "], ["x", "  "], ["x"]),
    (["{query} {abc:a:a:3}"], ["x"], ["x a", "x aa", "x aaa"]), (["{query}{query}"], ["ab"], ["abab"]),
    (["{query} {num:1:2}", "{query}"], ["x", "x 1"], ["x 1", "x 2", "x", "x 1 1", "x 1 2"]),
])
def test_expand(spark, formats, queries, want):
    assert made(spark, formats, queries) == want


@pytest.mark.parametrize("text", [
    "no place", "{query} {num:5:1}", "{query} {num:a:2}", "{query} {ABC:a:z:0}", "{query} {ABC:ab:z:1}", "{query} {ABC:z:a:1}",
    "{query} {ABC:a:z:14}", "{query}" + " {num:1:2000000}" * 4, "{query} {ABC:a:z:x}",
])
def test_refused(text):
    with pytest.raises(FormatError):
        parse_format(text)


def test_a_large_expansion_is_whole_and_in_order(spark):
    rows = spark.createDataFrame([(0, "k"), (1, "k")], "ordinal long, text string")
    got = expand_queries(rows, ["{query} {ABC:a:z:3}", "{query} {num:1:50000}"])
    size = 26 + 26**2 + 26**3
    assert got.count() == size + 50000
    picked = {r.ordinal: r.query for r in got.where(f"ordinal in (0, 25, 26, 701, 702, {size - 1}, {size}, {size + 49999})").collect()}
    assert picked == {
        0: "k a", 25: "k z", 26: "k aa", 701: "k zz", 702: "k aaa", size - 1: "k zzz", size: "k 1", size + 49999: "k 50000",
    }


def test_more_than_a_million_of_each_query(spark):
    rows = spark.createDataFrame([(0, "k")], "ordinal long, text string")
    got = expand_queries(rows, ["{query} {num:1:1200000}"])
    assert got.count() == 1_200_000 and got.where("ordinal = 1199999").first().query == "k 1200000"


def test_what_a_short_list_makes_is_dealt_over_tasks(spark, monkeypatch):
    """Ten lines in one task make 1000 queries: no task makes them all."""
    monkeypatch.setattr("rankframe.operators.expand.ROWS_PER_TASK", 100, raising=False)
    rows = spark.range(0, 10, 1, 1).selectExpr("id AS ordinal", "concat('q', id) AS text")
    got = expand_queries(rows, ["{query} {num:1:100}"])
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.query for r in got.orderBy("ordinal").collect()] == [f"q{i} {n}" for i in range(10) for n in range(1, 101)]
