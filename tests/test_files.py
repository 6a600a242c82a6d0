"""Files written and lists read."""

import csv
import io
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from rankframe.operators import layouts as Y
from rankframe.schemas import JOBS, TABLES
from rankframe.sources import readers, writers

ROWS = "ordinal long, rank long, query string, title string, url string, target string, held boolean, offtopic boolean, similarity double"


def written(path):
    parts = sorted(pathlib.Path(path).glob("part-*"))
    return b"".join(p.read_bytes() for p in parts)


@pytest.fixture
def rows(spark):
    data = [
        (0, 1, "q", 'a "quoted", title', "https://a.b/?x=1&y=<2>", "t", True, False, 0.71239),
        (0, 2, "q", "two\nlines", "u", "t", False, True, None), (1, 1, "r", " led by a blank", "u", "t", True, False, 0.0),
        (1, 2, "r", "plain", "u", "t", True, False, 1.0), (1, 3, "r", None, "u", "t", True, False, 1.0),
    ]
    return spark.createDataFrame(data, ROWS)


def test_csv(rows, tmp_path):
    layout = Y.Layout("results", ("title", "rank"), eol=Y.CRLF, bom=True)
    writers.write_lines(rows, layout, ["ordinal", "rank"], f"{tmp_path}/c")
    whole = written(f"{tmp_path}/c")
    assert whole.startswith(b"\xef\xbb\xbftitle,rank\r\n") and whole.endswith(b",3\r\n") and b'"two\r\nlines",2' in whole
    read = list(csv.reader(io.StringIO(whole.decode("utf-8-sig"), newline="")))
    assert read[1:] == [['a "quoted", title', "1"], ["two\r\nlines", "2"], [" led by a blank", "1"], ["plain", "2"], ["", "3"]]


def test_a_mark_without_a_header(rows, tmp_path):
    writers.write_lines(rows, Y.Layout("results", ("rank",), header=False, bom=True), ["ordinal", "rank"], f"{tmp_path}/c")
    assert written(f"{tmp_path}/c") == b"\xef\xbb\xbf1\n2\n1\n2\n3\n"


def test_txt(rows, tmp_path):
    layout = Y.Layout("results", ("title", "url"), format=Y.TXT, sep=Y.separator(","), header=False)
    writers.write_lines(rows.where("rank < 3"), layout, ["ordinal", "rank"], f"{tmp_path}/t")
    assert written(f"{tmp_path}/t").decode().split("\n")[:2] == ['a "quoted"  title,https://a.b/?x=1&y=<2>', "two lines,u"]


def test_jsonl(rows, tmp_path):
    layout = Y.Layout("completions", ("similarity", "key", "related"), format=Y.JSONL, bom=True)
    writers.write_lines(rows, layout, ["ordinal", "rank"], f"{tmp_path}/j")
    lines = written(f"{tmp_path}/j").decode().splitlines()
    assert lines[1] == '{"similarity":null,"key":"q","related":false}' and json.loads(lines[0])["similarity"] == 0.71239
    held = rows.select(Y.json_line(Y.Layout("verdicts", format=Y.JSONL)).alias("x")).first().x
    assert held == '{"ordinal":0,"target":"t","held":true}'
    text = rows.select(Y.json_line(Y.Layout("results", ("url",), format=Y.JSONL)).alias("x")).first().x
    assert text == '{"url":"https://a.b/?x=1&y=<2>"}'


def test_unique_and_preview(rows, tmp_path):
    layout = Y.Layout("results", ("url",), unique=True, header=False)
    writers.write_lines(rows, layout, ["ordinal", "rank"], f"{tmp_path}/u")
    assert written(f"{tmp_path}/u") == b"https://a.b/?x=1&y=<2>\nu\n"
    assert [r["rank"] for r in Y.preview(rows, layout, ["ordinal", "rank"]).collect()] == [1, 2]


def test_an_empty_table_still_has_its_header(rows, tmp_path):
    writers.write_lines(rows.where("false"), Y.Layout("results", ("url",)), ["ordinal", "rank"], f"{tmp_path}/e")
    assert written(f"{tmp_path}/e") == b"url\n"


def test_projection(rows):
    got = Y.project_layout(rows, Y.Layout("completions", ("similarity", "related", "suggestion"))).collect()
    assert tuple(got[0]) == ("0.712", "true", 'a "quoted", title') and tuple(got[1]) == ("", "false", "two\nlines")
    assert Y.default_fields("completions") == ("ordinal", "key", "suggestion")


@pytest.mark.parametrize("wrong", [
    {"fields": ("url", "url")}, {"fields": ("nothing",)}, {"fields": ()}, {"format": "xlsx"}, {"eol": "\r"},
])
def test_refused_layouts(wrong):
    with pytest.raises(Y.LayoutError):
        Y.Layout("results", **wrong)


def test_separators():
    assert [Y.separator(s) for s in ("", " TAB ", "\\t", ";", "→")] == ["\t", "\t", "\t", ";", "→"]
    for wrong in (";;", '"'):
        with pytest.raises(Y.LayoutError):
            Y.separator(wrong)


def test_query_list(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿ first \r\n\n# no\nsecond\n  \nsecond\n".encode())
    (tmp_path / "b.txt").write_text("third\n#x\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = readers.read_query_list(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(0, "first"), (1, "second"), (2, "second"), (3, "third")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        readers.read_query_list(spark, f"{tmp_path}/empty")


def job_row(spark, job_id):
    return spark.range(1).select(*[
        F.lit(job_id).cast("long").alias(f.name) if f.name == "job_id"
        else F.lit(False).alias(f.name) if f.name == "plan_ready" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in JOBS.fields
    ])


def test_plan_and_history(spark, tmp_path):
    root = f"{tmp_path}/history"
    for texts in (["a", "b"], ["c"]):
        listed = spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")
        writers.load_plan(listed, ["{query}", "{query} {num:1:2}"], job_row(spark, 7), 7, root)
    for name in ("pages", "results", "ads", "related"):
        writers.write_history({name: spark.createDataFrame([], TABLES[name])}, root)
    held = readers.read_history(spark, root)
    got = held["queries"].orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(9)) and [r.text for r in got][:4] == ["a", "a 1", "a 2", "b"]
    assert got[6].text == "c" and {r.state for r in got} == {"pending"}
    assert held["jobs"].collect()[0].plan_ready is True
    # Another job's partition is left alone when one is written again.
    writers.write_history({"queries": held["queries"].limit(2).withColumn("job_id", F.lit(8))}, root)
    again = readers.read_history(spark, root)["queries"].groupBy("job_id").count().collect()
    assert {r.job_id: r["count"] for r in again} == {7: 9, 8: 2}
    with pytest.raises(ValueError):
        writers.load_plan(spark.createDataFrame([], "ordinal long, text string"), [], job_row(spark, 9), 9, root)


def test_a_load_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/history"

    def load(texts, batch):
        listed = spark.createDataFrame(list(enumerate(texts)), "ordinal long, text string")
        writers.load_plan(listed, ["{query}"], job_row(spark, 7), 7, root, batch)

    def held():
        rows = spark.read.schema(TABLES["queries"]).parquet(f"{root}/queries").where("job_id = 7")
        return [(r.ordinal, r.text) for r in rows.orderBy("ordinal").collect()]

    real = spark.createDataFrame

    def failing(data, schema=None, **more):
        if schema == writers.PLANS and data:
            raise RuntimeError("lost between the two writes")
        return real(data, schema, **more)

    for texts, batch, before in ((["a", "b"], "one", []), (["c"], "two", [(0, "a"), (1, "b")])):
        with monkeypatch.context() as m:
            m.setattr(type(spark), "createDataFrame", lambda self, *a, **k: failing(*a, **k))
            listed = real(list(enumerate(texts)), "ordinal long, text string")
            with pytest.raises(RuntimeError):
                writers.load_plan(listed, ["{query}"], job_row(spark, 7), 7, root, batch)
        assert len(held()) == len(before) + len(texts)  # left behind, and not counted
        load(texts, batch)
        load(texts, batch)  # in the ledger: not loaded twice
        assert held() == before + [(len(before) + i, t) for i, t in enumerate(texts)]
    load(["d"], None)
    assert held()[-1] == (3, "d")


def test_preview_looks_further_until_it_has_ten(spark):
    rows = spark.range(5000).selectExpr("id AS ordinal", "id AS rank", "concat('h', CASE WHEN id < 900 THEN id % 3 ELSE id % 7 END) AS host")
    few = Y.preview(rows, Y.Layout("results", ("host",), unique=True), ["ordinal", "rank"]).collect()
    assert [r.host for r in few] == ["h0", "h1", "h2", "h4", "h5", "h6", "h3"]  # all there are
    more = rows.withColumn("host", F.expr("concat('h', CASE WHEN ordinal < 900 THEN ordinal % 3 ELSE ordinal END)"))
    assert [r.ordinal for r in Y.preview(more, Y.Layout("results", ("host",), unique=True), ["ordinal", "rank"]).collect()] == [0, 1, 2, *range(900, 907)]
