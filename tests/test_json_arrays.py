"""JSON arrays written in parts and read in splits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomspan.sources.json_array import read_array, write_array, write_array_file

KIND = "pos long, id string, text string, flags array<string>, ok boolean, n long, counts map<string,int>, at struct<x:int,y:array<struct<z:string>>>"


def _rows(n, seed=1):
    rng = random.Random(seed)
    bits = ['"', "\\", "\n", "\t", "\x00", "\x1f", "\x7f", "é", "日本", "👍", "a b", "\\u001F", "  }", "\n  },\n  {", "[", "]", "{", ",", " "]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 6))) if rng.random() > 0.1 else None
    return [
        (i, f"e{i}", text(), rng.choice([None, [], ["x"], ["x", None, "y"]]), rng.choice([True, False, None]), rng.choice([None, -5, 1 << 60]),
         rng.choice([None, {}, {"k": 1}]), rng.choice([None, (None, None), (1, []), (2, [("q",), None])]))
        for i in range(n)
    ]


def _plain(rows):
    """The list as Python dumps it, indented by two spaces and with all characters as they are."""
    struct = lambda v: v and {"x": v[0], "y": v[1] if v[1] is None else [z and {"z": z[0]} for z in v[1]]}
    return json.dumps([dict(zip(("id", "text", "flags", "ok", "n", "counts", "at"), (*r[1:7], struct(r[7])))) for r in rows], ensure_ascii=False, indent=2)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_bytes_of_one_file_and_of_the_parts(spark, tmp_path, n):
    rows = _rows(n)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    write_array_file(df, f"{tmp_path}/one.json")
    assert (tmp_path / "one.json").read_bytes().decode() == _plain(rows) and sorted(os.listdir(tmp_path)) == [x for x in (".one.json.crc", "one.json") if x in os.listdir(tmp_path)]
    write_array(df, f"{tmp_path}/parts")
    parts = sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("part-"))
    assert "".join((tmp_path / "parts" / p).read_bytes().decode() for p in parts) == _plain(rows) + "\n"
    kind = df.drop("pos").schema
    for path in ("one.json", "parts"):
        back = read_array(spark, f"{tmp_path}/{path}", kind).orderBy("pos").collect()
        assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("pos").collect()], path


def test_splits_smaller_than_elements(spark, tmp_path):
    rows = _rows(400, 7)
    (tmp_path / "a.json").write_text(_plain(rows), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        df = read_array(spark, f"{tmp_path}/a.json", spark.createDataFrame([], KIND).drop("pos").schema)
        assert df.rdd.getNumPartitions() > 4
        back = df.select("pos", "id", "text").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in back] == [r[:3] for r in rows]


def test_a_million_entries(spark, tmp_path):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("id"), F.lit("text").alias("raw_text"), F.array(F.lit("flag")).alias("qa_flags"))
    write_array(df, f"{tmp_path}/parts")
    assert len([p for p in os.listdir(tmp_path / "parts") if p.startswith("part-")]) > 1
    back = read_array(spark, f"{tmp_path}/parts")
    assert back.rdd.getNumPartitions() > 1
    wrong = back.filter((F.col("id") != F.concat(F.lit("e"), "pos")) | (F.col("qa_flags")[0] != "flag")).count()
    assert (wrong, back.agg(F.count("*"), F.countDistinct("pos"), F.max("pos")).first()) == (0, (n, n, n - 1))


def test_other_layouts_and_errors(spark, tmp_path):
    kind = "id string, n int"
    for k, (text, want) in enumerate(
        [("[]", []), ('[{"id": "a"}, {"id": "b", "n": 2}]', [("a", None), ("b", 2)]), ('[\n{"id": "a"},\n{"id": "b"}\n]', [("a", None), ("b", None)]),
         ('[\n  {},\n  {\n    "id": "b"\n  },\n  {},\n  {}\n]\n', [(None, None), ("b", None), (None, None), (None, None)]), ('[\n    {\n        "id": "a"\n    }\n]', [("a", None)]), ("[\n\n]", [])]
    ):
        (tmp_path / f"{k}.json").write_text(text)
        back = read_array(spark, f"{tmp_path}/{k}.json", spark.createDataFrame([], kind).schema)
        assert [(r["id"], r["n"]) for r in back.orderBy("pos").collect()] == want, text
    (tmp_path / "bad.json").write_text('[\n  {\n    "id": "a"\n  },\n  {\n    "id": oops\n  }\n]')
    with pytest.raises(Exception, match="no element of a JSON array"):
        read_array(spark, f"{tmp_path}/bad.json", spark.createDataFrame([], kind).schema).collect()
    assert read_array(spark, f"{tmp_path}/none.json").collect() == []
