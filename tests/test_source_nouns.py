"""Revalidation with the nouns of known texts kept by hash."""

import os

from pyspark.sql import functions as F

from loomspan.functions.names import text_hash
from loomspan.operators import incremental

KIND = "id string, name string, raw_text string, short_text string, qa_flags array<string>, _x string"
RAW = "In the north they met Orla and the guard of Quill, who told them nothing at all."


def _rows(spark):
    short = "They walked to the north and met {} there, which took them most of the day."
    rows = [("a", "n", RAW, short.format("Orla")), ("b", "n", RAW, short.format("Marta")), ("c", "Marta", RAW, short.format("Marta")), ("d", "n", None, short.format("Orla")), ("e", "n", RAW, None), ("f", "n", "", short.format("Orla"))]
    return spark.createDataFrame([(*r, ["own", "possible_hallucinated_name"] if r[0] == "a" else None, "x") for r in rows], KIND)


def _told(df):
    return {r["id"]: (r["qa_flags"], r["changed"]) for r in df.collect()}


def test_kept_nouns_give_the_same_flags_and_grow_by_new_texts(spark, tmp_path):
    folder, df = str(tmp_path / "n"), _rows(spark)
    plain = incremental.revalidate(df)
    assert _told(plain) == {
        "a": (["own"], True), "b": (["possible_hallucinated_name"], True), "c": ([], False), "d": (["possible_hallucinated_name"], True), "e": (None, False), "f": (["possible_hallucinated_name"], True),
    }
    nouns = incremental.kept_nouns(df, folder)
    assert {tuple(sorted(r["nouns"])) for r in nouns.collect()} == {("Orla", "Quill"), ()}
    kept = incremental.revalidate(df, nouns)
    assert _told(kept) == _told(plain) and kept.columns == plain.columns
    before = {f for f in os.listdir(folder) if f.endswith(".parquet") and os.path.getsize(f"{folder}/{f}")}
    more = df.filter("id = 'a'").unionByName(df.filter("id = 'a'").withColumn("raw_text", F.lit("Then came Bob, and Orla left.")))
    grown = incremental.kept_nouns(more, folder)
    assert grown.count() == 3 and before <= set(os.listdir(folder))


def test_known_texts_are_not_searched(spark):
    """A set that tells another story than the text shows that the set is what counts."""
    df = _rows(spark)
    lie = spark.createDataFrame([("Marta",)], "n string").select(text_hash(F.lit(RAW)).alias("text_hash"), F.array("n").alias("nouns"))
    got = _told(incremental.revalidate(df, lie))
    assert got["a"][0] == ["own", "possible_hallucinated_name"] and got["b"][0] == [] and got["d"][0] == ["possible_hallucinated_name"]
