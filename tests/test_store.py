"""The store against merging whole tables, batch after batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators.merge import merge_entries
from loomspan.plans import store

KIND = "pos long, category string, name string, short_text string, raw_text string, raw_text_hash string, qa_flags array<string>, reviewed boolean, date_added string, date_updated string"


def _table(spark, rows, start=0):
    full = [(start + i, c, n, s, f"text {n} {h}", h, f, False, None, None) for i, (c, n, s, h, f) in enumerate(rows)]
    return spark.createDataFrame(full, KIND)


def _batch(rng, n, names):
    return [(rng.choice(["light_cone", "relic_set", None]), rng.choice(["A", "a!", ""]) + str(rng.randrange(names)), rng.choice(["short", "short", "", None]), rng.choice("xyz"), rng.choice([None, [], ["f"]])) for _ in range(n)]


def _told(df):
    return sorted(map(repr, df.drop("pos").collect())), [r["name"] for r in df.orderBy("pos").collect()]


def test_upserts_equal_merges_of_whole_tables(spark, tmp_path):
    rng = random.Random(1)
    folder = str(tmp_path / "s")
    base = merge_entries(_table(spark, []), _table(spark, _batch(rng, 60, 40)), "2024")
    base = spark.createDataFrame(base.withColumn("pos", F.col("pos._pos")).select(*_table(spark, []).columns).collect(), KIND)
    store.create(spark, folder, base, buckets=5)
    whole = base
    for k in range(5):
        new = _table(spark, _batch(rng, 12, 60))
        last = whole.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
        merged = merge_entries(whole, new, f"2025-{k}")
        whole = spark.createDataFrame(merged.withColumn("pos", merged["pos._pos"] + merged["pos._src"] * (last + 1)).select(*base.columns).collect(), KIND)
        store.upsert(spark, folder, new, f"2025-{k}", compact_after=2, keep=2)
        assert _told(store.read(spark, folder)) == _told(whole), k
    assert store.versions(spark, folder) == [4, 5]
    named = {(g, b) for n in (4, 5) for b, runs in store.current(spark, folder, n).runs.items() for g in runs}
    held = {(int(g[2:]), int(b[2:])) for g in os.listdir(f"{folder}/data") for b in os.listdir(f"{folder}/data/{g}") if b.startswith("b=")}
    assert held == named
    assert all(len(r) <= 2 for r in store.current(spark, folder).runs.values())


def test_a_small_batch_touches_its_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "s")
    base = _table(spark, [("light_cone", f"n{i}", "s", "x", []) for i in range(1000)])
    store.create(spark, folder, base, buckets=32)
    version = store.upsert(spark, folder, _table(spark, [("light_cone", f"n{i}", "t", "y", []) for i in (3, 5, 8)]), "2025")
    touched = {b for b, runs in version.runs.items() if len(runs) > 1}
    assert 1 <= len(touched) <= 3 and {int(b[2:]) for b in os.listdir(f"{folder}/data/g=1") if b.startswith("b=")} == touched
    assert spark.read.parquet(f"{folder}/data/g=1").count() == 3
    read = store._rows(spark, folder, store.current(spark, folder, 0), touched).inputFiles()
    assert {f.split("/b=")[1].split("/")[0] for f in read} == {str(b) for b in touched}
    got = store.read(spark, folder)
    assert got.count() == 1000 and sorted(r["name"] for r in got.filter("short_text = 't'").collect()) == ["n3", "n5", "n8"]
    assert store.read(spark, folder, 0).filter("short_text = 't'").count() == 0


def test_repeated_cut_off_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path / "s")
    store.create(spark, folder, _table(spark, []), buckets=4)
    one = _table(spark, [("c", "A", "s", "x", None), (None, "B", "s", "x", None)])
    store.upsert(spark, folder, one, "2025", source="q", batch=0)
    again = store.upsert(spark, folder, _table(spark, [("c", "Z", "s", "x", None)]), "2026", source="q", batch=0)
    assert again.number == 1 and store.read(spark, folder).count() == 2
    assert store.upsert(spark, folder, _table(spark, [("c", "Z", "", "x", None)]), "2026").number == 1
    assert store.upsert(spark, folder, _table(spark, []), "2026", source="q", batch=1).batches == {"q": 1}
    _table(spark, [("c", "A", "wrong", "x", None)]).withColumn("b", F.lit(0)).write.partitionBy("b").parquet(f"{folder}/data/g=2")  # an upsert that was cut off
    assert {r["short_text"] for r in store.read(spark, folder).collect()} == {"s"}
    store.upsert(spark, folder, _table(spark, [("c", "C", "s", "x", None)]), "2026", source="q", batch=2)
    got = store.read(spark, folder).orderBy("pos").collect()
    assert [(r["category"], r["name"], r["date_added"]) for r in got] == [("c", "A", "2025"), (None, "B", "2025"), ("c", "C", "2026")]
    with pytest.raises(ValueError, match="already"):
        store.create(spark, folder, _table(spark, []))
    with pytest.raises(RuntimeError, match="another upsert"):
        store._commit(spark, folder, store.current(spark, folder))
