"""Numbering, places within hubs and as-of look-ups, all without a task that sees all rows."""

import random

from pyspark.sql import functions as F

from loomspan.operators import graph, serving
from loomspan.operators.numbering import next_at_or_after, numbered, placed


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "ä"]), i, "clash") for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, i long, pos string").drop("pos").repartition(7), [F.col("k"), F.desc("i")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.pos)] == [r[:2] for r in want]
    assert sorted(r.pos for r in got) == list(range(500))
    assert numbered(spark.createDataFrame([], "i long"), [F.col("i")]).collect() == []


def test_places_within_keys_and_a_hub(spark):
    rng = random.Random(2)
    rows = [("hub" if i % 3 else rng.choice(["x", None, "y"]), rng.randint(0, 9), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i long").repartition(5)
    got = placed(df, ["k"], [F.desc("v"), F.col("i")])
    by = {}
    for k, v, i in rows:
        by.setdefault(k, []).append((-v, i))
    want = {(k, i): n + 1 for k, held in by.items() for n, (_, i) in enumerate(sorted(held))}
    assert {(r.k, r.i): r.place for r in got.collect()} == want
    assert got.columns == ["k", "v", "i", "place"]


def test_next_at_or_after_by_blocks_of_blocks(spark):
    rng = random.Random(3)
    for top, block in ((200, 4), (50, 64), (1000, 3), (9, 1 << 16)):
        points = {p: f"v{p}" for p in rng.sample(range(top), rng.randint(0, min(12, top)))}
        asks = [rng.randint(0, top) for _ in range(40)]
        got = next_at_or_after(
            spark.createDataFrame(list(points.items()), "pos long, value string"), spark.createDataFrame([(a,) for a in asks], "pos long"), top, block
        ).collect()
        want = {a: next((points[p] for p in range(a, top + 1) if p in points), None) for a in asks}
        assert {r.pos: r.hit for r in got} == want and len(got) == len(want)


def test_evidence_in_a_readers_order(spark):
    names = ["zebra", "Äpfel", "apfel", "Apfel", "äpfel", "Zebra", "éclair", "eclair", None, "ecl", "ß", "ss"]
    entries = [(f"e{i}", "light_cone" if i % 2 else None, n) for i, n in enumerate(names)]
    pairs = [(h, e[0]) for h in ("hub", "other") for e in entries] + [("hub", "gone")]
    got = serving.evidence(spark.createDataFrame(pairs, "entity_id string, entry_id string"), spark.createDataFrame(entries, "entry_id string, category string, name string")).collect()
    by = {h: [r.name for r in sorted((r for r in got if r.entity_id == h), key=lambda r: r.place)] for h in ("hub", "other")}
    assert by["hub"] == by["other"] == [None, "apfel", "äpfel", "éclair", "ß", "zebra", "Apfel", "Äpfel", "ecl", "eclair", "ss", "Zebra"]
    assert sorted(r.place for r in got if r.entity_id == "hub") == list(range(1, 13))


def test_rotation_of_a_million_entities(spark):
    n = 1_000_000
    entities = spark.range(n).select(F.concat(F.lit("e"), "id").alias("id"), F.lit(2).alias("category_span"), F.lit(3).alias("entry_count"))
    cycle = graph.connection_cycle(entities, "seed")
    assert "SinglePartition" not in _plan(cycle)
    first = cycle.orderBy("pos").limit(3).collect()
    order = F.sha2(F.concat(F.lit("seed"), F.col("id")), 256)
    assert [r.id for r in first] == [r.id for r in entities.orderBy(order).limit(3).collect()]
    assert cycle.agg(F.countDistinct("pos").alias("d"), F.max("pos").alias("m")).first() == (n, n - 1)

    positions = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("id"))
    alive = positions.filter((F.col("pos") % 100_000 == 7) & (F.col("pos") < 900_000))
    days = spark.createDataFrame([("1970-01-01",), ("1970-01-09",), ("2300-01-01",), ("4600-01-01",), (None,)], "day string").select(F.col("day").cast("date").alias("day"))
    picks = serving.daily_pick(positions, alive, "1970-01-01", days)
    assert "SinglePartition" not in _plan(picks)
    assert {str(r.day): r.id for r in picks.collect()} == {"1970-01-01": "e7", "1970-01-09": "e100007", "2300-01-01": "e200007", "4600-01-01": "e7", "None": None}
