"""The graph from changes against a rebuild of everything, over random changes."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators.graph import entity_index
from loomspan.plans import graph_state as gs

KIND = "entry_pos long, entry_id string, category string, name string, raw_text string, reviewed boolean, qa_flags array<string>"
NAMES = ["Marta", "Quill", "Silver Guard", "the Luofu", "Luofu", "Lord Ash", "Ash", "River Wardens", "The Quill", "Express", "Old Town", "Marta's"]
WORDS = ["they met", "near the gate.", "and then", "of old", "He said", "with", "walked. The", "from"]


def _entry(rng, i):
    text = " ".join(x for _ in range(rng.randint(2, 9)) for x in (rng.choice(WORDS), rng.choice(NAMES)))
    category = rng.choice(["light_cone", "relic_set", "character_story", None])
    name = f"{rng.choice(['Marta', 'Quill • Dawn', 'Xianzhou Luofu', 'Ash', 'Nobody'])} — Story {i}"
    return (i, f"e{i}", category, name, text, rng.random() > 0.1, rng.choice([None, [], [], ["held"]]))


def _told(df):
    counts = F.to_json("category_counts")
    return sorted(map(repr, df.select("id", "key", "name", "kind", "entry_ids", "entry_count", "category_span", counts.alias("counts"), "first").collect()))


def test_updates_equal_rebuilds(spark, tmp_path):
    rng = random.Random(2)
    folder = str(tmp_path / "g")
    corpus = {i: _entry(rng, i) for i in range(60)}
    table = lambda rows: spark.createDataFrame(list(rows), KIND)
    gs.rebuild(table(corpus.values()), folder)
    assert _told(gs.entities(spark, folder)) == _told(entity_index(table(corpus.values())))
    for step in range(3):
        changed = {i: _entry(rng, i) for i in [*rng.sample(sorted(corpus), 4), 100 + step]}
        deleted = rng.sample(sorted(corpus), 3)
        number = gs.update(folder, table(changed.values()), spark.createDataFrame([(f"e{i}",) for i in deleted] + [("none",)], "entry_id string"))
        corpus = {i: r for i, r in {**corpus, **changed}.items() if i not in deleted}
        assert number == step + 1 and gs.newest(spark, folder) == number
        assert _told(gs.entities(spark, folder)) == _told(entity_index(table(corpus.values()))), step
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == ["v=2", "v=3"] and sorted(p.name for p in (tmp_path / "g/v=3").iterdir()) == ["forms", "names", "nodes"]


def test_untouched_entities_are_not_aggregated_anew(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "g")
    text = "they met the Silver Guard of Dawn"
    rows = [(i, f"e{i}", "light_cone", "x", text if i < 5 else "they saw the River Wardens there", True, []) for i in range(10)]
    gs.rebuild(spark.createDataFrame(rows, KIND), folder)
    seen, real = [], gs.entity_nodes
    monkeypatch.setattr(gs, "entity_nodes", lambda df, times: seen.append({r["key"] for r in df.select("key").distinct().collect()}) or real(df, times))
    gs.update(folder, spark.createDataFrame([(0, "e0", "light_cone", "x", "they saw nothing", True, [])], KIND), spark.createDataFrame([], "entry_id string"))
    assert seen == [{"silver guard of dawn"}]
    assert {r["name"]: r["entry_count"] for r in gs.entities(spark, folder).collect()} == {"Silver Guard of Dawn": 4, "River Wardens": 5}


def test_cut_off_and_empty(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(ValueError, match="no graph"):
        gs.entities(spark, folder)
    empty = spark.createDataFrame([], KIND)
    gs.rebuild(empty, folder)
    (tmp_path / "g/v=1/forms").mkdir(parents=True)  # an update that was cut off
    assert gs.newest(spark, folder) == 0 and gs.entities(spark, folder).collect() == []
    assert gs.update(folder, empty, empty.select("entry_id")) == 1 and gs.entities(spark, folder).collect() == []
