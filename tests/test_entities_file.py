"""The site's exchange file, written in parts."""

import json
import os

import pytest

from loomspan.plans.build import write_entities

KIND = "id string, name string, kind string, category_span int, entry_count long, category_counts map<string,long>, entry_ids array<string>, other string"


@pytest.mark.parametrize("n, cycle", [(0, 0), (3, 0), (3, 2), (400, 350)])
def test_parts_are_the_dump_of_the_object(spark, tmp_path, n, cycle):
    rows = [(f"e{i:03}", f'Näme "{i}"', "term", 1 + i % 3, i, {"a": i, "b": 2} if i else {}, [f"x{k}" for k in range(i % 4)], "-") for i in range(n)]
    ids = [rows[-1 - i][0] for i in range(cycle)]
    entities = spark.createDataFrame(rows[::-1], KIND).repartition(5)
    places = spark.createDataFrame(list(enumerate(ids))[::-1], "pos int, id string").repartition(3)
    write_entities(entities, places, str(tmp_path / "out"), "2025-01-01", "2025-06-01T00:00:00")
    want = {"generated_at": "2025-06-01T00:00:00", "entity_count": n, "cycle_start_date": "2025-01-01", "cycle": ids, "entities": [dict(zip(("id", "name", "kind", "category_span", "entry_count", "category_counts", "entry_ids"), r)) for r in rows]}
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    assert "".join((tmp_path / "out" / p).read_bytes().decode() for p in parts) == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    assert n < 100 or len(parts) > 1
