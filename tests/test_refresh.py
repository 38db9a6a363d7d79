"""Pages to corpus and graph by what is registered; model calls that overlap and are paced."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import builders, incremental
from loomspan.operators.graph import entity_index
from loomspan.plans import graph_state, refresh, store

TEXT = "they met the Silver Guard near the gate of Old Town"


def _pages(spark, items):
    return spark.createDataFrame([(t, f"{{{{Description|{text}}}}}") for t, text in items.items()], "title string, wikitext string")


@pytest.fixture
def registries():
    held = dict(builders.BUILDERS), dict(refresh.MODELS)
    yield
    for registry, before in zip((builders.BUILDERS, refresh.MODELS), held):
        registry.clear()
        registry.update(before)


def test_a_refresh_asks_writes_and_scans_what_changed(spark, tmp_path, registries):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        if "broken" in prompt:
            raise ValueError("no")
        return json.dumps({"short_text": "\n a plain summary of what the source text has to say here \t"})

    refresh.register_model("plain", model)
    corpus, graph = str(tmp_path / "c"), str(tmp_path / "g")
    settings = refresh.Settings("{name}: {raw_text}", "v1", "plain", 2)
    items = {f"Cone {i}": f"{TEXT} on day {i}" for i in range(6)} | {"Bad": "a broken text which nobody can retell"}
    run = lambda pages, day: refresh.refresh(spark, pages, corpus, graph, day, settings)
    assert run({"light_cone": (_pages(spark, items),)}, "2025-01-01") == 7 and calls.value == 7
    got = store.read(spark, corpus)
    assert got.count() == 6 and got.filter("short_text = 'a plain summary of what the source text has to say here'").count() == 6
    assert run({"light_cone": (_pages(spark, items),)}, "2025-01-02") == 1  # the failed one alone
    items["Cone 2"] = "they met the River Wardens and nobody else on that day"
    assert run({"light_cone": (_pages(spark, items | {"Bad": ""}),)}, "2025-01-03") == 1 and calls.value == 9
    dates = {r["name"]: (r["date_added"], r["date_updated"]) for r in store.read(spark, corpus).collect()}
    assert dates["Cone 2"] == ("2025-01-01", "2025-01-03") and dates["Cone 1"] == ("2025-01-01", "2025-01-01")

    # a new category is one registration
    builders.register_builder("note", lambda notes: notes.select(
        F.concat(F.lit("note-"), "title").alias("id"), F.lit("note").alias("category"), F.col("title").alias("name"), F.col("wikitext").alias("raw_text"), F.lit(False).alias("reviewed")))
    note = spark.createDataFrame([("n1", f"{TEXT} again"), ("n2", "we saw the River Wardens there, too")], "title string, wikitext string")
    assert run({"light_cone": (_pages(spark, items | {"Bad": ""}),), "note": (note,)}, "2025-01-04") == 2
    whole = store.read(spark, corpus)
    assert {r["category"] for r in whole.select("category").distinct().collect()} == {"light_cone", "note"}
    told = lambda df: sorted(map(repr, df.select("id", "name", "entry_ids", "entry_count", F.to_json("category_counts").alias("c")).collect()))
    rebuilt = entity_index(refresh._graph_rows(whole))
    assert told(graph_state.entities(spark, graph)) == told(rebuilt) and rebuilt.count() >= 2
    with pytest.raises(ValueError, match="no builder is registered for other"):
        refresh.raw_entries(spark, {"other": (note,)})


def test_settings_of_the_environment(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Tell {name}\n{raw_text}")
    got = refresh.Settings.read(spark, {"LOOMSPAN_PROMPT": str(tmp_path / "p.txt"), "LOOMSPAN_PROMPT_VERSION": "v9", "LOOMSPAN_CALLS": "2", "LOOMSPAN_DELAY": "0.5"})
    assert got == refresh.Settings("Tell {name}\n{raw_text}", "v9", "first_words", 2, 0.5) and refresh.Settings.read(spark, {}) == refresh.Settings()
    with pytest.raises(ValueError, match="no model x"):
        refresh.Settings.read(spark, {"LOOMSPAN_MODEL": "x"})


def test_answers_are_parsed_whole(spark):
    answers = ['{"short_text": " a\\n"}', "{", "{}", '{"short_text": 5}', '{"short_text": null}', "[]", '"x"', "null", None, '{"other": 1, "short_text": ""}', '{"short_text": "a"} and more']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", incremental.parse_answer(F.col("a")).alias("s")).collect()
    assert [r["s"] for r in sorted(rows)] == ["a", None, None, None, None, None, None, None, None, "", None]


def test_model_calls_overlap_and_fail_alone(spark):
    def slow(prompt):
        time.sleep(0.4)
        if prompt.endswith("3"):
            raise ValueError("no")
        return json.dumps({"short_text": f"a summary that is long enough to be taken for {prompt}"})

    kind = "pos long, id string, category string, name string, raw_text string, short_text string, raw_text_hash string, prompt_version string, qa_flags array<string>"
    df = spark.createDataFrame([(i, str(i), "c", f"n{i}", "text", None, None, None, None) for i in range(24)], kind).coalesce(1)
    incremental.paraphrase(df.limit(1), "{name}", "v1", slow).collect()
    start = time.time()
    got = {r["id"]: r["short_text"] for r in incremental.paraphrase(df, "{name}", "v1", slow, calls=12).collect()}
    assert time.time() - start < 24 * 0.4
    assert sorted((i for i, s in got.items() if s is None), key=int) == ["3", "13", "23"] and got["7"].endswith("n7")


def test_calls_begin_a_delay_apart():
    pace, begun, lock = incremental.Pace(0.05), [], threading.Lock()

    def call():
        pace.wait()
        with lock:
            begun.append(time.monotonic())

    threads = [threading.Thread(target=call) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    begun.sort()
    assert begun[-1] - begun[0] >= 0.2
