import pytest
from pyspark.sql import functions as F

from loomspan.operators import graph
from loomspan.operators import mentions as runs

SCHEMA = "entry_pos int, entry_id string, category string, name string, raw_text string, reviewed boolean, qa_flags array<string>"


def corpus(spark, *rows):
    return spark.createDataFrame([(i, r[0], r[1], r[2] if len(r) > 2 and r[2] else "n", r[3] if len(r) > 3 else None, *(r[4:] or (True, []))) for i, r in enumerate(rows)], SCHEMA)


def entry(i, category, text, name="n", reviewed=True, flags=()):
    return (i, category, name, text, reviewed, list(flags))


def nodes(spark, *rows):
    return {r["name"]: r for r in graph.entity_index(corpus(spark, *rows)).collect()}


def forms(spark, text, confirmed=None):
    df = spark.createDataFrame([(0, "a", text)], "entry_pos int, entry_id string, raw_text string")
    known = spark.createDataFrame([(k,) for k in confirmed], "key string") if confirmed else None
    return [r["surface"] for r in runs.surface_forms(runs.mentions(df), known).orderBy("match_pos").collect()]


def test_single_words_at_sentence_starts(spark):
    assert forms(spark, "Ostrava stood quiet. However, it fell") == []
    assert forms(spark, "Ostrava stood quiet", ["ostrava"]) == ["Ostrava"]
    assert forms(spark, "River Wardens patrol the Lake of Glass") == ["River Wardens", "Lake of Glass"]
    assert forms(spark, "we met Mr. Halvar, then Dr. Quill; xMr. Foo") == ["Halvar", "Quill"]
    assert forms(spark, "with Halvar and Dr. Quill") == ["Halvar and Dr", "Quill"]  # a connector joins, an abbreviation's period ends
    assert forms(spark, "The Then came, I think Then And") == []


@pytest.mark.parametrize("text, flags", [("Foo", [True, False]), ("a “Foo", [False, False]), ("a. (Foo", [True, False]), ("fled to Foo", [False, True]), ("St. Foo", None), ("x — Foo", [False, False])])
def test_context(spark, text, flags):
    df = spark.createDataFrame([(text,)], "raw_text string")
    got = [[r["opens"], r["prose"]] for r in runs.mentions(df).orderBy("match_pos").collect()]
    assert got[-1] == (flags if flags else [False, False])


def test_evidence_needs_two_entries(spark):
    rows = corpus(spark, entry("a", "x", "they fled toward Ostrava"), entry("b", "x", "gates of Ostrava; toward Once"), entry("c", "x", 'he said, "Look at that"'), entry("d", "x", 'she said, "Look here"'))
    assert [r["key"] for r in runs.confirmed_words(runs.mentions(rows)).collect()] == ["ostrava"]


def test_thresholds_and_counts(spark):
    text = "near the Copper Watch they stood"
    got = nodes(spark, entry("b", "relic_set", text), entry("a", "light_cone", text), entry("c", "character_story", text), entry("d", "light_cone", "the Lone Thing is here"))
    assert set(got) == {"Copper Watch"}
    n = got["Copper Watch"]
    assert (n["id"], n["kind"], n["entry_count"], n["category_span"], n["entry_ids"]) == ("copper-watch", "term", 3, 3, ["a", "b", "c"])
    assert n["category_counts"] == {"character_story": 1, "light_cone": 1, "relic_set": 1}
    two = [entry(i, "x", "he reached Ostrava today") for i in "ab"]
    assert nodes(spark, *two) == {} and set(nodes(spark, *two, entry("c", "x", "he reached Ostrava today"))) == {"Ostrava"}


def test_display_is_most_frequent_then_first(spark):
    assert set(nodes(spark, entry("a", "x", "saw River Wardens, then River Wardens"), entry("b", "x", "a River Warden"))) == {"River Wardens"}
    assert set(nodes(spark, entry("a", "x", "saw River Warden"), entry("b", "x", "saw River Wardens"))) == {"River Warden"}


def test_characters_aliases_and_variants(spark):
    got = nodes(
        spark, entry("a", "character_story", "met Miriam there", "Miriam — Story 1"), entry("b", "relic_set", "where Miriam was"),
        entry("c", "character_story", "x", "Jon Ash • Nova — Story 2"), entry("d", "x", "on the Luofu they met Jon Ash"), entry("e", "x", "of Xianzhou Luofu and, the Luofu. They saw Jon Ash"),
    )
    assert got["Miriam"]["kind"] == "character" and got["Miriam"]["entry_count"] == 2
    assert got["Jon Ash"]["kind"] == "character" and got["Xianzhou Luofu"]["entry_count"] == 2


def test_articles(spark):
    got = nodes(spark, entry("a", "character_story", "saw The Marta", "The Marta — Story 1"), entry("b", "x", "saw The Marta and, The River Wardens"), entry("c", "x", "of River Wardens"))
    assert got["The Marta"]["kind"] == "character" and got["River Wardens"]["entry_count"] == 2


def test_links_are_the_index_as_rows(spark):
    rows = corpus(spark, *[entry(str(i), "xyz"[i % 3], f"the Copper Watch of Old Town met Name{chr(97 + i % 5)} Foo, the Copper Watch") for i in range(30)])
    links = sorted((r["id"], r["entry_id"]) for r in graph.entity_links(rows).collect())
    assert links == sorted((r["id"], e) for r in graph.entity_index(rows).collect() for e in r["entry_ids"]) and links
    counted = graph.entity_index(rows).select("id", "entry_count", "category_span")
    assert "collect_list" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_gate_and_empty(spark):
    rows = [entry("a", "x", "the Copper Watch"), entry("b", "x", "the Copper Watch", flags=["f"]), entry("c", "x", "the Copper Watch", reviewed=False), entry("d", "x", None)]
    assert nodes(spark, *rows) == {}
    assert graph.entity_index(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slug_repeats_and_rotation(spark):
    rows = spark.createDataFrame([("A-B", 2, 5, 1), ("A B", 1, 9, 2), ("a b", 2, 5, 3), ("C", 2, 2, 4)], "name string, category_span int, entry_count int, first int")
    ids = graph.with_ids(rows)
    assert {r["name"]: r["id"] for r in ids.collect()} == {"A-B": "a-b", "a b": "a-b-2", "A B": "a-b-3", "C": "c"}
    cycle = [r["id"] for r in graph.connection_cycle(ids, "s").orderBy("pos").collect()]
    assert sorted(cycle) == ["a-b", "a-b-2"] and graph.shuffled_cycle(ids, "s") == graph.shuffled_cycle(ids, "s")


@pytest.mark.parametrize("partitions", [1, 7])
def test_partition_count_does_not_matter(spark, partitions):
    rows = corpus(spark, *[entry(str(i), "xyz"[i % 3], f"the Copper Watch of Old Town met Name{chr(97 + i % 5)} Foo") for i in range(30)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = sorted(tuple(map(str, r)) for r in graph.entity_index(rows.repartition(partitions)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(tuple(map(str, r)) for r in graph.entity_index(rows).collect()) and got
