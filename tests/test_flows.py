import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import builders, incremental, merge, serving
from loomspan.plans.build import build_corpus, entities_file
from loomspan.sources import json_array, wiki
from loomspan.streaming.upsert import latest, merge_stream

ROW = "pos long, id string, category string, name string, short_text string, raw_text_hash string, qa_flags array<string>, reviewed boolean, date_added string, date_updated string"


def rows(spark, *items):
    base = {"category": "c", "short_text": "s", "raw_text_hash": "h", "qa_flags": [], "reviewed": False, "date_added": "2020", "date_updated": "2021"}
    names = [c.split()[0] for c in ROW.split(", ")]
    return spark.createDataFrame([tuple(({**base, "pos": i, "id": f"i{i}"} | x).get(n) for n in names) for i, x in enumerate(items)], ROW)


def merged(spark, old, new):
    out = merge.merge_entries(rows(spark, *old), rows(spark, *new), "2025").orderBy("pos").collect()
    stats = merge.merge_stats(rows(spark, *old), rows(spark, *new)).first().asDict()
    return [(r["name"], r["id"], r["date_added"], r["date_updated"], r["reviewed"]) for r in out], stats


def test_merge(spark):
    out, stats = merged(
        spark, [{"name": "A"}, {"name": "B", "id": "old"}, {"name": "Keep", "reviewed": True}],
        [{"name": "a!", "id": "new"}, {"name": "B", "raw_text_hash": "h2", "qa_flags": ["f"]}, {"name": "C"}, {"name": "Keep", "short_text": ""}, {"name": "A", "category": "d"}],
    )
    assert out == [("a!", "new", "2020", "2021", True), ("B", "i1", "2020", "2025", False), ("Keep", "i2", "2020", "2021", True), ("C", "i2", "2025", "2025", True), ("A", "i4", "2025", "2025", True)]
    assert stats == {"added": 2, "updated": 1, "unchanged": 1, "skipped_no_short_text": 1, "held_back_flagged": 1}


def test_merge_repeated_keys_and_null_hashes(spark):
    out, stats = merged(spark, [{"name": "A", "raw_text_hash": None}], [{"name": "A", "raw_text_hash": None}, {"name": "A", "raw_text_hash": "x", "id": "mid"}, {"name": "A", "raw_text_hash": None, "id": "end"}, {"name": "B"}, {"name": "B"}])
    assert out == [("A", "end", "2020", "2025", True), ("B", "i4", "2025", "2025", True)]
    assert stats == {"added": 1, "updated": 2, "unchanged": 2, "skipped_no_short_text": 0, "held_back_flagged": 0}
    assert merged(spark, [], []) == ([], {"added": 0, "updated": 0, "unchanged": 0, "skipped_no_short_text": 0, "held_back_flagged": 0})


@pytest.mark.parametrize("stretch_rows", [1, 3, 65_536])
def test_merge_stats_of_hot_keys_match_a_plain_count(spark, stretch_rows):
    r = random.Random(stretch_rows)
    make = lambda n: [{"name": r.choice("AAAAAB"), "raw_text_hash": r.choice(["x", "y", None]), "qa_flags": r.choice([[], ["f"]]), "short_text": r.choice(["s", "s", "s", ""])} for _ in range(n)]
    old, new = make(40), make(90)
    last, want = {}, dict.fromkeys(["added", "updated", "unchanged", "skipped_no_short_text", "held_back_flagged"], 0)
    for x in old:
        last[x["name"]] = x["raw_text_hash"]
    for x in new:
        if not x["short_text"]:
            want["skipped_no_short_text"] += 1
            continue
        want["added" if x["name"] not in last else "unchanged" if last[x["name"]] == x["raw_text_hash"] else "updated"] += 1
        want["held_back_flagged"] += bool(x["qa_flags"])
        last[x["name"]] = x["raw_text_hash"]
    plain, told = rows(spark, *old), rows(spark, *new)
    assert merge.merge_stats(plain, told, stretch_rows).first().asDict() == want
    nested = lambda df: df.withColumn("pos", F.struct(F.lit(0).alias("file"), F.col("pos").alias("at")))
    assert merge.merge_stats(nested(plain), nested(told), stretch_rows).first().asDict() == want


def tracked(spark, *items):
    base = {"category": "c", "raw_text": "Some raw text which is long enough for all.", "short_text": None, "raw_text_hash": None, "prompt_version": None, "qa_flags": None}
    names = ["pos", "id", "category", "name", "raw_text", "short_text", "raw_text_hash", "prompt_version", "qa_flags"]
    return spark.createDataFrame([tuple((base | {"pos": i, "id": str(i)} | x).get(n) for n in names) for i, x in enumerate(items)], "pos long, id string, category string, name string, raw_text string, short_text string, raw_text_hash string, prompt_version string, qa_flags array<string>")


def model(prompt):
    if "bad" in prompt:
        raise ValueError("no")
    return json.dumps({"short_text": " a plain summary of what the source text has to say here "})


def test_paraphrase_isolates_failures_and_clears_flags(spark):
    df = tracked(spark, {"name": "bad", "raw_text_hash": "old"}, {"name": "n", "qa_flags": ["paraphrase_error", "short_text_too_long", "own", "own"]}, {"name": "n", "raw_text": ""}, {"name": "n", "qa_flags": ["flavor_text_unexpectedly_long"]})
    got = {r["id"]: r for r in incremental.paraphrase(df, "{name} {raw_text}", "v1", model).collect()}
    assert got["0"]["qa_flags"] == ["paraphrase_error"] and got["0"]["raw_text_hash"] == "old" and got["0"]["short_text"] is None
    assert got["1"]["qa_flags"] == ["own", "own"] and got["1"]["short_text"].startswith("a plain") and got["1"]["prompt_version"] == "v1"
    assert got["2"]["short_text"] is None and got["3"]["short_text"] is None
    again = incremental.paraphrase(spark.createDataFrame(list(got.values()), df.schema), "{name}", "v1", model)
    assert again.filter(incremental.is_stale("v1")).count() == 1  # only the failed row is due again


def test_paraphrase_limit_counts_successes(spark):
    df = tracked(spark, {"name": "bad"}, {"name": "n"}, {"name": "bad"}, {"name": "n"}, {"name": "n"})
    got = incremental.paraphrase_some(df, "{name}", "v1", 2, model, batch=2)
    assert sorted(r["id"] for r in got.filter("short_text is not null").collect()) == ["1", "3"] and got.count() == 5


def test_paraphrase_resumes_from_written_batches(spark, tmp_path):
    df = tracked(spark, *({"name": n} for n in ["n", "bad", "n", "n", "n"]), {"name": "n", "raw_text": ""})
    folder, calls = str(tmp_path / "b"), spark.sparkContext.accumulator(0)

    def counted(prompt):
        calls.add(1)
        return model(prompt)

    assert incremental.paraphrase_batches(df, folder, "{name}", "v1", limit=2, model=counted, batch=2) == {"processed": 2, "errors": 1}
    assert calls.value == 3
    (tmp_path / "b/batch=9/_temporary").mkdir(parents=True)  # a batch that was cut off
    assert incremental.paraphrase_batches(df, folder, "{name}", "v1", model=counted, batch=2) == {"processed": 2, "errors": 1}
    assert calls.value == 6  # the failed row and the two that were left
    got = {r["id"]: r for r in incremental.resumed(df, folder).collect()}
    assert len(got) == 6 and [i for i, r in sorted(got.items()) if r["short_text"]] == ["0", "2", "3", "4"] and got["1"]["qa_flags"] == ["paraphrase_error"]
    changed = incremental.resumed(df.withColumn("raw_text", F.when(F.col("pos") == 0, "Another text, since then.").otherwise(F.col("raw_text"))), folder)
    assert {r["id"] for r in changed.filter(incremental.is_stale("v1")).collect()} == {"0", "1"}


def test_revalidate_keeps_other_flags(spark):
    df = tracked(spark, {"name": "n", "short_text": "short", "qa_flags": ["paraphrase_error", "short_text_too_long", "x", "x"]}, {"name": "n", "qa_flags": ["short_text_too_long"]})
    got = {r["id"]: (r["qa_flags"], r["changed"]) for r in incremental.revalidate(df).collect()}
    assert got == {"0": (["paraphrase_error", "x", "x", "short_text_too_short"], True), "1": (["short_text_too_long"], False)}


def test_prompt_and_answer(spark):
    df = spark.createDataFrame([("{raw_text}", "c", "t")], "n string, c string, r string")
    assert df.select(incremental.render_prompt("{name}|{category}|{raw_text}", F.col("n"), F.col("c"), F.col("r"))).first()[0] == "t|c|t"
    assert [r[0] for r in spark.createDataFrame([('{"short_text": " a "}',), ("{",), ("{}",)], "a string").select(incremental.parse_answer(F.col("a"))).collect()] == ["a", None, None]


def test_builders(spark):
    pages = spark.createDataFrame(
        [("Cone", "{{I\n|rarity = 5\n|effect_path = Hunt\n}}{{Description|A ''long'' tale}}"), ("Bare", "nothing"), ("Set", "{{S\n|rarity = 3★4★5★\n|head = P1\n|hand = P2\n|body = P3\n|feet = P9\n}}"), ("P1", "==Description==\nFirst piece text"), ("P2", "==Other==\nx"), ("P3", "==Description==\n[[x|Third]] text"), ("Ball", "{{S\n|planarsphere = P1\n}}")],
        "title string, wikitext string",
    )
    cones = {r["name"]: r for r in builders.light_cones(pages.filter("title in ('Cone', 'Bare')"), "w/").collect()}
    assert (cones["Cone"]["subtitle"], cones["Cone"]["raw_text"], cones["Cone"]["qa_flags"], cones["Cone"]["id"]) == ("5★ Light Cone · Hunt", "A long tale", [], "light-cone-cone")
    assert cones["Bare"]["qa_flags"] == ["no_description_template"] and cones["Bare"]["raw_text"] == ""
    sets = {r["name"]: r for r in builders.relic_sets(pages.filter("title in ('Set', 'Ball')"), pages).collect()}
    assert sets["Set"]["raw_text"] == "First piece text Third text" and sets["Set"]["subtitle"] == "5★ Relic Set" and sets["Set"]["error"] == "P9"
    assert sets["Set"]["qa_flags"] == ["missing_piece_description:Hand", "missing_piece_description:Feet"]
    assert sets["Ball"]["qa_flags"] == ["missing_piece_field:Link Rope"] and sets["Ball"]["subtitle"] == "Planar Ornament"
    lore = spark.createDataFrame([("Ann", "{{Character Story|text1=one [[a|b]] story|text3=" + "x" * 5001 + "}}"), ("Bob", "none"), ("Cid", None)], "name string, wikitext string")
    got = builders.character_stories(lore, "w/").orderBy("id").collect()
    assert [(r["name"], r["subtitle"], r["raw_text"][:11], r["qa_flags"]) for r in got] == [("Ann — Story 1", "Character Story 1 of 2 · Ann", "one b story", []), ("Ann — Story 3", "Character Story 2 of 2 · Ann", "x" * 11, ["flavor_text_unexpectedly_long"])]


ENTITIES = "id string, name string, kind string, category_span int, entry_count int"


def test_browse(spark):
    df = spark.createDataFrame([(f"e{i:02}", f"Name {i}", "character" if i % 2 else "term", 1 + i % 3, i) for i in range(50)], ENTITIES)
    assert serving.browse(df).count() == 30 and serving.browse(df, "character", " NAME 1").count() == 6
    assert serving.browse(df, "bridging").filter("category_span < 2").count() == 0
    far = serving.browse(df, deep_link="e00", shown=5)
    assert far.orderBy(F.desc("rn")).first()["id"] == "e00" and serving.browse(df, deep_link="none", shown=5).count() == 5
    assert df.select(serving.result_count(F.lit(1), F.lit(1))).first()[0] == "Showing 1 of 1 connection."


def test_daily_pick(spark):
    cycle = spark.createDataFrame([(i, c) for i, c in enumerate("abcdefg")], "pos int, id string")
    days = spark.createDataFrame([("2024-01-01",), ("2023-12-28",), ("2024-01-07",)], "day string").select(F.to_date("day").alias("day"))
    live = spark.createDataFrame([("a",), ("d",)], "id string")
    got = {str(r["day"]): r["id"] for r in serving.daily_pick(cycle, live, "2024-01-01", days).collect()}
    assert got == {"2024-01-01": "a", "2023-12-28": "d", "2024-01-07": "a"}
    assert {r["id"] for r in serving.daily_pick(cycle, live.filter("false"), "2024-01-01", days).collect()} == {None}
    assert {r["id"] for r in serving.daily_pick(cycle.filter("false"), live, "2024-01-01", days).collect()} == {None}


def test_evidence_and_dangling(spark):
    pairs = spark.createDataFrame([("e", "1"), ("e", "2"), ("e", "3"), ("e", "gone")], "entity_id string, entry_id string")
    entries = spark.createDataFrame([("1", "character_story", "b"), ("2", "light_cone", "C"), ("3", "light_cone", "b")], "entry_id string, category string, name string")
    assert [r["entry_id"] for r in serving.evidence(pairs, entries).orderBy("place").collect()] == ["3", "2", "1"]
    assert [r["entry_id"] for r in serving.dangling_refs(pairs, entries).collect()] == ["gone"]


def test_json_arrays_and_build(spark, tmp_path):
    text = "they met at the Silver Guard of Old Town"
    new = [{"id": f"n{i}", "category": c, "name": f"N{i}", "short_text": "s", "raw_text": text, "raw_text_hash": "h", "qa_flags": []} for i, c in enumerate(["light_cone", "relic_set", "relic_set"])]
    (tmp_path / "a.json").write_text(json.dumps(new), encoding="utf-8")
    out = build_corpus(spark, str(tmp_path / "none.json"), {"x": str(tmp_path / "a.json"), "y": str(tmp_path / "missing.json")}, str(tmp_path / "out"), "2025-01-01", "seed")
    assert out["stats"].first()["added"] == 3 and out["entities"].count() == 1 and [r["id"] for r in out["cycle"].collect()] == ["silver-guard-of-old-town"]
    assert entities_file(out["entities"], out["cycle"], "2025-01-01").first()["entity_count"] == 1
    whole = entities_file(out["entities"], out["cycle"], "2025-01-01").first()
    assert [e["id"] for e in whole["entities"]] == whole["cycle"] == ["silver-guard-of-old-town"]
    json_array.write_array(json_array.read_array(spark, str(tmp_path / "a.json")), str(tmp_path / "b"))
    back = json_array.read_array(spark, str(tmp_path / "b"))
    assert [r["id"] for r in back.orderBy("pos").collect()] == ["n0", "n1", "n2"]


def test_build_runs_on_its_own_output(spark, tmp_path):
    base = {"category": "light_cone", "short_text": "s", "raw_text": "x", "raw_text_hash": "h", "qa_flags": []}
    (tmp_path / "a.json").write_text(json.dumps([base | {"id": n, "name": n} for n in ("A", "B")]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([base | {"id": n, "name": n} for n in ("C", "B", "D")]), encoding="utf-8")
    out = str(tmp_path / "out")
    build = lambda name, day: build_corpus(spark, out, {"x": str(tmp_path / name)} if name else {}, out, day, "seed")
    assert build("a.json", "2025-01-01")["stats"].first()["added"] == 2
    again = build("b.json", "2025-01-02")
    assert again["stats"].first().asDict() == {"added": 2, "updated": 0, "unchanged": 1, "skipped_no_short_text": 0, "held_back_flagged": 0}
    assert [(r["id"], r["date_added"]) for r in again["entries"].orderBy("pos").collect()] == [("A", "2025-01-01"), ("B", "2025-01-01"), ("C", "2025-01-02"), ("D", "2025-01-02")]
    none = build("", "2025-01-03")
    assert none["stats"].first()["added"] == 0 and [r["id"] for r in none["entries"].orderBy("pos").collect()] == ["A", "B", "C", "D"]


def test_daily_pick_of_a_long_cycle(spark):
    """Two hundred thousand positions, a third of them live: every day's pick against a plain walk."""
    n = 200_000
    cycle = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"))
    live = cycle.filter("pos % 3 = 1 and (pos < 50000 or pos > 90000)").select("id")
    days = spark.range(3000).select(F.expr("date_add(date '2024-01-01', cast(id * 150 as int))").alias("day"))
    alive = lambda p: p % 3 == 1 and (p < 50_000 or p > 90_000)
    for r in serving.daily_pick(cycle, live, "2024-01-01", days).collect():
        at = (r["day"] - datetime.date(2024, 1, 1)).days % n
        while not alive(at):
            at = (at + 1) % n
        assert r["id"] == str(at)


def test_streaming_merge(spark, tmp_path):
    old = rows(spark, {"name": "A"}, {"name": "B"})
    old.write.parquet(str(tmp_path / "c/v=0"))
    rows(spark, {"name": "B", "raw_text_hash": "z"}, {"name": "C"}).write.parquet(str(tmp_path / "in"))
    merge_stream(spark.readStream.schema(old.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "cp"), "2025").awaitTermination(60)
    assert [(r["name"], r["date_updated"]) for r in latest(spark, str(tmp_path / "c")).orderBy("pos").collect()] == [("A", "2021"), ("B", "2025"), ("C", "2025")]


def test_streaming_merge_keeps_first_seen_order_over_batches(spark, tmp_path):
    old = rows(spark, {"name": "A"})
    old.write.parquet(str(tmp_path / "c/v=0"))
    for batch in (["B1", "B2", "B3"], ["C1", "C2"], ["B2", "D"]):
        rows(spark, *({"name": n} for n in batch)).write.mode("append").parquet(str(tmp_path / "in"))
        merge_stream(spark.readStream.schema(old.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "cp"), "2025").awaitTermination(60)
    got = latest(spark, str(tmp_path / "c")).orderBy("pos").collect()
    assert [r["name"] for r in got] == ["A", "B1", "B2", "B3", "C1", "C2", "D"] and len({r["pos"] for r in got}) == 7


class Fake:
    def __init__(self):
        self.calls, self.waits, self.fail = [], [], 2

    def fetch(self, params):
        self.calls.append(params)
        if params.get("page") == "T1" and self.fail:
            self.fail -= 1
            return 503, {}
        if "list" in params:
            if "cmcontinue" in params:
                return 200, {"query": {"categorymembers": [{"title": "T2"}]}}
            return 200, {"query": {"categorymembers": [{"title": "T1"}]}, "continue": {"cmcontinue": "x"}}
        return (200, {"parse": {"wikitext": {"*": "text"}}}) if params["page"] == "T1" else (200, {"error": "missing"})


def test_wiki_client(tmp_path):
    f = Fake()
    c = wiki.Client(f.fetch, str(tmp_path), sleep=f.waits.append, now=lambda: 0.0)
    assert list(c.members("K")) == ["T1", "T2"] and c.wikitext("T1") == "text" and c.wikitext("T1") == "text"
    assert len(f.calls) == 5 and 2.0 in f.waits and 4.0 in f.waits and any(1.0 <= w <= 1.4 for w in f.waits)
    with pytest.raises(KeyError):
        c.wikitext("T2")
    assert len(list(tmp_path.iterdir())) == 3  # errors are not kept


def test_wiki_source(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        f = Fake()
        f.fail = 0
        return wiki.Client(f.fetch, folder, sleep=lambda s: None, now=lambda: 0.0)

    spark.dataSource.register(wiki.make_source("fakewiki", make))
    got = spark.read.format("fakewiki").option("category", "K").load().orderBy("pos").collect()
    assert [(r["title"], r["wikitext"], r["error"] is None) for r in got] == [("T1", "text", True), ("T2", None, False)]
