from urllib.parse import quote

import pytest

from loomspan import queries

PROSE = "Long ago the Astral Express left. " * 300
TEXTS = {1: PROSE + "\n'''Été''' [[P|deep]] {{sic|teh}} 一二 end", 2: "é 12\n3", 4: PROSE * 2 + "tail", 5: "\t\n", 7: "Kurz und gut, [[a|b]].", 8: None}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


def fold(text):
    return " ".join(text.split())


def plain(text):
    return text.replace("'''", "").replace("[[P|deep]]", "deep").replace("[[a|b]]", "b").replace("{{sic|teh}}", "teh")


def rows(spark, sf, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_page_url(spark, sf):
    got = rows(spark, sf, "page_url")
    assert {i: r["url"] for i, r in got.items()} == {i: t and "https://w/" + quote(t.replace(" ", "_"), safe="/:()',!&") for i, t in TEXTS.items()}


def test_clean_text(spark, sf):
    got = rows(spark, sf, "clean_text_whole")
    for i in (2, 4, 5):
        t = TEXTS[i]
        assert got[i]["clean"] == fold(f"A B {t} b {t} {t} {t} he x end")
    assert got[1]["clean"].startswith(fold("A B " + plain(TEXTS[1]) + " b")) and got.keys() == TEXTS.keys() and got[8]["clean"] is None


def test_template_fields(spark, sf):
    got = rows(spark, sf, "template_fields_whole")
    assert got.keys() == TEXTS.keys() and got[8]["first"] is None
    for i, t in TEXTS.items():
        if t:
            assert (got[i]["argument"], got[i]["first"], got[i]["second"]) == (f"x {{{{n|{t}}}}} y", t.strip(), "[[a|b]]")
            assert got[i]["field"] == (t.strip().split("\n")[0].strip() or "|two = [[a|b]]")


def test_light_cones(spark, sf):
    got = rows(spark, sf, "light_cone_records_whole", "id")
    assert len(got) == len(TEXTS)
    for i, t in TEXTS.items():
        want = "" if i == 5 else fold(plain(t or "") + " link")
        told = "no_description_template" if i == 5 else "flavor_text_unexpectedly_long" if len(want) > 3000 else "flavor_text_too_short" if len(want) < 10 else ""
        assert (got[f"light-cone-page-{i}"]["raw_text"], got[f"light-cone-page-{i}"]["flags"]) == (want, told)


def test_relic_sets(spark, sf):
    got = rows(spark, sf, "relic_set_records_whole", "id")
    assert len(got) == len(TEXTS)
    # set 1 has pieces 2 and 3, of which 3 is no page; set 4 has 5 to 8; set 2 has 3 to 6; set 7 has 8 and 9
    assert got["relic-set-set-1"]["raw_text"] == "é 12 3" and got["relic-set-set-1"]["error"] == "P3"
    assert got["relic-set-set-4"]["raw_text"] == fold(plain(TEXTS[7])) and got["relic-set-set-4"]["error"] == "P6"


def test_relic_sets_of_long_pieces(spark, tmp_path):
    texts = {i: PROSE for i in (1, 2, 3, 5, 6, 7)}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(spark, str(tmp_path), "relic_set_records_whole", "id")["relic-set-set-1"]
    assert got["raw_text"] == fold(PROSE + PROSE) and got["flags"] == "flavor_text_unexpectedly_long" and got["error"] is None


def test_character_stories(spark, sf):
    got = rows(spark, sf, "character_story_records_whole", "id")
    assert len(got) == 2 * sum(bool((t or "").strip()) for t in TEXTS.values())
    for i, t in TEXTS.items():
        for n, place in ((1, 1), (4, 2)):
            if (t or "").strip():
                one = got[f"character-story-c-{i}-{n}"]
                assert one["raw_text"] == fold(plain(t)) and one["subtitle"] == f"Character Story {place} of 2 · C {i}"
                assert one["flags"] == ("flavor_text_unexpectedly_long" if len(fold(plain(t))) > 5000 else "flavor_text_too_short" if len(fold(plain(t))) < 10 else "")
