"""Texts of any length: no expression recurses over a text, and none reads it once per start that leads nowhere."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import markup, names, qa
from loomspan.operators.mentions import mentions, surface_forms

MANY = 1_000_000


def _one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def _mentions(spark, text):
    return mentions(spark.createDataFrame([(0, "e", text)], "entry_pos long, entry_id string, raw_text string"))


@pytest.mark.parametrize("joint", [" ", "\n", " of ", "  the\n"])
def test_a_run_of_a_million_names_is_one_mention(spark, joint):
    rows = _mentions(spark, joint.join(["Bob"] * MANY)).select("match_pos", F.length("surface").alias("n"), "opens").collect()
    joined = {" ": 1, "\n": 1, " of ": 4, "  the\n": 5}[joint]
    assert [tuple(r) for r in rows] == [(0, 3 * MANY + joined * (MANY - 1), True)]


def test_lists_of_names_one_a_line(spark):
    rows = surface_forms(_mentions(spark, "We met " + "\n".join(["Anna Lee"] * 1_500) + ". Then Bob left.")).collect()
    assert len(rows) == 2 and rows[0]["surface"] == " ".join(["Anna Lee"] * 1_500)


def test_a_million_honorifics(spark):
    assert _one(spark, "Lord " * MANY + "Bob", names.strip_honorific) == "Bob"
    assert _one(spark, "Lord " * MANY + "bob", names.strip_honorific) == "Lord bob"


def test_a_million_apostrophes(spark):
    assert _one(spark, "Bob" + "'" * MANY, names.noun_form) == "Bob"
    assert _one(spark, "Bob" + "'s" * MANY, names.noun_form) == "Bob"
    assert _one(spark, "saw Bob" + "'" * MANY + " and Ann", lambda c: qa.proper_nouns(c, True)) == ["Bob", "Ann"]
    assert _one(spark, "saw " + "Bob " * 200_000, lambda c: qa.proper_nouns(c, True)) == ["Bob"]


def _plain_html(html):
    c = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ", html)
    c = re.sub(r"(?s)<[^>]*>", " ", c)
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = c.replace(code, char)
    return " ".join(c.split())


def test_html_text_against_plain_rewrites(spark):
    rng = random.Random(4)
    bits = ["<script>", "<SCRIPT x=1>", "</script>", "</Script>", "<style>", "</style>", "<!--", "-->", "<b>", "</b>", "<", ">", "a", " b ", "&amp;", "&lt;", "<scripty>", "<script", "İ", "\n"]
    pages = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(2_000)]
    got = spark.createDataFrame(list(enumerate(pages)), "i int, t string").select("i", markup.html_text(F.col("t")).alias("r")).collect()
    for r in got:
        assert r["r"] == _plain_html(pages[r["i"]]), pages[r["i"]]


@pytest.mark.parametrize("opener", ["<script>", "<style ", "<!--", "<", "<script", "</script><script>"])
def test_unclosed_openers_cost_their_own_length(spark, opener):
    start = time.time()
    _one(spark, opener * (MANY // len(opener)), markup.html_text)
    assert time.time() - start < 30
