"""Very long texts and pages: no recursion over a text, and no cost that grows with its square."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspan.llm import license_scan as ls
from loomspan.llm import secret_scan as ss
from loomspan.llm import url_filter as uf


def test_licence_scan_of_dotted_and_dashed_words(spark):
    texts = ["Copyright table 1" + ".1" * 500_000, "released under cc-by" + "-sa" * 200_000 + " 4.0", "Licensed under CC BY-SA 4.0."]
    rows = ls.licence_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["families"] for r in rows}[2] == "CC-BY-SA" and len(rows) == 3


def _plain_spans(text, rules):
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), rank, m.end(), r.kind))
    return sorted(found)


def _plain_redacted(text, spans):
    out, at = "", 0
    for start, _, end, _ in spans:
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def test_spans_and_redaction_against_plain_python(spark):
    rng = random.Random(9)
    bits = ["password=hunter22 ", "token: abcdefgh", "0123456789abcdef01234567", "AKIA" + "A1" * 10, "👍é", " word", "\n", "secret = 0123456789abcdef0123456789", "x" * 700, "ghp_" + "a" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(150)] + ["", None, "x" * ss._BLOCK, "y" * (ss._BLOCK - 24) + "0123456789abcdef01234567", "0123456789abcdef01234567" * 3]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in ss.find_secrets(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in ss.redact_secrets(df).collect()}
    for i, t in rows:
        spans = _plain_spans(t or "", ss.RULES)
        assert [(s, e, k) for s, _, e, k in found[i]] == [(s, e, k) for s, _, e, k in spans], i
        assert clean[i] == (t if t is None else _plain_redacted(t, spans)), i


def test_a_hundred_thousand_spans_take_seconds(spark):
    text = "".join(f"{k:032x} file{k}\n" for k in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ss.redact_secrets(spark.createDataFrame([(1, "00112233445566778899aabbcc")], "doc_id long, text string")).collect()  # compiles
    start = time.time()
    clean = ss.redact_secrets(df).first()["text"]
    assert time.time() - start < 60
    assert clean == re.sub(r"[0-9a-f]{24,}", "<secret>", text)


@pytest.mark.parametrize("page", ["<link " * 60_000, "<link " * 60_000 + ">", "<meta " * 60_000 + ">" + "<meta " * 60_000, "<" * 400_000, "<link rel=" * 40_000 + ">"])
def test_malformed_pages_cost_their_length(spark, page):
    df = spark.createDataFrame([(page,)], "h string")
    start = time.time()
    assert df.select(uf.alias_targets(F.col("h")).alias("t")).first()["t"] == []
    assert time.time() - start < 20


def test_links_inside_odd_tags_are_found(spark):
    page = "<link <link rel=canonical href=/a> <link rel='x' href='/no'> <meta <meta http-equiv=refresh content='0; url=/b'> <link rel=canonical href=/c"
    assert spark.createDataFrame([(page,)], "h string").select(uf.alias_targets(F.col("h")).alias("t")).first()["t"] == ["/a", "/b"]
