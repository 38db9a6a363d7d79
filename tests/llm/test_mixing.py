import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.llm import mixing


def test_word_count(spark):
    texts = [None, "", " ", "a", " a ", "a\tb\nc\x0bd\x0ce\rf", "é\u00a0b c", "  x  y  "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_share_out():
    assert mixing.share_out([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.share_out([10, 1000], [3, 1], 1515, 2) == [20.0, 1495.0]
    assert mixing.share_out([], [], 0, 2) == [] and mixing.share_out([0, 5], [1, 1], 7.5, 2) == [0.0, 7.5]


def test_fit_budget_meets_reachable_budgets():
    r = random.Random(0)
    for _ in range(150):
        counts = {r.randint(1, 60): r.randint(1, 9) for _ in range(r.randint(1, 12))}
        total = sum(s * c for s, c in counts.items())
        budget = r.randint(0, total + 5)
        take = mixing.fit_budget(counts, budget, window=300)
        assert all(0 <= take[s] <= counts[s] for s in take)
        got = sum(s * k for s, k in take.items())
        reach = 1
        for s, c in counts.items():
            for _ in range(c):
                reach |= reach << s
        best = max(b for b in range(min(budget, total) + 1) if reach >> b & 1)
        assert got == best or budget - got <= 60 and got <= budget


def test_operator(spark):
    r = random.Random(1)
    docs = [(i, " ".join(["w"] * r.choice([1, 3, 3, 3, 17, 60])), r.choice(["a", "b", "c", "é", None])) for i in range(600)] + [(900, None, "a"), (901, " ", "z"), (902, "x", "z"), (902, "x", "z")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    one = mixing.mix_sources(df, bucket_rows=7)
    rows, again = [tuple(map(str, x)) for x in one.collect()], [tuple(map(str, x)) for x in mixing.mix_sources(df.repartition(3), bucket_rows=7).collect()]
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    source = {d[0]: d[2] for d in docs}
    sizes, taken, target = {}, {}, {}
    for x in one.collect():
        s = source[x["doc_id"]]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + x["size"], taken.get(s, 0) + x["taken"], x["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == mixing.share_out([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order if sizes[s] > 50)


def test_which_documents_are_taken(spark):
    """Of each source and size the plan's number of documents, in the order of their hashes: restated row by row."""
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * r.choice([2, 2, 2, 5])), "hot" if i % 3 else "b") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {x["doc_id"]: x["taken"] // x["size"] for x in mixing.mix_sources(df, bucket_rows=4, run_buckets=3).collect()}
    h = {x[0]: x[1] for x in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text")).collect()}
    groups = {}
    for i, text, source in docs:
        groups.setdefault((source, len(text.split())), []).append(i)
    for ids in groups.values():
        buckets = -(-len(ids) // 4)
        order = sorted(ids, key=lambda i: (min(int(((h[i] % 2**64) >> 11) * 2.0**-53 * buckets), buckets - 1), h[i], i))
        each = min(rows[i] for i in ids)
        more = [i for i in ids if rows[i] > each]
        assert set(more) == set(order[: len(more)]) and all(rows[i] == each + 1 for i in more)


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "x " * 3, "a")], "doc_id long, text string, source string")
    assert {(x["doc_id"], x["size"]) for x in mixing.mix_sources(df).collect()} == {(1, 400_000), (2, 3)}


def test_apply_and_empty(spark):
    docs = [(i, "a b c " * (i % 5), "s" if i % 3 else None, i) for i in range(50)] + [(7, "a b c a b c ", "s", 7)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, _d0 int")
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mix_sources(df).agg(F.sum("taken")).first()[0]
    none = df.filter("false")
    assert mixing.mix_sources(none).collect() == [] and mixing.apply_mix(none).collect() == []
