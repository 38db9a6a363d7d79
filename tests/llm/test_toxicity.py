import random
import zlib

import numpy as np

from loomspan.llm import toxicity as tx
from loomspan.llm.boosting import BoostedTrees, isotonic


def table(spark, n=600, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(3, 8)))
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        words = [word() for _ in range(r.randint(10, 60))]
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["you idiot", "zorkan", "zorkel", "pathetic", "id10t"]))
        docs.append((i, " ".join(words), "en", "src", len(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    got = tx.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.9 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, 200)
    a = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels).collect()}
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert a == {r["doc_id"]: r["score"] for r in tx.toxicity(docs, flipped).collect()}


def test_odd_rows(spark):
    docs, labels = table(spark, 120)
    odd = spark.createDataFrame([(None, "text", "x"), (1000, None, "x"), (1001, "", "x"), (1002, "you idiot " * 20000, "x"), (5, "again", "x"), (5, "again", "x")], "doc_id long, text string, toxic string")
    more = labels.union(spark.createDataFrame([(None, None, 1), (3, 1, None), (4, 0, 1), (4, 0, 0)], labels.schema))
    got = tx.toxicity(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), more)
    assert got.count() == 126 and got.filter("score is null or held_out is null").count() == 0
    assert tx.toxicity(odd, more).count() == 6


def test_empty_and_unlabelled(spark):
    docs, labels = table(spark, 30)
    assert {r["score"] for r in tx.toxicity(docs, labels.filter("false")).collect()} == {0.0}
    assert tx.toxicity(docs.filter("false"), labels).collect() == []


def test_reject_keeps_all_columns(spark):
    docs, labels = table(spark, 300)
    model = tx.train_toxicity(docs, labels)
    kept = tx.reject_toxic(docs, model)
    assert kept.schema == docs.schema
    scored = {r["doc_id"] for r in tx.score_toxicity(docs, model).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == scored


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = BoostedTrees(trees=60, depth=3).fit(x[:2000], y[:2000])
    assert ((t.raw(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert BoostedTrees().fit(x[:0], y[:0]).raw(x[:2]).tolist() == [0.5, 0.5]
    raw = r.random(500)
    xs, ys = isotonic(raw, (r.random(500) < raw).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and abs(np.interp(raw, xs, ys).mean() - raw.mean()) < 0.1
