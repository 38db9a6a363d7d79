import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from loomspan.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_bounds_and_best_fit():
    r = random.Random(0)
    for _ in range(60):
        capacity = r.choice([10, 64, 100])
        lengths = np.array([r.randint(1, capacity) for _ in range(r.randint(1, 60))])
        bins, offsets, used = packing.best_fit_decreasing(lengths, capacity)
        assert np.bincount(bins, weights=lengths).max() <= capacity and len(set(bins.tolist())) == used
        bound = packing.lower_bound(lengths, capacity)
        assert -(-lengths.sum() // capacity) <= bound <= used <= 1.5 * bound + 1
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([], int), 10) == 0
    assert packing.lower_bound(np.array([4] * 6), 10) == 3


def test_tokens_match_the_tokenizer_itself():
    t, parts = Tokenizer.from_file(PATH), packing.PartIds(PATH)
    r = random.Random(1)
    texts = ["don't stop I'll", "İstanbul ΣΑΣ", "éa <|endoftext|> x", "a\u00a0b\x1cc\x85d", "x." * 60, " lead\ttrail \r\n", "Ab,'s it's'!", "№5 ﬁ", "a.\u0301b word.\u0301", "k" * 300]
    texts += ["".join(r.choice("abAB .,!'\n\té-5") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "  ", "Ab " * 100_000, "H\u0331\u00c5 A\u030a. B\u00c5(x)", "x" * 3000 + "."]
    flat, bounds = packing.token_ids(pa.array(texts, pa.string()), parts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert flat[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids
    flat, bounds = packing.token_ids(pa.array([], pa.string()), parts)
    assert len(flat) == 0 and bounds.tolist() == [0]


def test_parts_leave_the_cache_by_generations(monkeypatch):
    monkeypatch.setattr(packing, "_HELD_PARTS", 3)
    parts = packing.PartIds(PATH)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    first = [parts[w] for w in words]
    assert len(parts) <= 3 and len(parts.older) <= 3 and [parts[w] for w in words] == first


def test_a_very_long_text_is_cut_into_full_pieces(spark):
    text = "some words that never end " * 40_000
    rows = packing.best_fit_packing(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), PATH).collect()
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.length for r in mine[:-1]] == [4096] * (len(mine) - 1) and sum(r.length for r in mine) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)


def test_operator(spark):
    r = random.Random(2)
    docs = [(i, " ".join("word" * r.randint(1, 3) for _ in range(r.choice([1, 5, 40, 200])))) for i in range(300)] + [(900, None), (901, ""), (None, "x"), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, piece string")
    rows = packing.best_fit_packing(df, PATH, 64).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(str(doc), k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert sorted((str(x["doc_id"]), x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == sorted(want)
    total = sum(x["length"] for x in rows)
    assert check(rows, 64) <= 1.02 * packing.lower_bound(np.array([x["length"] for x in rows]), 64) and total


def test_exchange_closes_gaps(spark):
    r = random.Random(3)
    lengths = [r.choice([1, 2, 9, 21, 30, 33, 40, 55, 64]) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    few = check(packing.pack(df, 64, group_rows=100).collect(), 64)
    alone = check(packing.pack(df, 64, group_rows=100, rounds=1).collect(), 64)
    assert packing.lower_bound(np.array(lengths), 64) <= few <= alone and few <= 1.02 * packing.lower_bound(np.array(lengths), 64)


def test_empty(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_workers_get_bounded_batches_of_texts(spark, monkeypatch):
    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('some words of a text ', 500) as text")  # 21 MB in one partition

    def sizes(batches):
        for k, batch in enumerate(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": [0], "piece": pa.array([k], pa.int32()), "start": [batch.nbytes], "length": [batch.num_rows], "ids_crc32": [0]})

    monkeypatch.setattr(packing, "tokenize_pieces", lambda docs, *_: docs.mapInArrow(sizes, packing.PIECE_SCHEMA))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = packing.best_fit_packing(docs, PATH).collect()
    assert sum(r["length"] for r in rows) == 2000 and max(r["start"] for r in rows) <= 1.1 * common.BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_a_worker_gives_its_memory_back_between_tasks(spark):
    def run(batches):
        for batch in batches:
            held = pa.array([str(k) * 20 for k in range(800_000)])
            yield batch.slice(0, min(1, len(held)))

    def left(batches):
        list(batches)
        kb = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon"))
        yield pa.RecordBatch.from_arrays([pa.array([kb])], ["kb"])

    one = spark.range(0, 10, 1, 1)
    fresh = one.mapInArrow(left, "kb long").first()[0]
    one.mapInArrow(common.releasing(run), "id long").count()
    assert one.mapInArrow(left, "kb long").first()[0] <= fresh + 40_000
