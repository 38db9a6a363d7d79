"""Online packing: exact round trip, bounds on padding and open windows, a plain version of the placing rule."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspan.llm import online_packing as op
from loomspan.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, sequence_id string, ids string, grp int"


def _texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    words = ["alpha", "beta,", "Gamma.", "déjà", "x1", "日本", "(paren)"]
    return [" ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.8) * 4) % 900)) for _ in range(n)]


def _docs(spark, texts, parts=3):
    rows = [(i, t, "clash", "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id")


def _whole(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def _check(rows, whole, capacity, slack):
    """Pieces cover every document once, crc and offsets are right, and only whole, nearly whole and power-of-two sequences exist."""
    ids = dict(enumerate(whole))
    cover, places = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cover) == set(ids)
    for doc, spans in cover.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[doc])
    short = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        if at < capacity - slack:
            assert at & (at - 1) == 0
            short += 1
    assert short <= capacity.bit_length()
    return places


def test_round_trip_over_many_tasks_and_rounds(spark):
    texts = [*_texts(400), "", "word " * 5000]
    out = op.pack_online(_docs(spark, texts, 12), TOKENIZER, capacity=256, most=4, group_windows=8)
    rows = out.collect()
    assert out.columns == op.NAMES
    whole = _whole(texts)
    places = _check(rows, whole, 256, 2)
    tokens = sum(map(len, whole))
    assert 256 * (len(places) - 9) <= 1.01 * tokens
    again = {(r.doc_id, r.start, r.sequence_id) for r in op.pack_online(_docs(spark, texts, 12), TOKENIZER, capacity=256, most=4, group_windows=8).collect()}
    assert again == {(r.doc_id, r.start, r.sequence_id) for r in rows}


def test_default_parameters_pad_little(spark):
    texts = _texts(3000, 5)
    rows = op.pack_online(_docs(spark, texts), TOKENIZER).collect()
    whole = _whole(texts)
    places = _check(rows, whole, 2048, 16)
    pad = sum(2048 - n for n in (sum(x for _, x in p) for p in places.values()) if n & (n - 1))
    assert pad <= 0.005 * sum(map(len, whole))


def test_nulls_repeats_and_empty_tables(spark):
    assert op.pack_online(_docs(spark, []), TOKENIZER).collect() == []
    rows = [(1, None), (1, "same text"), (1, "same text"), (None, "same text"), (2, "")]
    got = op.pack_online(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    three = len(_whole(["same text"])[0])
    assert sorted(((r.doc_id is not None, r.doc_id), r.doc_tokens) for r in got if r.start == 0) == sorted(
        [((True, 1), 1), ((True, 1), three), ((True, 1), three), ((False, None), three), ((True, 2), 1)], key=lambda x: (x[0][0], x[0][1] or 0, x[1])
    )
    assert sum(r.length for r in got) == 3 * three + 2


def test_repeated_rows_in_one_id_are_dealt_by_window(spark):
    """A third of all rows share one doc_id and one text; the merging groups go by window and stay even."""
    rows = spark.range(600).selectExpr("IF(id % 3 = 0, 0, id) AS doc_id", "IF(id % 3 = 0, 'the same short text', concat('other ', repeat('word ', CAST(id % 40 AS INT)))) AS text").repartition(8)
    got = op.pack_online(rows, TOKENIZER, capacity=128, most=4, group_windows=8).collect()
    assert sum(1 for r in got if r.start == 0 and r.doc_id == 0) == 200


def test_wrong_parameters(spark):
    with pytest.raises(ValueError, match="power of two"):
        op.pack_online(_docs(spark, []), TOKENIZER, capacity=100)
    with pytest.raises(ValueError, match="merging group"):
        op.pack_online(_docs(spark, []), TOKENIZER, most=64, group_windows=64)


def _plain(lengths, capacity, most, slack):
    """The rule over a plain list: rooms of the open windows, rooms of the emitted ones."""
    rooms, emitted = [], []
    for n in lengths:
        while n:
            fit = [r for r in rooms if r >= n]
            if fit or len(rooms) < most:
                r = min(fit) if fit else capacity
                if fit:
                    rooms.remove(r)
                (rooms if r - n else emitted).append(r - n)
                n = 0
            else:
                r = min(rooms)
                rooms.remove(r)
                n -= r if r > slack else 0
                emitted.append(0 if r > slack else r)
            assert len(rooms) <= most
    return sorted(rooms), emitted


def test_placing_rule_against_plain_lists():
    rng = random.Random(11)
    for _ in range(20):
        capacity, most, slack = 64, rng.randint(1, 6), rng.randint(0, 5)
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        windows, emitted = op.OpenWindows(capacity, most, slack), []
        for i, n in enumerate(lengths):
            for w in windows.add(op.Piece(i, 0, bytes(4 * n), n)):
                emitted.append(w.room)
                assert sum(map(len, w.held)) == capacity - w.room
        assert (sorted(w.room for w in windows.left()), emitted) == _plain(lengths, capacity, most, slack)


def test_poured_windows_are_full_or_powers_of_two():
    rng = random.Random(12)
    windows = []
    for i in range(30):
        w = op.Window(64)
        for k in range(3):
            w.put(op.Piece(3 * i + k, 0, bytes(4 * rng.randint(1, 20)), 20))
        windows.append(w)
    out = list(op.pour(windows, 64))
    sizes = [sum(map(len, w.held)) for w in out]
    assert sum(sizes) == sum(64 - w.room for w in windows) and all(n == 64 for n in sizes[: sum(sizes) // 64])
    assert all(n & (n - 1) == 0 for n in sizes) and len(set(sizes[sum(sizes) // 64 :])) == len(sizes[sum(sizes) // 64 :])
