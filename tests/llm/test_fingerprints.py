import hashlib
import random

import numpy as np
import pytest

from loomspan.llm import fingerprints as fp


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))


def phrases(text, level):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    names, starts = fp._mix(points.astype(np.uint64) + np.uint64(1)), np.array([0])
    for _ in range(level):
        names, starts = fp.parse(names, starts)
    return names


def test_equal_substrings_share_interior_phrases():
    r = random.Random(1)
    shared = words(r, 300)
    for shift in range(5):
        a, b = phrases("x" * shift + words(r, 20) + shared, 3), phrases(words(r, 31) + shared + words(r, 5), 3)
        inside = phrases(shared, 3)[6:-6]
        assert len(inside) > 20 and set(inside.tolist()) <= set(a.tolist()) and set(inside.tolist()) <= set(b.tolist())


def test_phrases_are_short_and_labels_differ():
    r = random.Random(2)
    text = words(r, 400)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    keep = np.append(True, points[1:] != points[:-1])
    names = fp._mix(points[keep].astype(np.uint64) + np.uint64(1))
    label = fp._labels(names, np.array([0]))
    assert label.max() < 6 and (label[1:] != label[:-1]).all()
    assert len(phrases(text, 1)) * 2 <= len(text) <= len(phrases(text, 1)) * 14


def test_batches_do_not_change_fingerprints():
    r = random.Random(3)
    texts = ["", "a", "aaaa" * 50, "ab", *[words(r, k) for k in (1, 2, 5, 50, 500)], "é𝒳" * 40]
    every = fp.sketch(texts)
    for t, row in zip(texts, every):
        assert (fp.sketch([t])[0] == row).all()
    assert (every[0] == 0).all()


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = fp.sketch([text, edited, following])
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(fp.likeness(a, b)), float(fp.likeness(a, c)))
    return out


M64 = 2**64 - 1


def scalar_mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M64
    return h ^ h >> 32


def scalar_parse(names):
    """One level of one document, position by position."""
    merged, i = [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        merged.append(names[i] if j - i == 1 else scalar_mix((names[i] + (j - i) * 0x9E3779B97F4A7C15) & M64))
        i = j

    def toss(left, own):
        low = (left ^ own) & -(left ^ own) or 1
        return 2 * (low.bit_length() - 1) + (own & low != 0)

    labels = [toss(merged[i - 1] if i else own ^ 1, own) for i, own in enumerate(merged)]
    for _ in range(3):
        labels = [toss(labels[i - 1] if i else own ^ 1, own) for i, own in enumerate(labels)]
    begin = [i for i, x in enumerate(labels) if not i or x > labels[i - 1] and x > (labels[i + 1] if i + 1 < len(labels) else -1)]
    return [scalar_mix(sum(x * pow(0xD6E8FEB86659FD93, k, 2**64) for k, x in enumerate(merged[a:b])) & M64) for a, b in zip(begin, [*begin[1:], len(merged)])]


def test_levels_match_a_scalar_version():
    r = random.Random(3)
    for _ in range(60):
        docs = [[scalar_mix(r.choice(b"aabc") + 1) for _ in range(r.randint(1, 60))] for _ in range(r.randint(1, 6))]
        for _ in range(3):
            flat, sizes = np.array([x for d in docs for x in d], np.uint64), [len(d) for d in docs]
            names, starts = fp.parse(flat, np.cumsum(sizes) - sizes)
            docs = [scalar_parse(d) for d in docs]
            assert names.tolist() == [x for d in docs for x in d] and starts.tolist() == (np.cumsum([len(d) for d in docs]) - [len(d) for d in docs]).tolist()


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_operator_matches_brute_force(spark, bucket_rows):
    r = random.Random(4)
    rows = [(i * 7 % 23, words(r, r.randint(0, 80))) for i in range(20)] + [(100, None), (101, ""), (None, "no id here"), (103, "x"), (104, "q" * 3000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, bucket string")
    got = {x["doc_id"]: tuple(x)[1:] for x in fp.fingerprint_documents(df, bucket_rows).collect()}
    assert got == brute(rows)


def test_repeats_single_and_empty(spark):
    schema = "doc_id long, text string"
    rows = fp.fingerprint_documents(spark.createDataFrame([(1, "some text here"), (1, "some text here"), (2, "some text here")], schema), 1).collect()
    assert len(rows) == 3 and len({x["fingerprint"] for x in rows}) == 1 and all(x["near_next"] == 1.0 for x in rows)
    one = fp.fingerprint_documents(spark.createDataFrame([(5, "abcd")], schema)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []


def test_likeness_tells_edits_from_strangers():
    r = random.Random(6)
    texts = [words(r, 300) for _ in range(40)]
    a = fp.sketch(texts)
    edited = fp.sketch([fp.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1])])
    near, far = fp.likeness(a, edited), fp.likeness(a, np.roll(a, -1, 0))
    assert near.min() > 0.2 and far.max() < 0.1
