import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ngram_join as nj
from loomspan.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def family(r, base, n, rate):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(int(rate * r.random() * len(words))):
            words[r.randrange(len(words))] = f"new{r.random()}"
        out.append(" ".join(words[r.randint(0, 3) :]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    texts = []
    for n, length, rate in ((12, 60, 0.08), (25, 40, 0.1), (6, 200, 0.05), (3, 8, 0.2), (30, 30, 0.06)):
        texts += family(r, [word() + str(r.random()) for _ in range(length)], n, rate)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'x{r.random()}' for _ in range(r.choice([2, 10, 15, 80])))}" for _ in range(25)]
    texts += [texts[0].upper(), texts[0] + "\n", "one two", "ONE\ttwo", "a b c d", "a b c d e", "a b c d e f", "", " \n", None, "é É", "É é", "K \u212a", "x" * 5000]
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_components_match_brute_force(spark, rows):
    df = spark.createDataFrame([(*x, 0, "p") for x in rows], "doc_id long, text string, n int, place string")
    got = sorted(tuple(x) for x in nj.jaccard_components(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (2, "A B C D E F G"), (9, None), (9, None), (None, "a b c d e f g")], "doc_id long, text string")
    got = sorted(((x["doc_id"] is None, x["doc_id"], x["n_shingles"], x["component_id"]) for x in nj.jaccard_components(df).collect()), key=str)
    assert got == sorted([(False, 2, 3, 2), (False, 4, 3, 2), (False, 4, 3, 2), (False, 9, 0, 9), (False, 9, 0, 9), (True, None, 3, 2)], key=str)
    assert nj.jaccard_components(df.filter("false")).collect() == []


def test_keep_one(spark, rows):
    extra = [(1, rows[0][1]), (9000, None), (9000, None)]
    df = spark.createDataFrame([(*x, "keep", 1) for x in rows + extra], "doc_id long, text string, _key string, place int")
    out = nj.keep_one_per_component(df)
    assert out.columns == df.columns
    want = brute(rows + extra)
    kept = sorted(x["doc_id"] for x in out.collect())
    bare = [d for d, n, _ in want if n == 0]
    assert kept == sorted({c for _, n, c in want if n} | set()) + [] if not bare else kept == sorted([*{c for _, n, c in want if n}, *bare])
    assert nj.keep_one_per_component(df.filter("false")).collect() == []


def test_merge_and_probe_match_counting():
    r = np.random.default_rng(1)
    for _ in range(200):
        query = r.permutation(120)[: r.integers(1, 60)]
        records = [r.permutation(120)[: r.integers(0, 60)] for _ in range(int(r.integers(1, 9)))]
        overlap = [len(np.intersect1d(query, x)) for x in records]
        assert nj.merge_short(query, records) == overlap
        assert [nj.probe_long(query, x) for x in records] == overlap
    assert nj.merge_short(query, []) == []


def test_merging_prunes_and_loses_nothing(spark):
    """The links of all pairs of the index, by merge and probe, are those of plain intersection; the merge alone drops most."""
    r = random.Random(2)
    base = r.sample(range(10**6), 80)
    sets = [sorted({*r.sample(base, r.randint(30, 80)), *r.sample(range(10**6), r.randint(0, 25))}) for _ in range(40)]
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, n long, shingles array<long>")
    index = nj._index(df, 75)
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(40) if a != b], "query long, node long")
    overlap = lambda a, b: F.ceil((a + b) * 75 / 175)
    got = {tuple(x) for x in nj._links(pairs, index, overlap).collect()}
    meet = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})
    assert got == {(a, b) for a in range(40) for b in range(40) if a != b and meet(a, b)} and got


def test_the_census_is_linear_in_the_hashes():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 400, 3000, 1, 2000)]
    size = sum(map(len, sets))
    for ranges in (1, 50, 100_000, 10**9):
        rows = list(nj.deal_chunk(sets, ranges))
        assert len(rows) <= min(ranges, size) and sum(len(x[3]) for x in rows) == 4 * size
        assert sum(len(x[1]) + len(x[2]) for x in rows) <= 8 * size
        counts = np.zeros(len(sets), int)
        for _, texts, each, _ in rows:
            np.add.at(counts, np.frombuffer(texts, np.uint32), np.frombuffer(each, np.uint32))
        assert counts.tolist() == [len(s) for s in sets]
    assert list(nj.deal_chunk([], 7)) == [] and list(nj.deal_chunk([sets[0]], 7)) == []


def test_very_long_texts(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = words[:30_000] + ["other"] + words[30_000:]
    far = [f"v{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (8, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in nj.jaccard_components(df).collect()) == brute(rows)


def test_shingle_sets():
    words = nj.WordHashes()
    a, b, c, d = nj.shingle_sets([b"a b c d e f", b"A\tB C\x0bD e F", b"a b c", None], words)
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0
    assert (nj.shingle_sets([b"x"] * 3 + [b"a b c d e f"], words)[3] == a).all()


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randint(-200, 200), r.randint(-200, 200)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, x) for x in range(5001, 5050)] + [(7, 7)]
    got = {x["node"]: x["comp"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(len(edges)):
        old = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if old == least:
            break
    assert got == least


def test_connected_components_of_long_chains_of_hashes(spark):
    r = random.Random(5)
    chains = [[r.getrandbits(63) - 2**62 for _ in range(n)] for n in (3000, 2, 700)]
    edges = [e for c in chains for e in zip(c, c[1:])]
    r.shuffle(edges)
    got = {x["node"]: x["comp"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(c) for c in chains for n in c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
