import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomspan.llm import mixing, packing, toxicity  # noqa: E402
from loomspan.llm.common import cut, table  # noqa: E402
from loomspan.llm.ngram_join import jaccard_components  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_key", "found0", "size", "piece"]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_duplicates":
            linked = jaccard_components(docs)
            assert linked.filter("component_id <> doc_id").count() == 0
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "secrets":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ids
    assert counts[0] >= counts[1] >= counts[2] == counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}


def test_empty(spark):
    docs = table(spark, SF, "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.count() == 0


# --- a plain version of every stage, one document after another ------------------------------------------------------------


def plain_score(text, model):
    """Features token by token, every tree walked by hand, the calibration read off its knots."""
    tokens = (text or "").split()
    n, x = len(tokens), [0.0] * 20
    if n:
        seen = []
        for t in tokens:
            core = t.strip(toxicity._PUNCT)
            word = core.lower()
            letters = word.isalpha()
            bare = word if letters else "".join(dict(zip("013457@$!|", "oieastasil")).get(c, c) for c in word)
            look = lambda w: float(np.float32(model.lexicon.get(w, 0.0)))
            seen.append({
                "insult": bare in toxicity.INSULTS, "weight": look(word) or look(bare), "stem": max(look(bare[:4] + "*"), look(bare[:5] + "*")), "you": word in toxicity.SECOND_PERSON,
                "caps": len(core) > 1 and core.isupper(), "mixed": not letters and bool(re.search(r"[\d@$!*|]", core)) and any(map(str.isalpha, core)),
                "long": bool(re.search(r"([^\W\d_])\1\1", word)), "marks": len(t) - len(core) if letters else sum(c in toxicity._PUNCT for c in t), "word": word,
            })
        total = lambda k: float(sum(s[k] for s in seen))
        some = lambda k: float(sum(s[k] > 0 for s in seen))
        hits = [i for i, s in enumerate(seen) if s["insult"] or s["weight"] or s["stem"]]
        near = sum(any(seen[j]["you"] for j in range(max(0, i - 4), min(n, i + 5))) for i in hits)
        x = [
            math.log1p(n), total("insult"), total("insult") / n * 100, some("weight"), some("weight") / n * 100, total("weight"), max(s["weight"] for s in seen), len({seen[i]["word"] for i in hits}) / n * 100,
            near, near / n * 100, total("caps") / n * 100, total("marks") / n, text.count("!") / n, total("mixed") / n * 100, total("long") / n * 100,
            some("stem"), some("stem") / n * 100, total("stem"), total("stem") / n * 100, max(s["stem"] for s in seen),
        ]
    score = model.trees.base
    for feature, limit, value in model.trees.model:
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > limit[node] else 1)
        score += value[node - len(feature)]
    raw, (xs, ys) = 1 / (1 + math.exp(-score)), model.knots
    i = next((i for i, at in enumerate(xs) if at > raw), len(xs))
    even = ys[0] if i == 0 else ys[-1] if i == len(xs) else ys[i - 1] + (ys[i] - ys[i - 1]) * (raw - xs[i - 1]) / (xs[i] - xs[i - 1])
    return min(1.0, max(0.0, 0.995 * even + 0.005 * raw))


def plain_near_duplicates(docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    best = {}
    for d, s, g in zip(docs, sets, group):
        if s and (g not in best or d["doc_id"] < best[g]["doc_id"]):
            best[g] = d
    return [d for d, s, g in zip(docs, sets, group) if not s or best[g] is d]


SECRETS = [
    (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6), (r"(AKIA[A-Z0-9]+)", 0, 20), (r"([0-9a-f]+)", 0, 24),
    (r"(gh[pousr]_[A-Za-z0-9]{36,})", 0, 0), (r"(xox[abprs]-[A-Za-z0-9-]{20,})", 0, 0), (r"(AIza[A-Za-z0-9_-]{35})", 0, 0), (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, 0),
    (r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 0),
]


def plain_secrets(docs):
    """Every character inside a span goes; a span that overlaps the one before adds no further mark."""
    out = []
    for d in docs:
        text = d["text"]
        spans = sorted((m.start(), m.end()) for p, flags, least in SECRETS for m in re.finditer(p, text or "", flags) if len(m[1]) >= least)
        if spans:
            kept, at = "", 0
            for a, b in spans:
                if a >= at:
                    kept += text[at:a] + "<secret>"
                at = max(at, b)
            text = kept + text[at:]
        out.append({**d, "text": text, "n_chars": None if text is None else len(text)})
    return out


def plain_mix(docs):
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size(d) for d in docs if d["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, list(sources), Fraction(3, 2) * sum(whole.values())
    while open_:
        each = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if each[s] > 2 * whole[s]]
        for s in over or open_:
            target[s] = Fraction(2 * whole[s]) if over else each[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]

    def unit(d):
        h = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(d["doc_id"].to_bytes(8, "little", signed=True), h)
        return h if d["text"] is None else xxhash.xxh64_intdigest(d["text"].encode(), h)

    out = []
    for s in sources:
        own = [d for d in docs if d["source"] == s]
        counts, budget = Counter(map(size, own)), round(float(target[s]))
        each = budget // whole[s] if whole[s] else 0
        more = mixing.fit_budget(dict(counts), budget - each * whole[s])
        for k in counts:
            # below 256 documents of a size there is one bucket; the hash is compared as a signed long
            order = sorted((d for d in own if size(d) == k), key=lambda d: ((unit(d) + 2**63) % 2**64, d["doc_id"]))
            for i, d in enumerate(order):
                out += [d] * (each + (i < more.get(k, 0)) if k else 0)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    texts, bad = [], set()
    for i in range(220):
        w = words(r.randint(10, 60))
        if r.random() < 0.25:
            bad.add(len(texts))
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["you idiot", "zorkan", "zorkel!!", "PATHETIC", "id10t"]))
        texts.append(" ".join(w))
    for _ in range(6):  # drifting near copies of one text
        base = words(50)
        for _ in range(8):
            base[r.randrange(50)] = word()
            texts.append(" ".join(base))
    texts += [texts[0].upper(), texts[1] + "\n", texts[2], texts[2], " ".join(words(5000)), "", "  ", None, "one two", "a b c d e", None]
    keys = ["token = abcdef99", "AKIA" + "B" * 20, "password='0123456789abcdef01234567'", "ghp_" + "x" * 40, "0" * 30, "-----BEGIN RSA PRIVATE KEY-----", "token=abc", "AKIA1"]
    texts += [" ".join([*words(8), k, *words(8), r.choice(keys), "é𝒳"]) for k in keys * 3]
    rows = [(7 * i + 3, t, None, r.choice(["hot", "hot", "a", "é", None]), None if t is None else len(t), "k", i, str(i), i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    labels = [(7 * i + 3, 1, int(i in bad)) for i in range(200)] + [(None, 1, 1), (10, None, None)]
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, found0 int, size string, piece int").write.parquet(place + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(place + "/labels.parquet")
    return place


def told(docs):
    return Counter(tuple(d[c] for c in COLUMNS) for d in docs)


def test_every_stage_matches_a_plain_version(spark, folder):
    """Nulls, empty and long texts, near copies, repeated rows, ties and clashing columns; each stage on what the last one left."""
    docs = table(spark, folder, "documents")
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    plain = {
        "toxicity": lambda rows: [d for d in rows if plain_score(d["text"], model) < 0.3], "near_duplicates": plain_near_duplicates,
        "secrets": plain_secrets, "mixing": plain_mix,
    }
    assert docs.columns == COLUMNS
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, want = cut(stage(spark, docs, folder), name), plain[name](rows)
        got = [r.asDict() for r in docs.collect()]
        assert docs.columns == COLUMNS and told(got) == told(want), name
        assert told(got) != told(rows), name
        rows = want
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, lengths = Counter(), []
    for d in rows:
        ids = np.array(tokens.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            part = ids[k * 4096 : (k + 1) * 4096]
            pieces[d["doc_id"], k, k * 4096, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == pieces
    filled = {}
    for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 4096 and max(lengths) == 4096
    room = []  # best fit decreasing by hand
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(room) if left >= n]
        at = min(fits, key=lambda i: room[i]) if fits else len(room)
        room[at:at + 1] = [(room[at] if fits else 4096) - n]
    assert packing.lower_bound(np.array(lengths), 4096) <= len(filled) <= len(room)
