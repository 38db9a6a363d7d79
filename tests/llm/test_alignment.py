"""Token alignment against both tokenizers run on whole texts, one document after another."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomspan.llm import alignment as al
from loomspan.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER

SCHEMA = "doc_id long, text string, n_a string, links string"


@pytest.fixture(scope="module")
def tokenizers():
    return al.Tokenizers(BYTE_TOKENIZER, PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def pairs(tokenizers):
    return tokenizers.possible_pairs()


def _plain(text, tokenizers, a_file, b_file):
    """Ids and groups of one text by walking over all byte offsets; None without tokens."""
    if not text:
        return None
    a, b = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)
    whole = (" " + text).encode()
    if b"".join(tokenizers.a_bytes[i] for i in a) != whole or b"".join(tokenizers.b_bytes[i] for i in b) != whole:
        return None

    def spans(ids, table):
        at = 0
        for i in ids:
            yield at, at + len(table[i]), i
            at += len(table[i])

    a_spans, b_spans = list(spans(a, tokenizers.a_bytes)), list(spans(b, tokenizers.b_bytes))
    cuts = sorted({e for _, e, _ in a_spans} & {e for _, e, _ in b_spans})
    links = [(i, j) for e in cuts for _, f, i in a_spans if f == e for _, g, j in b_spans if g == e]
    groups, low = [], 0
    for e in cuts:
        inside = lambda side: ",".join(str(i) for s, f, i in side if low <= s and f <= e)  # noqa: B023, E731
        groups.append(inside(a_spans) + "|" + inside(b_spans))
        low = e
    return a, b, links, ";".join(groups)


def _expected(rows, tokenizers):
    a_file, b_file = Tokenizer.from_file(BYTE_TOKENIZER), SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    a_file.encode_special_tokens = True
    plain = [(i, _plain(t, tokenizers, a_file, b_file)) for i, t in rows]
    count = Counter(link for _, p in plain if p for link in p[2])
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for i, p in plain:
        if p is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = p
            out.append((i, len(a), len(b), groups.count(";") + 1, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest()))
    return out


ODD = [
    "Hello world", "two  spaces   three", " leading", "trailing ", "trailing  ", "line\nbreak\n\nand \n mixed\t tabs \r\n end", "tab\there", "\n", " ", "   ", "don't we'll I'M it's'",
    "<|endoftext|> in a text <s> </s> <0x41> <unk>", "a▁b", "▁", "x ▁ y", "naïve café déjà", "日本語 の テスト", "emoji 👩‍👩‍👧 end", "é combining", " nbsp  x", "　wide　 space",
    "a\x85 b", "a\x1c b \x1d c", "zero​ width﻿ mark", "mongolian᠎ x", "nul\x00 byte", "x" * 500, "1234567890 3.14159 1,000,000", "(a) [b] {c} ...!!!???", "end.\nNext, line; here: now", "snake_case camelCase UPPER", "\r\r \r", "ﬁ ligature ① ½",
]


def test_odd_texts_against_whole_texts(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate([*ODD, None, ""])] + [(None, "Hello world"), (3, "Hello world"), (3, "Hello world")]
    got = al.align_tokens(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3), BYTE_TOKENIZER, PIECE_TOKENIZER)
    assert got.columns == [c.split()[0] for c in al.SCHEMA.split(", ")]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_expected(rows, tokenizers), key=key)


def test_random_texts_against_whole_texts(spark, tokenizers):
    rng = random.Random(7)
    bits = [" ", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "the", "ing", "tion", "A", "b", "é", "ß", "本", "▁", "0", "42", "-", " ", "\x85", "👍", "can't"]
    weights = [9] * 3 + [1] * (len(bits) - 3)
    texts = ["".join(rng.choices(bits, weights, k=rng.randint(0, 40))) for _ in range(600)]
    rows = list(enumerate(texts))
    got = al.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()
    assert sorted(map(tuple, got)) == sorted(_expected(rows, tokenizers))


def test_empty_table_and_long_text(spark, tokenizers):
    assert al.align_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE_TOKENIZER, PIECE_TOKENIZER).collect() == []
    none = al.align_tokens(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    rows = [(1, "some words, again and again. " * 20_000), (2, "z" * 3_000)]
    got = al.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_TOKENIZER, PIECE_TOKENIZER).collect()
    assert [r.n_groups == r.n_links > 0 for r in got] == [True, True]


def test_index_lists_every_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        ends = [np.sort(np.append(rng.choice(np.arange(1, size), min(int(rng.integers(0, size)), size - 1), replace=False), size)) if size > 1 else np.array([1]) for _ in range(2)]
        first, last = al.overlaps(*ends)
        a, b = (list(zip([0, *e[:-1]], e)) for e in ends)
        for (s, e), p, q in zip(a, first, last):
            assert [k for k, (x, y) in enumerate(b) if x < e and s < y] == list(range(p, q))


def test_every_link_is_a_possible_pair(tokenizers, pairs):
    """The bound that the broadcast rests on: linked tokens end together, so one's bytes end with the other's."""
    assert len(pairs) == len(np.unique(pairs)) < 330_000
    columns = al.align_texts(pa.array(ODD), tokenizers, pairs)
    links, starts = al._from_bytes(columns[-1])
    assert np.diff(starts).tolist() == columns[3].to_pylist() and al._from_bytes(columns[-1].slice(3, 2))[0].tolist() == links[starts[3] : starts[5]].tolist()
    for code in pairs[links].tolist():
        a, b = tokenizers.a_bytes[code >> 32], tokenizers.b_bytes[code & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


def test_units_are_sure_cuts(tokenizers):
    """Tokens of the units, one after another, are those of the whole text."""
    for text in ODD:
        of, starts, units, _, _ = al.cut_units(pa.array([text]))
        held = [units[k] for k in of]
        assert "".join(held) == " " + text and starts.tolist() == [0, len(of)]
        (a, _), (b, _) = tokenizers.encode(held, 0, 0)
        assert a.tolist() == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert b.tolist() == tokenizers.b.encode(text)
