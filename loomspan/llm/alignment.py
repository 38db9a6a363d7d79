"""Cross-tokenizer alignment.

Two tokenizers cut the same bytes. For every A token the B tokens that overlap it are found in a static interval index over B's byte
ranges (sorted starts and ends, queried by bisection); the gaps between bytes that no token of either side spans are the group
boundaries. An A and a B token that end together are linked.

Both tokenizers cut a text before a space that follows a character other than white space, whatever stands around: A's expression
never matches on from such a character into a space, and no piece of B holds its space mark behind another character. A text is
therefore a row of *units* (a space and what follows), and each distinct unit of a chunk of texts is tokenized and aligned once.

Linked tokens end together, so one's bytes end with the other's: the two vocabularies alone bound the pairs of ids that can ever be
linked (324,297 for the two public ones, whatever the corpus). A link is stored as its number in the table of these pairs, four bytes
each in one value per document; the pairs are counted in the tasks and then by an aggregate, and every task gets the counts as one
array, broadcast on the ground of that bound.

Defined results: texts that are null or empty, or whose joined A or B bytes differ from a space and the text (U+2581 is such a
character), have no tokens: zeros and an empty ``groups_sha256``. Special tokens' strings are plain text. Repeated rows count as often
as they occur; a null doc_id stays null; an empty table gives an empty result; other columns are ignored. Whole texts are aligned: a
very long one is a chunk of its own in memory (about 100 bytes a character).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import _LETTERS, _runs

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_LONGS = lambda names: [(n, pa.int64()) for n in names]
_KINDS = pa.schema([*_LONGS(("doc_id", *COUNTS, "n_best", "count_sum")), ("groups_sha256", pa.string())])
_HELD = pa.schema([*_LONGS(("doc_id", *COUNTS)), ("groups_sha256", pa.string()), ("links", pa.binary())])
_MET = pa.schema(_LONGS(("pair", "n")))
#: A pair of ids is one number, A's id in the high bits.
_B_BITS = 32
#: Of texts, of units that go through a tokenizer in one call, and of links: what a task works on at a time.
_CHUNK_BYTES, _CHUNK_UNITS, _CHUNK_LINKS = 1 << 20, 4096, 1 << 20
_NUMBER = np.dtype("<i4")
#: Words behind which the next space is no sure cut: empty ones, and those that end in what either side may take for white space.
_LOOSE = re.compile(r"\A\Z|[\s\u180e\u200b\ufeff]\Z")
_SPACE_MARK = "\u2581"
#: Units of ASCII and Latin letters, which every version of Unicode puts into the same classes.
_LATIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*+\Z")
#: The expression of the byte-level pre-tokenizer.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Token bytes of both tokenizers, and the ids of units."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {letter: b for b, letter in _LETTERS.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        of_id = {i: bytes([byte[c] for c in piece]) for piece, i in vocabulary.items()}
        self.a_bytes = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        with open(a_path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        self.fast = None
        # where ids rank the merges, Latin text can go through the plain merge loop, which gives the same ids
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made == sorted(made):
            self.fast = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks={b: i for i, b in of_id.items()}, special_tokens={})

        self.b = SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        if any(_SPACE_MARK in self.b.id_to_piece(i).lstrip(_SPACE_MARK) for i in range(size)):
            raise ValueError("a piece of B goes on over a space, so texts cannot be cut there")
        self.b_bytes = [self._piece_bytes(i) for i in range(size)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        told = lambda side, mark: np.array([f"{i}{mark}" for i in range(len(side))], object)
        self.a_told, self.a_last, self.b_told, self.b_last = told(self.a_bytes, ","), told(self.a_bytes, "|"), told(self.b_bytes, ","), told(self.b_bytes, ";")

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(_SPACE_MARK, " ").encode()

    def possible_pairs(self) -> np.ndarray:
        """All pairs of ids whose bytes end alike as far as the shorter one goes, sorted: what can ever be linked."""

        def by_bytes(side: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, x in enumerate(side):
                if x:
                    out.setdefault(x, []).append(i)
            return out

        a, b = by_bytes(self.a_bytes), by_bytes(self.b_bytes)
        longer_a = [(i, j) for x, ids in a.items() for k in range(len(x)) for j in b.get(x[k:], ()) for i in ids]
        longer_b = [(i, j) for x, ids in b.items() for k in range(1, len(x)) for i in a.get(x[k:], ()) for j in ids]
        return np.sort(np.array([(i << _B_BITS) | j for i, j in longer_a + longer_b], np.int64))

    def _joined(self, encode, units: list[str], table: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that follow each other with sure cuts between them, in one call; None if it changes their bytes."""
        text = "".join(units)
        ids = encode(text)
        if b"".join([table[i] for i in ids]) != text.encode():
            return None
        ids = np.array(ids, np.int64)
        ends = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy())
        return ids, np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, "right"), prepend=0)

    def _a_singly(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def _b_singly(self, units: list[str]) -> list[list[int]]:
        """B adds the first space of a text itself; a lone space, as the end of a text can be, is nothing to it without that."""
        return [ids or [self.b.piece_to_id(_SPACE_MARK)] for ids in self.b.encode([u[1:] for u in units], num_threads=1)]

    def encode(self, units: list[str], latin_units: int, sure_units: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: the ids of all units, and how many each has. The first ``latin_units`` are Latin text, the first ``sure_units`` end and
        start with sure cuts. A bounded number of units is with a tokenizer at a time."""
        out = []
        for joined, singly, table, sizes, most in (
            (self.fast and self.fast.encode_ordinary, self._a_singly, self.a_bytes, self.a_size, latin_units if self.fast else 0),
            (lambda text: self.b.encode(text[1:]), self._b_singly, self.b_bytes, self.b_size, sure_units),
        ):
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for at in range(0, len(units), _CHUNK_UNITS):
                for lo, hi in ((at, min(at + _CHUNK_UNITS, max(at, most))), (max(at, most), at + _CHUNK_UNITS)):
                    if part := units[lo:hi]:
                        ids = self._joined(joined, part, table, sizes) if hi <= most else None
                        if ids is None:
                            lists = singly(part)
                            ids = np.array([i for x in lists for i in x], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
                        found.append(ids)
            out.append(tuple(np.concatenate(x) for x in zip(*found)))
        return out


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the range [first, last) of the B tokens that share a byte with it.

    Tokens tile the same bytes; both arrays hold their ends in order. First is the B token stabbed by A's first byte, last the one
    behind that stabbed by its last byte.
    """
    a_starts = np.concatenate([[0], a_ends[:-1]])
    b_starts = np.concatenate([[0], b_ends[:-1]])
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


@dataclass
class Aligned:
    """Units aligned, side by side: per unit whether its bytes are kept, its tokens, its groups as text, and its links."""

    kept: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[str]
    links: np.ndarray  # linked pairs of all units, by their number
    upto: np.ndarray  # where each unit's links start, and the end

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.upto)


def _kept(units: list[str], ids: np.ndarray, upto: np.ndarray, table: list[bytes]) -> np.ndarray:
    found = [table[i] for i in ids.tolist()]
    if b"".join(found) == "".join(units).encode() and upto[-1] == len(ids):
        return np.ones(len(units), bool)
    return np.array([b"".join(found[p:q]) == u.encode() for u, p, q in zip(units, upto.tolist(), upto[1:].tolist())], bool)


def align_units(units: list[str], latin_units: int, sure_units: int, tokenizers: Tokenizers, pairs: np.ndarray) -> Aligned:
    """Units as :func:`cut_units` gives them. Those whose bytes a tokenizer changes have no tokens."""
    (a, n_a), (b, n_b) = tokenizers.encode(units, latin_units, sure_units)
    from_zero = lambda n: np.concatenate([[0], np.cumsum(n)])
    kept = _kept(units, a, from_zero(n_a), tokenizers.a_bytes) & _kept(units, b, from_zero(n_b), tokenizers.b_bytes)
    if not kept.all():
        a, b = a[np.repeat(kept, n_a)], b[np.repeat(kept, n_b)]
        n_a, n_b = np.where(kept, n_a, 0), np.where(kept, n_b, 0)
    a_ends, b_ends = np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])
    _, last = overlaps(a_ends, b_ends)
    # no token spans the gap behind an A token if the last B token over it ends there; the two are linked and close a group
    closes = b_ends[last - 1] == a_ends if len(a) else np.zeros(0, bool)
    a_at, b_at = np.flatnonzero(closes) + 1, last[closes]
    links = np.searchsorted(pairs, (a[a_at - 1] << _B_BITS) | b[b_at - 1])
    # tokens in the order in which they are told: the A tokens of a group, then its B tokens
    before = np.concatenate([[0], b_at])
    told = np.empty(len(a) + len(b), object)
    told[np.arange(len(a)) + before[np.searchsorted(a_at, np.arange(len(a)), "right")]] = np.where(closes, tokenizers.a_last[a], tokenizers.a_told[a])
    b_closes = np.zeros(len(b), bool)
    b_closes[b_at - 1] = True
    told[np.arange(len(b)) + a_at[np.searchsorted(b_at, np.arange(len(b)), "right")]] = np.where(b_closes, tokenizers.b_last[b], tokenizers.b_told[b])
    told, ends = told.tolist(), from_zero(n_a + n_b).tolist()
    groups = ["".join(told[p:q]) for p, q in zip(ends, ends[1:])]
    return Aligned(kept, n_a, n_b, groups, links.astype(np.int32), np.searchsorted(a_at, from_zero(n_a), "right"))


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int, int]:
    """Texts as units: an index per unit, where each text's units start (one more entry than texts), and the distinct units, of which
    as many as told first are Latin text with sure cuts around them, and as many as told then have sure cuts.

    Texts are split at every space; a word that ends in white space and an empty one are put together again with the next, as a cut is
    only sure behind a character that is none. Null and empty texts have no unit.
    """
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern(texts, " ")
    coded = pc.list_flatten(split).dictionary_encode()
    words, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    starts = split.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    units, counts = [" " + w for w in words], np.diff(starts)
    loose = np.fromiter((_LOOSE.search(w) is not None for w in words), bool, len(words))
    if loose.any():
        number = {u: k for k, u in enumerate(units)}
        stretches, last = [], 0
        for k in np.flatnonzero(_sums(loose[of], starts)).tolist():
            mine, now = [], ""
            for at in of[starts[k] : starts[k + 1]].tolist():
                if now and not _LOOSE.search(now):
                    mine.append(now)
                    now = ""
                now += units[at]
            mine = [number.setdefault(u, len(number)) for u in (*mine, now)] if len(texts[k].as_py()) else []
            stretches += [of[starts[last] : starts[k]], np.array(mine, np.int64)]
            counts[k], last = len(mine), k + 1
        of, units = np.concatenate([*stretches, of[starts[last] :]]), list(number)
    kind = np.fromiter((2 if _LOOSE.search(u) or _SPACE_MARK in u else 0 if _LATIN.match(u) else 1 for u in units), np.int64, len(units))
    used = np.zeros(len(units), bool)
    used[of] = True
    kind[~used] = 3  # stood only in words that were put together
    order = np.argsort(kind, kind="stable")
    place = np.empty(len(units), np.int64)
    place[order] = np.arange(len(units))
    upto = np.searchsorted(kind[order], [1, 2, 3])
    return place[of], np.concatenate([[0], np.cumsum(counts)]), [units[k] for k in order[: upto[2]].tolist()], int(upto[0]), int(upto[1])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def align_texts(texts: pa.Array, tokenizers: Tokenizers, pairs: np.ndarray) -> list[pa.Array]:
    """Of each text: its counts, the digest of its groups, and its links."""
    of, starts, units, latin_units, sure_units = cut_units(texts)
    unit = align_units(units, latin_units, sure_units, tokenizers, pairs)
    whole = (_sums(~unit.kept[of], starts) == 0) & (np.diff(starts) > 0)
    counts = [np.where(whole, _sums(n[of], starts), 0) for n in (unit.n_a, unit.n_b, unit.n_links, unit.n_links)]
    groups, place = unit.groups, of.tolist()
    digests = [
        hashlib.sha256("".join([groups[u] for u in place[a:b]])[:-1].encode()).hexdigest() if held else ""
        for held, a, b in zip(whole.tolist(), starts.tolist(), starts[1:].tolist())
    ]
    of = of[np.repeat(whole, np.diff(starts))]
    size = unit.n_links[of]
    upto = np.concatenate([[0], np.cumsum(size)])
    links = unit.links[np.repeat(unit.upto[of] - upto[:-1], size) + np.arange(upto[-1])]
    ends = np.concatenate([[0], np.cumsum(counts[3])])
    return [*map(pa.array, counts), pa.array(digests, pa.string()), _to_bytes(links, ends)]


def _to_bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value of four-byte numbers for each stretch between two ``ends``."""
    offsets = pa.py_buffer((ends * _NUMBER.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(numbers.astype(_NUMBER).tobytes())])


def _from_bytes(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values, and where each value's start (one more entry than values)."""
    if not len(held):
        return np.zeros(0, _NUMBER), np.zeros(1, np.int64)
    _, offsets, data = held.buffers()
    starts = np.frombuffer(offsets, np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    flat = np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]].view(_NUMBER)
    return flat, (starts - starts[0]) // _NUMBER.itemsize


def _link_slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_CHUNK_LINKS`` links; a row that has more is one of its own."""
    for a, b in _runs(batch.column(name), _CHUNK_LINKS * _NUMBER.itemsize):
        yield batch.slice(a, b - a)


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document, columns ``SCHEMA``: A is a byte-level BPE file of ``tokenizers``, B a sentencepiece model with byte fallback.

    ``n_links`` equals ``n_groups``, as no token is empty: a group ends where two tokens do.
    """
    context = docs.sparkSession.sparkContext
    possible = Tokenizers(a_path, b_path).possible_pairs()
    sent = context.broadcast(possible)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = None
        for batch in batches:
            tokenizers = tokenizers or Tokenizers(a_path, b_path)
            for a, b in _runs(batch.column(1), _CHUNK_BYTES):
                columns = align_texts(batch.column(1).slice(a, b - a), tokenizers, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], schema=_HELD)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for part in _link_slices(batch, "links"):
                met += np.bincount(_from_bytes(part.column("links"))[0], minlength=len(met))
        pair = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(met[pair])], schema=_MET)

    held = ", ".join(SCHEMA.split(", ")[:5]) + ", groups_sha256 string, links binary"
    aligned = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(align, held), "aligned")
    met = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(possible) + 1, np.int64)
    counts[met["pair"].to_numpy()] = met["n"].to_numpy()
    b_of = np.append(possible & ((1 << _B_BITS) - 1), 0)
    most = np.zeros(int(b_of.max()) + 1, np.int64)
    np.maximum.at(most, b_of, counts)
    told = context.broadcast((counts, (counts == most[b_of]).astype(np.int64)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = told.value
        for batch in batches:
            for part in _link_slices(batch, "links"):
                flat, starts = _from_bytes(part.column("links"))
                sums = [pa.array(_sums(of[flat], starts)) for of in (best, counts)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in ("doc_id", *COUNTS)], *sums, part.column("groups_sha256")], schema=_KINDS)

    return aligned.mapInArrow(rate, SCHEMA)
