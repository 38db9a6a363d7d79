"""Best-fit packing with certified repacking.

Documents become token pieces of at most ``capacity`` tokens; pieces are spread over groups of bounded size and each group
is packed by best-fit decreasing. Dual-feasible functions give every group a lower bound on its bin count. Bins of groups
with a gap, and the emptiest bins of all groups, give their pieces back; these are regrouped and packed again until nothing
improves. Groups hold a bounded number of pieces whatever the input, so no task grows with the corpus.

Defined results: null and empty texts give one piece holding only the end id; repeated rows are packed as often as they
occur; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored. Whole texts are tokenized:
a very long one is a chunk of its own in memory (about 30 bytes a character) and gives as many pieces as it fills.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, drop, pieces, releasing

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
_HELD_PARTS = 200_000  # word parts remembered, in each of two generations
_CHUNK_BYTES = 4 << 20
_ENDS = ".,!?%&$#*:;\"()-|"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for the letters from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class PartIds(dict):
    """Word part to packed little-endian ids; a full generation becomes the older one, and what is used again stays.

    A part of Latin letters is one unit to the pre-tokenizer, and the normalizer puts it in lower case and does nothing else:
    the vocabulary's merges are applied to it straight away. Any other part goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merge = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            if part.isalpha() and (part.isascii() or max(part) < "\u0250") and (low := part.lower()).isalpha():
                found = [t.id for t in self.merge(low if low.isascii() else low.encode().decode("latin-1").translate(_LETTERS))]
            else:
                found = self.tokenizer.encode(part, add_special_tokens=False).ids
            ids = array("I", found).tobytes()
        if len(part) <= 48:
            if len(self) >= _HELD_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


def token_ids(texts: pa.Array, parts: PartIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all whole texts in one array, and where each text's ids start (one more entry than texts).

    The vocabulary's pre-tokenizer never joins across white space, so the ids of a text are those of its words in order. It also
    splits punctuation from letters, so a word that ends in a letter and then ASCII punctuation is put together from two
    parts; ASCII parts are looked up in lower case, which is what the normalizer makes of them. Every distinct part of the
    texts is looked up once, and the occurrences are laid out by index.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.list_flatten(split).dictionary_encode()
    of, words = coded.indices.to_numpy(), coded.dictionary
    bare = pc.utf8_rtrim(words, characters=_ENDS)
    stems = pc.if_else(pc.match_substring_regex(bare, r"\pL$"), bare, words)
    ends = np.flatnonzero(pc.binary_length(stems).to_numpy() < pc.binary_length(words).to_numpy())
    sizes = pc.utf8_length(stems.take(pa.array(ends))).to_pylist()
    tails = np.full(len(words), "", object)
    tails[ends] = [w[n:] for w, n in zip(words.take(pa.array(ends)).to_pylist(), sizes)]
    tails = pa.array(tails, pa.string())
    stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
    stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
    distinct = [parts[p] if p else b"" for p in (*stems.dictionary.to_pylist(), *tails.dictionary.to_pylist())]
    ids = np.frombuffer(b"".join(distinct), "<u4")
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
    starts = np.cumsum(lengths) - lengths
    pair = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], 1)[of].reshape(-1)
    each = lengths[pair]
    upto = np.concatenate([[0], np.cumsum(each)])
    flat = ids[np.repeat(starts[pair] - upto[:-1], each) + np.arange(upto[-1])]
    return flat, upto[2 * split.offsets.to_numpy()]


def _runs(texts: pa.Array, size: int = _CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` bytes of text, whatever the batch size; a longer text is one of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece number, start, length, CRC-32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = PartIds(tokenizer_path)
        tail = int(end_id).to_bytes(4, "little")
        step = 4 * capacity
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                flat, bounds = token_ids(batch.column(1).slice(a, b - a), parts)
                for doc, lo, hi in zip(batch.column(0).slice(a, b - a).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    ids = flat[lo:hi].tobytes() + tail
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions.

    For a threshold t up to half the capacity, lengths above capacity - t count as whole bins, lengths under t as nothing
    and the rest as themselves: a feasible rounding, so the rounded volume bounds the bin count. A second family rounds a
    length x to floor((k + 1) x / capacity) / k unless (k + 1) x / capacity is whole, where x keeps its own share.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(volume[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        whole = int(number[-1] - number[capacity - t + 1])
        rest = int(volume[capacity - t + 1] - volume[t])
        best = max(best, whole + -(-rest // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        units = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece. Open bins are kept by free space; the tightest fit is the lowest set bit at or above
    the piece's length in a bit mask of free spaces, so a piece costs one shift."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            if not free[left]:
                mask |= 1 << left
            free[left].append(b)
    return bins, offsets, opened


def _group_packer(capacity: int, last: bool):
    """Packs one group; unless it is the last round, marks the bins whose pieces go to the exchange."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        give = np.zeros(used, bool)
        if not last:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            give[np.argsort(fill, kind="stable")[: 1 + 4 * (used - bound)]] = True
        return pdf[NAMES].assign(grp=key[0], bin=bins, offset=offsets, group_bins=used, group_bound=bound, open=give[bins])

    return run


def pack(found: DataFrame, capacity: int = 4096, group_rows: int = 4096, rounds: int = 4) -> DataFrame:
    """Pack pieces (``PIECE_SCHEMA``); adds ``sequence_id``, ``offset``, ``group_bins``, ``group_bound``.

    ``group_bound`` is the certified least number of bins of the row's last group and ``group_bins`` what it used.
    A round packs the open pieces in hashed groups of about ``group_rows``; a group's bins stay closed if they are full
    enough, the others (its emptiest bin, and as many as the gap asks for) go to the next round's exchange. The last round
    keeps everything. The exchange shrinks by orders of magnitude a round; no step collects pieces to the driver.
    """
    schema = PIECE_SCHEMA + ", grp long, bin long, offset long, group_bins long, group_bound long, open boolean"
    left, closed = found, []
    for k in range(rounds):
        n = left.count()
        if not n and k:
            break
        groups = pieces(n, group_rows)
        last = k == rounds - 1 or groups == 1

        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(k), "doc_id", "piece", "ids_crc32"), F.lit(groups)))
        done = cut(dealt.groupBy("grp").applyInPandas(_group_packer(capacity, last), schema), "packing")
        closed.append(
            done.filter(~F.col("open")).select(
                *NAMES,
                ((F.lit(k).cast("long") * (1 << 58)) + F.col("grp") * (1 << 24) + F.col("bin")).alias("sequence_id"),
                "offset", "group_bins", "group_bound",
            )
        )
        if last:
            break
        left = done.filter("open").select(*NAMES)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize whole documents and pack them into as few sequences as the bounds allow."""
    found = cut(tokenize_pieces(docs, tokenizer_path, capacity, end_id), "pieces", BATCH_BYTES)
    out = pack(found, capacity)
    drop(found)  # the first round has read it
    return out
