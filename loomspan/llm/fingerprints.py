"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On each level runs of one name collapse, deterministic coin tossing labels every
position from its few left neighbours only, and local maxima of the labels start phrases; a phrase is named by the hash of the
names in it. So equal substrings get equal phrases, but for a few names at their edges, whatever their offset. The
fingerprint keeps, for each of 128 hash slots, one byte of the smallest phrase name of levels ``LOW`` to ``HIGH`` in that
slot; the share of equal slots estimates how alike two phrase sets are.

Documents of a batch are parsed together as one array, with phrase breaks between them.

Defined results: null text counts as empty; an empty text has a fingerprint of empty slots, alike (1.0) only to another such
one; a null doc_id sorts after all others; repeated doc_ids are ordered by a hash of their text; with one document the next
document is itself; an empty table gives an empty result; other columns are ignored. Whole texts are parsed; a very long one
takes about 100 bytes a character while it is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, shuffle_partitions

SLOTS, LOW, HIGH = 128, 2, 4
_BATCH_CHARS = 1 << 20
_M = np.uint64(0xD6E8FEB86659FD93)
_M_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_ONE = np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _toss_table(values: int) -> np.ndarray:
    """Coin tossing of small labels as a table: [left, own] to 2 * lowest differing bit + own bit there."""
    left, own = np.meshgrid(np.arange(values), np.arange(values), indexing="ij")
    low = (left ^ own) & -(left ^ own)
    low[low == 0] = 1
    return (2 * np.log2(low).astype(np.int64) + ((own & low) != 0)).astype(np.uint8)


_TOSS = _toss_table(128)


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels 0..5, neighbours distinct, each decided by the position and its four left neighbours.

    A document's first position tosses against its own value with the lowest bit flipped.
    """
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[starts] = names[starts] ^ _ONE
    differ = left ^ names
    low = differ & (~differ + _ONE)
    label = (np.bitwise_count(low - _ONE) << 1 | ((names & low) != 0)).astype(np.uint8)
    before = np.empty_like(label)
    for _ in range(3):
        before[1:] = label[:-1]
        before[starts] = label[starts] ^ 1
        label = _TOSS[before, label]
    return label


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _named(names: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of every phrase ``names[begin[i]:begin[i + 1]]``: a polynomial by prefix sums, free of the phrase's offset."""
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * _powers(len(names), _M), out=total[1:])
    return _mix((total[np.append(begin[1:], len(names))] - total[begin]) * _powers(len(names), _M_INV)[begin])


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: phrase names, and where each document's phrases start. Every document must hold a name."""
    first = np.zeros(len(names), bool)
    first[starts] = True
    fresh = first.copy()
    fresh[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(fresh)
    if len(at) < len(names):
        run = np.diff(np.append(at, len(names))).astype(np.uint64)
        names = names[at]
        names = np.where(run > 1, _mix(names + run * np.uint64(0x9E3779B97F4A7C15)), names)
        first = first[at]
        starts = np.flatnonzero(first)
    label = _labels(names, starts).astype(np.int8)
    after = np.empty_like(label)
    after[:-1] = label[1:]
    after[np.append(starts[1:], len(names)) - 1] = -1
    before = np.empty_like(label)
    before[1:] = label[:-1]
    cut_at = first | ((label > before) & (label > after))
    begin = np.flatnonzero(cut_at)
    return _named(names, begin), np.flatnonzero(first[begin])


def sketch(texts: list[str]) -> np.ndarray:
    """Slot bytes of every whole text; 0 marks an empty slot."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    lengths = np.array([len(texts[i]) for i in full], np.int64)
    points = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    names, starts = _mix(points.astype(np.uint64) + _ONE), np.cumsum(lengths) - lengths
    least = np.full(len(full) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, HIGH + 1):
        names, starts = parse(names, starts)
        if level >= LOW:
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(names))))
            np.minimum.at(least, owner * SLOTS + (names >> np.uint64(57)).astype(np.int64), names & np.uint64((1 << 57) - 1))
    empty = least == np.iinfo(np.uint64).max
    byte = (_mix(least) % np.uint64(255) + _ONE).astype(np.uint8)
    byte[empty] = 0
    out[full] = byte.reshape(len(full), SLOTS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that are not empty in both; 1 for two empty fingerprints."""
    some = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    return np.where(some > 0, same / np.maximum(some, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order (bucket, lent, descending id); a bucket ends with the lent first document of the one below."""
    held: list[tuple[int, bool, int | None, str]] = []
    known: np.ndarray | None = None  # fingerprint of held[0]
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, known
        marks = sketch([r[3] for r in held[0 if known is None else 1 :]])
        if known is not None:
            marks = np.concatenate([known[None], marks])
        pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        changed = [edited(held[i][3], held[i + 1][3]) for i in pairs]
        other = sketch(changed)
        mine, following = marks[pairs], marks[[i + 1 for i in pairs]]
        held, known = held[-1:], marks[-1]
        return mine, following, other, changed, pairs

    def emit(rows: list) -> pa.RecordBatch:
        mine, following, other, changed, pairs = flush()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([m.tobytes().hex() for m in mine], pa.string()),
                pa.array([m.tobytes().hex() for m in other], pa.string()),
                pa.array(likeness(mine, other), pa.float64()),
                pa.array(likeness(mine, following), pa.float64()),
            ],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )

    for batch in batches:
        for bucket, lent, doc, text in zip(*(batch.column(i) for i in range(4))):
            row = (bucket.as_py(), lent.as_py(), doc.as_py(), text.as_py() or "")
            if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                continue  # the same first document, repeated
            held.append(row)
            chars += len(row[3])
            if chars > _BATCH_CHARS:
                yield emit(held)
                chars = 0
    if len(held) > 1:
        yield emit(held)


def _below(bounds: Column, bits: int, key: Column) -> Column:
    """How many of the bounds (sorted, padded with the largest long to 2**bits) lie under ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.element_at(bounds, p + s) < key, p + s).otherwise(p))


def fingerprint_documents(docs: DataFrame, bucket_rows: int = 2000, max_buckets: int = 1 << 20, part_bytes: int = 64 << 20) -> DataFrame:
    """One row per document, ``SCHEMA``. The next document is the one with the next smaller id.

    Ids are cut into buckets at approximate quantiles in two steps: into ranges (at most the root of ``max_buckets`` numbers reach
    the driver) and each range into buckets by a table that is broadcast, as is that of the buckets' first texts (at most
    ``max_buckets`` rows each, under 64 MB). Every text is shuffled once, to its bucket, and each bucket's first text is lent to
    the bucket above it. Neighbouring buckets share a partition up to about ``part_bytes``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(-(2**63)))
    ).withColumn("tie", F.xxhash64("text"))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    want = min(pieces(n, bucket_rows), max_buckets)
    ranges = math.isqrt(want - 1) + 1
    fine = pieces(want, ranges)
    top = 2**63 - 1

    def quantiles(parts: int) -> Column:
        return F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 50 * max(parts, 200))

    bounds = sorted(set(rows.agg(quantiles(ranges)).first()[0] or [])) if ranges > 1 else []
    bits = max(1, len(bounds).bit_length())
    padded = F.array(*[F.lit(b) for b in bounds + [top] * ((1 << bits) - len(bounds))])
    rows = rows.withColumn("range", _below(padded, bits, F.col("key")))
    fine_bits = max(1, fine.bit_length())
    filled = lambda b: F.concat(b, F.array_repeat(F.lit(top), F.lit(1 << fine_bits) - F.size(b)))
    inner = cut(rows.groupBy("range").agg(quantiles(fine).alias("b")).select("range", filled(F.array_sort(F.array_distinct("b"))).alias("inner")), "mark-bounds")
    # null-safe, as the planner would infer a filter for the other side from an equality with a computed range
    inner = inner.withColumnRenamed("range", "of_range")
    rows = rows.join(F.broadcast(inner), F.col("range").eqNullSafe(F.col("of_range")))
    rows = rows.withColumn("bucket", F.col("range") * (1 << fine_bits) + _below(F.col("inner"), fine_bits, F.col("key"))).drop("inner", "of_range")

    heads = rows.groupBy("range", "bucket").agg(F.max(F.struct("key", "tie")).alias("head"))
    heads = cut(heads.withColumn("above", F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket"))), "mark-heads")
    lowest = {r["range"]: r["low"] for r in heads.groupBy("range").agg(F.min("bucket").alias("low")).collect()}
    used = sorted(lowest)
    after = {r: lowest[used[(i + 1) % len(used)]] for i, r in enumerate(used)}
    beyond = F.element_at(F.array(*[F.lit(after.get(r, 0)) for r in range(len(bounds) + 1)]), F.col("range") + 1)
    heads = heads.select(F.col("bucket").alias("of_bucket"), F.col("head.key").alias("h_key"), F.col("head.tie").alias("h_tie"), F.coalesce("above", beyond).alias("above"))
    rows = rows.join(F.broadcast(heads), F.col("bucket").eqNullSafe(F.col("of_bucket")))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("lent"))
    also = F.struct(F.col("above").alias("to"), F.lit(True).alias("lent"))
    head = (F.col("key") == F.col("h_key")) & (F.col("tie") == F.col("h_tie"))
    dealt = rows.withColumn("at", F.explode(F.when(head, F.array(own, also)).otherwise(F.array(own))))
    places = min(want, max(shuffle_partitions(spark), pieces(size, part_bytes)))
    # ranges are even in rows, and so are their buckets, but not every bucket number is used
    place = F.floor((F.shiftright("to", fine_bits) + F.least(F.col("to") % (1 << fine_bits) / F.lit(float(fine)), F.lit(0.999999))) * F.lit(places / (len(bounds) + 1)))
    ordered = (
        dealt.select(F.col("at.to").alias("to"), F.col("at.lent").alias("lent"), "doc_id", "text", "key", "tie")
        .repartitionById(places, F.least(place, F.lit(places - 1)).cast("int")).sortWithinPartitions("to", "lent", F.desc("key"), F.desc("tie"))
    )
    return ordered.select("to", "lent", "doc_id", "text").mapInArrow(_fingerprint, SCHEMA)
