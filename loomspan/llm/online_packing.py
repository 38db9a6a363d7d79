"""Bounded-space online packing.

Every task reads its documents once, in order, and keeps a fixed number of open windows. A piece goes whole into the open window it
fills best, else into a new window while there are fewer than that number; when neither is possible the fullest window is emitted.
Its gap is padding if it is small (``slack``), otherwise the head of the waiting piece fills it. What a task leaves open are whole
windows, so leftovers are bounded by the tasks, not by the documents; they are dealt into groups of a bounded number of windows and
packed in the same way, round by round, until one group is left. That one's open windows are poured into each other, and the last
tokens of all are cut at powers of two, which need no padding.

Defined results: null and empty texts give one piece holding only the end id; repeated rows are packed as often as they occur; a null
doc_id stays null; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored. Whole texts are
tokenized: a very long one is a chunk of its own in memory (about 30 bytes a character) and gives as many pieces as it fills.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, pieces
from .packing import PartIds, _runs, token_ids

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A row that is still open carries its ids, as a later round may cut it.
_KINDS = pa.schema([*[(c.split()[0], pa.int64()) for c in PACKED.split(", ")], ("ids", pa.binary())])
NAMES = _KINDS.names[:-1]
#: Rounds and tasks have their own ranges of sequence ids.
_ROUND, _TASK = 1 << 58, 1 << 32
_WIDTH = 4


@dataclass(frozen=True)
class Piece:
    """Ids ``start`` to ``start + len(ids) / 4`` of a document of ``tokens`` ids."""

    doc: int | None
    start: int
    ids: bytes
    tokens: int

    def __len__(self) -> int:
        return len(self.ids) // _WIDTH

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: n * _WIDTH], self.tokens), Piece(self.doc, self.start + n, self.ids[n * _WIDTH :], self.tokens)


@dataclass
class Window:
    room: int
    held: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.held.append(piece)
        self.room -= len(piece)


class OpenWindows:
    """At most ``most`` open windows by their room. Bit ``r`` of ``mask`` is set where a window has room ``r``, so the best fit for a
    piece is the lowest set bit at or above its length and the fullest window is the lowest of all."""

    def __init__(self, capacity: int, most: int, slack: int):
        self.capacity, self.most, self.slack = capacity, most, slack
        self.by_room: list[list[Window]] = [[] for _ in range(capacity + 1)]
        self.mask = self.opened = 0

    def _take(self, room: int) -> Window:
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        self.opened -= 1
        return window

    def _keep(self, window: Window) -> None:
        self.by_room[window.room].append(window)
        self.mask |= 1 << window.room
        self.opened += 1

    def add(self, piece: Piece) -> Iterator[Window]:
        """Place one piece of at most ``capacity`` ids; yields the windows that this closes."""
        while True:
            fitting = self.mask >> len(piece)
            if fitting:
                window = self._take(len(piece) + (fitting & -fitting).bit_length() - 1)
            elif self.opened < self.most:
                window = Window(self.capacity)
            else:
                window = self._take((self.mask & -self.mask).bit_length() - 1)
                if window.room > self.slack:
                    head, piece = piece.split(window.room)
                    window.put(head)
                yield window
                continue
            window.put(piece)
            if window.room:
                self._keep(window)
            else:
                yield window
            return

    def left(self) -> list[Window]:
        """The windows still open, fullest first."""
        return [w for windows in self.by_room for w in windows]


def pour(windows: list[Window], capacity: int) -> Iterator[Window]:
    """All pieces of ``windows`` in order, cut wherever a window is full; the rest is cut at powers of two, largest first."""
    total = sum(capacity - w.room for w in windows)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    waiting = [p for w in windows for p in w.held][::-1]
    for size in sizes:
        window = Window(size)
        while window.room:
            piece = waiting.pop()
            if len(piece) > window.room:
                piece, rest = piece.split(window.room)
                waiting.append(rest)
            window.put(piece)
        yield window


class _Rows:
    """Rows of windows as record batches of about ``most`` rows."""

    def __init__(self, first: int, most: int = 20_000):
        self.next, self.most, self.columns = first, most, [[] for _ in _KINDS]

    def add(self, window: Window, still_open: bool = False) -> None:
        offset = 0
        for p in window.held:
            row = (p.doc, p.start, len(p), zlib.crc32(p.ids), p.tokens, self.next, offset, p.ids if still_open else None)
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += len(p)
        self.next += 1

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _KINDS)], schema=_KINDS)
            self.columns = [[] for _ in _KINDS]


def _first_pass(tokenizer_path: str, capacity: int, end_id: int, most: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, windows = PartIds(tokenizer_path), OpenWindows(capacity, most, slack)
        rows, tail = _Rows(TaskContext.get().partitionId() * _TASK), int(end_id).to_bytes(_WIDTH, "little")
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                flat, bounds = token_ids(batch.column(1).slice(a, b - a), parts)
                for doc, lo, hi in zip(batch.column(0).slice(a, b - a).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    ids = flat[lo:hi].tobytes() + tail
                    step = capacity * _WIDTH
                    for at in range(0, len(ids), step):
                        for window in windows.add(Piece(doc, at // _WIDTH, ids[at : at + step], len(ids) // _WIDTH)):
                            rows.add(window)
                yield from rows.flush(rows.most)
        for window in windows.left():
            rows.add(window, still_open=True)
        yield from rows.flush()

    return run


def _merge(capacity: int, most: int, slack: int, number: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        windows, rows = OpenWindows(capacity, most, slack), _Rows(number * _ROUND + key[0].as_py() * _TASK)
        order = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, ids, tokens in zip(*[order[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]):
            for window in windows.add(Piece(doc, start, ids, tokens)):
                rows.add(window)
        for window in pour(windows.left(), capacity) if last else windows.left():
            rows.add(window, still_open=not last)
        return pa.Table.from_batches(list(rows.flush()), _KINDS)

    return run


def pack_online(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, most: int = 64, slack: int | None = None, group_windows: int = 1024) -> DataFrame:
    """Tokenize whole documents and pack them into windows of ``capacity`` ids (a power of two); columns ``PACKED``.

    A task holds at most ``most`` open windows. ``slack`` is the largest gap that is padded rather than filled by a cut (None: a
    128th of the capacity). A merging task holds ``group_windows`` windows, a bounded number whatever the input; each round
    leaves ``most`` of them, so rounds grow with the logarithm of the tasks. Sequences shorter than ``capacity`` by more than
    ``slack`` have a power of two of ids, and there are fewer of them than the capacity has bits.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if group_windows < 2 * most:
        raise ValueError("a merging group must hold at least twice the open windows of a task")
    slack = capacity // 128 if slack is None else slack
    schema = PACKED + ", ids binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    done, closed, number, last = cut(rows.mapInArrow(_first_pass(tokenizer_path, capacity, end_id, most, slack), schema), "online"), [], 0, False
    while True:
        closed.append(done.filter("ids IS NULL").select(*NAMES))
        left = done.filter("ids IS NOT NULL")
        windows = left.filter("offset = 0").count()
        if last or not windows:
            break
        number, groups = number + 1, pieces(windows, group_windows)
        last = groups == 1
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(number), "sequence_id"), F.lit(groups)))
        done = cut(dealt.groupBy("grp").applyInArrow(_merge(capacity, most, slack, number, last), schema), "online-merge")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out
