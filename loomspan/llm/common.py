"""Shared plumbing of the training-data operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_KNOWN: set[str] = set()
_WRITING: dict[str, int] = {}
_BEFORE: dict[str, str | None] = {}
_LOCK = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of rows with whole texts in one Arrow batch, in the JVM and in the worker: by their number alone, 10,000 texts are one batch.
BATCH_BYTES = 15 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path is opened by Spark alone, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where that is unset, a local session (tests) gets a private
    folder; on a cluster that would be a machine-local one, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _FALLBACK.get(context.applicationId)
        if not root:
            root = _FALLBACK[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomspan-")
    return root.rstrip("/")


@contextlib.contextmanager
def _while_writing(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the time of a write. Writes may overlap: the first makes the setting, the last restores it."""
    with _LOCK:
        if not _WRITING.get(key):
            _BEFORE[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        _WRITING[key] = _WRITING.get(key, 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[key] -= 1
            if not _WRITING[key] and _BEFORE[key] is None:
                spark.conf.unset(key)
            elif not _WRITING[key]:
                spark.conf.set(key, _BEFORE[key])


def cut(df: DataFrame, label: str = "t", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors.

    The shuffle files behind the write are deleted as soon as it is done, as nothing reads them any more. The table itself is
    deleted by :func:`drop`, at the latest when the driver ends. ``batch_bytes`` bounds the Arrow batches that Python workers get.
    """
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/loomspan/{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with contextlib.ExitStack() as settings:
        settings.enter_context(_while_writing(spark, _CLEANUP, "true"))
        if batch_bytes:
            settings.enter_context(_while_writing(spark, _BATCH, str(batch_bytes)))
        df.write.parquet(path)
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        target, system = _located(spark, folder)
        system.deleteOnExit(target)
    out = spark.read.schema(schema).parquet(path)
    out._loomspan_path = path
    return out


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    path = getattr(df, "_loomspan_path", None)
    if path:
        target, system = _located(df.sparkSession, path)
        system.delete(target, True)


def release_memory() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when its task is done, what it held is given back. Spark keeps idle workers for later tasks, beside
    stages that run in the JVM alone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def texts_in(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of a column, a few of them as Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(n: float, per_piece: int) -> int:
    """How many pieces of at most about ``per_piece`` rows hold ``n`` rows."""
    return max(1, math.ceil(n / per_piece))


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge with the smallest node id of its component.

    ``edges`` has long columns ``a`` and ``b``. In a round every node points at its smallest neighbour. Such pointers only ever
    close in pairs, whose smaller node becomes a root; pointers are jumped to their roots, and the edges between different
    roots are the graph of the next round. Each of its nodes stands for two or more of this one, so rounds grow with the
    logarithm of the nodes whatever the ids and the shape, and the loop ends when no edge is left. At the end the rounds'
    pointers are followed backwards. Every step is cut to the shared folder.
    Self loops and repeated edges are harmless; an empty table gives an empty result.
    """
    live = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    rounds = []
    while True:
        roots = _roots(live)
        rounds.append(roots)
        to = lambda end: roots.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: B023, E731
        left = live.filter("a <> b").join(to("a"), "a").join(to("b"), "b").filter("a_up <> b_up")
        rest = cut(left.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "cc-edges")
        drop(live)
        live = rest
        if live.isEmpty():
            break
    drop(live)
    labels = rounds.pop()
    while rounds:
        below = rounds.pop()
        top = labels.select(F.col("node").alias("up"), F.col("up").alias("top"))
        joined = cut(below.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "cc-labels")
        drop(below)
        drop(labels)
        labels = joined
    least = labels.groupBy("up").agg(F.min("node").alias("comp"))
    out = cut(labels.join(least, "up").select("node", "comp"), "cc-labels")
    drop(labels)
    return out


def _roots(live: DataFrame) -> DataFrame:
    """node, up: the root that each node of ``live`` (edges in both directions) reaches by smallest neighbours."""
    other = F.min(F.when(F.col("b") != F.col("a"), F.col("b")))
    picked = live.groupBy(F.col("a").alias("node")).agg(F.coalesce(other, F.col("a")).alias("up"))
    back = picked.select(F.col("node").alias("up"), F.col("up").alias("back"))
    root = (F.col("back") == F.col("node")) & (F.col("node") < F.col("up"))
    tree = cut(picked.join(back, "up").select("node", F.when(root, F.col("node")).otherwise(F.col("up")).alias("up")), "cc-labels")
    while True:
        over = tree.select(F.col("node").alias("up"), F.col("up").alias("over"))
        new = cut(tree.join(over, "up").select("node", F.col("up").alias("was"), F.col("over").alias("up")), "cc-labels")
        changed = not new.filter(F.col("was") != F.col("up")).isEmpty()
        drop(tree)
        tree = new.select("node", "up")
        tree._loomspan_path = new._loomspan_path
        if not changed:
            return tree
