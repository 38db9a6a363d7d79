"""A corpus of change files: an upsert reads and writes what it changes.

A store is a folder. ``data/g=N/b=B`` holds the rows that change file N wrote for bucket B of the merge keys; ``log/V.json`` names, for
version V, the change files of every bucket in order, of which the last row of a key counts. An upsert looks only into the buckets
of its keys, writes only their rows, and becomes visible with its log file, which is renamed into place and never overwritten.
Buckets with many change files are rewritten into one, and files that no kept version names are deleted.

Defined results: an empty batch, or one whose rows have no short text, makes no version; repeated keys in a batch apply in
order; a null category is a category of its own; a batch that was applied before (same source, same or lower number) is skipped; files of
an upsert that was cut off are never read and are overwritten by the next one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import merge_name
from ..operators.merge import merge_entries
from ..sources.json_array import exists, located

_KEY, _BUCKET, _FILE = "_key", "b", "g"


@dataclass(frozen=True)
class Version:
    """What ``log/number.json`` says: runs are the change files of each bucket, oldest first."""

    number: int
    buckets: int
    fields: str
    last_pos: int
    next_file: int
    runs: dict[int, tuple[int, ...]]
    batches: dict[str, int]

    def text(self) -> str:
        return json.dumps({**self.__dict__, "runs": {str(b): list(g) for b, g in sorted(self.runs.items())}}, indent=1)

    @staticmethod
    def read(text: str) -> Version:
        held = json.loads(text)
        return Version(**{**held, "runs": {int(b): tuple(g) for b, g in held["runs"].items()}})

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.fields))


def _names(spark: SparkSession, folder: str) -> list[str]:
    place, system = located(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{folder}/log") if n.endswith(".json"))


def current(spark: SparkSession, folder: str, number: int | None = None) -> Version | None:
    """The newest version, or the one of that number; None if there is none."""
    found = versions(spark, folder)
    number = number if number is not None else found[-1] if found else None
    if number not in found:
        return None
    return Version.read(spark.read.text(f"{folder}/log/{number}.json", wholetext=True).first()["value"])


def _commit(spark: SparkSession, folder: str, version: Version) -> Version:
    draft, system = located(spark, f"{folder}/log/.{version.number}-{uuid.uuid4().hex}")
    target, _ = located(spark, f"{folder}/log/{version.number}.json")
    out = system.create(draft)
    out.write(bytearray(version.text().encode()))
    out.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"version {version.number} was written by another upsert")
    return version


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    """Adds the merge key and its bucket."""
    key = merge_name(F.col("name"))
    return df.withColumn(_KEY, key).withColumn(_BUCKET, F.pmod(F.xxhash64(F.coalesce("category", F.lit("")), key), F.lit(buckets)).cast("int"))


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a[_BUCKET] == b[_BUCKET]) & a["category"].eqNullSafe(b["category"]) & a[_KEY].eqNullSafe(b[_KEY])


def _write(rows: DataFrame, folder: str, file: int) -> None:
    """``rows`` with their buckets as change file ``file``; a bucket's rows are together, so that each has few files."""
    rows.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/data/{_FILE}={file}")


def _rows(spark: SparkSession, folder: str, version: Version, buckets: set[int] | None = None) -> DataFrame:
    """Current rows of all or some buckets, with key and bucket. Buckets of one file need no comparison of rows and are not moved."""
    schema = T.StructType([*version.schema().fields, T.StructField(_KEY, T.StringType()), T.StructField(_BUCKET, T.IntegerType()), T.StructField(_FILE, T.IntegerType())])
    names = [*version.schema().names, _KEY, _BUCKET]
    wanted = {b: g for b, g in version.runs.items() if buckets is None or b in buckets}
    paths = lambda few: [f"{folder}/data/{_FILE}={g}/{_BUCKET}={b}" for b, runs in sorted(wanted.items()) for g in runs if (len(runs) == 1) == few]
    read = lambda p: spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*p) if p else spark.createDataFrame([], schema)
    alone, mixed = read(paths(True)), read(paths(False))
    row = F.struct(*version.schema().names)
    newest = mixed.groupBy(_BUCKET, "category", _KEY).agg(F.max_by(row, _FILE).alias("_row")).select("_row.*", _KEY, _BUCKET)
    return alone.select(*names).unionByName(newest)


def create(spark: SparkSession, folder: str, entries: DataFrame, buckets: int = 64) -> Version:
    """Version 0: ``entries`` (with ``pos``). Of rows that share a merge key all are kept until one of that key is upserted."""
    if versions(spark, folder):
        raise ValueError(f"{folder} holds a store already")
    _write(_keyed(entries, buckets), folder, 0)
    last = entries.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    held = {int(n.split("=")[1]): (0,) for n in _names(spark, f"{folder}/data/{_FILE}=0") if n.startswith(f"{_BUCKET}=")}
    return _commit(spark, folder, Version(0, buckets, entries.schema.json(), int(last), 1, held, {}))


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The corpus as of the newest version, or of one that is still kept."""
    version = current(spark, folder, number)
    if version is None:
        raise ValueError(f"{folder} has no version {'' if number is None else number}")
    return _rows(spark, folder, version).drop(_KEY, _BUCKET)


def upsert(spark: SparkSession, folder: str, new: DataFrame, today: str, source: str = "", batch: int | None = None, compact_after: int = 8, keep: int = 2) -> Version:
    """Merge ``new`` (with ``pos``, its order) into the newest version as :func:`merge_entries` does; its new keys come after all there are.

    Reads the buckets of the batch's keys, writes rows of those keys, and rewrites such of these buckets as then have more than
    ``compact_after`` change files. Keeps ``keep`` versions. ``source`` and ``batch`` make a repeated call do nothing.
    """
    version = current(spark, folder)
    if batch is not None and version.batches.get(source, -1) >= batch:
        return version
    told = new.filter(F.coalesce("short_text", F.lit("")) != "")
    keys = _keyed(told, version.buckets).select("category", _KEY, _BUCKET).distinct()
    touched = {r[_BUCKET] for r in keys.select(_BUCKET).distinct().collect()}
    if not touched:
        return version if batch is None else _commit(spark, folder, replace(version, number=version.number + 1, batches={**version.batches, source: batch}))
    before = _rows(spark, folder, version, touched)
    held = before.join(keys, _same_key(before, keys), "left_semi").select(*version.schema().names)
    merged = merge_entries(held, told, today)
    rows = merged.withColumn("pos", merged["pos._pos"] + merged["pos._src"] * (version.last_pos + 1)).select(*[F.col(f.name).cast(f.dataType) for f in version.schema().fields])
    file = version.next_file
    _write(_keyed(rows, version.buckets), folder, file)
    last = spark.read.schema(version.schema()).parquet(f"{folder}/data/{_FILE}={file}").agg(F.max("pos")).first()[0]
    version = replace(
        version, number=version.number + 1, last_pos=max(version.last_pos, int(last)), next_file=file + 1,
        runs={**version.runs, **{b: (*version.runs.get(b, ()), file) for b in touched}}, batches=version.batches if batch is None else {**version.batches, source: batch},
    )
    full = {b for b in touched if len(version.runs[b]) > compact_after}
    if full:
        _write(_rows(spark, folder, version, full), folder, version.next_file)
        version = replace(version, next_file=version.next_file + 1, runs={**version.runs, **{b: (version.next_file,) for b in full}})
    _commit(spark, folder, version)
    vacuum(spark, folder, keep)
    return version


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Forget all but the last ``keep`` versions, then delete the buckets of change files that none of those names."""
    found = versions(spark, folder)
    for number in found[:-keep]:
        place, system = located(spark, f"{folder}/log/{number}.json")
        system.delete(place, False)
    kept = [current(spark, folder, n) for n in found[-keep:]]
    named = {(g, b) for v in kept for b, runs in v.runs.items() for g in runs}
    newest = kept[-1].next_file
    for file in (int(n.split("=")[1]) for n in _names(spark, f"{folder}/data") if n.startswith(f"{_FILE}=")):
        held = {int(n.split("=")[1]) for n in _names(spark, f"{folder}/data/{_FILE}={file}") if n.startswith(f"{_BUCKET}=")}
        gone = {b for b in held if (file, b) not in named}
        if file >= newest:
            continue  # of an upsert that goes on
        for path in [f"{folder}/data/{_FILE}={file}"] if gone == held else [f"{folder}/data/{_FILE}={file}/{_BUCKET}={b}" for b in gone]:
            place, system = located(spark, path)
            system.delete(place, True)


def opened(spark: SparkSession, folder: str, buckets: int = 64) -> Version:
    """The newest version; a folder that holds a plain table of entries in ``v=0`` becomes a store of it."""
    version = current(spark, folder)
    if version is None:
        if not exists(spark, f"{folder}/v=0"):
            raise ValueError(f"{folder} holds no corpus")
        version = create(spark, folder, spark.read.parquet(f"{folder}/v=0"), buckets)
    return version
