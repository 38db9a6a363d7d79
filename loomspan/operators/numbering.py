"""Orders over all rows without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fixed

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_ROW_BITS = 33
BLOCK = 1 << 16


def numbered(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Adds ``name``: each row's place from 0 in ``order``, which should tell all rows apart.

    Rows are dealt into ranges of the order, sorted within and written; a range's first place is the number of rows in the ranges
    before. Only those numbers, one per shuffle partition, reach the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fixed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    starts, upto = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts.append((p, upto))
        upto += n
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _begin long"))
    return rows.join(begin, part == F.col("_part")).withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_at", "_part", "_begin")


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """Adds ``name``: each row's place from 1 among the rows of its ``keys`` (nulls are a key) in ``order``.

    All rows are numbered by keys and order; a key's first number is a minimum, pre-aggregated in the tasks, so a key that most rows share
    is spread over as many tasks as its rows ask for.
    """
    rows = numbered(df, [*[F.col(k) for k in keys], *order], "_n")
    firsts = rows.groupBy(*keys).agg(F.min("_n").alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(firsts[f"_k{i}"])
    return rows.join(firsts, same).select(*df.columns, (F.col("_n") - F.col("_first") + 1).alias(name))


def next_at_or_after(points: DataFrame, asks: DataFrame, top: int, block: int = BLOCK) -> DataFrame:
    """(pos, hit) for each distinct ``asks.pos``: the value of the first of ``points`` (pos, value) at or after it, or null.

    Positions go from 0 to ``top``. Both sides meet in blocks of ``block`` positions; an ask with no point behind it in its block
    takes the first of a later block, found in the same way among the blocks' first points, of which there are ``block`` times fewer.
    """
    at = lambda c: F.floor(F.col(c) / block)
    points = points.select(F.col("pos").cast("long").alias("pos"), "value").filter(F.col("value").isNotNull())
    value = points.schema["value"].dataType
    stops = points.withColumn("asks", F.lit(False)).union(asks.select(F.col("pos").cast("long"), F.lit(None).cast(value), F.lit(True)).distinct())
    back = Window.partitionBy(at("pos")).orderBy(F.desc("pos"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    here = stops.withColumn("hit", F.last("value", ignorenulls=True).over(back)).filter("asks").select("pos", "hit")
    if top < block:
        return here
    here = here.withColumn("_next", at("pos") + 1)
    firsts = points.groupBy(at("pos").alias("pos")).agg(F.min_by("value", "pos").alias("value"))
    wanted = here.filter(F.col("hit").isNull()).select(F.col("_next").alias("pos")).distinct()
    above = next_at_or_after(firsts, wanted, top // block + 1, block).select(F.col("pos").alias("_next"), F.col("hit").alias("_above"))
    return here.join(above, "_next", "left").select("pos", F.coalesce("hit", "_above").alias("hit"))
