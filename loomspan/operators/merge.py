"""Upsert of new rows into a dated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from ..functions.names import merge_name
from ..functions.qa import has_flags


def _sequence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sides as one ordered table of (category, merge key, src, pos, hash, row); new rows without a short text are out."""
    fields = [c for c in existing.columns if c != "pos"]
    shaped = lambda df, src: df.select("category", merge_name(F.col("name")).alias("_key"), F.lit(src).alias("_src"), F.col("pos").alias("_pos"), F.struct(*fields).alias("_row"))
    add = new
    for c in fields:
        if c not in new.columns:
            add = add.withColumn(c, F.lit(None).cast(existing.schema[c].dataType))
    return shaped(existing, 0).unionByName(shaped(add.filter(F.coalesce("short_text", F.lit("")) != ""), 1))


def merge_entries(existing: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """The merged corpus in first-seen order (``pos``).

    A new row replaces the old one of its (category, folded name) whole; date_added stays, date_updated becomes ``today`` if
    the text hash changed anywhere along the batch. Rows nobody replaces stay. Both sides have ``pos``; repeated keys in a
    batch apply in order. Aggregates only, so a key shared by very many rows is pre-aggregated, never gathered.
    """
    order = F.struct("_src", "_pos")
    seq = _sequence(existing, new)
    last_old = F.when(F.col("_src") == 0, order)
    tail = seq.groupBy("category", "_key").agg(
        F.max_by("_row", order).alias("_row"), F.max("_src").alias("_new"), F.min(order).alias("_first"),
        F.max_by("_row", last_old).alias("_old"), F.max(last_old).alias("_at"),
    )
    # of the chain (last existing row, then the new ones) all hashes must agree for the date to stay
    old_hash = F.col("_old.raw_text_hash")
    chain = seq.filter("_src = 1").groupBy("category", "_key").agg(
        F.min("_row.raw_text_hash").alias("_lo"), F.max("_row.raw_text_hash").alias("_hi"), F.count_if(F.col("_row.raw_text_hash").isNull()).alias("_nulls"), F.count("*").alias("_n")
    )
    c = chain.select(F.col("category").alias("_c"), F.col("_key").alias("_k"), "_lo", "_hi", "_nulls", "_n")
    j = tail.join(c, tail["category"].eqNullSafe(c["_c"]) & (tail["_key"] == c["_k"]), "left")
    same = F.when(F.col("_nulls") == 0, (F.col("_lo") == F.col("_hi")) & old_hash.eqNullSafe(F.col("_lo"))).otherwise((F.col("_nulls") == F.col("_n")) & old_hash.isNull())
    had = F.col("_at").isNotNull()
    new = F.col("_new") == 1
    added = F.when(new, F.when(had, F.coalesce("_old.date_added", F.lit(today))).otherwise(today)).otherwise(F.col("_row.date_added"))
    updated = F.when(new, F.when(had & same, F.coalesce("_old.date_updated", F.lit(today))).otherwise(today)).otherwise(F.col("_row.date_updated"))
    reviewed = F.when(new, ~has_flags(F.col("_row.qa_flags"))).otherwise(F.col("_row.reviewed"))
    fields = [f for f in existing.columns if f not in ("pos", "date_added", "date_updated", "reviewed")]
    return j.select(*[F.col(f"_row.{f}").alias(f) for f in fields], reviewed.alias("reviewed"), added.alias("date_added"), updated.alias("date_updated"), F.col("_first").alias("pos"))


def _stretch(pos: Column, kind: DataType, rows: int) -> Column:
    """``pos`` in stretches of ``rows`` that keep its order; of a struct the last field is cut. Other types are one stretch."""
    if isinstance(kind, StructType) and kind.names:
        head = [pos[n].alias(n) for n in kind.names[:-1]]
        return F.struct(*head, _stretch(pos[kind.names[-1]], kind.fields[-1].dataType, rows).alias("stretch"))
    return F.floor(pos / rows) if isinstance(kind, IntegralType) else F.lit(0)


def merge_stats(existing: DataFrame, new: DataFrame, stretch_rows: int = 65_536) -> DataFrame:
    """One row: added, updated, unchanged, skipped_no_short_text, held_back_flagged (which overlaps the first three).

    Rows of a merge key are compared with the one before in stretches of ``stretch_rows`` positions; the window over a whole key
    sees one row per stretch, its first and last hash, so a key shared by very many rows is no hot task.
    """
    seq = _sequence(existing, new).select("category", "_key", "_src", "_pos", F.col("_row.raw_text_hash").alias("hash"), has_flags(F.col("_row.qa_flags")).alias("flagged"))
    seq = seq.withColumn("_part", _stretch(F.col("_pos"), seq.schema["_pos"].dataType, stretch_rows))
    key, part, zero = ["category", "_key"], ["_src", "_part"], F.lit(0).cast("long")

    def counted(rows: DataFrame) -> DataFrame:
        same = F.col("was").eqNullSafe(F.col("hash"))
        return rows.filter("_src = 1").agg(
            F.count_if("first").alias("added"), F.count_if(~F.col("first") & ~same).alias("updated"), F.count_if(~F.col("first") & same).alias("unchanged"),
            zero.alias("skipped_no_short_text"), F.count_if("flagged").alias("held_back_flagged"),
        )

    w = Window.partitionBy(*key, *part).orderBy("_pos")
    inner = seq.withColumn("was", F.lag("hash").over(w)).withColumn("n", F.row_number().over(w)).filter("n > 1").withColumn("first", F.lit(False))
    told = F.struct("hash", "flagged")
    ends = seq.groupBy(*key, *part).agg(F.min_by(told, "_pos").alias("head"), F.max_by(told, "_pos").alias("tail"))
    over = Window.partitionBy(*key).orderBy(*part)
    heads = ends.select("_src", "head.*", F.lag("tail.hash").over(over).alias("was"), (F.row_number().over(over) == 1).alias("first"))
    bare = F.count_if(F.coalesce("short_text", F.lit("")) == "")
    skipped = new.agg(zero.alias("added"), zero.alias("updated"), zero.alias("unchanged"), bare.alias("skipped_no_short_text"), zero.alias("held_back_flagged"))
    done = counted(inner).union(counted(heads)).union(skipped)
    return done.agg(*[F.sum(c).alias(c) for c in done.columns])
