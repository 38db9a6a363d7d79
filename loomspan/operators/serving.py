"""Browse, search, evidence and pick-of-the-day queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import CATEGORIES, describe_spread, name_matches, plural
from .numbering import BLOCK, next_at_or_after, placed

PAGE_SIZE = 30


def matching(entities: DataFrame, tab: str = "all", query: str = "") -> DataFrame:
    """Entities of a tab (all, bridging, character) whose name holds the query."""
    rows = entities.filter(name_matches(F.col("name"), F.lit(query)))
    return rows.filter("category_span >= 2") if tab == "bridging" else rows.filter("kind = 'character'") if tab == "character" else rows


def browse(entities: DataFrame, tab: str = "all", query: str = "", shown: int = PAGE_SIZE, deep_link: str | None = None) -> DataFrame:
    """The first ``shown`` matches in rank order, as many more as it takes to reach ``deep_link``; ``rn`` from 1.

    Without a deep link this is a distributed top-k; with one, its rank is counted first.
    """
    rows = matching(entities, tab, query)
    order = (F.desc("category_span"), F.desc("entry_count"), F.asc("name"), F.asc("id"))
    if deep_link is not None:
        target = rows.filter(F.col("id") == deep_link).select("category_span", "entry_count", "name", "id").first()
        if target is not None:
            key = lambda s, c, n, i: F.struct(-s, -c, n, i)
            mine = key(F.lit(target[0]), F.lit(target[1]), F.lit(target[2]), F.lit(target[3]))
            shown = max(shown, rows.filter(key(F.col("category_span"), F.col("entry_count"), F.col("name"), F.col("id")) <= mine).count())
    top = rows.orderBy(*order).limit(shown)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def result_count(shown: Column, total: Column) -> Column:
    return F.concat(F.lit("Showing "), shown.cast("string"), F.lit(" of "), plural(total, "connection"), F.lit("."))


def evidence(entity_entries: DataFrame, entries: DataFrame, categories: tuple[str, ...] = tuple(c for c, _, _ in CATEGORIES)) -> DataFrame:
    """Entries behind an entity ((entity_id, entry_id) pairs), missing ones dropped; ``place`` orders by category, then name as
    a reader would (locale collation), then id. Unknown categories come first. An entity of very many entries is spread over tasks."""
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.coalesce("category", F.lit(""))) - 1
    rows = entity_entries.join(entries, "entry_id").withColumn("_rank", rank)
    order = [F.col("_rank"), F.collate("name", "UNICODE"), F.col("entry_id")]
    return placed(rows, ["entity_id"], order).drop("_rank")


def connection_card(entity: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Summary line of each entity, and whether it bridges categories."""
    counts = {c: F.col("category_counts")[c] for c, _, _ in categories}
    return entity.select("id", "name", "kind", describe_spread(counts, categories).alias("spread"), (F.col("category_span") > 1).alias("bridges"), F.col("entry_count"))


def last_updated(entries: DataFrame, *by: str) -> DataFrame:
    """The latest update and the number of entries, of all or by the columns ``by``."""
    return entries.groupBy(*by).agg(F.max("date_updated").alias("latest"), F.count("*").alias("entries"))


def cycle_index(today: Column, start: Column, length: Column) -> Column:
    """Day index into a cycle; valid before its start, too."""
    return F.pmod(F.datediff(today, start).cast("long"), length.cast("long"))


def daily_pick(cycle: DataFrame, entities: DataFrame, start: str, days: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row of ``days`` (day): the first id at or after the day's index that still exists, walking around once.

    Only the distinct indexes (no more than the cycle is long) meet the live positions, in blocks of ``block`` positions; days then
    look theirs up. Days without a hit (an empty cycle, or one of which nothing lives) have a null id.
    """
    n, last = cycle.agg(F.count("*"), F.max("pos")).first()
    if n == 0:
        return days.select("day", F.lit(None).cast("string").alias("id"))
    live = cycle.join(entities.select("id").distinct(), "id", "left_semi").select(F.col("pos").cast("long").alias("pos"), F.col("id").alias("value"))
    twice = live.union(live.select(F.col("pos") + n, "value"))
    asked = days.select("day", cycle_index(F.col("day"), F.lit(start).cast("date"), F.lit(n)).alias("pos"))
    found = next_at_or_after(twice, asked.select("pos").distinct(), n + max(n, last + 1), block)
    return asked.join(found, "pos", "left").select("day", F.col("hit").alias("id"))


def rotation_coverage(cycle: DataFrame, entities: DataFrame, start: str, first: str, last: str) -> DataFrame:
    """One row: distinct picks over the days from ``first`` to ``last``, days without a pick, and the cycle's length."""
    spark = cycle.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return daily_pick(cycle, entities, start, days).agg(
        F.countDistinct("id").alias("picks"), F.count_if(F.col("id").isNull()).alias("empty_days"), F.lit(cycle.count()).cast("long").alias("length")
    )


def by_id(df: DataFrame, order: str = "pos") -> DataFrame:
    """One row per id: of repeated ids the last row, at the place of the first."""
    fields = [c for c in df.columns if c != order]
    return df.groupBy("id").agg(F.min(order).alias(order), F.max_by(F.struct(*fields), order).alias("_row")).select(order, *[f"_row.{c}" for c in fields])


def dangling_refs(entity_entries: DataFrame, entries: DataFrame) -> DataFrame:
    """Cited entries that do not exist."""
    return entity_entries.join(entries.select("entry_id"), "entry_id", "left_anti")
