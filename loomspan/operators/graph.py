"""The entity graph: gazetteer, resolution, index, rotation."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import ALIASES, canonical_key, entity_slug, strip_article
from ..functions.qa import is_eligible
from ..functions.regex import strip
from .lineage import fixed
from .mentions import confirmed_words, mentions, surface_forms
from .numbering import numbered

MIN_ENTRIES, MIN_SINGLE_WORD, MIN_ROTATION_ENTRIES, MIN_ROTATION_SPAN = 2, 3, 3, 2


def _before(c: Column, mark: str) -> Column:
    return strip(F.substring_index(c, mark, 1))


def gazetteer(entries: DataFrame, category: str = "character_story") -> DataFrame:
    """(key, name): every character's display and base name to the base name; of repeated keys the last entry counts."""
    display = _before(F.col("name"), " — ")
    rows = (
        entries.filter((F.col("category") == category)).select("entry_pos", display.alias("display")).filter("display <> ''")
        .select("entry_pos", _before(F.col("display"), " • ").alias("base"), F.explode(F.array_distinct(F.array("display", _before(F.col("display"), " • ")))).alias("surface"))
    )
    return rows.groupBy(canonical_key(F.col("surface")).alias("key")).agg(F.max_by("base", "entry_pos").alias("name"))


def alias_table(spark: SparkSession, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(key, name, target): bounded by the curated list."""
    rows = spark.createDataFrame(list(aliases.items()) or [], "surface string, name string")
    return rows.select(canonical_key(F.col("surface")).alias("key"), "name", canonical_key(F.col("name")).alias("target"))


def resolve(forms: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds key, canonical and kind: gazetteer by the full form, by the form without its article, alias, else a term.

    The joins are equi-joins on keys; the alias list is small by construction, the gazetteer is broadcast only where its
    measured size allows.
    """
    g1 = names.select(F.col("key").alias("_k1"), F.col("name").alias("_n1"))
    g2 = names.select(F.col("key").alias("_k2"), F.col("name").alias("_n2"))
    g3 = names.select(F.col("key").alias("_k3"))
    a = aliases.join(g3, F.col("target") == F.col("_k3"), "left").select(F.col("key").alias("_ka"), F.col("name").alias("_na"), F.col("target").alias("_ta"), F.col("_k3").isNotNull().alias("_ca"))
    bare = strip_article(F.col("surface"))
    rows = forms.withColumn("_bare", F.when(bare != "", bare).otherwise(F.col("surface"))).withColumn("_bkey", canonical_key(F.col("_bare")))
    rows = rows.join(g1, F.col("key") == F.col("_k1"), "left").join(g2, (F.col("_bkey") == F.col("_k2")) & (F.col("_bare") != F.col("surface")), "left").join(F.broadcast(a), F.col("_bkey") == F.col("_ka"), "left")
    pick = lambda *v: F.coalesce(*v)
    one, two, al = F.col("_k1").isNotNull(), F.col("_k2").isNotNull(), F.col("_ka").isNotNull()
    key = F.when(one, F.col("key")).when(two, F.col("_bkey")).when(al, F.col("_ta")).otherwise(F.col("_bkey"))
    canonical = F.when(one, F.col("_n1")).when(two, F.col("_n2")).when(al, F.col("_na")).otherwise(F.col("_bare"))
    kind = F.when(one | two | (al & F.col("_ca")), "character").otherwise("term")
    own = [c for c in forms.columns if c not in ("key", "surface")]
    return rows.select(*own, key.alias("key"), canonical.alias("canonical"), kind.alias("kind"))


def entity_nodes(resolved: DataFrame, times: Column | None = None) -> DataFrame:
    """Aggregate mentions (entry_pos, entry_id, category, match_pos, key, canonical, kind) to entities, before ids. A row may stand for
    ``times`` mentions of a form in an entry, the first of them at match_pos.

    The display name is the most frequent form, of equals the first seen; counts are by distinct entry. Every step groups by a
    key after a map-side pre-aggregation.
    """
    seen = F.struct("entry_pos", "match_pos")
    forms = resolved.groupBy("key", "canonical").agg((F.count("*") if times is None else F.sum(times)).alias("n"), F.min(seen).alias("first"))
    display = forms.groupBy("key").agg(F.min_by("canonical", F.struct(-F.col("n"), "first")).alias("name"), F.min("first").alias("first"))
    pairs = resolved.groupBy("key", "entry_id").agg(F.min("kind").alias("kind"), F.max_by("category", "entry_pos").alias("category"))
    counts = pairs.groupBy("key", "category").agg(F.count("*").cast("long").alias("n"), F.min("kind").alias("kind"), F.collect_list("entry_id").alias("ids"))
    nodes = counts.groupBy("key").agg(
        F.min("kind").alias("kind"), F.sum("n").alias("entry_count"), F.count("*").alias("category_span"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("category", F.lit("")), "n")))).alias("category_counts"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("entry_ids"),
    )
    bar = F.when(F.size(F.split("name", " ")) == 1, MIN_SINGLE_WORD).otherwise(MIN_ENTRIES)
    enough = (F.col("entry_count") >= MIN_ENTRIES) & ((F.col("kind") == "character") | (F.col("entry_count") >= bar))
    return nodes.join(display, "key").filter(enough)


def with_ids(nodes: DataFrame) -> DataFrame:
    """Adds id: the name's slug, from its second use on (in rank order) with a running number."""
    order = Window.partitionBy("_slug").orderBy(F.desc("category_span"), F.desc("entry_count"), "name", "first")
    rows = nodes.withColumn("_slug", entity_slug(F.col("name"))).withColumn("_n", F.row_number().over(order))
    return rows.withColumn("id", F.when(F.col("_n") > 1, F.concat_ws("-", "_slug", F.col("_n").cast("string"))).otherwise(F.col("_slug"))).drop("_slug", "_n")


RANK = (F.desc, "category_span"), (F.desc, "entry_count"), (F.asc, "name"), (F.asc, "first")


def ranked(entities: DataFrame) -> DataFrame:
    return entities.orderBy(*[f(c) for f, c in RANK])


def _resolved(entries: DataFrame, aliases: dict[str, str], gated: bool) -> DataFrame:
    """Mentions of eligible entries with key, canonical and kind."""
    rows = entries.filter(is_eligible(F.col("reviewed"), F.col("qa_flags"))) if gated else entries
    found = fixed(mentions(rows.select("entry_pos", "entry_id", "category", "raw_text")))  # read twice, scanned once
    forms = surface_forms(found, confirmed_words(found))
    return resolve(forms, gazetteer(rows.select("entry_pos", "category", "name")), alias_table(entries.sparkSession, aliases))


def entity_index(entries: DataFrame, aliases: dict[str, str] = ALIASES, gated: bool = True) -> DataFrame:
    """Entities of eligible entries: id, name, kind, entry_ids, entry_count, category_counts, category_span, key, first.

    ``entries`` has entry_pos (total order), entry_id, category, name, raw_text, and reviewed and qa_flags if ``gated``. ``entry_ids``
    is an array for exchange, gathered only if it is selected; counts and ids need none, and :func:`entity_links` has rows.
    """
    return with_ids(entity_nodes(_resolved(entries, aliases, gated)))


def entity_links(entries: DataFrame, aliases: dict[str, str] = ALIASES, gated: bool = True) -> DataFrame:
    """(id, entry_id): the same entities' entries as rows, so that an entity of very many entries is never one array."""
    resolved = _resolved(entries, aliases, gated)
    ids = with_ids(entity_nodes(resolved)).select("key", "id")
    return resolved.select("key", "entry_id").distinct().join(ids, "key").select("id", "entry_id")


def graph_totals(entities: DataFrame) -> DataFrame:
    return entities.agg(
        F.count("*").alias("entity_count"), F.count_if(F.col("category_span") >= 2).alias("bridging"), F.count_if(F.col("kind") == "character").alias("characters")
    )


def rotation_candidates(entities: DataFrame) -> DataFrame:
    return entities.filter((F.col("category_span") >= MIN_ROTATION_SPAN) & (F.col("entry_count") >= MIN_ROTATION_ENTRIES))


def connection_cycle(entities: DataFrame, seed: str) -> DataFrame:
    """(pos, id): eligible entities in the order of a seeded hash, the same on any cluster; numbered in ranges of the hash, so that no
    task sees them all."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id")), 256)
    rows = rotation_candidates(entities).select("id", order.alias("_order"))
    return numbered(rows, [F.col("_order"), F.col("id")]).select("pos", "id")


def shuffled_cycle(entities: DataFrame, seed: str, most: int = 100_000) -> list[str]:
    """The same ids shuffled by Python's generator in rank order, as a list: for bit parity with a published rotation."""
    rows = ranked(rotation_candidates(entities)).select("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ids to shuffle on the driver")
    ids = [r["id"] for r in rows]
    random.Random(seed).shuffle(ids)
    return ids
