"""The entity graph from changes: texts are scanned once, and entities are aggregated anew where a change reaches.

``folder/v=N`` holds three tables. ``forms``: per entry and form how often it is mentioned, where first, and whether in prose, a
state that adds up over entries and is replaced entry by entry. ``names``: what the gazetteer is made of. ``nodes``: the entities
before ids. An update scans the texts of changed entries alone; it replaces their forms, finds the keys whose entities can
differ, and aggregates those from the forms of all entries. The tables hold no texts.

A key can differ if a changed entry mentions it (then or now), or if a name of the gazetteer with this key was added, lost or
renamed; both spread to the keys that the forms in question resolve to, before and after. All other entities stay as they are.

Defined results: an update equals a rebuild over the changed corpus, deletions, flags that hold an entry back and changed names
included; deleting what is not there does nothing; an entry that is changed and deleted is deleted; a folder without a finished
version is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ALIASES, canonical_key, strip_article, strip_honorific
from ..functions.qa import is_eligible
from ..operators.graph import alias_table, entity_nodes, gazetteer, resolve, with_ids
from ..operators.mentions import confirmed_words, mentions, surface_forms
from ..sources.json_array import exists, located

_AT = ["entry_pos", "entry_id", "category"]


def entry_forms(entries: DataFrame) -> DataFrame:
    """Forms that the eligible entries mention: one row per entry, surface, and whether it opens a sentence."""
    rows = entries.filter(is_eligible(F.col("reviewed"), F.col("qa_flags"))).select(*_AT, "raw_text")
    return mentions(rows).groupBy(*_AT, "surface", "opens").agg(F.min("match_pos").alias("match_pos"), F.max("prose").alias("prose"), F.count("*").alias("times"))


def _names(entries: DataFrame) -> DataFrame:
    return entries.filter(is_eligible(F.col("reviewed"), F.col("qa_flags"))).select(*_AT, "name")


def _resolved(forms: DataFrame, names: DataFrame, confirmed: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return resolve(surface_forms(forms, confirmed), gazetteer(names), alias_table(forms.sparkSession, aliases))


def newest(spark: SparkSession, folder: str) -> int | None:
    """The last version that is whole; its nodes are written last."""
    if not exists(spark, folder):
        return None
    place, system = located(spark, folder)
    found = [int(s.getPath().getName()[2:]) for s in system.listStatus(place) if s.getPath().getName().startswith("v=")]
    return max((n for n in found if exists(spark, f"{folder}/v={n}/nodes/_SUCCESS")), default=None)


def _write(tables: dict[str, DataFrame], folder: str, number: int) -> dict[str, DataFrame]:
    out = {}
    for name, df in tables.items():
        path = f"{folder}/v={number}/{name}"
        df.write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def rebuild(entries: DataFrame, folder: str, aliases: dict[str, str] = ALIASES) -> int:
    """A new version from all entries (entry_pos, entry_id, category, name, raw_text, reviewed, qa_flags); returns its number."""
    spark = entries.sparkSession
    last = newest(spark, folder)
    number = 0 if last is None else last + 1
    held = _write({"forms": entry_forms(entries), "names": _names(entries)}, folder, number)
    nodes = entity_nodes(_resolved(held["forms"], held["names"], confirmed_words(held["forms"]), aliases), F.col("times"))
    _write({"nodes": nodes}, folder, number)
    return number


def _moved(before: DataFrame, now: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key): gazetteer keys whose name was added, lost or changed, and the aliases that lead to them."""
    a, b = before.select("key", F.col("name").alias("_was")), now.select("key", F.col("name").alias("_is"))
    keys = a.join(b, "key", "full").filter(~F.col("_was").eqNullSafe(F.col("_is"))).select("key")
    led = aliases.join(keys.select(F.col("key").alias("target")), "target", "left_semi").select("key")
    return keys.union(led).distinct()


def _form_keys(forms: DataFrame) -> DataFrame:
    """Adds the keys of a form, with and without its article."""
    bare: Column = strip_article(F.col("_s"))
    return (
        forms.withColumn("_s", strip_honorific(F.col("surface"))).withColumn("_key", canonical_key(F.col("_s")))
        .withColumn("_bkey", canonical_key(F.when(bare != "", bare).otherwise(F.col("_s")))).drop("_s")
    )


def update(folder: str, changed: DataFrame, deleted: DataFrame, aliases: dict[str, str] = ALIASES, keep: int = 2) -> int:
    """A new version with ``changed`` entries (whole rows, new ones included) in place of what they were and without the ``deleted``
    (entry_id); returns its number. ``keep`` versions stay."""
    spark = changed.sparkSession
    last = newest(spark, folder)
    if last is None:
        raise ValueError(f"{folder} holds no graph")
    was = {t: spark.read.parquet(f"{folder}/v={last}/{t}") for t in ("forms", "names", "nodes")}
    gone = changed.select("entry_id").union(deleted.select("entry_id")).distinct()
    live = changed.join(deleted.select("entry_id").distinct(), "entry_id", "left_anti")
    stays = lambda df: df.join(gone, "entry_id", "left_anti").select(*df.columns)
    fresh = _write({"fresh": entry_forms(live)}, folder, last + 1)["fresh"]
    now = _write({"forms": stays(was["forms"]).unionByName(fresh), "names": stays(was["names"]).unionByName(_names(live))}, folder, last + 1)

    moved = _moved(gazetteer(was["names"]), gazetteer(now["names"]), alias_table(spark, aliases))
    lost = was["forms"].join(gone, "entry_id", "left_semi")
    words = _form_keys(lost.select("surface").union(fresh.select("surface"))).select(F.col("_key").alias("key"))
    reached_keys = words.union(moved).distinct()
    sides = []
    for tables in (was, now):
        keyed = _form_keys(tables["forms"])
        one = keyed.join(reached_keys.select(F.col("key").alias("_key")), "_key", "left_semi")
        two = keyed.join(moved.select(F.col("key").alias("_bkey")), "_bkey", "left_semi")
        rows = one.select(*tables["forms"].columns).unionByName(two.select(*tables["forms"].columns)).distinct()
        sides.append(_resolved(rows, tables["names"], confirmed_words(tables["forms"]), aliases).select("key"))
    reached = _write({"reached": sides[0].union(sides[1]).distinct()}, folder, last + 1)["reached"]

    resolved = _resolved(now["forms"], now["names"], confirmed_words(now["forms"]), aliases)
    anew = entity_nodes(resolved.join(reached, "key", "left_semi"), F.col("times"))
    _write({"nodes": was["nodes"].join(reached, "key", "left_anti").unionByName(anew)}, folder, last + 1)
    for name in ["fresh", "reached"]:
        place, system = located(spark, f"{folder}/v={last + 1}/{name}")
        system.delete(place, True)
    for number in range(max(0, last + 1 - keep), -1, -1):
        place, system = located(spark, f"{folder}/v={number}")
        if not system.delete(place, True):
            break
    return last + 1


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version's entities, as ``entity_index`` gives them."""
    number = newest(spark, folder)
    if number is None:
        raise ValueError(f"{folder} holds no graph")
    return with_ids(spark.read.parquet(f"{folder}/v={number}/nodes"))
