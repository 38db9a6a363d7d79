"""The build: category files into the corpus, the corpus into the entity graph and its rotation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connection_cycle, entity_index
from ..operators.merge import merge_entries, merge_stats
from ..operators.numbering import numbered
from ..sources.json_array import exists, json_text, read_array, union_sources


def indexed(entries: DataFrame) -> DataFrame:
    return entity_index(entries.select(F.col("pos").alias("entry_pos"), F.col("id").alias("entry_id"), "category", "name", "raw_text", "reviewed", "qa_flags"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Entries with ``pos``, from a JSON array or from the newest version an earlier build left under ``path``; empty if neither is there."""
    at = newest(spark, path)
    if at is not None:
        return spark.read.parquet(f"{path}/v={at}/entries")
    return read_array(spark, path).withColumn("pos", F.col("pos").cast("long"))


def newest(spark: SparkSession, path: str) -> int | None:
    """The last version under ``path`` whose build came to its end; the cycle is written last."""
    found, n = None, 0
    while exists(spark, f"{path}/v={n}"):
        found = n if exists(spark, f"{path}/v={n}/cycle/_SUCCESS") else found
        n += 1
    return found


def build_corpus(spark: SparkSession, corpus: str, sources: dict[str, str], out: str, today: str, seed: str) -> dict[str, DataFrame]:
    """Merge the sources (category to file; missing files are skipped) into ``corpus`` and write entries, entities and cycle as
    Parquet under a new version of ``out``. ``corpus`` is a JSON array or the ``out`` of an earlier build, this one's included: a
    version is never overwritten while it is read, and one whose build was cut off is not read. Returns tables read back."""
    existing = read_corpus(spark, corpus)
    new = union_sources(spark, sources)
    stats = merge_stats(existing, new)
    at = newest(spark, out)
    folder = f"{out}/v={0 if at is None else at + 1}"
    merged = merge_entries(existing, new, today)
    # new rows come after all there are
    last = existing.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    merged.withColumn("pos", merged["pos._pos"] + merged["pos._src"] * (last + 1)).write.mode("overwrite").parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    indexed(entries).write.mode("overwrite").parquet(f"{folder}/entities")
    entities = spark.read.parquet(f"{folder}/entities")
    connection_cycle(entities, seed).write.mode("overwrite").parquet(f"{folder}/cycle")
    return {"entries": entries, "entities": entities, "cycle": spark.read.parquet(f"{folder}/cycle"), "stats": stats}


def entities_file(entities: DataFrame, cycle: DataFrame, start: str) -> DataFrame:
    """One row: generated_at, entity_count, cycle_start_date, the cycle's ids in order and the entities by id. One row holds everything;
    :func:`write_entities` writes the same in parts."""
    told = ("id", "name", "kind", "category_span", "entry_count", "category_counts", "entry_ids")
    # by the ids alone, as maps have no order
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    ids = cycle.agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c"), F.lit(0).alias("one")).select(F.transform("c", lambda x: x["id"]).alias("cycle"), "one")
    rows = entities.agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_list(F.struct(*told)), by_id).alias("entities"), F.lit(0).alias("one"))
    return rows.join(ids, "one").select(F.current_timestamp().alias("generated_at"), "entity_count", F.lit(start).alias("cycle_start_date"), "cycle", "entities")


def write_entities(entities: DataFrame, cycle: DataFrame, path: str, start: str, generated_at: str) -> None:
    """The same exchange file as indented JSON, replacing what is there: a folder of part files, which one after another in the order of
    their names are the object (and a line end). Ids and entities are lines that many tasks write; none holds them all."""
    spark = entities.sparkSession
    told = entities.select("id", "name", "kind", "category_span", "entry_count", "category_counts", "entry_ids")
    count, last_id = told.agg(F.count("*"), F.max("id")).first()
    last_pos = cycle.agg(F.max("pos")).first()[0]
    quoted = lambda text: json.dumps(text, ensure_ascii=False)
    head = f'{{\n  "generated_at": {quoted(generated_at)},\n  "entity_count": {count},\n  "cycle_start_date": {quoted(start)},\n  "cycle": ['
    marks = [(0, head + ("],\n" if last_pos is None else "")), (2, ("" if last_pos is None else "  ],\n") + '  "entities": [' + ("]\n}" if count == 0 else "")), (4, "" if count == 0 else "  ]\n}")]
    if last_pos is None:
        marks = [(0, marks[0][1] + marks[1][1]), marks[2]]
    line = "section int, pos long, id string, value string"
    ends = lambda last: F.when(last, "").otherwise(",")
    ids = cycle.select(F.lit(1).alias("section"), F.col("pos").cast("long").alias("pos"), "id", F.concat(F.lit("    "), json_text(F.col("id"), T.StringType()), ends(F.col("pos") == last_pos)).alias("value"))
    each = json_text(F.struct(*told.columns), told.schema, 2)
    nodes = told.select(F.lit(3).alias("section"), F.lit(0).cast("long").alias("pos"), "id", F.concat(F.lit("    "), each, ends(F.col("id") == last_id)).alias("value"))
    rest = spark.createDataFrame([(k, 0, None, text) for k, text in marks if text], line)
    rows = numbered(rest.unionByName(ids).unionByName(nodes), [F.col("section"), F.col("pos"), F.col("id")], "_n")
    rows.select("value").write.mode("overwrite").text(path)


def run_summary(entries: DataFrame) -> DataFrame:
    """Per category: entries, flagged ones, ones without text."""
    return entries.groupBy("category").agg(F.count("*").alias("entries"), F.count_if(F.size("qa_flags") > 0).alias("flagged"), F.count_if(F.coalesce("raw_text", F.lit("")) == "").alias("empty"))
