"""From pages to corpus and graph, driven by what is registered: builders by category, models by name, settings by environment.

A refresh builds entries of all categories that have pages, paraphrases those whose text changed, merges them into the store, and
updates the graph with them. What did not change is not asked, written or scanned again.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import merge_name
from ..operators.builders import BUILDERS
from ..operators.incremental import Model, first_words, is_stale, paraphrase
from ..operators.lineage import fixed
from ..operators.numbering import numbered
from ..sources.json_array import ENTRY
from . import graph_state, store

MODELS: dict[str, Model] = {"first_words": first_words}


def register_model(name: str, model: Model) -> None:
    MODELS[name] = model


@dataclass(frozen=True)
class Settings:
    """How to paraphrase. ``read`` takes them from the environment: LOOMSPAN_PROMPT (path of the template, on any file system),
    LOOMSPAN_PROMPT_VERSION, LOOMSPAN_MODEL (a registered name), LOOMSPAN_CALLS (at a time in a task), LOOMSPAN_DELAY (seconds)."""

    template: str = "{raw_text}"
    version: str = "v1"
    model: str = "first_words"
    calls: int = 4
    delay: float = 0.0

    @staticmethod
    def read(spark: SparkSession, environ: Mapping[str, str] = os.environ) -> Settings:
        own = Settings()
        path = environ.get("LOOMSPAN_PROMPT")
        template = spark.read.text(path, wholetext=True).first()["value"] if path else own.template
        model = environ.get("LOOMSPAN_MODEL", own.model)
        if model not in MODELS:
            raise ValueError(f"no model {model} is registered")
        return Settings(template, environ.get("LOOMSPAN_PROMPT_VERSION", own.version), model, int(environ.get("LOOMSPAN_CALLS", own.calls)), float(environ.get("LOOMSPAN_DELAY", own.delay)))


def raw_entries(spark: SparkSession, pages: Mapping[str, tuple[DataFrame, ...]]) -> DataFrame:
    """Entries of every registered category that has pages (the arguments of its builder), in the registry's order, numbered by ``pos``."""
    unknown = sorted(set(pages) - set(BUILDERS))
    if unknown:
        raise ValueError(f"no builder is registered for {', '.join(unknown)}")
    out = spark.createDataFrame([], T.StructType([T.StructField("rank", T.IntegerType()), *ENTRY.fields]))
    for rank, category in enumerate(c for c in BUILDERS if c in pages):
        out = out.unionByName(BUILDERS[category](*pages[category]).withColumn("rank", F.lit(rank)), allowMissingColumns=True)
    return numbered(out.select("rank", *ENTRY.names), [F.col("rank"), F.col("id"), F.xxhash64(*ENTRY.names)]).drop("rank")


def _graph_rows(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("pos").alias("entry_pos"), F.col("id").alias("entry_id"), "category", "name", "raw_text", "reviewed", "qa_flags")


def refresh(spark: SparkSession, pages: Mapping[str, tuple[DataFrame, ...]], corpus: str, graph: str, today: str, settings: Settings | None = None) -> int:
    """Bring the store ``corpus`` and the graph state ``graph`` up to date with ``pages``; returns how many entries were asked for.

    An entry is known by its category and folded name. One whose model call failed keeps its flag and is asked again next time; it is
    not merged until it has a short text.
    """
    settings = settings or Settings.read(spark)
    fields = [f for f in ENTRY.names if f not in ("short_text", "prompt_version", "raw_text_hash")]
    if store.current(spark, corpus) is None:
        store.create(spark, corpus, spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()), *ENTRY.fields])))
    known = store.read(spark, corpus).select(F.col("category").alias("_c"), merge_name(F.col("name")).alias("_k"), "short_text", "prompt_version", "raw_text_hash")
    raw = raw_entries(spark, pages).select("pos", *fields)
    rows = raw.join(known, raw["category"].eqNullSafe(F.col("_c")) & (merge_name(raw["name"]) == F.col("_k")), "left").select("pos", *ENTRY.names)
    due = fixed(rows.filter(is_stale(settings.version)))
    n = due.count()
    if n:
        done = fixed(paraphrase(due, settings.template, settings.version, MODELS[settings.model], settings.calls, settings.delay))
        told = done.filter(~F.coalesce(F.array_contains("qa_flags", "paraphrase_error"), F.lit(False)))
        store.upsert(spark, corpus, told, today)
        keys = told.select("category", merge_name(F.col("name")).alias("_k")).distinct()
        now = store.read(spark, corpus)
        changed = now.join(keys, now["category"].eqNullSafe(keys["category"]) & (merge_name(now["name"]) == keys["_k"]), "left_semi")
        if graph_state.newest(spark, graph) is None:
            graph_state.rebuild(_graph_rows(now), graph)
        else:
            graph_state.update(graph, _graph_rows(changed), spark.createDataFrame([], "entry_id string"))
    return n
