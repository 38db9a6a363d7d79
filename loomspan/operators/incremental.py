"""Incremental paraphrase of changed rows, and revalidation."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import text_hash
from ..functions.qa import other_flags, proper_nouns, short_text_flags
from ..functions.regex import strip
from ..sources.json_array import exists
from .lineage import fixed

Model = Callable[[str], str]


def render_prompt(template: str, name: Column, category: Column, raw_text: Column) -> Column:
    """The template with {name}, {category} and {raw_text} put in, in that order (also inside what was put in before)."""
    c = F.replace(F.lit(template), F.lit("{name}"), name)
    return F.replace(F.replace(c, F.lit("{category}"), category), F.lit("{raw_text}"), raw_text)


def parse_answer(answer: Column) -> Column:
    """short_text of a JSON answer, stripped; null if the answer is malformed or holds none, or one that is no text."""
    held = F.try_variant_get(F.try_parse_json(answer), "$.short_text", "variant")
    alone = F.json_array_length(F.concat(F.lit("["), answer, F.lit("]"))) == 1  # nothing follows the value
    return F.when(alone & (F.schema_of_variant(held) == "STRING"), strip(F.try_variant_get(held, "$", "string")))


def is_stale(version: str) -> Column:
    """Rows to paraphrase: with a text, not held for length, and changed since the last run."""
    held = F.coalesce(F.array_contains("qa_flags", "flavor_text_unexpectedly_long"), F.lit(False))
    same = F.col("raw_text_hash").eqNullSafe(text_hash(F.col("raw_text"))) & F.col("prompt_version").eqNullSafe(F.lit(version)) & (F.coalesce("short_text", F.lit("")) != "")
    return (F.coalesce("raw_text", F.lit("")) != "") & ~held & ~same


def first_words(prompt: str) -> str:
    """Stand-in for a model: answers with the start of the prompt's last line."""
    return json.dumps({"short_text": prompt.rsplit("\n", 1)[-1][:200]})


class Pace:
    """Lets calls of one task begin at least ``delay`` seconds after each other, however many threads ask."""

    def __init__(self, delay: float):
        self.delay, self.lock, self.next = delay, threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            begin, self.next = max(now, self.next), max(now, self.next) + self.delay
        if begin > now:
            time.sleep(begin - now)


def _ask(model: Model, pace: Pace, prompt: str) -> str | None:
    pace.wait()
    try:
        return model(prompt)
    except Exception:  # any failure marks this row alone
        return None


def paraphrase(entries: DataFrame, template: str, version: str, model: Model = first_words, calls: int = 4, delay: float = 0.0) -> DataFrame:
    """Stale rows get a new short text, hash, version and flags; a row whose call fails, or whose answer is no JSON object with a text
    ``short_text``, keeps its hash (so it is tried again) and gets ``paraphrase_error``. All other rows stay.

    The call runs in Arrow batches on stale rows only: in every task at most ``calls`` at a time, beginning ``delay`` seconds apart. A
    failing row fails alone.
    """
    names = entries.columns
    stale = entries.filter(is_stale(version)).withColumn("_prompt", render_prompt(template, F.col("name"), F.col("category"), F.col("raw_text")))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(delay)
        with ThreadPoolExecutor(calls) as pool:
            for pdf in batches:
                yield pdf.drop(columns="_prompt").assign(_said=list(pool.map(lambda prompt: _ask(model, pace, prompt), pdf["_prompt"])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    # the answer is parsed here, not in the workers
    done = stale.mapInPandas(call, schema + ", _said string").withColumn("_answer", parse_answer(F.col("_said"))).drop("_said")
    ok = F.col("_answer").isNotNull()
    held = F.coalesce("qa_flags", F.array().cast("array<string>"))
    failed = F.when(F.array_contains(held, "paraphrase_error"), held).otherwise(F.concat(held, F.array(F.lit("paraphrase_error"))))
    fresh = F.concat(other_flags(F.col("qa_flags"), "paraphrase_error"), short_text_flags(F.col("_answer"), F.col("raw_text"), F.col("name")))
    changed = done.select(
        *[c for c in names if c not in ("short_text", "raw_text_hash", "prompt_version", "qa_flags")],
        F.coalesce("_answer", "short_text").alias("short_text"), F.when(ok, text_hash(F.col("raw_text"))).otherwise(F.col("raw_text_hash")).alias("raw_text_hash"),
        F.when(ok, F.lit(version)).otherwise(F.col("prompt_version")).alias("prompt_version"), F.when(ok, fresh).otherwise(failed).alias("qa_flags"),
    )
    return entries.filter(~F.coalesce(is_stale(version), F.lit(False))).unionByName(changed.select(*names))


def paraphrase_some(entries: DataFrame, template: str, version: str, limit: int, model: Model = first_words, batch: int = 100) -> DataFrame:
    """Like :func:`paraphrase`, but in ``pos`` order until ``limit`` rows have succeeded. Batches of rows run one after another, as
    later rows must wait for earlier failures; between batches only ids and counts reach the driver."""
    done, last, got = None, None, 0
    while got < limit:
        rows = entries.filter(is_stale(version)) if last is None else entries.filter(is_stale(version) & (F.col("pos") > last))
        ids = [r["pos"] for r in rows.orderBy("pos").select("pos").limit(min(batch, limit - got)).collect()]
        if not ids:
            break
        out = fixed(paraphrase(entries.filter(F.col("pos").isin(ids)), template, version, model))
        got += out.filter(~F.coalesce(F.array_contains("qa_flags", "paraphrase_error"), F.lit(False))).count()
        done, last = out if done is None else done.unionByName(out), ids[-1]
    if done is None:
        return entries
    return entries.join(done.select("pos"), "pos", "left_anti").unionByName(done)


def _batched(entries: DataFrame) -> T.StructType:
    return T.StructType([*entries.schema.fields, T.StructField("batch", T.IntegerType())])


def resumed(entries: DataFrame, folder: str) -> DataFrame:
    """The entries with what earlier batches under ``folder`` wrote: of each ``pos`` the last batch's row, unless the source text has
    changed since. No folder: the entries as they are. A batch that was cut off has no committed files and is not read."""
    spark = entries.sparkSession
    if not exists(spark, folder):
        return entries
    rows = spark.read.schema(_batched(entries)).parquet(folder)
    row = F.struct(*[F.col(c) for c in entries.columns])
    last = rows.groupBy(F.col("pos").alias("_pos")).agg(F.max_by(row, "batch").alias("_done"))
    both = entries.join(last, F.col("pos") == F.col("_pos"), "left")
    holds = F.col("_done").isNotNull() & F.col("_done.raw_text").eqNullSafe(F.col("raw_text"))
    return both.select(*[F.when(holds, F.col(f"_done.{c}")).otherwise(F.col(c)).alias(c) for c in entries.columns])


def paraphrase_batches(entries: DataFrame, folder: str, template: str, version: str, limit: int | None = None, model: Model = first_words, batch: int = 1000) -> dict[str, int]:
    """Paraphrase stale rows in ``pos`` order, each batch written to ``folder/batch=N`` before the next begins, until ``limit`` rows
    have succeeded (None: all). After an interruption the same call goes on behind the last written batch; rows that failed are tried
    again. Returns the counts of this run: processed (succeeded) and errors. Read the result by :func:`resumed`."""
    spark, counts, last = entries.sparkSession, {"processed": 0, "errors": 0}, None
    number = 0
    if exists(spark, folder):
        number = 1 + (spark.read.schema(_batched(entries)).parquet(folder).agg(F.max("batch")).first()[0] or 0)
    due = resumed(entries, folder).filter(is_stale(version))
    while limit is None or counts["processed"] < limit:
        most = batch if limit is None else min(batch, limit - counts["processed"])
        rows = (due if last is None else due.filter(F.col("pos") > last)).orderBy("pos").limit(most)
        path = f"{folder}/batch={number}"
        paraphrase(rows, template, version, model).write.mode("overwrite").parquet(path)
        failed = F.array_contains("qa_flags", "paraphrase_error")
        seen = spark.read.schema(entries.schema).parquet(path).agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"), F.max("pos").alias("last")).first()
        if not seen["n"]:
            break
        counts["processed"] += seen["n"] - seen["bad"]
        counts["errors"] += seen["bad"]
        last, number = seen["last"], number + 1
    return counts


def source_nouns(entries: DataFrame) -> DataFrame:
    """(text_hash, nouns) of every distinct source text: what a revalidation needs to know of it."""
    found = entries.select(text_hash(F.col("raw_text")).alias("text_hash"), proper_nouns(F.col("raw_text"), True).alias("nouns")).filter("text_hash IS NOT NULL")
    return found.groupBy("text_hash").agg(F.any_value("nouns").alias("nouns"))


def kept_nouns(entries: DataFrame, folder: str) -> DataFrame:
    """:func:`source_nouns` from a table under ``folder``: only texts whose hash is not in it yet are searched, and are added to it."""
    spark, schema = entries.sparkSession, "text_hash string, nouns array<string>"
    held = spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
    hashed = entries.withColumn("_h", text_hash(F.col("raw_text")))
    new = hashed.join(held.select(F.col("text_hash").alias("_h")), "_h", "left_anti")
    source_nouns(new).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def revalidate(entries: DataFrame, nouns: DataFrame | None = None) -> DataFrame:
    """Fresh flags for rows with a short text, after the flags a validation does not own; ``changed`` tells where they differ.

    ``nouns`` (text_hash, nouns; one row a hash) spares the search of texts that it knows: those rows join a small set by hash.
    """
    names = entries.columns
    if nouns is not None:
        known = nouns.select(F.col("text_hash").alias("_h"), F.col("nouns").alias("_nouns"))
        entries = entries.join(known, text_hash(F.col("raw_text")) == F.col("_h"), "left")
    held = F.coalesce("qa_flags", F.array().cast("array<string>"))
    told = short_text_flags(F.col("short_text"), F.col("raw_text"), F.col("name"), None if nouns is None else F.col("_nouns"))
    fresh = F.concat(other_flags(F.col("qa_flags")), told)
    now = F.when(F.coalesce("short_text", F.lit("")) != "", fresh).otherwise(F.col("qa_flags"))
    out = entries.withColumn("changed", ~F.coalesce(now, held).eqNullSafe(held)).withColumn("qa_flags", now)
    return out.select(*names, "changed")
