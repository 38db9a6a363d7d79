"""A scrape that can be stopped at any page: a stream of titles, fetched batch by batch into a table that is its own cache.

``folder/run=R/batch=B`` holds the rows (pos, title, wikitext, error) that a batch fetched or found. Batches are committed by Spark, so
what was fetched is kept on the file system that all executors share; the stream's checkpoint tells where to go on. A page that
could not be fetched is a row with an error and no text; it does not end the scrape, and :func:`retry_failed` asks for it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.json_array import exists, located
from ..sources.wiki import Client

PAGE = "pos long, title string, wikitext string, error string"


def fetched(titles: DataFrame, client: Callable[[], Client], lanes: int = 1) -> DataFrame:
    """Each title's page. ``lanes`` tasks ask at the same time, each at the client's pace."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        api = client()
        for pdf in batches:
            for pos, title in zip(pdf["pos"], pdf["title"]):
                text = error = None
                try:
                    text = api.wikitext(title)
                except Exception as e:  # one bad page does not end the scrape
                    error = str(e) or type(e).__name__
                yield pd.DataFrame({"pos": [pos], "title": [title], "wikitext": [text], "error": [error]})

    return titles.select("pos", "title").repartitionByRange(lanes, "pos").sortWithinPartitions("pos").mapInPandas(fetch, PAGE)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every title."""
    if not exists(spark, folder):
        return spark.createDataFrame([], PAGE)
    rows = spark.read.schema(PAGE + ", run int, batch long").parquet(folder)
    newest = rows.groupBy("title").agg(F.max_by(F.struct("pos", "wikitext", "error"), F.struct("run", "batch")).alias("_row"))
    return newest.select("_row.pos", "title", "_row.wikitext", "_row.error")


def _fetch_batch(titles: DataFrame, folder: str, run: int, batch: int, client: Callable[[], Client], lanes: int, refresh: bool) -> None:
    """Write a batch: pages that are there already as they are, the others from the server."""
    spark = titles.sparkSession
    titles = titles.dropDuplicates(["title"])
    held = pages(spark, folder).filter("error IS NULL").select("title", "wikitext", "error")
    if refresh:
        held = held.filter("false")
    known = titles.join(held, "title").select("pos", "title", "wikitext", "error")
    new = fetched(titles.join(held, "title", "left_anti"), client, lanes)
    known.unionByName(new).write.mode("overwrite").parquet(f"{folder}/run={run}/batch={batch}")


def scrape(titles: DataFrame, folder: str, checkpoint: str, client: Callable[[], Client], lanes: int = 1, refresh: bool = False) -> StreamingQuery:
    """Fetch the pages of a stream of titles (pos, title; see ``wiki.make_listing``) into ``folder``. A call after a stop goes on with the
    batch that was not finished; ``refresh`` asks the server even for pages that are there."""

    def step(batch: DataFrame, number: int) -> None:
        _fetch_batch(batch, folder, 0, number, client, lanes, refresh)

    return titles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def retry_failed(spark: SparkSession, folder: str, client: Callable[[], Client], lanes: int = 1) -> int:
    """Ask again for the pages whose newest row is an error; returns how many those were."""
    failed = pages(spark, folder).filter("error IS NOT NULL").select("pos", "title")
    n = failed.count()
    if n:
        place, system = located(spark, folder)
        run = 1 + max(int(s.getPath().getName().split("=")[1]) for s in system.listStatus(place) if s.getPath().getName().startswith("run="))
        _fetch_batch(failed, folder, run, 0, client, lanes, False)
    return n
