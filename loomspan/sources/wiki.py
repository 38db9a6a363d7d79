"""Connector to a wiki API as Python data sources: paced and retried reads of category members and pages, in one go or as a stream
whose offsets are the server's own continuation marks."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# Pacing, retries, time limit of a request.
MIN_DELAY, JITTER, TRIES, FIRST_WAIT, RETRIED, LIST_SIZE, TIMEOUT = 1.0, 0.4, 5, 2.0, (429, 500, 502, 503), 500, 20


def http_fetch(endpoint: str, agent: str, timeout: float = TIMEOUT) -> Callable[[dict], tuple[int, dict]]:
    """A ``fetch`` for :class:`Client` that asks ``endpoint`` by GET. A status other than 200 comes without a body."""

    def fetch(params: dict) -> tuple[int, dict]:
        request = Request(f"{endpoint}?{urlencode(params)}", headers={"User-Agent": agent})
        try:
            with urlopen(request, timeout=timeout) as answer:
                return answer.status, json.loads(answer.read().decode("utf-8"))
        except HTTPError as e:
            return e.code, {}

    return fetch


def cache_name(params: dict) -> str:
    """File of a request: sha256 of its parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest() + ".json"


class Client:
    """``fetch(params)`` returns (status, body). Answers are kept in the folder ``cache``, if any; errors in an answer's body are not.
    The folder is one machine's; where tasks run on many, a scrape's own table (``plans.scrape``) is what is asked first."""

    def __init__(self, fetch: Callable[[dict], tuple[int, dict]], cache: str | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.fetch, self.cache, self.sleep, self.now, self.last = fetch, cache and Path(cache), sleep, now, None

    def get(self, params: dict, refresh: bool = False) -> dict:
        path = self.cache and self.cache / cache_name(params)
        if path and path.exists() and not refresh:
            return json.loads(path.read_text(encoding="utf-8"))
        for k in range(TRIES):
            if self.last is not None:
                self.sleep(max(0.0, MIN_DELAY - (self.now() - self.last)) + random.uniform(0, JITTER))
            self.last = self.now()
            status, body = self.fetch(params)
            if status == 200:
                if path and "error" not in body:
                    self.cache.mkdir(parents=True, exist_ok=True)
                    path.write_text(json.dumps(body), encoding="utf-8")
                return body
            if status not in RETRIED:
                raise RuntimeError(f"status {status}")
            self.sleep(FIRST_WAIT * 2**k)
        raise RuntimeError("no answer after retries")

    def listed(self, category: str, mark: str = "", refresh: bool = False) -> tuple[list[str], str]:
        """Page titles of a category from the continuation ``mark`` on (empty: the start), as many as the server gives at once, and
        the next mark, empty at the end."""
        params = {"action": "query", "list": "categorymembers", "cmtitle": f"Category:{category}", "cmtype": "page", "cmlimit": str(LIST_SIZE), "format": "json"}
        body = self.get({**params, "cmcontinue": mark} if mark else params, refresh)
        return [m["title"] for m in body["query"]["categorymembers"]], body["continue"]["cmcontinue"] if "continue" in body else ""

    def members(self, category: str, refresh: bool = False) -> Iterator[str]:
        """Page titles of a category, following continuations, in order."""
        mark, more = "", True
        while more:
            titles, mark = self.listed(category, mark, refresh)
            yield from titles
            more = bool(mark)

    def wikitext(self, title: str, refresh: bool = False) -> str:
        body = self.get({"action": "parse", "page": title, "prop": "wikitext", "format": "json"}, refresh)
        return body["parse"]["wikitext"]["*"]


def make_source(name: str, client: Callable[[], Client]) -> type[DataSource]:
    """A data source class to register under ``name``: option ``category`` gives (pos, title, wikitext, error).

    One partition, as the server is to be asked one request at a time; a page that fails has an error and no text. Option
    ``limit`` stops after that many titles; 0 gives none.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            api, limit = client(), self.options.get("limit")
            refresh = self.options.get("refresh", "false") == "true"
            for pos, title in enumerate(api.members(self.options["category"], refresh)):
                if limit is not None and pos >= int(limit):
                    return
                try:
                    yield pos, title, api.wikitext(title, refresh), None
                except Exception as e:  # one bad page does not end the scan
                    yield pos, title, None, str(e)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "pos int, title string, wikitext string, error string"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source


def make_listing(name: str, client: Callable[[], Client]) -> type[DataSource]:
    """A streaming source to register under ``name``: the titles of option ``category`` as (pos, title), option ``pages`` (20) of them
    a batch.

    An offset is the server's continuation mark, how many titles behind it are done, and the place of the next: a stream that was
    stopped goes on at the next title, and one that has reached the end finds titles that are added there later.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.category, self.pages, self.api = options["category"], int(options.get("pages", "20")), client()

        def initialOffset(self) -> dict:
            return {"mark": "", "done": 0, "pos": 0}

        def _from(self, start: dict, most: int) -> tuple[list[tuple[int, str]], dict]:
            found, at = [], dict(start)
            while len(found) < most:
                titles, mark = self.api.listed(self.category, at["mark"], refresh=True)
                part = titles[at["done"] : at["done"] + most - len(found)]
                found += [(at["pos"] + k, t) for k, t in enumerate(part)]
                at = {"mark": at["mark"], "done": at["done"] + len(part), "pos": at["pos"] + len(part)}
                if at["done"] < len(titles) or not mark:
                    break
                at = {"mark": mark, "done": 0, "pos": at["pos"]}
            return found, at

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            found, end = self._from(start, self.pages)
            return iter(found), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(self._from(start, end["pos"] - start["pos"])[0])

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "pos long, title string"

        def simpleStreamReader(self, schema) -> Reader:
            return Reader(self.options)

    return Listing
