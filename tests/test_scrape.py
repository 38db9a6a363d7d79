"""A scrape against a server of its own: stopped midway, gone on, failed pages asked again."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from loomspan.plans import scrape as plan
from loomspan.sources import wiki


class Server:
    """A wiki with a listing in pages of seven titles; ``bad`` titles fail, and every request is noted."""

    def __init__(self, titles):
        self.titles, self.bad, self.asked, self.listed, self.agents = list(titles), set(), [], [], set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.agents.add(self.headers["User-Agent"])
                status, body = outer.listing(q) if "list" in q else outer.page(q["page"])
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *a):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.endpoint = f"http://127.0.0.1:{self.http.server_port}/api"

    def listing(self, q):
        at = int(q.get("cmcontinue", "0"))
        self.listed.append(at)
        part = self.titles[at : at + 7]
        more = {"continue": {"cmcontinue": str(at + 7)}} if at + 7 < len(self.titles) else {}
        return 200, {"query": {"categorymembers": [{"title": t} for t in part]}, **more}

    def page(self, title):
        self.asked.append(title)
        return (404, {}) if title in self.bad else (200, {"parse": {"wikitext": {"*": f"text of {title}"}}})


@pytest.fixture
def server():
    s = Server(f"T{i:02}" for i in range(24))
    yield s
    s.http.shutdown()


def _client(endpoint):
    return lambda: wiki.Client(wiki.http_fetch(endpoint, "tests"), sleep=lambda s: None)


def _run(spark, server, tmp_path, name, **more):
    spark.dataSource.register(wiki.make_listing(name, _client(server.endpoint)))
    titles = spark.readStream.format(name).option("category", "K").option("pages", "5").load()
    query = plan.scrape(titles, str(tmp_path / "pages"), str(tmp_path / "cp"), _client(server.endpoint), **more)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_goes_on_at_the_next_page(spark, server, tmp_path, monkeypatch):
    server.bad = {"T03", "T17"}
    real, done = plan._fetch_batch, []

    def stopping(*a):
        if len(done) == 2:
            raise RuntimeError("stopped")
        real(*a)
        done.append(a[3])

    monkeypatch.setattr(plan, "_fetch_batch", stopping)
    with pytest.raises(Exception, match="stopped"):
        _run(spark, server, tmp_path, "wiki_a")
    assert server.asked == [f"T{i:02}" for i in range(10)] and done == [0, 1]
    monkeypatch.setattr(plan, "_fetch_batch", real)
    server.asked.clear()
    server.listed.clear()
    _run(spark, server, tmp_path, "wiki_a")
    assert server.asked == [f"T{i:02}" for i in range(10, 24)] and min(server.listed) == 7  # the listing, too, is not read from its start
    got = plan.pages(spark, str(tmp_path / "pages")).orderBy("pos").collect()
    assert [(r.pos, r.title) for r in got] == [(i, f"T{i:02}") for i in range(24)]
    assert {r.title: r.error for r in got if r.error} == {"T03": "status 404", "T17": "status 404"} and all((r.wikitext is None) == (r.error is not None) for r in got)

    server.titles.append("T24")  # at the end of the listing
    server.bad, server.asked = {"T17"}, []
    _run(spark, server, tmp_path, "wiki_a")
    assert server.asked == ["T24"]
    assert plan.retry_failed(spark, str(tmp_path / "pages"), _client(server.endpoint)) == 2 and sorted(server.asked) == ["T03", "T17", "T24"]
    got = {r.title: r for r in plan.pages(spark, str(tmp_path / "pages")).collect()}
    assert len(got) == 25 and got["T03"].wikitext == "text of T03" and [t for t, r in got.items() if r.error] == ["T17"]
    assert server.agents == {"tests"}


def test_pages_that_are_there_are_not_asked_for(spark, server, tmp_path):
    spark.createDataFrame([(0, "T00", "held", None), (1, "T01", None, "status 500")], plan.PAGE).write.parquet(str(tmp_path / "pages/run=-1/batch=0"))
    _run(spark, server, tmp_path, "wiki_b", lanes=2)
    assert "T00" not in server.asked and "T01" in server.asked and len(server.asked) == 23
    got = {r.title: r.wikitext for r in plan.pages(spark, str(tmp_path / "pages")).collect()}
    assert got["T00"] == "held" and got["T01"] == "text of T01" and len(got) == 24


def test_an_empty_category(spark, tmp_path):
    server = Server([])
    _run(spark, server, tmp_path, "wiki_c")
    assert plan.pages(spark, str(tmp_path / "pages")).collect() == [] and server.asked == []
    server.http.shutdown()
