import random
import re

from loomspan.llm import url_filter as uf


def judge(spark, *rows, edges=None):
    df = spark.createDataFrame(list(rows), "page_id long, url string, html string")
    more = spark.createDataFrame(edges, "source string, target string") if edges else None
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge_pages(df, more_edges=more).collect()}


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.name)).name if fit else None


def test_rules_match_a_plain_version(spark):
    r = random.Random(0)
    urls = [None, "", "nourl", "://", "a://", "HTTP://EXAMPLE.com/en/7?x", "http://xexample.com/en/7", "http://com/en/", "x://é.ORG/es/#/de"]
    urls += ["".join([r.choice(["http", "HTTPS"]), "://", r.choice(["", "a.", "A.b."]), r.choice(["example.", "xample.", ""]), r.choice(["com", "net", "org"]), "/", r.choice(["en", "de", "es"]), "/", r.choice(["7", "8", "71", ""]), r.choice(["", "?q", "#f"])]) for _ in range(120)]
    got = judge(spark, *[(i, u, None) for i, u in enumerate(urls)])
    kinds = {x.name: x.verdict for x in uf.RULES}
    for i, u in enumerate(urls):
        host, path, rule = plain(u)
        assert got[i] == (host, path, rule, kinds.get(rule, "allow"))


def test_aliases(spark):
    got = judge(
        spark, (1, "http://A.example.org/x", '<link rel="canonical" href="https://b.org/es/1">'), (2, "https://b.org/es/1", "x"), (3, "http://c.fr/q", '<META HTTP-EQUIV="refresh" content="0; URL=http://a.example.org/x#f">'),
        (4, "http://d.fr/1", '<script>location.href="/es/"</script>'), (5, None, None), (6, "http://k.fr/", "<link href=http://x.net/de/1 rel=canonical >"), (7, "http://x.net/de/1?", '<link rel=canonical href="http://a.org/es/">'),
        (8, "http://m.fr/a/b", '<link rel="canonical" href="c">'), (9, "http://m.fr/a/c", '<link rel="canonical" href="//b.org/es/2">'), (9, "http://m.fr/a/c", '<link rel="canonical" href="//b.org/es/2">'),
        (10, "http://p.fr/", '<link rel="canonical" href="http://q.fr/">'), (11, "http://q.fr/", '<link rel="canonical" href="http://x.net/de/3">'), (12, "http://r.fr/", '<link rel="canonical" href="http://p.fr/"><link rel="canonical" href="http://b.org/es/9">'),
        edges=[("http://s.fr/", "http://com/en/"), ("http://s.fr/", "http://s.fr/")],
    )
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow"}


def test_alias_tags_in_any_form(spark):
    to = "https://b.org/es/1"
    tags = [
        f"<link href={to} rel=canonical>", f'<link rel="alternate canonical" href="{to}">', f"<LINK HREF='{to}' REL='Canonical'>", f"<link href={to} rel=canonical />", f'<link href="{to}" rel=canonical/>',
        f'<meta content="0; URL={to}" http-equiv="refresh">', f"<meta content='0;url=\"{to}\"' http-equiv=Refresh>", f"<meta content=0;url={to} name=x http-equiv='refresh'/>", f'<meta http-equiv="refresh" content="0; url={to}">',
    ]
    no = [f'<link rel="alternate" href="{to}">', f'<link rel="noncanonical" href="{to}">', f'<meta content="0; url={to}" name="refresh">', f'<meta content="url={to}" http-equiv="x-refresh">']
    got = judge(spark, *[(i, f"http://h.fr/{i}", f"<title>x</title>{t}<p>y</p>") for i, t in enumerate(tags + no)])
    assert [got[i][3] for i in range(len(tags + no))] == ["block"] * len(tags) + ["allow"] * len(no)


def test_long_chains_and_stars(spark):
    chain = [(i, f"http://h.fr/{i}", f'<link rel="canonical" href="http://h.fr/{i + 1}">') for i in range(40)]
    star = [(100 + i, f"http://s.fr/{i}", '<link rel="canonical" href="http://h.fr/20">') for i in range(60)]
    got = judge(spark, *chain, *star, (39, "http://h.fr/40", '<link rel="canonical" href="http://w.com/en/">'))
    assert {v[3] for v in got.values()} == {"block"}


def test_components_match_a_union_find(spark):
    """Random graphs of links among pages and urls that are no pages, judged by a plain union-find."""
    r = random.Random(8)
    hosts = ["a.fr", "b.fr", "x.com", "y.net", "z.org", "example.com", "example.net"]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'it'])}/{r.randint(0, 40)}"
    pages, edges = [], []
    for i in range(300):
        u, links = url(), [url() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        pages.append((i, u if i % 29 else None, "".join(f'<link rel="canonical" href="{t}">' for t in links)))
        edges += [(u, t) for t in links if i % 29]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    kinds = {x.name: x.verdict for x in uf.RULES}
    told = {}
    for x in root:
        told.setdefault(find(x), set()).add(kinds.get(plain(x)[2]))
    got = judge(spark, *pages)
    for i, u, _ in pages:
        group = told[find(u)] if u in root else set()
        alias = "allow" if "allow" in group else "block" if "block" in group else "allow"
        assert got[i] == (*plain(u), kinds.get(plain(u)[2], alias))
    assert sum(len(g) > 1 for g in told.values()) > 3


def test_clashing_columns_and_a_long_page(spark):
    df = spark.createDataFrame([(1, "http://a.fr/" + "x" * 50_000, "<p>" * 200_000 + '<link rel="canonical" href="http://q.org/es/1">', 3, 4)], "page_id long, url string, html string, node int, host int")
    assert [x["verdict"] for x in uf.judge_pages(df).collect()] == ["block"]


def test_empty(spark):
    assert uf.judge_pages(spark.createDataFrame([], "page_id long, url string, html string, node string, rule string")).collect() == []
