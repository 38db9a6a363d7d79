"""The library's operators as queries over the driver's tables, each with the SQL it is held against.

The driver has no wiki corpus, so the tables stand in for it: documents are entries (id, language as category), pages are web
pages, conversations are numbered stories, orders with their line items are sets with pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import display, markup, names, qa
from .functions.context import follows_prose, opens_sentence
from .operators import builders, graph, incremental, merge, serving
from .operators import mentions as runs
from .operators.lineage import scratch
from .plans import graph_state, store
from .sources import json_array

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = "rotation-1"
CATEGORY = {"en": "light_cone", "fr": "relic_set", "es": "relic_set", "de": "character_story"}
SPREAD = (("en", "English text", "English texts"), ("de", "German text", "German texts"), ("fr", "French text", "French texts"), ("es", "Spanish text", "Spanish texts"))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _category() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), F.col("lang")), F.lit("other"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries; the name pairs the letters of the text's first two words as a character and a variant, and is the
    character's alone if the second has none: a bullet that nothing follows would count as part of the character's name."""
    words = F.split("text", r"[ \n\t]+")
    word = lambda i: F.regexp_replace(F.coalesce(F.get(words, F.lit(i)), F.lit("")), "[^A-Za-z]", "")
    who = F.when(word(1) == "", word(0)).otherwise(F.concat(word(0), F.lit(" • "), word(1)))
    category = _category()
    held = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    return docs(spark, sf_dir).join(held, F.col("doc_id") == F.col("l_id"), "left").select(
        F.col("doc_id").alias("entry_pos"), F.col("doc_id").cast("string").alias("entry_id"), category.alias("category"),
        F.concat(who, F.lit(" — Story "), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("raw_text"),
        F.lit(True).alias("reviewed"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("qa_flags"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_index(entries(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used capitalised names of the documents, with the languages they bridge."""
    found = runs.mentions(docs(spark, sf_dir).select(F.col("doc_id"), "lang", "text"), text="text")
    rows = found.withColumn("key", names.canonical_key(names.strip_honorific(F.col("surface"))))
    return rows.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.count("*").alias("n_mentions")).filter("n_docs > 1")


# --- SQL building blocks -------------------------------------------------------------------------------------------------

_W = "[A-Z][a-z’']+"
_RUN = f"{_W}(?:[ \\n\\t]+(?:of|the|de|and|in|on)[ \\n\\t]+{_W}|[ \\n\\t]+{_W})*".replace("'", "''")
_BLANKS = "chr(32)||chr(9)||chr(10)"
_SKIP = _BLANKS + "||'\"'||chr(39)||'“”‘’()'"
_ABBR = ",".join(f"'{a}'" for a in names.ABBREVIATIONS)
_STOP = ",".join("'" + w.replace("'", "''") + "'" for w in names.STOPWORDS)
_HON = ",".join(f"'{h}'" for h in names.HONORIFICS)
_TITLES = "|".join(f"[{h[0].upper()}{h[0]}]{h[1:]}" for h in names.HONORIFICS)


def _opens(before: str) -> str:
    rest = f"rtrim({before}, {_SKIP})"
    return f"({rest} = '' OR (right({rest}, 1) IN ('.','!','?') AND NOT (right({rest}, 1) = '.' AND lower(regexp_extract({rest}, '(\\p{{L}}*)[.]$', 1)) IN ({_ABBR}))))"


def _key(c: str) -> str:
    k = f"regexp_replace(lower({c}), '[''’]s$', '')"
    return f"(CASE WHEN right({k}, 1) = 's' AND length({k}) > 4 THEN left({k}, length({k}) - 1) ELSE {k} END)"


def _dash(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


def _mentions_sql(source: str, keep: str) -> str:
    return f"""
      parts AS (SELECT {keep}, string_split(regexp_replace(raw_text, '({_RUN})', chr(1)||'\\1'||chr(2), 'g'), chr(1)) AS p FROM {source}),
      cut AS (SELECT {keep}, CAST(i - 2 AS INTEGER) AS match_pos, regexp_replace(split_part(p[i], chr(2), 1), '[ \\n\\t]+', ' ', 'g') AS surface,
                     replace(coalesce(p[i - 2], '') || p[i - 1], chr(2), '') AS before FROM parts, unnest(range(2, len(p) + 1)) AS t(i)),
      mention AS (SELECT {keep}, match_pos, surface, {_opens('before')} AS opens, regexp_matches(rtrim(before, {_BLANKS}), '\\p{{Ll}}$') AS prose FROM cut)"""


_DOC_ENTRIES = "src AS (SELECT doc_id, text AS raw_text FROM documents)"
_WORD0 = "regexp_replace(coalesce(regexp_split_to_array(text, '[ \\n\\t]+')[{}], ''), '[^A-Za-z]', '', 'g')"
_ENTRIES = f"""
  held AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
  entry AS (
    SELECT d.doc_id AS entry_pos, CAST(d.doc_id AS VARCHAR) AS entry_id,
           CASE lang WHEN 'en' THEN 'light_cone' WHEN 'fr' THEN 'relic_set' WHEN 'es' THEN 'relic_set' WHEN 'de' THEN 'character_story' ELSE 'other' END AS category,
           {_WORD0.format(1)} || ' • ' || {_WORD0.format(2)} AS display, text AS raw_text
    FROM documents d LEFT JOIN held USING (doc_id) WHERE coalesce(toxic, 0) <> 1)"""
_BARE = "regexp_replace(surface, '^(?:[Tt][Hh][Ee]|[Aa][Nn]?) +', '')"
_INDEX = f"""WITH {_ENTRIES}, {_mentions_sql('entry', 'entry_pos, entry_id, category')},
  named AS (SELECT entry_pos, entry_id, category, match_pos, opens, prose, regexp_replace(surface, '^(?:(?:{_TITLES}) )+([A-Z])', '\\1') AS surface FROM mention),
  keyed AS (SELECT *, {_key('surface')} AS key, len(string_split(surface, ' ')) AS words FROM named),
  confirmed AS (SELECT key FROM keyed WHERE words = 1 AND prose AND lower(surface) NOT IN ({_STOP},{_HON}) GROUP BY key HAVING count(DISTINCT entry_id) >= 2),
  form AS (SELECT k.* FROM keyed k LEFT JOIN confirmed c USING (key)
           WHERE CASE WHEN words = 1 THEN lower(surface) NOT IN ({_STOP},{_HON}) AND (NOT opens OR c.key IS NOT NULL)
                 ELSE len(list_filter(string_split(lower(surface), ' '), lambda w: w NOT IN ({_STOP}))) > 0 END),
  gaz_rows AS (SELECT entry_pos, trim(split_part(display, ' • ', 1)) AS base, unnest([trim(display), trim(split_part(display, ' • ', 1))]) AS surface FROM entry WHERE category = 'character_story' AND trim(display) <> ''),
  gaz AS (SELECT {_key("surface")} AS key, max_by(base, entry_pos) AS name FROM gaz_rows GROUP BY 1),
  alias AS (SELECT {_key("a")} AS key, n AS name, {_key("n")} AS target FROM (VALUES {",".join(f"('{a}','{n}')" for a, n in names.ALIASES.items())}) AS v(a, n)),
  bare AS (SELECT *, CASE WHEN {_BARE} = '' THEN surface ELSE {_BARE} END AS bare FROM form),
  bkey AS (SELECT *, {_key("bare")} AS bkey FROM bare),
  resolved AS (
    SELECT b.entry_pos, b.entry_id, b.category, b.match_pos,
           CASE WHEN g1.key IS NOT NULL THEN b.key WHEN g2.key IS NOT NULL THEN bkey WHEN a.key IS NOT NULL THEN a.target ELSE bkey END AS key,
           CASE WHEN g1.key IS NOT NULL THEN g1.name WHEN g2.key IS NOT NULL THEN g2.name WHEN a.key IS NOT NULL THEN a.name ELSE bare END AS canonical,
           CASE WHEN g1.key IS NOT NULL OR g2.key IS NOT NULL OR (a.key IS NOT NULL AND g3.key IS NOT NULL) THEN 'character' ELSE 'term' END AS kind
    FROM bkey b LEFT JOIN gaz g1 ON b.key = g1.key LEFT JOIN gaz g2 ON b.bkey = g2.key AND b.bare <> b.surface LEFT JOIN alias a ON b.bkey = a.key LEFT JOIN gaz g3 ON a.target = g3.key),
  forms AS (SELECT key, canonical, count(*) AS n, min(entry_pos * 10000000 + match_pos) AS first FROM resolved GROUP BY 1, 2),
  shown AS (SELECT key, canonical AS name, min(first) OVER (PARTITION BY key) AS first FROM forms QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1),
  node AS (SELECT key, min(kind) AS kind, count(DISTINCT entry_id) AS entry_count, count(DISTINCT category) AS category_span, string_agg(DISTINCT entry_id, ',' ORDER BY entry_id) AS entry_ids FROM resolved GROUP BY key),
  kept AS (SELECT node.*, shown.name, shown.first FROM node JOIN shown USING (key)
           WHERE entry_count >= 2 AND (kind = 'character' OR entry_count >= CASE WHEN len(string_split(shown.name, ' ')) = 1 THEN 3 ELSE 2 END)),
  slugged AS (SELECT *, CASE WHEN {_dash("name")} = '' THEN 'unnamed' ELSE {_dash("name")} END AS slug FROM kept),
  entity AS (SELECT * EXCLUDE (n), slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY category_span DESC, entry_count DESC, name, first) AS n FROM slugged))
"""


def _nouns(text: str, skip: bool) -> str:
    """DuckDB list of noun forms of a text column expression."""
    parts = f"string_split(regexp_replace({text}, '([A-Za-z][a-zA-Z'']*)', chr(1)||'\\1'||chr(2), 'g'), chr(1))"
    bare = "regexp_replace(tok, '(?:''s|'')+$', '')"
    noun = f"CASE WHEN right({bare}, 1) = 's' AND length({bare}) > 3 THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
    common = ",".join(f"'{c}'" for c in qa.COMMON)
    return f"""(SELECT coalesce(list(DISTINCT {noun}), []) FROM (
        SELECT split_part(p[i], chr(2), 1) AS tok, replace(coalesce(p[i - 2], '') || p[i - 1], chr(2), '') AS before FROM (SELECT {parts} AS p), unnest(range(2, len(p) + 1)) AS t(i))
        WHERE regexp_matches(tok, '^[A-Z]') AND lower(tok) NOT IN ({common}) {'AND NOT ' + _opens('before') if skip else ''})"""


# --- mentions and graph --------------------------------------------------------------------------------------------------


@query(f"WITH {_DOC_ENTRIES}, {_mentions_sql('src', 'doc_id')} SELECT doc_id, match_pos, surface, opens, prose FROM mention")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.mentions(docs(spark, sf_dir).select("doc_id", "text"), text="text").select("doc_id", "match_pos", "surface", "opens", "prose")


@query(
    f"""WITH {_DOC_ENTRIES}, {_mentions_sql('src', 'doc_id')},
    named AS (SELECT doc_id, prose, regexp_replace(surface, '^(?:(?:{_TITLES}) )+([A-Z])', '\\1') AS surface FROM mention)
    SELECT {_key('surface')} AS key, count(DISTINCT doc_id) AS entries FROM named
    WHERE NOT contains(surface, ' ') AND prose AND lower(surface) NOT IN ({_STOP},{_HON}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2"""
)
def confirmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.confirmed_words(runs.mentions(docs(spark, sf_dir).select("doc_id", "text"), text="text"), entry="doc_id").select("key", "entries")


@query(_INDEX + "SELECT id, key, name, kind, entry_ids, entry_count, category_span FROM entity")
def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("id", "key", "name", "kind", F.array_join("entry_ids", ",").alias("entry_ids"), "entry_count", "category_span")


@query(_INDEX + "SELECT r.key AS key, r.category AS category, count(DISTINCT r.entry_id) AS n FROM resolved r JOIN entity e USING (key) GROUP BY 1, 2")
def entity_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("key", F.explode("category_counts").alias("category", "n"))


@query(_INDEX + "SELECT key, name, CAST(length(name) AS INTEGER) AS n_chars FROM entity")
def entity_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("key", "name", F.length("name").alias("n_chars"))


@query(
    f"""SELECT p_partkey AS key, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (
      SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_size DESC, p_retailprice DESC, name, p_partkey) AS n FROM (
        SELECT p_partkey, p_size, p_retailprice, p_type AS name, {_dash('p_type')} AS slug FROM part))"""
)
def slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("name"), F.col("p_size").alias("category_span"), F.col("p_retailprice").alias("entry_count"), F.col("p_partkey").alias("first"))
    return graph.with_ids(rows).select("key", "id")


@query(_INDEX + f"SELECT row_number() OVER (ORDER BY sha256('{SEED}' || id), id) - 1 AS pos, id FROM entity WHERE category_span >= 2 AND entry_count >= 3")
def connection_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connection_cycle(index(spark, sf_dir), SEED).select(F.col("pos").cast("long").alias("pos"), "id")


@query(_INDEX + "SELECT count(*) AS entity_count, count(*) FILTER (category_span >= 2) AS bridging, count(*) FILTER (kind = 'character') AS characters FROM entity")
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_totals(index(spark, sf_dir))


@query(_INDEX + "SELECT id, name, kind, category_span, entry_count, row_number() OVER (ORDER BY category_span DESC, entry_count DESC, name, id) AS rn FROM entity WHERE category_span >= 2 AND contains(lower(name), 'th') QUALIFY rn <= 30")
def browse_filter_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.browse(index(spark, sf_dir), "bridging", " TH ").select("id", "name", "kind", "category_span", "entry_count", F.col("rn").cast("long").alias("rn"))


@query(
    _INDEX + """, one AS (SELECT id, unnest(string_split(entry_ids, ',')) AS entry_id FROM entity)
    SELECT o.id AS entity_id, o.entry_id AS entry_id, row_number() OVER (PARTITION BY o.id ORDER BY coalesce(list_position(['light_cone','relic_set','character_story'], e.category), 0), o.entry_id) AS place
    FROM one o JOIN entry e USING (entry_id)"""
)
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.entity_links(entries(spark, sf_dir)).select(F.col("id").alias("entity_id"), "entry_id")
    rows = entries(spark, sf_dir).select("entry_id", "category", F.col("entry_id").alias("name"))
    return serving.evidence(pairs, rows).select("entity_id", "entry_id", F.col("place").cast("long").alias("place"))


@query(
    _INDEX + f""", one AS (SELECT id, unnest(string_split(entry_ids, ',')) AS entry_id FROM entity),
    titled AS (SELECT CAST(doc_id AS VARCHAR) AS entry_id, split_part(text, chr(10), 1) AS name FROM documents)
    SELECT o.id AS entity_id, o.entry_id AS entry_id, t.name AS name, row_number() OVER (PARTITION BY o.id
      ORDER BY coalesce(list_position(['light_cone','relic_set','character_story'], e.category), 0), icu_sort_key(t.name, 'root') NULLS FIRST, o.entry_id) AS place
    FROM one o JOIN entry e USING (entry_id) JOIN titled t USING (entry_id)"""
)
def evidence_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries behind every entity in a reader's order of their names: the first lines of the texts, accents and cases as they are."""
    pairs = graph.entity_links(entries(spark, sf_dir)).select(F.col("id").alias("entity_id"), "entry_id")
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("entry_id"), _category().alias("category"), F.substring_index("text", "\n", 1).alias("name"))
    return serving.evidence(pairs, rows).select("entity_id", "entry_id", "name", "place")


# --- serving -------------------------------------------------------------------------------------------------------------

_START = "1995-06-17"


@query(
    f"""WITH cycle AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS id FROM nation),
    live AS (SELECT pos, id FROM cycle WHERE length(id) % 2 = 0), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    asked AS (SELECT day, ((date_diff('day', DATE '{_START}', day) % 25) + 25) % 25 AS i FROM days)
    SELECT CAST(day AS VARCHAR) AS day, min_by(id, (pos - i + 25) % 25) AS id FROM asked, live GROUP BY day"""
)
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation")
    cycle = nations.select((F.col("n_nationkey")).cast("long").alias("pos"), F.col("n_name").alias("id"))
    live = nations.filter(F.length("n_name") % 2 == 0).select(F.col("n_name").alias("id"))
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return serving.daily_pick(cycle, live, _START, days).select(F.col("day").cast("string").alias("day"), "id")


@query(
    f"""WITH cycle AS (SELECT n_nationkey AS pos, n_name AS id FROM nation), live AS (SELECT pos, id FROM cycle WHERE length(id) % 2 = 0),
    asked AS (SELECT day, ((date_diff('day', DATE '{_START}', CAST(day AS DATE)) % 25) + 25) % 25 AS i FROM unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 1 DAY)) AS t(day)),
    pick AS (SELECT day, min_by(id, (pos - i + 25) % 25) AS id FROM asked, live GROUP BY day)
    SELECT count(DISTINCT id) AS picks, count(*) FILTER (id IS NULL) AS empty_days, CAST(25 AS BIGINT) AS length FROM pick"""
)
def rotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation")
    cycle = nations.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("id"))
    return serving.rotation_coverage(cycle, nations.filter(F.length("n_name") % 2 == 0).select(F.col("n_name").alias("id")), _START, "1995-01-01", "1995-12-31")


@query("SELECT CAST(user_id AS VARCHAR) AS id, min(event_id) AS pos, max_by(event_type, event_id) AS event_type, max_by(props, event_id) AS props FROM events GROUP BY user_id")
def dedup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("id"), "event_type", "props")
    return serving.by_id(rows).select("id", "pos", "event_type", "props")


@query("SELECT l.doc_id AS entry_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.dangling_refs(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id")), docs(spark, sf_dir).filter("lang = 'en'").select(F.col("doc_id").alias("entry_id")))


def _spread_sql() -> str:
    items = ", ".join(f"CASE WHEN {k} > 0 THEN {k} || CASE WHEN {k} = 1 THEN ' {one}' ELSE ' {many}' END END" for k, one, many in SPREAD)
    sums = ", ".join(f"count(*) FILTER (lang = '{k}') AS {k}" for k, _, _ in SPREAD)
    return f"""SELECT source, CASE WHEN len(p) = 1 THEN p[1] WHEN len(p) = 0 THEN ' and undefined' ELSE array_to_string(p[:-2], ', ') || ' and ' || p[-1] END AS spread
      FROM (SELECT source, list_filter([{items}], lambda x: x IS NOT NULL) AS p FROM (SELECT source, {sums} FROM documents GROUP BY source))"""


@query(_spread_sql())
def describe_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = docs(spark, sf_dir).groupBy("source").agg(*[F.count_if(F.col("lang") == k).alias(k) for k, _, _ in SPREAD])
    return counts.select("source", display.describe_spread({k: F.col(k) for k, _, _ in SPREAD}, SPREAD).alias("spread"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages""")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", display.escape_html(F.col("html")).alias("escaped"))


@query("SELECT o_orderpriority AS category, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(*) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS told FROM orders GROUP BY 1")
def last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_updated"))
    return serving.last_updated(rows, "category").select("category", "latest", display.plural(F.col("entries"), "order").alias("told"))


# --- names, hashes, markup -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS merge_key FROM customer")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.merge_name(F.col("c_name")).alias("merge_key"))


@query(f"SELECT p_partkey AS id, 'light-cone-' || {_dash('p_name')} AS plain, 'character-story-' || {_dash('p_name')} || '-' || p_size AS numbered FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.slug(name, "light-cone").alias("plain"), names.slug(name, "character-story", F.col("p_size")).alias("numbered"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", names.text_hash(F.col("text")).alias("hash"))


_ENC = "url_encode(replace(text, ' ', '_'))"
for _code, _char in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%27", "''"), ("%2C", ","), ("%21", "!"), ("%26", "&"), ("%7E", "~")):
    _ENC = f"replace({_ENC}, '{_code}', '{_char}')"


@query(f"SELECT doc_id, 'https://w/' || {_ENC} AS url FROM documents")
def page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", names.page_url(F.col("text"), "https://w/").alias("url"))


#: Characters of the markup. Queries with SQL read whole texts without them; the ``_whole`` ones read texts as they are.
MARKS = "{}[]|<>'="
_PIECE = "translate(text, '" + MARKS.replace("'", "''") + "', '')"
_WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _piece() -> Column:
    return F.translate("text", MARKS, "")


def _folded(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WHITE}+', ' ', 'g'))"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


@query("SELECT doc_id, " + _folded(f"'A B ' || {_PIECE} || ' b ' || {_PIECE} || ' ' || {_PIECE} || ' ' || {_PIECE} || ' he x   end'") + " AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = _piece()
    marked = F.concat(F.lit("A<br />B "), piece, F.lit(" '''b''' [[p|"), piece, F.lit("]] {{w|x|"), piece, F.lit("}} {{Rubi|"), piece, F.lit("|r}} {{MC|m=he|f=she}} {{MC|x|y}} {{sic}} {{ja|z}}  end "))
    return docs(spark, sf_dir).select("doc_id", markup.clean_text(marked).alias("clean"))


@query("SELECT doc_id, " + _folded(f"'a ' || repeat('▇', 1 + doc_id % 4) || ' ▇ ' || {_stripped(_PIECE)} || ' ' || {_stripped(_PIECE)} || ' ' || {_PIECE} || ' ' || {_PIECE} || ' z'") + " AS clean FROM documents")
def clean_text_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rare templates: blocks, slips shown and hidden, colours, links to characters."""
    piece = _piece()
    marked = F.concat(
        F.lit("a {{Obfuscate|"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("}} {{Obfuscate|x}} {{sic|"), piece, F.lit("}} {{Sic|gone|hide=1}} {{Color|keyword|"), piece,
        F.lit("}} {{Character Page Link|"), piece, F.lit("}} {{Character Page Link|"), piece, F.lit("|ref=12}} z"),
    )
    return docs(spark, sf_dir).select("doc_id", markup.clean_text(marked).alias("clean"))


@query(
    f"""SELECT doc_id, 'x {{{{n|' || {_PIECE} || '}}}} y' AS argument, {_stripped(_PIECE)} AS first, CASE WHEN text IS NOT NULL THEN '[[a|b]]' END AS second,
      coalesce(nullif({_stripped(f"split_part({_stripped(_PIECE)}, chr(10), 1)")}, ''), CASE WHEN text IS NOT NULL THEN '|two = [[a|b]]' END) AS field FROM documents"""
)
def template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = _piece()
    page = F.concat(F.lit("{{Box\n|one = "), piece, F.lit("\n|two = [[a|b]]\n}} {{Description|x {{n|"), piece, F.lit("}} y}} tail"))
    params = markup.template_params(F.col("page"), "Box")
    return docs(spark, sf_dir).select("doc_id", page.alias("page")).select(
        "doc_id", markup.template_arg(F.col("page"), "Description").alias("argument"), params["one"].alias("first"), params["two"].alias("second"), markup.infobox_field(F.col("page"), "one").alias("field")
    )


@query()
def clean_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``clean_text``, of texts as they are."""
    text = F.col("text")
    marked = F.concat(F.lit("A<br />B "), text, F.lit(" '''b''' [[p|"), text, F.lit("]] {{w|x|"), text, F.lit("}} {{Rubi|"), text, F.lit("|r}} {{MC|m=he|f=she}} {{MC|x|y}} {{sic}} {{ja|z}}  end "))
    return docs(spark, sf_dir).select("doc_id", markup.clean_text(marked).alias("clean"))


@query()
def template_fields_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``template_fields``, of texts as they are."""
    text = F.col("text")
    page = F.concat(F.lit("{{Box\n|one = "), text, F.lit("\n|two = [[a|b]]\n}} {{Description|x {{n|"), text, F.lit("}} y}} tail"))
    params = markup.template_params(F.col("page"), "Box")
    return docs(spark, sf_dir).select("doc_id", page.alias("page")).select(
        "doc_id", markup.template_arg(F.col("page"), "Description").alias("argument"), params["one"].alias("first"), params["two"].alias("second"), markup.infobox_field(F.col("page"), "one").alias("field")
    )


@query(
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \n\t\r]+', ' ', 'g')) AS body FROM pages"""
)
def html_section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), markup.html_text(F.col("html")).alias("body"))


@query("SELECT event_id, k AS name, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def props_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


# --- checks --------------------------------------------------------------------------------------------------------------


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text from its eleventh character as a short text, every seventh as it is, some empty."""
    short = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.substring("text", 11, 150))
    return docs(spark, sf_dir).select("doc_id", short.alias("short"), F.col("text").alias("raw"), F.col("source").alias("name"), "text")


_SHORT = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text ELSE substring(text, 11, 150) END AS short, text AS raw, source AS name FROM documents)"
_REFUSED = " OR ".join("contains(lower(short), '" + m.replace("'", "''") + "')" for m in qa.REFUSALS)
_BLANK = "' ' || chr(9) || chr(10)"


@query(
    f"""SELECT doc_id, CASE WHEN trim(short, {_BLANK}) = '' THEN 'empty_short_text' ELSE array_to_string(list_filter([
        CASE WHEN length(short) < 40 THEN 'short_text_too_short' END, CASE WHEN length(short) > 280 THEN 'short_text_too_long' END,
        CASE WHEN trim(short, {_BLANK}) = trim(raw, {_BLANK}) THEN 'short_text_identical_to_raw' END, CASE WHEN {_REFUSED} THEN 'possible_refusal_artifact' END,
        CASE WHEN regexp_matches(short, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN 'possible_untranslated_text' END,
        CASE WHEN len(list_filter(s, lambda x: NOT list_contains(r, x) AND NOT list_contains(n, x))) > 0 THEN 'possible_hallucinated_name' END], lambda x: x IS NOT NULL), ',') END AS flags
      FROM (SELECT *, {_nouns('short', True)} AS s, {_nouns('raw', True)} AS r, {_nouns('name', False)} AS n FROM {_SHORT})"""
)
def qa_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short_texts(spark, sf_dir).select("doc_id", F.array_join(qa.short_text_flags(F.col("short"), F.col("raw"), F.col("name")), ",").alias("flags"))


@query(f"SELECT item_id, array_to_string(list_sort({_nouns('text', True)}), ',') AS prose, array_to_string(list_sort({_nouns('text', False)}), ',') AS every FROM benchmark")
def qa_proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nouns = lambda skip: F.array_join(F.array_sort(qa.proper_nouns(F.col("text"), skip)), ",")
    return read(spark, sf_dir, "benchmark").select("item_id", nouns(True).alias("prose"), nouns(False).alias("every"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 3000 THEN 'flavor_text_unexpectedly_long' END, CASE WHEN length(text) < 10 THEN 'flavor_text_too_short' END) AS flags FROM documents")
def length_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(qa.length_flags(F.col("text"), builders.LIGHT_CONE_MAX), ",").alias("flags"))


# --- merge and increments ------------------------------------------------------------------------------------------------


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents under 600 modulo 1000 as the corpus; from 400 on as the new batch. The name repeats, so keys do too."""
    at = F.col("doc_id") % 1000
    name = F.concat(F.lit("N-"), (F.col("doc_id") % 700).cast("string"))
    rows = docs(spark, sf_dir).select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), name.alias("name"), F.substring("text", 1, 80).alias("short_text"),
        F.when(F.col("doc_id") % 5 == 0, "same").otherwise(names.text_hash(F.col("text"))).alias("raw_text_hash"), F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("held"))).otherwise(F.array().cast("array<string>")).alias("qa_flags"),
        F.lit(True).alias("reviewed"), F.lit("2024-01-01").alias("date_added"), F.lit("2024-02-01").alias("date_updated"), at.alias("at"), F.col("doc_id").alias("d"),
    )
    old = rows.filter("at < 600").drop("at", "d")
    new = rows.filter("at >= 400").withColumn("short_text", F.when(F.col("d") % 13 == 0, "").otherwise(F.col("short_text"))).drop("at", "d", "date_added", "date_updated")
    return old, new


_SEQ = """WITH r AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, lang AS category, 'n' || (doc_id % 700) AS key, doc_id % 1000 AS slot, doc_id % 13 = 0 AS bare, doc_id % 9 = 0 AS flagged,
      CASE WHEN doc_id % 5 = 0 THEN 'same' ELSE sha256(text) END AS hash, text FROM documents),
    seq AS (SELECT 0 AS src, * FROM r WHERE slot < 600 UNION ALL SELECT 1 AS src, * FROM r WHERE slot >= 400 AND NOT bare AND left(text, 80) <> ''),
    own AS (SELECT *, row_number() OVER (PARTITION BY category, key, src ORDER BY pos DESC) AS back FROM seq),
    chain AS (SELECT *, row_number() OVER w AS n, lag(hash) OVER w AS was, lag(src) OVER w AS from_src FROM own WHERE src = 1 OR back = 1 WINDOW w AS (PARTITION BY category, key ORDER BY src, pos)),
    step AS (SELECT *, src = 1 AND (n = 1 OR was IS DISTINCT FROM hash) AS fresh, max(CASE WHEN src = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY category, key) AS had FROM chain)"""


@query(
    _SEQ + """ SELECT category, key, max_by(id, src * 1000000000 + pos) AS id, CASE WHEN max(had) = 1 THEN '2024-01-01' ELSE '2025-05-05' END AS date_added,
      CASE WHEN bool_or(fresh) THEN '2025-05-05' ELSE '2024-02-01' END AS date_updated, CASE WHEN max(src) = 1 THEN NOT max_by(flagged, src * 1000000000 + pos) ELSE true END AS reviewed FROM step GROUP BY category, key"""
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    out = merge.merge_entries(old, new, "2025-05-05")
    return out.select("category", names.merge_name(F.col("name")).alias("key"), "id", "date_added", "date_updated", "reviewed")


@query(
    _SEQ + """ SELECT count(*) FILTER (src = 1 AND n = 1) AS added, count(*) FILTER (src = 1 AND n > 1 AND was IS DISTINCT FROM hash) AS updated, count(*) FILTER (src = 1 AND n > 1 AND was IS NOT DISTINCT FROM hash) AS unchanged,
      (SELECT count(*) FROM r WHERE slot >= 400 AND (bare OR left(text, 80) = '')) AS skipped_no_short_text, count(*) FILTER (src = 1 AND flagged) AS held_back_flagged FROM step"""
)
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_stats(*_old_new(spark, sf_dir))


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return docs(spark, sf_dir).select(
        d.alias("pos"), d.cast("string").alias("id"), F.col("lang").alias("category"), F.col("source").alias("name"), F.col("text").alias("raw_text"),
        F.when(d % 4 == 0, F.substring("text", 1, 100)).alias("short_text"), F.when(d % 3 == 0, names.text_hash(F.col("text"))).otherwise("old").alias("raw_text_hash"),
        F.when(d % 2 == 0, "v1").alias("prompt_version"),
        F.when(d % 10 == 0, F.array(F.lit("flavor_text_unexpectedly_long"))).when(d % 10 == 1, F.array(F.lit("short_text_too_long"), F.lit("mine"), F.lit("mine"), F.lit("paraphrase_error"))).otherwise(F.array().cast("array<string>")).alias("qa_flags"),
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 10 <> 0 AND NOT (doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 4 = 0 AND left(text, 100) <> '')")
def incremental_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).filter(incremental.is_stale("v1")).select("id")


@query(
    f"""WITH short AS (SELECT doc_id, left(text, 100) AS short, text AS raw, source AS name FROM documents WHERE doc_id % 4 = 0),
    flag AS (SELECT doc_id, CASE WHEN trim(short, {_BLANK}) = '' THEN 'empty_short_text' ELSE array_to_string(list_filter([
        CASE WHEN length(short) < 40 THEN 'short_text_too_short' END, CASE WHEN trim(short, {_BLANK}) = trim(raw, {_BLANK}) THEN 'short_text_identical_to_raw' END, CASE WHEN {_REFUSED} THEN 'possible_refusal_artifact' END,
        CASE WHEN len(list_filter(s, lambda x: NOT list_contains(r, x) AND NOT list_contains(n, x))) > 0 THEN 'possible_hallucinated_name' END], lambda x: x IS NOT NULL), ',') END AS f
      FROM (SELECT *, {_nouns('short', True)} AS s, {_nouns('raw', True)} AS r, {_nouns('name', False)} AS n FROM short)),
    was AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'flavor_text_unexpectedly_long' WHEN doc_id % 10 = 1 THEN 'short_text_too_long,mine,mine,paraphrase_error' ELSE '' END AS old,
                   CASE WHEN doc_id % 10 = 0 THEN 'flavor_text_unexpectedly_long' WHEN doc_id % 10 = 1 THEN 'mine,mine,paraphrase_error' ELSE '' END AS kept FROM documents),
    now AS (SELECT w.doc_id, old, CASE WHEN f IS NULL OR w.doc_id % 4 <> 0 THEN old ELSE kept || CASE WHEN kept <> '' AND f <> '' THEN ',' ELSE '' END || f END AS flags FROM was w LEFT JOIN flag USING (doc_id))
    SELECT CAST(doc_id AS VARCHAR) AS id, flags, flags <> old AS changed FROM now"""
)
def revalidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.revalidate(_tracked(spark, sf_dir)).select("id", F.array_join("qa_flags", ",").alias("flags"), "changed")


_FLAG_SQL = f"""CASE WHEN {_stripped('short')} = '' THEN 'empty_short_text' ELSE array_to_string(list_filter([
        CASE WHEN length(short) < 40 THEN 'short_text_too_short' END, CASE WHEN {_stripped('short')} = {_stripped('raw')} THEN 'short_text_identical_to_raw' END, CASE WHEN {_REFUSED} THEN 'possible_refusal_artifact' END,
        CASE WHEN regexp_matches(short, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN 'possible_untranslated_text' END,
        CASE WHEN len(list_filter(s, lambda x: NOT list_contains(r, x) AND NOT list_contains(n, x))) > 0 THEN 'possible_hallucinated_name' END], lambda x: x IS NOT NULL), ',') END"""


@query(
    f"""WITH due AS (SELECT doc_id, {_stripped("left(regexp_extract('Original text: ' || text, '[^\\n]*$'), 200)")} AS short, text AS raw, source AS name FROM documents WHERE text <> '' AND doc_id % 10 <> 0),
    flag AS (SELECT doc_id, short, {_FLAG_SQL} AS f FROM (SELECT *, {_nouns('short', True)} AS s, {_nouns('raw', True)} AS r, {_nouns('name', False)} AS n FROM due)),
    was AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN left(text, 100) END AS short, CASE WHEN doc_id % 2 = 0 THEN 'v1' END AS version, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END AS hash, sha256(text) AS now,
                   CASE WHEN doc_id % 10 = 0 THEN 'flavor_text_unexpectedly_long' WHEN doc_id % 10 = 1 THEN 'short_text_too_long,mine,mine,paraphrase_error' ELSE '' END AS old, CASE WHEN doc_id % 10 = 1 THEN 'mine,mine' ELSE '' END AS kept FROM documents)
    SELECT CAST(w.doc_id AS VARCHAR) AS id, CASE WHEN f IS NULL THEN w.short ELSE flag.short END AS short_text, CASE WHEN f IS NULL THEN version ELSE 'v2' END AS prompt_version, CASE WHEN f IS NULL THEN hash ELSE now END AS raw_text_hash,
      CASE WHEN f IS NULL THEN old ELSE kept || CASE WHEN kept <> '' AND f <> '' THEN ',' ELSE '' END || f END AS flags FROM was w LEFT JOIN flag USING (doc_id)"""
)
def incremental_paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = "Name: {name}\nCategory: {category}\nOriginal text: {raw_text}"
    return incremental.paraphrase(_tracked(spark, sf_dir), template, "v2").select("id", "short_text", "prompt_version", "raw_text_hash", F.array_join("qa_flags", ",").alias("flags"))


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS total,
    'Character Story ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' of ' || count(*) OVER (PARTITION BY conv_id) || ' · ' || conv_id AS subtitle FROM conversations WHERE role <> 'system' AND text <> ''"""
)
def story_position_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = builders.positions(read(spark, sf_dir, "conversations").filter("role <> 'system' and text <> ''"), "conv_id", "turn")
    told = F.format_string("Character Story %d of %d · %s", F.col("position"), F.col("total"), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "turn", F.col("position").cast("long").alias("position"), "total", told.alias("subtitle"))


@query("SELECT o_orderkey, string_agg(l_returnflag || l_linestatus || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS pieces, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ordered_piece_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    # the pieces are gathered before the join, so each order's lines cross the network once
    gathered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["l_returnflag"], x["l_linestatus"], x["l_partkey"].cast("string"))), " ")
    return orders.join(gathered, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", text.alias("pieces"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n"))


@query("SELECT category, count(*) AS entries, count(*) FILTER (flagged) AS flagged, count(*) FILTER (text = '') AS empty FROM (SELECT lang AS category, doc_id % 9 = 0 AS flagged, text FROM documents) GROUP BY 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.build import run_summary as summary

    return summary(docs(spark, sf_dir).select(F.col("lang").alias("category"), F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("qa_flags"), F.col("text").alias("raw_text")))


# --- record builders -----------------------------------------------------------------------------------------------------


def _whole() -> Column:
    return F.coalesce("text", F.lit(""))


_LENGTHS = "concat_ws(',', CASE WHEN length({t}) > {most} THEN 'flavor_text_unexpectedly_long' END, CASE WHEN length({t}) < 10 THEN 'flavor_text_too_short' END)"


@query(
    f"""SELECT 'light-cone-page-' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'Light Cone' WHEN doc_id % 3 = 0 THEN 'Light Cone · ' || lang ELSE '5★ Light Cone · ' || lang END AS subtitle,
      CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_folded(f"coalesce({_PIECE}, '') || ' link'")} END AS raw_text,
      CASE WHEN doc_id % 5 = 0 THEN 'no_description_template' ELSE {_LENGTHS.format(t=_folded(f"coalesce({_PIECE}, '') || ' link'"), most=builders.LIGHT_CONE_MAX)} END AS flags, 'w/Page_' || doc_id AS source_url FROM documents"""
)
def light_cone_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    box = F.concat(F.lit("{{Box\n|rarity = "), F.when(d % 3 == 0, "?").otherwise("5"), F.lit("\n|effect_path = "), F.col("lang"), F.lit("\n}}"))
    told = F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("{{Description|"), F.coalesce(_piece(), F.lit("")), F.lit(" [[a|link]]}}")))
    pages = docs(spark, sf_dir).select(F.concat(F.lit("Page "), d.cast("string")).alias("title"), F.concat(box, told).alias("wikitext"))
    return builders.light_cones(pages, "w/").select("id", "subtitle", "raw_text", F.array_join("qa_flags", ",").alias("flags"), "source_url")


@query(
    f"""WITH one AS (SELECT doc_id, {_folded(_PIECE)} AS t FROM documents),
    part AS (SELECT s.doc_id, i, p.doc_id AS pid, CASE WHEN p.doc_id % 4 = 0 THEN '' ELSE coalesce(p.t, '') END AS t FROM one s, unnest(range(0, CASE WHEN s.doc_id % 2 = 0 THEN 4 ELSE 2 END)) AS u(i) LEFT JOIN one p ON p.doc_id = s.doc_id + i + 1),
    label AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN ['Head','Hand','Body','Feet'][i + 1] ELSE ['Planar Sphere','Link Rope'][i + 1] END AS label FROM part),
    whole AS (SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (t <> ''), '') AS raw_text,
                     string_agg('missing_piece_description:' || label, ',' ORDER BY i) FILTER (t = '') AS lost, min(doc_id + i + 1) FILTER (pid IS NULL) AS gone FROM label GROUP BY doc_id)
    SELECT 'relic-set-set-' || doc_id AS id, '4★ ' || CASE WHEN doc_id % 2 = 0 THEN 'Relic Set' ELSE 'Planar Ornament' END AS subtitle, raw_text, 'P' || gone AS error,
      concat_ws(',', lost, CASE WHEN raw_text = '' THEN 'no_lore_text' END, CASE WHEN length(raw_text) > {builders.RELIC_MAX} THEN 'flavor_text_unexpectedly_long' END, CASE WHEN raw_text <> '' AND length(raw_text) < 10 THEN 'flavor_text_too_short' END) AS flags FROM whole"""
)
def relic_set_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    link = lambda field, i: F.concat(F.lit(f"|{field} = P"), (d + i).cast("string"), F.lit("\n"))
    cavern = F.concat(*[link(f, i + 1) for i, (f, _) in enumerate(builders.CAVERN)])
    planar = F.concat(*[link(f, i + 1) for i, (f, _) in enumerate(builders.PLANAR)])
    sets = docs(spark, sf_dir).select(F.concat(F.lit("Set "), d.cast("string")).alias("title"), F.concat(F.lit("{{Set\n|rarity = 3★4★\n"), F.when(d % 2 == 0, cavern).otherwise(planar), F.lit("}}")).alias("wikitext"))
    body = F.when(d % 4 == 0, "").otherwise(F.coalesce(_piece(), F.lit("")))
    pages = docs(spark, sf_dir).select(F.concat(F.lit("P"), d.cast("string")).alias("title"), F.concat(F.lit("==Description==\n"), body, F.lit("\n==Next==\nz")).alias("wikitext"))
    return builders.relic_sets(sets, pages).select("id", "subtitle", "raw_text", "error", F.array_join("qa_flags", ",").alias("flags"))


@query(
    f"""WITH one AS (SELECT doc_id, lang, {_folded(_PIECE)} AS t FROM documents WHERE {_folded(_PIECE)} <> '')
    SELECT 'character-story-c-' || doc_id || '-' || n AS id, 'C ' || doc_id || ' — Story ' || n AS name, 'Character Story ' || place || ' of 2 · C ' || doc_id AS subtitle, t AS raw_text,
      {_LENGTHS.format(t='t', most=builders.STORY_MAX)} AS flags FROM one, (VALUES (1, 1), (4, 2)) AS v(n, place)"""
)
def character_story_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(_piece(), F.lit(""))
    page = F.concat(F.lit("x {{Character Story|text1 = "), text, F.lit("|text2 = |mention1=[[a|b]]|text4="), text, F.lit("}}"))
    lore = docs(spark, sf_dir).select(F.concat(F.lit("C "), F.col("doc_id").cast("string")).alias("name"), page.alias("wikitext"))
    return builders.character_stories(lore).select("id", "name", "subtitle", "raw_text", F.array_join("qa_flags", ",").alias("flags"))


@query()
def light_cone_records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``light_cone_records``, of texts as they are."""
    d = F.col("doc_id")
    box = F.concat(F.lit("{{Box\n|rarity = "), F.when(d % 3 == 0, "?").otherwise("5"), F.lit("\n|effect_path = "), F.col("lang"), F.lit("\n}}"))
    told = F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("{{Description|"), _whole(), F.lit(" [[a|link]]}}")))
    pages = docs(spark, sf_dir).select(F.concat(F.lit("Page "), d.cast("string")).alias("title"), F.concat(box, told).alias("wikitext"))
    return builders.light_cones(pages, "w/").select("id", "subtitle", "raw_text", F.array_join("qa_flags", ",").alias("flags"), "source_url")


@query()
def relic_set_records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``relic_set_records``, of texts as they are."""
    d = F.col("doc_id")
    link = lambda field, i: F.concat(F.lit(f"|{field} = P"), (d + i).cast("string"), F.lit("\n"))
    cavern = F.concat(*[link(f, i + 1) for i, (f, _) in enumerate(builders.CAVERN)])
    planar = F.concat(*[link(f, i + 1) for i, (f, _) in enumerate(builders.PLANAR)])
    sets = docs(spark, sf_dir).select(F.concat(F.lit("Set "), d.cast("string")).alias("title"), F.concat(F.lit("{{Set\n|rarity = 3★4★\n"), F.when(d % 2 == 0, cavern).otherwise(planar), F.lit("}}")).alias("wikitext"))
    body = F.when(d % 4 == 0, "").otherwise(_whole())
    pages = docs(spark, sf_dir).select(F.concat(F.lit("P"), d.cast("string")).alias("title"), F.concat(F.lit("==Description==\n"), body, F.lit("\n==Next==\nz")).alias("wikitext"))
    return builders.relic_sets(sets, pages).select("id", "subtitle", "raw_text", "error", F.array_join("qa_flags", ",").alias("flags"))


@query()
def character_story_records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``character_story_records``, of texts as they are."""
    page = F.concat(F.lit("x {{Character Story|text1 = "), _whole(), F.lit("|text2 = |mention1=[[a|b]]|text4="), _whole(), F.lit("}}"))
    lore = docs(spark, sf_dir).select(F.concat(F.lit("C "), F.col("doc_id").cast("string")).alias("name"), page.alias("wikitext"))
    return builders.character_stories(lore).select("id", "name", "subtitle", "raw_text", F.array_join("qa_flags", ",").alias("flags"))


@query(
    _INDEX + """, per AS (SELECT r.key, count(DISTINCT r.entry_id) FILTER (r.category = 'light_cone') AS a, count(DISTINCT r.entry_id) FILTER (r.category = 'relic_set') AS b, count(DISTINCT r.entry_id) FILTER (r.category = 'character_story') AS c
      FROM resolved r GROUP BY 1),
    word AS (SELECT key, list_filter([CASE WHEN a > 0 THEN a || CASE WHEN a = 1 THEN ' light cone' ELSE ' light cones' END END, CASE WHEN b > 0 THEN b || CASE WHEN b = 1 THEN ' relic set' ELSE ' relic sets' END END,
      CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' character story' ELSE ' character stories' END END], lambda x: x IS NOT NULL) AS p FROM per)
    SELECT id, name, kind, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[:-2], ', ') || ' and ' || p[-1] END AS spread, category_span > 1 AS bridges, entry_count FROM entity JOIN word USING (key)"""
)
def connection_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.connection_card(index(spark, sf_dir))


# --- what is kept between runs -------------------------------------------------------------------------------------------


@query(ORACLE_SQL["merge_upsert"])
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge through a store of change files: the old rows, then the new ones in two batches."""
    old, new = _old_new(spark, sf_dir)
    base = merge.merge_entries(old, new.filter("false"), "2024-02-01")
    folder = scratch(spark, "store")
    store.create(spark, folder, base.withColumn("pos", F.col("pos._pos")).select(*old.columns), buckets=16)
    middle = (new.agg(F.max("pos")).first()[0] or 0) // 2  # no new rows: two empty batches
    for batch in (new.filter(F.col("pos") <= middle), new.filter(F.col("pos") > middle)):
        store.upsert(spark, folder, batch, "2025-05-05", compact_after=1)
    return store.read(spark, folder).select("category", names.merge_name(F.col("name")).alias("key"), "id", "date_added", "date_updated", "reviewed")


@query(ORACLE_SQL["entity_index"])
def graph_from_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all entries, reached by an update: some of them were other or not there before, and some others were."""
    now = entries(spark, sf_dir)
    kind = F.pmod(F.xxhash64("entry_id"), F.lit(20))
    swapped = F.concat(F.lit("they met Old Mara at "), F.substring_index("raw_text", "\n", 1))
    before = now.filter(kind != 1).withColumn("raw_text", F.when(kind == 0, swapped).otherwise(F.col("raw_text")))
    extra = now.filter(kind == 2).withColumn("entry_id", F.concat(F.lit("gone-"), "entry_id"))
    folder = scratch(spark, "graph")
    graph_state.rebuild(before.unionByName(extra), folder)
    graph_state.update(folder, now.filter(kind <= 1), extra.select("entry_id"))
    return graph_state.entities(spark, folder).select("id", "key", "name", "kind", F.array_join("entry_ids", ",").alias("entry_ids"), "entry_count", "category_span")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text, lang, source, n_chars FROM documents")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as an indented JSON array in parts, and read again in splits."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("pos"), "doc_id", "text", "lang", "source", "n_chars")
    folder = scratch(spark, "array")
    json_array.write_array(rows, f"{folder}/documents")
    return json_array.read_array(spark, f"{folder}/documents", rows.drop("pos").schema)


@query(ORACLE_SQL["revalidate_flags"])
def revalidate_kept_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same revalidation with the nouns of the source texts from a kept table."""
    rows = _tracked(spark, sf_dir)
    nouns = incremental.kept_nouns(rows, scratch(spark, "nouns"))
    return incremental.revalidate(rows, nouns).select("id", F.array_join("qa_flags", ",").alias("flags"), "changed")
