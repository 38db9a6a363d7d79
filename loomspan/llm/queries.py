"""The registered query of every training-data operator, with production parameters, over its whole table.

Fingerprints, toxicity, packing, mixing (which documents it takes), PII candidates, licence scores, token alignment and whitening are not
expressible in SQL; their tests hold them against brute-force versions or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import secret_scan, url_filter
from .alignment import align_tokens
from .common import table
from .fingerprints import fingerprint_documents
from .license_scan import licence_digest
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .online_packing import pack_online
from .packing import best_fit_packing
from .pii import pii_digest
from .secret_scan import secret_digest
from .topk import exact_top_k
from .toxicity import toxicity
from .url_filter import judge_pages
from .whitening import whiten

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_toxicity, op3_best_fit_packing, op4_source_mix, op5_url_filter, op6_pii, op7_ngram_join, op8_license_scan,
        op9_secret_scan, op10_exact_topk, op11_token_alignment, op12_online_packing, op13_embedding_whitening,
    )
}

# --- SQL that the queries are held against ---------------------------------------------------------------------------------

_GAP = "[\\x20\\x09-\\x0D]+"


def _fits(r: url_filter.Rule) -> str:
    return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"


def _url_sql() -> str:
    """Rules by length; links of pages by the same expressions, closed by recursion."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules) + " END"
    split = "'(?s)^(.*?://)([^/?#]*)([^?#]*)'"
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = lambda u: f"{low(f'coalesce(regexp_extract({u}, {split}, 2), {chr(39)}{chr(39)})')} AS host, coalesce(regexp_extract({u}, {split}, 3), '') AS path"
    normal = lambda u: f"{low(f'regexp_extract({u}, {split}, 1) || regexp_extract({u}, {split}, 2)')} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    resolved = (
        "CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t "
        "ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || t END"
    )
    return f"""WITH RECURSIVE
      target AS (SELECT url, replace(t, '&amp;', '&') AS t FROM (SELECT url, unnest(list_concat(
        list_transform(regexp_extract_all(html, {quoted(url_filter.CANONICAL)}), lambda x: regexp_extract(x, {quoted(url_filter.HREF)}, 1)),
        list_concat(regexp_extract_all(html, {quoted(url_filter.REFRESH)}, 1), regexp_extract_all(html, {quoted(url_filter.SCRIPT)}, 1)))) AS t FROM pages WHERE html IS NOT NULL AND url IS NOT NULL) WHERE t <> ''),
      link AS (SELECT {normal('url')} AS a, {normal('whole_url')} AS b FROM (SELECT url, {resolved} AS whole_url FROM target)),
      edge AS (SELECT a, b FROM link WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM link WHERE a <> '' AND b <> '' AND a <> b),
      reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
      told AS (SELECT a, {verdict} AS own FROM (SELECT a, {rule} AS rule FROM (SELECT a, b, {parts('b')} FROM reach))),
      alias AS (SELECT a, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' ELSE 'allow' END AS alias FROM told GROUP BY a),
      judged AS (SELECT *, {rule} AS rule FROM (SELECT page_id, url, {parts('url')} FROM pages))
      SELECT page_id, host, path, rule, coalesce({verdict}, alias, 'allow') AS verdict FROM judged LEFT JOIN alias ON alias.a = {normal('judged.url')}"""


_JOIN_SQL = f"""WITH RECURSIVE
  word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda w: w <> '') AS w FROM documents),
  held AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM word),
  one AS (SELECT doc_id, unnest(s) AS g FROM held),
  met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM met JOIN held x ON x.doc_id = a JOIN held y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
  edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
  SELECT h.doc_id AS doc_id, CAST(any_value(len(h.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM held h JOIN reach r ON r.a = h.doc_id GROUP BY h.doc_id"""


def _secret_sql() -> str:
    """Every rule's matches by splitting the text at them; positions are running sums of what lies between."""
    kinds = [r.kind for r in secret_scan.RULES]
    found = []
    for n, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        tested = f"regexp_extract(hit, '{p}', {r.group})" if r.group else "hit"
        found.append(
            f"""SELECT doc_id, {n} AS rank, '{r.kind}' AS kind, upto - length(rest) - length(hit) AS a, upto - length(rest) AS b FROM (
              SELECT doc_id, split_part(p[i], chr(2), 1) AS hit, split_part(p[i], chr(2), 2) AS rest, list_sum(list_transform(p[1:i], lambda x: length(replace(x, chr(2), '')))) AS upto
              FROM (SELECT doc_id, string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents WHERE regexp_matches(text, '{p}')), unnest(range(2, len(p) + 1)) AS t(i))
            WHERE length({tested}) >= {r.least}"""
        )
    base = [r.kind for r in secret_scan.RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    told = "string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, rank)"
    return f"""WITH span AS ({' UNION ALL '.join(found)})
      SELECT d.doc_id AS doc_id, {counts}, sha256(coalesce({told} FILTER (rank < {len(base)}), '')) AS base_sha256, coalesce({told} FILTER (kind IS NOT NULL), '') AS spans
      FROM documents d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": _url_sql(),
    "op7_ngram_join": _JOIN_SQL,
    "op9_secret_scan": _secret_sql(),
    "op10_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
          WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
}
