"""The queries on the graph against their SQL, over entries whose first two words make no character and variant."""

import duckdb
import pytest
from test_registry import same

from loomspan import catalog

DOCS = [
    ("de", "Mara | they met Mara there."), ("de", "mara, 7 and so to Mara came."), ("de", "Mara Lune went with Kato home."), ("de", "7 Kato went."),
    ("de", "7 | Kato went with Mara, so did Rell."), ("de", "KATO"), ("de", ""), ("de", None), ("en", "they met Rell and Kato in Mara Lune."), (None, "so Rell went."),
    ("de", "Toro | they met Toro there."), ("en", "so Toro went."),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("bare"), duckdb.connect()
    con.execute("create table documents (doc_id bigint, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, *row) for i, row in enumerate(DOCS)])
    con.execute("create table labels as select 11::bigint as doc_id, 0 as quality, 0 as toxic")
    for name in ("documents", "labels"):
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", "connection_card entity_category_counts entity_display_name entity_index evidence_by_name evidence_list graph_from_changes graph_totals".split())
def test_a_name_without_a_variant_is_a_character(spark, tables, name):
    folder, con = tables
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    told = lambda df: sorted((tuple(map(same, r)) for r in df.itertuples(index=False)), key=str)
    assert told(got) == told(want) and len(want)
