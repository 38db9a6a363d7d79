"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last keep the columns of ``documents``.

1. toxicity: documents scored at 0.3 or more go.
2. near_duplicates: of every group that five-word shingles link at a similarity of 0.75, the smallest doc_id stays.
3. secrets: found spans are replaced in the text; no document goes.
4. mixing: rows are taken as often as the source mix asks (none, once or twice).
5. packing: sequences of at most 4096 tokens.

Defined results: empty tables pass through every stage; null, empty and word-less texts are no near duplicates, have no secrets and
end at the mixing stage; a null source is a source of its own; repeated rows are near duplicates of each other, so one of them stays;
of equal texts the smallest doc_id stays; very long texts are read whole and packed in pieces; extra columns are kept, whatever their
names, up to the packing stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.common import cut, table
from loomspan.llm.mixing import apply_mix
from loomspan.llm.ngram_join import keep_one_per_component
from loomspan.llm.packing import best_fit_packing
from loomspan.llm.queries import TOKENIZER
from loomspan.llm.secret_scan import redact_secrets
from loomspan.llm.toxicity import reject_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs, n=5, percent=75)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, TOKENIZER, capacity=4096, end_id=1)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing),
]

#: Stages 1, 4 and 5 are not expressible in SQL; every stage is tested against a plain version, one document after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
