"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame; all
but the last return the columns of documents. run() writes each stage's result as Parquet to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labquarry.llm.common import read, stored
from labquarry.llm.jaccard import keep_one_of_each
from labquarry.llm.langid import keep_identified
from labquarry.llm.mixing import mix
from labquarry.llm.packing import pack_documents
from labquarry.llm.pii import redact_documents


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens from the documents, as often as the mix repeats them."""
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned filters, min-hash paths and random rounding have no SQL; tests/llm/ hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
