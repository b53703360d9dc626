import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labquarry.llm import exact
from labquarry.storage import new_folder

SCHEMA = "doc_id long, text string, file string, digest string"


def draw(n=400):
    rnd = random.Random(4)
    docs = []
    for k in range(n):
        text = rnd.choice([None, "", "é", " \t", "a b", "ab ", "a b", "w" * rnd.randrange(3), f"text {rnd.randrange(60)}", f"te xt{rnd.randrange(60)}\n\x0b\x0c\r", str(k)])
        docs.append((k if k % 50 else None, text, "x", "y"))
    return docs + docs[10:20] + [(9000 + k, "hot copy", "x", "y") for k in range(300)] + [(9500, "l" * 400_000, "", ""), (9501, "l " * 400_000, "", "")]


def check(docs, got):
    """Against a plain grouping; of rows that are equal in all that decides, either may stay."""
    groups = {}
    for d, text, *_ in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), d is None, d or 0))
    want = {hashlib.sha256(n.encode()).hexdigest(): (len(own), None if min(own)[1] else min(own)[2]) for n, own in groups.items()}
    assert len(got) == len(docs) and sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in docs)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(want)  # one of each group stays
    for r in got:
        assert (r["group_size"], r["keep_id"]) == want[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2)), lambda text: F.lit(b"0")])
def test_like_plain_grouping(spark, tmp_path, digest):
    docs = draw()
    files = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(files)
    dedup = exact.StreamingDedup(spark, files, new_folder(spark), digest)
    dedup.absorb(files_a_batch=2)
    check(docs, dedup.verdicts().collect())
    dedup.drop()


def test_state_lasts_from_one_delivery_to_the_next(spark, tmp_path):
    docs, files = draw(), str(tmp_path / "documents.parquet")
    half = len(docs) // 2
    folder = new_folder(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for own in (docs[:half], docs[half:]):
        spark.createDataFrame(own, SCHEMA).repartition(2).write.mode("append").parquet(files)
        exact.StreamingDedup(spark, files, folder).absorb()
    dedup = exact.StreamingDedup(spark, files, folder)
    dedup.absorb()  # nothing new
    assert dedup.state().agg(F.sum("n")).first()[0] == len(docs)
    check(docs, dedup.verdicts().collect())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_single_file_and_any_table(spark, tmp_path):
    docs = draw(60)
    table = spark.createDataFrame(docs, SCHEMA)
    check(docs, exact.exact_duplicates(table).collect())
    table.coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*")).rename(tmp_path / "documents.parquet")
    check(docs, exact.op13_streaming_dedup(spark, str(tmp_path)).collect())


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert exact.op13_streaming_dedup(spark, str(tmp_path)).count() == 0
    assert exact.exact_duplicates(none).count() == 0
