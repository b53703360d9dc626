import re

import pytest

from labquarry.llm import jaccard
from labquarry.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out[name] = docs.toPandas()
    return out


def test_stages_against_brute_force(results):
    columns = list(results["documents"].columns)
    start, named, one, clean, mixed, packed = results.values()
    assert all(list(x.columns) == columns for x in (named, one, clean, mixed))
    assert set(named["doc_id"]) == {i for i, t in zip(start["doc_id"], start["text"], strict=True) if re.search(r"[^\W\d_]", t or "")}
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in zip(named["doc_id"], named["text"], strict=True)}
    ids, top = sorted(sets), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[max(find(a), find(b))] = min(find(a), find(b))
    assert set(one["doc_id"]) == {find(i) for i in ids}
    assert set(clean["doc_id"]) == set(one["doc_id"]) and not clean["text"].str.contains(r"[a-z0-9]@[a-z0-9]+\.").any()
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed["doc_id"]) <= set(clean["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert packed[packed["piece"] == 0].shape[0] == len(mixed)


def test_nothing_goes_through(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
