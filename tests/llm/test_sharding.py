import zlib

from labquarry.llm import sharding


def test_shards(spark, tmp_path):
    rows = [(k, None if k % 40 == 0 else "é" * (k % 97) + str(k % 13), "x") for k in range(3000)] + [(5, "r", "x"), (5, "r", "x"), (None, "n", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, slot string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op4_fixed_virtual_slots(spark, str(tmp_path)).toPandas()
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted(tuple(map(int, r)) for r in got[["doc_id", "size", "text_crc32"]].fillna(-1).to_numpy()) == want
    assert set(got["law"]) == {"bytes"} and got["shard"].between(0, 15).all() and got["grown_shard"].isna().all()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 0.02 * sums.mean()
    assert all(sorted(own) == list(range(len(own))) for _, own in got.groupby("shard")["slot"])


def test_map_is_versioned():
    first = sharding.SlotMap.first(4, 64)
    sizes = {k: 1 + (k * 7) % 19 for k in range(64)} | {3: 200}
    second = first.rebalanced(sizes)
    assert second.version == 2
    shards = list(first.shards)
    for version, slot, a, b in second.edits:
        assert version == 2 and shards[slot] == a
        shards[slot] = b
    assert tuple(shards) == second.shards
    grown = second.rebalanced(sizes, 5)
    load = [sum(v for k, v in sizes.items() if grown.shards[k] == s) for s in range(5)]
    assert min(load) > 0 and max(sorted(load)[:-1]) - min(load) <= 20
    assert max(second.rebalanced(sizes, 3).shards) == 2


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op4_fixed_virtual_slots(spark, str(tmp_path)).count() == 0


def test_stored_map_over_a_grown_table(spark, tmp_path):
    folder = str(tmp_path / "map")
    rows = [(k, 1 + k * k % 97) for k in range(2000)]
    table = lambda some: spark.createDataFrame([(*r, "x", 7) for r in some], "doc_id long, size long, shard string, virtual_slot int")
    first, one = sharding.assign_shards(table(rows), ["doc_id"], "size", 4, 64, folder=folder)
    assert sharding.versions(spark, folder)[-1] == one.version and sharding.load(spark, folder) == one
    before = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in first.collect()}
    stored = sharding.versions(spark, folder)
    _, same = sharding.assign_shards(table(rows), ["doc_id"], "size", 4, 64, folder=folder)
    assert same == one and sharding.versions(spark, folder) == stored  # an unchanged table makes no new version
    grown = rows + [(5000 + k, 300) for k in range(40)]
    second, two = sharding.assign_shards(table(grown), ["doc_id"], "size", 4, 64, folder=folder)
    assert two.version == one.version + 1 and sharding.versions(spark, folder) == [*stored, two.version]
    moved = {slot: (a, b) for _, slot, a, b in sharding.load(spark, folder).edits}
    after = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in second.collect()}
    for i, (slot, shard) in before.items():
        assert after[i][0] == slot and after[i][1] == (moved[slot][1] if slot in moved else shard)
    assert moved and sharding.load(spark, folder, one.version) == one  # old versions stay
    assert sharding.load(spark, str(tmp_path / "none")) is None
    _, third = sharding.assign_shards(table([]), ["doc_id"], "size", 4, 64, folder=folder)
    assert third == two


def test_more_and_fewer_shards_edit_the_same_map(spark, tmp_path):
    """16, 17 and again 16 shards: versions of one map; only slots of its edits move, and shards stay near equal."""
    rows = [(k, "w" * (k * 7919 % 301)) for k in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    runs = [sharding.op4_fixed_virtual_slots(spark, str(tmp_path), n).toPandas().set_index("doc_id") for n in (16, 17, 16)]
    for n, got in zip((16, 17, 16), runs, strict=True):
        sums = got.groupby("shard")["size"].sum()
        assert list(sums.index) == list(range(n)) and sums.max() - sums.min() <= 0.02 * sums.mean()
        assert all(sorted(own) == list(range(len(own))) for _, own in got.groupby("shard")["slot"])
    few, more, back = (got["shard"] for got in runs)
    assert (few != more.loc[few.index]).mean() <= 1.3 / 17  # about a seventeenth of the rows is needed
    assert (more != back.loc[more.index]).mean() <= 1.3 / 17
    assert (runs[0]["virtual_slot"] == runs[1]["virtual_slot"].loc[few.index]).all()


def test_very_long_texts_and_clashes(spark, tmp_path):
    rows = [(k, "é" * 400_000 if k == 9 else "a" * k, *["x"] * 4) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, size string, shard string, slot string, number string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op4_fixed_virtual_slots(spark, str(tmp_path)).toPandas()
    assert len(got) == 60 and got["size"].max() == 800_001 and sorted(got["doc_id"]) == list(range(60))
