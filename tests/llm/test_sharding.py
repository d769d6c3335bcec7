import zlib

from pyspark.sql import functions as F

from txnrules.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, vslot string, key int"  # clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def laid_out(spark, rows):
    found = S.hashed(frame(spark, rows))
    first = S.first_map(S.slot_bytes(found), 8)
    return found, first, S.rebalance(first, 8)


def test_sizes_checksums_and_positions(spark):
    texts = [(i, "wörd " * (i % 37)) for i in range(3000)] + [(None, None), (None, None), (7, ""), (7, "same"), (7, "same"), (1, "x" * 9000)]
    found, _, second = laid_out(spark, texts)
    out = S.shard(found, second).collect()
    assert len(out) == len(texts)
    want = sorted(((i if i is not None else -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted(((r.key if r.key is not None else -1), r["size"], r.crc) for r in out) == want
    loads = {}
    for k in range(8):
        mine = [r for r in out if r.shard == k]
        assert sorted(r.position for r in mine) == list(range(len(mine)))
        loads[k] = sum(r["size"] for r in mine)
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 8


def test_growing_moves_slots_only_into_the_new_shard(spark):
    _, _, second = laid_out(spark, [(i, "a" * (i % 91)) for i in range(5000)])
    third = S.grow(second, 8)
    both = second.alias("a").join(third.alias("b"), "vslot").select(F.col("a.shard").alias("was"), F.col("b.shard").alias("is"), F.col("b.bytes").alias("n"), F.col("b.version").alias("v")).collect()
    assert len(both) == S.SLOTS and {r.v for r in both} == {3}
    assert all(r["is"] in (r.was, 8) for r in both)
    load = [sum(r.n for r in both if r["is"] == k) for k in range(9)]
    assert abs(load[8] - sum(load) / 9) < 0.05 * sum(load) / 9


def test_map_versions_are_kept(spark, tmp_path):
    _, first, second = laid_out(spark, [(1, "a"), (2, "bbbbbb")])
    path = str(tmp_path / "map")
    S.store_map(first, path)
    S.store_map(second, path)
    assert S.load_map(spark, path).select("version").distinct().collect()[0].version == 2
    assert S.load_map(spark, path, 1).count() == S.SLOTS


def test_empty_table(spark):
    found, _, second = laid_out(spark, [])
    assert S.shard(found, second).count() == 0
