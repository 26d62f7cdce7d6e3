import zlib

from panelspark.llm import sharding
from pyspark.sql import functions as F
from tests.llm.data import awkward, frame


def test_contract_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    out = sharding.shard(frame(spark, rows, extra=True), str(tmp_path / "map")).select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    for s in range(24):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert {r["shard"] for r in out} <= set(range(24))


def test_bytes_near_equal_and_same_again(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    one = sharding.shard(docs, str(tmp_path / "a")).cache()
    load = [r[0] for r in one.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(load) == 24 and max(load) < 1.02 * min(load)
    two = sharding.shard(docs, str(tmp_path / "b"))
    assert one.exceptAll(two).count() == 0


def greedy(sizes, shards):
    load, to = [0] * shards, {}
    for slot, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = load.index(min(load))
        load[at] += n
        to[slot] = at
    return to


def test_map_is_largest_first_and_rebalance_moves_little(spark, tmp_path):
    sizes = {i: (i * 7919) % 500 + 1 for i in range(300)}
    table = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "virtual_slot int, slot_bytes long, slot_rows long")
    first = sharding.first_map(table, 5)
    assert {r["virtual_slot"]: r["shard"] for r in first.collect()} == greedy(sizes, 5)
    folder = str(tmp_path / "map")
    sharding.save_map(first, folder)
    before = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder).collect()}
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, folder), table, 6), folder)
    after = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder).collect()}
    assert {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder, 0).collect()} == before
    moved = [s for s in after if after[s] != before[s]]
    assert all(after[s] == 5 for s in moved) and sum(sizes[s] for s in moved) < 1.3 * sum(sizes.values()) / 6
    load = [sum(sizes[s] for s in after if after[s] == k) for k in range(6)]
    assert max(load) < 1.25 * sum(load) / 6


def test_empty(spark, tmp_path):
    assert sharding.shard(frame(spark, []), str(tmp_path / "map")).count() == 0


def test_a_store_that_grows_edits_its_map(spark, tmp_path):
    folder = str(tmp_path / "map")

    def docs(n):
        return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))

    def shards_of(n, shards):
        out = {r["doc_id"]: (r["shard"], r["slot"], r["size"]) for r in sharding.shard(docs(n), folder, shards).collect()}
        assert len(out) == n
        for s in range(shards):
            mine = [v for v in out.values() if v[0] == s]
            assert sorted(v[1] for v in mine) == list(range(len(mine)))
        return out

    def versions():
        return spark.read.parquet(folder).select("version").distinct().count()
    first = shards_of(1000, 6)
    assert shards_of(1000, 6) == first and versions() == 1  # nothing changed
    assert spark.read.parquet(folder).count() == sharding.SLOTS
    more = shards_of(30_000, 6)
    assert versions() == 2 and sharding.load_map(spark, folder).count() == sharding.SLOTS
    wider = shards_of(30_000, 7)
    assert versions() == 3
    moved = [d for d in wider if wider[d][0] != more[d][0]]
    assert sum(wider[d][2] for d in moved) < 1.5 * sum(v[2] for v in wider.values()) / 7
    load = [sum(v[2] for v in wider.values() if v[0] == s) for s in range(7)]
    assert max(load) < 1.2 * sum(load) / 7
    fewer = shards_of(30_000, 4)
    assert {v[0] for v in fewer.values()} == set(range(4)) and versions() == 4
