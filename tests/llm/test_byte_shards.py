import re
import zlib

from llm_texts import prose
from pyspark.sql import functions as F

from pipelab.llm import byte_shards as bs
from pipelab.session import scratch_path


def brute(rows, shards, overhead=16):
    """(id, size, crc, shard, slot) by one loop over the sorted documents."""
    sized = sorted(
        ((d is not None, d or 0, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for d, t in rows)
    )
    total, before, out, slots = sum(r[2] for r in sized), 0, [], {}
    for known, d, size, crc in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total)) if total else 0
        out.append((d if known else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


def test_equals_one_loop(spark, docs, texts):
    for shards in (1, 3, 40):
        got = bs.balanced_shards(docs, shards)
        assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert _rows(got) == sorted(brute(texts, shards), key=str)
        assert {r["law"] for r in got.collect()} == {"bytes"} and got.filter("grown_shard is not null").count() == 0


def test_shards_are_balanced_and_contiguous(spark):
    rows = [(k * 7 % 4001, prose(k, 1 + k % 37)) for k in range(4001)]
    got = bs.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((d, s, c, "bytes", k, n, None) for d, s, c, k, n in brute(rows, 40)), key=str)
    held, ids, most = {}, {}, max(r["size"] for r in got)
    for r in got:
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        ids.setdefault(r["shard"], []).append(r["doc_id"])
    target = sum(held.values()) / 40
    assert len(held) == 40 and all(abs(v - target) <= most for v in held.values())
    assert all(max(ids[k]) < min(ids[k + 1]) for k in range(39))


def test_one_id_and_text_for_a_third_of_the_rows_is_cut(spark):
    rows = [(5, "same text")] * 3000 + [(None, None)] * 3000 + [(k, prose(k, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert _rows(bs.balanced_shards(df)) == sorted(brute(rows, 40), key=str)
    kept = df.select("doc_id", "text").withColumns({"size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    placed = kept.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(8, *bs._ORDER)
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500


def test_shuffled_totals_give_the_same(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(bs, "BROADCAST_RANGES", 0)
    assert _rows(bs.balanced_shards(docs, 7)) == sorted(brute(texts, 7), key=str)


def test_no_bytes_at_all(spark, empty):
    assert bs.balanced_shards(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert _rows(bs.balanced_shards(blank, 4, overhead=0)) == sorted(brute([(1, None), (2, "")], 4, 0), key=str)


def test_written_shards_hold_all_rows_in_order(spark, docs):
    path = scratch_path(spark, "test-shards")
    bs.write_shards(docs, path, 5)
    read = spark.read.parquet(path)
    assert read.drop("shard_number").exceptAll(docs).count() == 0 and read.count() == docs.count()
    assert sorted(read.columns) == sorted([*docs.columns, "shard_number"])
    got = read.groupBy("shard_number").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).collect()
    want = {r["shard"]: r["n"] for r in bs.balanced_shards(docs, 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert {r["shard_number"]: r["n"] for r in got} == want


def test_plan_has_no_python(spark, docs):
    plan = bs.balanced_shards(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
