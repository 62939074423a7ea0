import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspark.llm import sstable
from loomspark.llm.queries import op7_sstable, vocabulary


def test_shard_round_trip_and_lookup(tmp_path):
    rows = [(i, np.arange(i % 7, dtype=np.uint32) + np.uint32(abs(i or 0))) for i in [*range(-50, 400, 3), 400, 400]] + [(None, np.ones(3, np.uint32))]
    path = f"{tmp_path}/a.sst"
    with open(path, "wb") as f:
        writer = sstable.ShardWriter(f, 4, block_bytes=200)
        for i, ids in rows:
            writer.add(sstable.key_of(i), ids)
        writer.close()
    shard = sstable.Shard(path)
    assert [(sstable.id_of(k), v.tolist()) for k, v in shard] == [(i, v.tolist()) for i, v in rows]
    assert shard.records == len(rows) and shard.ids == sum(len(v) for _, v in rows) and len(shard.index) > 5
    assert [v.tolist() for v in shard.get(400)] == [v.tolist() for i, v in rows if i == 400]
    assert [v.tolist() for v in shard.get(-47)] == [rows[1][1].tolist()] and len(shard.get(None)) == 1
    assert sum(sstable.key_of(i) in shard.bloom for i in range(1000, 3000)) < 100 and shard.get(1001) == []
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(1), rows[0][1])


def test_query_against_library(spark, sf_dir):
    library, start, want = Tokenizer.from_file(vocabulary()), 0, {}
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(x["text"], add_special_tokens=False).ids, 2]
        want[x["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {x["doc_id"]: (x["start"], x["n_tokens"], x["ids_crc32"]) for x in op7_sstable(spark, sf_dir).collect()} == want


def test_odd_rows_and_files(spark, odd_docs, no_docs, tmp_path):
    shards = sstable.write_tokens(odd_docs, f"file://{tmp_path}/a", vocabulary())
    assert sum(s["records"] for s in shards) == odd_docs.count()
    library = Tokenizer.from_file(vocabulary())
    (one,) = sstable.lookup(f"file://{tmp_path}/a", 2)
    assert one.tolist() == [*library.encode("  SHARED line of text\t\nown words here\nshort", add_special_tokens=False).ids, 2]
    assert len(sstable.lookup(f"file://{tmp_path}/a", 5)) == 2 and len(sstable.lookup(f"file://{tmp_path}/a", None)) == 1 and sstable.lookup(f"file://{tmp_path}/a", 77) == []
    assert sstable.write_tokens(no_docs, f"file://{tmp_path}/b", vocabulary()) == []


def test_search_starts_at_whole_keys(tmp_path):
    ids = [*range(0, 300, 2), 150, 150, *([151] * 40), *range(152, 400)]
    rows = [(i, np.array([i, n], np.uint16)) for n, i in enumerate(sorted(ids))]
    path = f"{tmp_path}/a.sst"
    with open(path, "wb") as f:
        writer = sstable.ShardWriter(f, 2, block_bytes=700)
        for i, v in rows:
            writer.add(sstable.key_of(i), v)
        writer.close()
    shard = sstable.Shard(path)
    assert len(shard.index) > 2 and all(len(shard._read(*place)[1]) > 1 for _, *place in shard.index)
    for i in range(-1, 402):
        assert [v.tolist() for v in shard.get(i)] == [v.tolist() for k, v in rows if k == i]


def test_lookup_opens_the_shards_that_can_hold_the_id(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = sstable.write_tokens(docs, f"file://{tmp_path}/a", vocabulary())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    opened = []
    monkeypatch.setattr(sstable, "Shard", lambda path, real=sstable.Shard: opened.append(path) or real(path))
    library = Tokenizer.from_file(vocabulary())
    for x in docs.limit(9).collect():
        opened.clear()
        (ids,) = sstable.lookup(f"file://{tmp_path}/a", x["doc_id"])
        assert ids.tolist() == [*library.encode(x["text"], add_special_tokens=False).ids, 2] and len(opened) == 1
    assert len(shards) > 1


def test_whole_texts_give_the_same_ids(spark, odd_docs, tmp_path):
    parts = [sstable.write_tokens(odd_docs, f"file://{tmp_path}/{n}", vocabulary(), whole_texts=n) for n in (False, True)]
    assert [[(s["records"], s["ids"]) for s in p] for p in parts][0] == [(s["records"], s["ids"]) for s in parts[1]]
    for i in (1, 2, 5, 10, None):
        one, other = (sorted(x.tolist() for x in sstable.lookup(f"file://{tmp_path}/{n}", i)) for n in (False, True))
        assert one == other


def test_repeated_and_null_ids_spread_over_shards(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"text number {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = sstable.write_tokens(docs, f"file://{tmp_path}/a", vocabulary())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(shards) > 2 and max(s["records"] for s in shards) < 2500
    assert len(sstable.lookup(f"file://{tmp_path}/a", 7)) == 2000 == len(sstable.lookup(f"file://{tmp_path}/a", None))
