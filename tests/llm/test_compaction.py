import pytest

from loomspark.llm import compaction


def test_tiers_merge_to_target(spark, tmp_path):
    plan = compaction.TierPlan(target=60_000, smallest=2_000, ratio=3.0, fan=3)
    made = compaction.ShardSet(spark, f"file://{tmp_path}/s", plan)
    rows = spark.range(4000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text")
    for k in range(4):
        made.append(rows.where(f"doc_id % 4 = {k}").repartition(4))
    assert made.version() == 4 and len(made.shards()) == 16
    before = made.shards()
    made.compact(keep=10)
    after = made.shards()
    assert len(after) < len(before) and not made.groups(after)
    assert sorted(x["doc_id"] for x in made.read().collect()) == list(range(4000))
    assert made.read(4).count() == 4000 and made.read().select("__shard").distinct().count() == len(after)
    assert made.expire(1) > 0 and made.read().count() == 4000
    with pytest.raises(compaction.ManifestConflict):
        made.commit(after, made.version() - 1)


def test_groups_keep_to_target_and_tier():
    plan = compaction.TierPlan(target=100, smallest=10, ratio=2.0, fan=3)
    owner = compaction.ShardSet.__new__(compaction.ShardSet)
    owner.plan = plan
    shards = [compaction.ShardFile(str(i), s) for i, s in enumerate([5, 6, 7, 30, 31, 100, 150, 35, 36, 9])]
    due = owner.groups(shards)
    assert [[s.size for s in g] for g in due] == [[5, 6, 7, 9], [30, 31, 35]]


def test_small_arrivals_end_in_few_shards_and_old_versions_stay(spark, tmp_path):
    plan = compaction.TierPlan(target=400_000, smallest=4_000, ratio=4.0, fan=4)
    made = compaction.ShardSet(spark, f"file://{tmp_path}/s", plan)
    rows = spark.range(3000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text")
    for k in range(5):
        made.append(rows.where(f"doc_id % 5 = {k}").repartition(8))
        before, n = made.version(), made.read().count()
        assert made.compact(keep=4) > before and made.read(before).count() == n == made.read().count() == 600 * (k + 1)
    assert len(made.shards()) <= 5 and made.read().select("doc_id").distinct().count() == 3000
    named = {s.name.split("/")[0] for v in made.versions() for s in made.shards(v)}
    assert {p.name for p in (tmp_path / "s").glob("run-*")} == named and len(made.versions()) == 4


def test_two_writers_and_leftovers(spark, tmp_path):
    one, other = (compaction.ShardSet(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.range(20).selectExpr("id as doc_id", "'x' as __shard")
    one.append(rows)
    claim = one._claim

    def overtaken(scratch, final):
        one._claim = claim
        other.append(rows)
        return claim(scratch, final)

    one._claim = overtaken
    assert one.append(rows) == 3 and one.read().count() == 60 and one.read().columns == ["doc_id", "__shard"]
    with pytest.raises(ValueError):
        one.append(rows.drop("__shard"))
    with pytest.raises(compaction.ManifestConflict):
        one._change({"gone"}, [])
    assert one.clean() == 0 and one.clean(hours=-1) == 1 and one.read().count() == 60


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    made = compaction.ShardSet(spark, f"file://{tmp_path}/s")
    made.append(odd_docs)
    made.append(no_docs)
    made.compact()
    back = made.read().drop("__shard")
    assert back.columns == odd_docs.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, odd_docs.collect()))
    with pytest.raises(ValueError):
        compaction.ShardSet(spark, f"file://{tmp_path}/empty").read()


def test_commit_by_rename(spark, tmp_path, monkeypatch):
    made = compaction.ShardSet(spark, f"file://{tmp_path}/s")
    elsewhere = type("Url", (), {"scheme": "hdfs", "path": ""})()
    monkeypatch.setattr(compaction, "urlparse", lambda path: elsewhere)
    rows = spark.range(5).selectExpr("id as doc_id")
    assert made.append(rows) == 1 and made.append(rows) == 2 and made.read().count() == 10
    monkeypatch.setattr(made, "version", lambda: 1)  # as a writer sees it whom another has overtaken
    with pytest.raises(compaction.ManifestConflict):
        made.commit([], 1)
