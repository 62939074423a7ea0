import pytest
from pyspark.sql import functions as F

from loomspark.operators.keyed_store import KeyedStore

SCHEMA = "id long, label string, at long"


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def _folders(store, version=None):
    return {r[1] for r in store.ranges(version)}


@pytest.fixture()
def store(spark, tmp_path):
    rows = spark.range(400).select("id", F.concat(F.lit("a"), "id").alias("label"), F.lit(0).cast("long").alias("at"))
    return KeyedStore(spark, f"{tmp_path}/s", ["id"], range_rows=50).create(rows)


def test_changes_rewrite_the_touched_ranges_only(spark, store):
    before, first = _folders(store), _rows(store.read())
    assert len(before) == 8 and len(first) == 400
    version = store.version()
    store.upsert(spark.createDataFrame([(7, "old", 1), (7, "new", 2), (1000, "more", 1)], SCHEMA), F.col("at"))
    want = sorted([x for x in first if x[0] != 7] + [(7, "new", 2), (1000, "more", 1)], key=str)
    assert _rows(store.read()) == want
    assert len(_folders(store) & before) >= len(before) - 2
    assert _rows(store.read(version)) == first  # the version before stands
    store.delete(spark.createDataFrame([(7,), (5555,)], "id long"))
    assert _rows(store.read()) == [x for x in want if x[0] != 7]
    store.insert(spark.createDataFrame([(8, "kept out", 1), (7, "back", 1)], SCHEMA))
    assert _rows(store.lookup(spark.createDataFrame([(7,), (8,), (9999,)], "id long"))) == [(7, "back", 1), (8, "a8", 0)]


def test_writers_of_other_ranges_both_land_and_of_the_same_range_redo(spark, store):
    other = KeyedStore(spark, store.path, ["id"], 50)
    real, calls = store._written, []

    def slow(*given):
        made = real(*given)
        if not calls:  # another writer is done in between, in the same range
            calls.append(other.upsert(spark.createDataFrame([(7, "theirs", 1), (11, "theirs", 1)], SCHEMA)))
        return made

    store._written = slow
    store.upsert(spark.createDataFrame([(7, "ours", 2)], SCHEMA))
    found = dict((x[0], x[1]) for x in _rows(store.read()))
    assert found[7] == "ours" and found[11] == "theirs" and len(found) == 400


def test_nulls_empty_and_expiry(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", ["id", "label"]).create(spark.createDataFrame([], SCHEMA))
    assert store.read().count() == 0 and store.version() == 1
    rows = [(None, "x", 1), (None, "x", 1), (None, None, 2), (1, None, 3)]
    store.upsert(spark.createDataFrame(rows, SCHEMA))
    assert _rows(store.read()) == sorted(set(rows), key=str)
    store.delete(spark.createDataFrame([(None, None)], "id long, label string"))
    assert store.read().count() == 2
    store.delete(store.read())
    assert store.read().count() == 0 and store.expire(1) >= 1 and store.versions() == [store.version()]
    with pytest.raises(FileExistsError):
        KeyedStore(spark, f"{tmp_path}/s", ["id", "label"]).create(spark.createDataFrame([], SCHEMA))
