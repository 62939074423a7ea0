import random
import threading
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import mixing


@pytest.mark.parametrize("seed", range(20))
def test_period_deviates_by_less_than_a_block(seed):
    r = random.Random(seed)
    weights = [r.randint(1, 40) for _ in range(r.randint(1, 12))]
    slots = mixing.pfair_period(weights)
    assert [sum(i == t for i, _ in slots) for t in range(len(weights))] == weights
    assert mixing.deviation([i for i, _ in slots] * 2, weights) < 1
    assert all(k == sum(x == i for x, _ in slots[:n]) for n, (i, k) in enumerate(slots))


@pytest.mark.parametrize("blocks,weights", [([7, 30, 0, 3, 2], [5, 3, 4, 2, 0]), ([1, 1, 1], [9, 1, 5]), ([400, 3], [1, 2]), ([], [])])
def test_phases_place_every_block_once(blocks, weights):
    order, listed = {}, 0
    for p in mixing.phases(blocks, weights):
        assert len(p.slots) == min(p.period, p.length) and sum(p.taken().values()) == p.length
        listed += len(p.slots)
        at = {s: n for n, s in enumerate(p.slots)}
        for i, n in p.taken().items():
            for j in range(n):
                slot = j // p.weights[i] * p.period + at[i, j % p.weights[i]]
                assert slot < p.length
                order[p.start + slot] = (i, p.had[i] + j)
    assert sorted(order) == list(range(sum(blocks))) and listed <= sum(blocks)
    assert sorted(order.values()) == [(i, k) for i, b in enumerate(blocks) for k in range(b)]


def test_many_sources_need_no_quadratic_schedule():
    blocks = [1 + i % 7 for i in range(3000)]
    assert sum(len(p.slots) for p in mixing.phases(blocks, [1 + i % 3 for i in range(3000)])) <= sum(blocks)


def test_mix_follows_the_schedule(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    plan = mixing.MixPlan(block=10, bucket_rows=37)
    got = mixing.mix(docs, plan).collect()
    assert len(got) == 2000 and len({(x["__slot"], x["__rank"]) for x in got}) == 2000
    slots = {}
    for x in got:
        slots.setdefault(x["__slot"], set()).add(x["source"])
    assert all(len(s) == 1 for s in slots.values()) and sorted(slots) == list(range(len(slots)))
    counts = {s: sum(y == s for _, y in rows) for _, s in rows}
    names, weights = zip(*mixing.derived_weights(counts, plan).items(), strict=True)
    order = [names.index(next(iter(slots[n]))) for n in range(len(slots))]
    first_out = min(max(n for n, i in enumerate(order) if i == t) for t in range(len(names)))
    assert mixing.deviation(order[: first_out + 1], list(weights)) < 1
    again = mixing.mix(docs.repartition(2), plan).collect()
    assert {(x["doc_id"], x["__slot"], x["__rank"]) for x in again} == {(x["doc_id"], x["__slot"], x["__rank"]) for x in got}


def test_explicit_weights_and_odd_rows(spark, odd_docs, no_docs):
    plan = mixing.MixPlan(weights=(("s", 3),), block=2)
    got = mixing.mix(odd_docs, plan).collect()
    assert len(got) == odd_docs.count()
    assert max(x["__slot"] for x in got if x["source"] == "s") < min(x["__slot"] for x in got if x["source"] is None)
    assert mixing.mix(no_docs).count() == 0
    laid = mixing.mixed_order(odd_docs)
    assert laid.columns == odd_docs.columns and laid.count() == odd_docs.count()
    assert mixing.deviation([0, 1], [1, 1]) == Fraction(1, 2)


def test_query_against_plain_schedule(spark, sf_dir):
    from loomspark.llm.queries import op1_mixing

    got = op1_mixing(spark, sf_dir).collect()
    rows = [(x["doc_id"], x["source"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((x["doc_id"], x["source"]) for x in got) == sorted(rows)
    plan = mixing.MixPlan()
    counts = {s: sum(y == s for _, y in rows) for s in sorted({y for _, y in rows})}
    weights = mixing.derived_weights(counts, plan)
    left, done, clock, slots = {s: -(-n // plan.block) for s, n in counts.items()}, dict.fromkeys(counts, 0), 0, []
    while any(left[s] > done[s] for s in counts):
        # one phase, slot by slot: of the released blocks the one with the earliest deadline, ties by source
        active = [s for s in counts if left[s] > done[s]]
        total, had = sum(weights[s] for s in active), dict(done)
        clock = 0
        while all(left[s] > done[s] for s in active):
            ready = []
            for s in active:
                k = done[s] - had[s]
                if k * total // weights[s] <= clock:
                    ready.append((-(-(k + 1) * total // weights[s]), active.index(s), s))
            _, _, s = min(ready)
            slots.append((s, done[s]))
            done[s] += 1
            clock += 1
    place = {(s, k): n for n, (s, k) in enumerate(slots)}
    by = {}
    for x in got:
        assert x["slot"] == place[x["source"], x["block"]] and 0 <= x["rank"] < plan.block
        by.setdefault((x["source"], x["block"]), []).append(x["rank"])
    for (s, k), ranks in by.items():
        assert sorted(ranks) == list(range(min(plan.block, counts[s] - k * plan.block)))


def test_hot_ids_spread_and_places_are_whole(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 5, f"s{i % 2}", f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/in")
    plan = mixing.MixPlan(block=8, bucket_rows=100, range_rows=300)
    for given in (docs, spark.read.parquet(f"{tmp_path}/in").select("doc_id", "source"), spark.read.parquet(f"{tmp_path}/in")):
        made = mixing.mix(given, plan).collect()
        assert len({(x["__slot"], x["__rank"]) for x in made}) == 3000
    want = [x["text"] for x in sorted(made, key=lambda x: (x["__slot"], x["__rank"]))]
    mixing.mixed_order(spark.read.parquet(f"{tmp_path}/in"), plan).write.parquet(f"{tmp_path}/out")
    laid = mixing.positions(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [x["text"] for x in sorted(laid, key=lambda x: x["mix_position"])] == want
    plan_text = mixing.mixed_order(spark.read.parquet(f"{tmp_path}/in"), plan)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange shufflepartitionid") == 1 and "rangepartitioning" not in plan_text


def test_many_sources_are_found_at_once():
    r = np.random.default_rng(3)
    sources, each = 10_000, 100
    s = np.repeat(np.arange(sources), each)
    t, u = r.integers(0, 50, len(s)), r.integers(0, 1 << 40, len(s))
    order = np.lexsort((u, t, s))
    ranges = np.empty(len(s), np.int32)
    ranges[order] = np.tile(np.arange(each, dtype=np.int32), sources)
    names = [None if x == 7 else f"s{x}" for x in s]
    began = time.perf_counter()
    held = mixing._Ranges(pa.table({"s": names, "t": t, "u": u, "range": ranges}))
    assert (held.find(names, t, u) == ranges).all()
    assert time.perf_counter() - began < 20
    for i in range(0, len(s), 9973):  # rows between two entries belong to the one before
        first = max((j for j in range(s[i] * each, (s[i] + 1) * each) if (t[j], u[j]) <= (t[i], u[i] + 1)), key=lambda j: (t[j], u[j]))
        assert held.find([names[i]], t[i : i + 1], u[i : i + 1] + 1)[0] == ranges[first]


def test_sources_beyond_what_is_sent_are_joined(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 3 == 0 else f"s{i % 7}", f"t{i}") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    plan = mixing.MixPlan(block=8, bucket_rows=100, range_rows=300)
    want = [x["text"] for x in mixing.mixed_order(docs, plan).collect()]
    monkeypatch.setattr(mixing._Ranges, "MOST", 4)
    laid = mixing.mixed_order(docs, plan)
    assert laid.columns == docs.columns and [x["text"] for x in laid.collect()] == want
    assert laid.rdd.getNumPartitions() == 7


def test_tables_of_other_threads_stay(spark):
    from loomspark.llm.common import written
    from loomspark.scratch import materialize

    other = []

    def make():
        worker = threading.Thread(target=lambda: other.append(materialize(spark.range(5), "other")))
        worker.start()
        worker.join()
        own = materialize(spark.range(3), "own")
        return own

    spent = []
    assert written(spark, make, "whole", spent).count() == 3 and len(spent) == 1
    assert other[0].count() == 5
