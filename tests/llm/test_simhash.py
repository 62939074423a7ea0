import random

import numpy as np
import pytest

from loomspark.llm import components, simhash
from tests.llm import brute


def test_fingerprint_matches_plain_version():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(r.choice(["Aé", "b", "Ccc", "dd\x1c"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute.fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n\t")


def test_fingerprint_walks_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 31}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr("loomspark.llm.common.PIECE", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    r = random.Random(radius)
    for positions in (list(range(64)), sorted(r.sample(range(64), 30))):
        masks = simhash.covering_masks(radius, positions)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            diff = sum(1 << p for p in r.sample(positions, radius))
            assert any(not m & diff for m in masks)


def _check(spark, prints):
    docs = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    nodes = spark.createDataFrame([(f,) for f in {f for _, f in docs}], "fp long")
    stars = {x["node"]: x["root"] for x in components.star_components(simhash.linked_pairs(nodes)).collect()}
    group = {}
    for (_, f), c in zip(docs, brute.components(prints), strict=True):
        group.setdefault(stars.get(f, f), set()).add(c)
    assert all(len(v) == 1 for v in group.values())
    assert len(group) == len(set(brute.components(prints)))


def test_links_of_light_and_dense_buckets(spark, monkeypatch):
    r = random.Random(5)
    center = r.getrandbits(64)
    prints = [(i, center ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 5)))) for i in range(400)]
    prints += [(1000 + i, r.getrandbits(64)) for i in range(300)]
    _check(spark, prints)
    monkeypatch.setattr(simhash, "DENSE", 8)
    _check(spark, prints)


def test_bucket_links_span_what_all_pairs_span():
    r = np.random.default_rng(1)
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)))
    zero = np.zeros(len(fp), np.int64)
    for small in (2, 32, 1000):
        u, v = simhash._links(zero, zero, zero, fp.view(np.int64), 3, small)
        assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in zip(u, v, strict=True))
        root = {int(f): int(f) for f in fp}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u, v, strict=True):
            root[find(int(a))] = find(int(b))
        assert len({find(int(f)) for f in fp}) == len(set(brute.components([(i, int(f)) for i, f in enumerate(fp)])))


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 5), (200, 201)], "u long, v long")
    roots = {x["node"]: x["root"] for x in components.star_components(edges).collect()}
    assert {roots[i] for i in range(61)} == {0} and roots[201] == 200 and 100 not in roots


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], set()).add((x["fingerprint"], x["component_id"]))
    assert by[3] == by[4] == by[11] == {("0" * 16, 3)} and by[9] == {(f"{brute.fingerprint('one'):016x}", 8)}
    assert len(by[5]) == 1 and len(by[None]) == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    from loomspark.llm.queries import op4_simhash

    docs = [(x["doc_id"], brute.fingerprint(x["text"])) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(docs, brute.components(docs), strict=True)}
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in op4_simhash(spark, sf_dir).collect()} == want
