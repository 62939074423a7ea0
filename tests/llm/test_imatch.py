import hashlib

import numpy as np

from loomspark.llm import imatch
from loomspark.llm.queries import op6_imatch


def test_query_follows_the_contract(spark, sf_dir):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id", ascending=False).collect()]
    got = {x["doc_id"]: x for x in op6_imatch(spark, sf_dir).collect()}
    by_text = {}
    for n, (i, text) in enumerate(docs):
        other = imatch.edited(text, docs[(n + 1) % len(docs)][1])
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        by_text.setdefault(text, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([x["near_edited"] > x["near_next"] for x in got.values()]) > 0.9


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"every half{i % 2} tenth{i % 10} own{i}") for i in range(100)], "doc_id long, text string")
    lex = imatch.lexicon(docs, "text", imatch.IMatchPlan(least_share=0.05, most_share=0.3))
    want = imatch.term_hashes(" ".join(f"tenth{i}" for i in range(10)))
    assert lex.tolist() == want.tolist()


def test_likeness_falls_with_edits():
    words = [f"term{i}" for i in range(400)]
    lex, plan = imatch.term_hashes(" ".join(words)), imatch.IMatchPlan()
    base = imatch.fingerprint(" ".join(words), lex, plan)
    near, far = (imatch.likeness(base, imatch.fingerprint(" ".join(words[:n] + [f"other{i}" for i in range(400 - n)]), lex, plan)) for n in (390, 150))
    assert imatch.likeness(base, base) == 1.0 >= near > far
    assert imatch.fingerprint(" ".join(reversed(words)) + " TERM1", lex, plan) == base


def _plain_marks(text, lex, plan):
    """Fingerprint by sets and Python integers."""
    import re

    import xxhash

    full = (1 << 64) - 1
    terms = {xxhash.xxh64_intdigest(t.encode()) for t in re.findall(r"\w+", text.lower())}
    if not terms:
        return "t" + xxhash.xxh64_hexdigest(text.encode())
    inside = terms & set(lex.tolist())
    lead, terms = ("", inside) if inside else ("x", terms)

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    level, parts = min(plan.levels, max(0, round(np.log2(max(1.0, len(terms) / plan.aim))))), []
    for j in (level, level + 1):
        marks = ""
        for row in range(plan.subsets):
            left = sorted(t for t in terms if mixed(t ^ mixed(row + 1)) < 1 << 64 - j)
            data = b"".join(t.to_bytes(8, "little") for t in left)
            marks += hashlib.blake2b(data, digest_size=2, salt=row.to_bytes(2, "little")).hexdigest() if left else "----"
        parts.append(marks)
    return f"{lead}{level}:{parts[0]}:{parts[1]}"


def test_query_s_fingerprints_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, plan = [(x["doc_id"], x["text"]) for x in docs.collect()], imatch.IMatchPlan()
    seen = {}
    for _, text in rows:
        for t in set(imatch.term_hashes(text).tolist()):
            seen[t] = seen.get(t, 0) + 1
    low, high = max(2.0, plan.least_share * len(rows)), plan.most_share * len(rows)
    lex = np.array(sorted(t for t, n in seen.items() if low <= n <= high), np.uint64)
    got = {x["doc_id"]: x["fingerprint"] for x in op6_imatch(spark, sf_dir).collect()}
    assert got == {i: _plain_marks(text, lex, plan) for i, text in rows}


def test_long_texts_are_walked_in_pieces(monkeypatch):
    text = "alpha_beta ünder 12 " * 300 + "last"
    whole = imatch.term_hashes(text).tolist()
    for piece in (1, 3, 64):
        monkeypatch.setattr(imatch, "PIECE", piece)
        assert imatch.term_hashes(text).tolist() == whole


def test_null_and_repeated_ids_spread_over_ranges(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 400}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    for docs in (spark.read.parquet(f"{tmp_path}/in"), spark.createDataFrame(rows, "doc_id long, text string")):
        got = imatch.with_next(docs, lambda i, a, b: (i, a, b), "id long, text string, following string")
        pairs = [(x["id"], x["text"], x["following"]) for x in got.collect()]
        assert sorted((repr(x[:2]) for x in pairs)) == sorted(map(repr, rows))
        # every row is followed once: the texts that follow are the texts themselves
        assert sorted(x[2] for x in pairs) == sorted(t for _, t in rows)
        own = imatch._Cuts.of(docs.selectExpr("doc_id as id", "shiftrightunsigned(xxhash64(text), 1) as mark"), 32)
        assert list(own.ids).count(~7) > 5 and len(own.nulls) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    got = imatch.fingerprints(odd_docs).collect()
    by = {x["doc_id"]: x["fingerprint"] for x in got}
    assert len(got) == odd_docs.count() and by[3] == by[4] and by[8] == by[9]
    assert imatch.fingerprints(no_docs).count() == 0
    pairs = imatch.with_next(odd_docs, lambda i, a, b: (i, a, b), "id long, text string, following string").collect()
    order = sorted(((x["doc_id"], x["text"] or "") for x in odd_docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted(((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)), key=repr)
    assert sorted(((x["id"], x["text"], x["following"]) for x in pairs), key=repr) == want
    assert imatch.with_next(no_docs, lambda i, a, b: (i, a, b), "id long, text string, following string").count() == 0
