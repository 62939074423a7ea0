import random

from loomspark.llm import quality
from tests.llm import brute

NAMES = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words"]


def test_base_metrics_against_plain_version(spark):
    r = random.Random(4)
    pool = ["a", "B", "cé", "###", "|", "\n", "\n\n", "\t", " ", "日本", "\x1c"]
    texts = [None, "", " ", "a b c", "a b c a b c", "x x x x x"] + ["".join(r.choice(pool) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.judge(docs, docs.select("doc_id")).collect()
    assert {x["doc_id"]: tuple(x[n] for n in NAMES) for x in got} == {i: brute.base_metrics(t) for i, t in enumerate(texts)}
    for x in got:
        assert x["__base_failed"] == (x["__n_words"] < 50 or 100 * x["__n_repeat_words"] > 50 * x["__n_words"])


def test_junk_goes_and_clean_stays(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    assert all(x["__kept"] for x in rows if x["quality"] == 1 and not x["__base_failed"])
    assert not any(x["__kept"] for x in rows if x["quality"] == 0)


def test_scores_against_brute_force(spark):
    r = random.Random(8)
    words = ["alpha", "Beta", "gamma9", "42", "###", "x,y", "a_b", "delta", "!"]
    docs = [(i, " ".join(r.choice(words[: 4 + i % 6]) for _ in range(r.randint(0, 90)))) for i in range(120)] + [(500, None), (501, ""), (7, "alpha Beta twice")]
    trusted = {i for i in range(0, 120, 7)} | {7}
    rules = quality.QualityRules(buckets=256, threshold=-0.05)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = quality.judge(frame, spark.createDataFrame([(i,) for i in trusted] * 2, "id long"), rules).collect()
    want = {(i, t): v for (i, t), v in zip(docs, brute.mean_ratios(docs, trusted, rules.buckets), strict=True)}
    assert len(got) == len(docs)
    for x in got:
        assert abs(x["__score"] - want[x["doc_id"], x["text"]]) < 2e-6
        assert x["__kept"] == (not x["__base_failed"] and x["__score"] >= rules.threshold)


def test_query_against_brute_force(spark, sf_dir):
    from loomspark.llm.queries import op2_quality, trusted_ids

    rules = quality.QualityRules()
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ascii_only = {i for i, t in docs if t is None or t.isascii()}
    ratios = quality.log_ratios(spark.createDataFrame(docs, "doc_id long, text string"), trusted_ids(spark, sf_dir), rules)
    got = {x["doc_id"]: x for x in op2_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute.base_metrics(text)
        if i in ascii_only:
            found = brute.grams(brute.ratio_tokens(text), rules.buckets)
            assert abs(x["score"] - (sum(ratios[b] for b in found) / len(found) if found else 0.0)) < 2e-6


def test_bound_of_trusted_ids_is_exact(spark):
    docs = spark.range(19_500).selectExpr("id as doc_id", "concat('w', id) as text")
    count = lambda rules: sum(round(v, 9) != low for v in rules) if (low := round(min(rules), 9)) is not None else 0
    rules = quality.QualityRules(buckets=1 << 18, trusted_rows=20_000)
    every = quality.log_ratios(docs, docs.select("doc_id"), rules)
    assert max(abs(x) for x in every) < 1e-12  # all are trusted: both models are the same
    some = quality.QualityRules(buckets=1 << 18, trusted_rows=1_000)
    chosen = {x["doc_id"] for x in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").limit(1000).collect()}
    want = quality.log_ratios(docs, docs.where(docs.doc_id.isin(list(chosen))).select("doc_id"), rules)
    assert quality.log_ratios(docs, docs.select("doc_id"), some) == want and count(want) > 0


def test_bounded_trusted_sample_and_odd_rows(spark, odd_docs, no_docs):
    few = quality.judge(odd_docs, odd_docs.select("doc_id"), quality.QualityRules(trusted_rows=2))
    assert few.count() == odd_docs.count() and set(odd_docs.columns) < set(few.columns)
    empty = {x["doc_id"]: x for x in few.collect()}[3]
    assert empty["__n_words"] == 0 and empty["__base_failed"] and not empty["__kept"]
    assert quality.judge(no_docs, no_docs.select("doc_id")).count() == 0
    alone = quality.judge(odd_docs, odd_docs.where("false").select("doc_id")).collect()
    assert {x["__score"] for x in alone} == {0.0}


def test_good_documents_are_the_kept_ones(spark, sf_dir, odd_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        want = quality.judge(docs, labels).where("__kept").select(*docs.columns)
        got = quality.good_documents(docs, labels)
        assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_plan_has_no_python(spark, odd_docs):
    made = quality.judge(odd_docs, odd_docs.select("doc_id"))
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
