import numpy as np

from loomspark.llm import langid
from loomspark.llm.queries import op10_langid


def test_held_out_accuracy(spark, sf_dir):
    truth = {x["doc_id"]: x["lang"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op10_langid(spark, sf_dir).collect()
    out = [x for x in got if x["held_out"]]
    assert len(got) == len(truth) and len(out) > 20
    assert np.mean([x["lang_pred"] == truth[x["doc_id"]] for x in out]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got)


def test_query_against_plain_version(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    plan, got = model.plan, {x["doc_id"]: x for x in op10_langid(spark, sf_dir).collect()}

    def features(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        text, found = f" {' '.join(words)} ", {}
        for n in plan.orders:
            for i in range(len(text) - n + 1):
                h = n
                for c in text[i : i + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
                    h ^= h >> 29
                found[h % plan.features] = found.get(h % plan.features, 0) + 1
        norm = sum(found.values()) ** 0.5
        return {k: v**0.5 / norm for k, v in found.items()}

    def duel(x, names):
        wins = dict.fromkeys(names, 0)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w = model.pairs[a, b]
                wins[a if sum(v * w[k] for k, v in x.items()) + w[-1] >= 0 else b] += 1
        return max(names, key=wins.get)

    for d in docs.collect()[::3]:
        x = features(d["text"])
        assert got[d["doc_id"]]["lang_pred"] == duel(x, model.langs[duel(x, model.families)])


def test_long_texts_are_not_cut(monkeypatch):
    text = "Ünder dem Baum, 12 Äpfel! ΑΣ " * 40 + " ende"
    whole = langid.features(text, langid.LangIdPlan())
    for piece in (1, 2, 7, 64, len(text) - 1):
        assert np.array_equal(langid.features(text, langid.LangIdPlan(piece=piece)), whole)
    k = (1 << 20) + 5
    long = "ab cd " * (k // 6 + 1)
    assert np.array_equal(langid.features(long[:k], langid.LangIdPlan()), langid.features(long[:k], langid.LangIdPlan(piece=1 << 22)))


def test_repeated_rows_do_not_pass_the_bound(spark):
    from pyspark.sql import functions as F

    same = spark.range(20_000).select("id", F.lit("the same text again and again").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(3000).select("id", F.concat(F.lit("ein anderer Text "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    plan = langid.LangIdPlan(per_lang=400)
    chosen = {x["lang"]: x["n"] for x in langid._chosen(same.union(others).select("text", "lang"), plan).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert chosen == {"en": 1, "de": 400}
    model = langid.fit(same.union(others).withColumnRenamed("id", "doc_id"), plan)
    assert model.langs == {"germanic": ["de", "en"]}


def test_families_come_first(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), langid.LangIdPlan(per_lang=60))
    assert model.families == ["germanic", "romance"] and model.langs == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.pairs) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}


def test_svm_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    w = langid.train_svm(x, y, 30, 1e-4)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {x["lang_pred"] for x in got if x["doc_id"] in (3, 4, 11, 12)} == {"und"} and {x["lang_pred"] for x in got if x["doc_id"] == 1} == {"en"}
    none = langid.fit(no_docs)
    assert {x["lang_pred"] for x in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
