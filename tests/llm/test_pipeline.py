import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from loomspark.llm import mixing, quality
from loomspark.llm.queries import vocabulary
from tests.llm import brute
from tests.llm.test_shingles import _groups


def _groups_of_near_texts(texts):
    """Of all pairs, those of Jaccard similarity 0.8 or more in five-word shingles, as the place of each group's first text."""
    sets = []
    for text in texts:
        words = brute.WORD.findall((text or "").translate(brute.LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()})
    return _groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def _good(docs, trusted):
    """Ids that the quality rules must keep and may keep; scores next to the threshold and of other than ASCII texts may go either way."""
    rules = quality.QualityRules()
    must, may = set(), set()
    ratios = brute.mean_ratios([(x["doc_id"], x["text"]) for x in docs], trusted, rules.buckets)
    for x, score in zip(docs, ratios, strict=True):
        n, _, _, _, repeated = brute.base_metrics(x["text"])
        if n >= 50 and 2 * repeated <= n:
            sure = x["text"].isascii() and abs(score - rules.threshold) > 1e-4
            may |= {x["doc_id"]} if not sure or score >= rules.threshold else set()
            must |= {x["doc_id"]} if sure and score >= rules.threshold else set()
    return must, may


def test_run_against_brute_force(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = sorted((x.asDict() for x in read("documents").collect()), key=lambda x: x["doc_id"])
    kept = {x["doc_id"] for x in corpus_pipeline.quality_rules(spark, read("documents"), sf_dir).collect()}
    must, may = _good(docs, {x["doc_id"] for x in read("labels").where("quality = 1").collect()})
    assert must <= kept <= may and len(must) > 50
    docs = [x for x in docs if x["doc_id"] in kept]
    lines = brute.line_dedup([(x["doc_id"], x["text"]) for x in docs])
    texts = [lines[x["doc_id"]][2] for x in docs]
    library = Tokenizer.from_file(vocabulary())
    want = {docs[i]["doc_id"]: library.encode(texts[i], add_special_tokens=False).ids for i in set(_groups_of_near_texts(texts))}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {x["doc_id"]: x["token_ids"] for x in got} == want and len(got) == len(want) < len(docs)


def test_stages_return_the_columns(spark, sf_dir, odd_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_docs.select(*columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.where("false"), odd_docs):
            made = stage(spark, rows, sf_dir)
            assert made.columns == rows.columns, name
            made.collect()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_one_row_of_each_group_stays(spark, odd_docs, sf_dir):
    got = [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, odd_docs, sf_dir).collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 5, 7, 8, 10, 12] and got.count(None) == 1


def test_order_of_the_mix_over_several_files(spark, sf_dir, tmp_path):
    rows = [(i, "word " * (i * 37 % 90 + 1), "en", f"s{i * i % 5}", i) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = [x["doc_id"] for x in mixing.mix(docs).orderBy("__slot", "__rank").collect()]
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxPartitionBytes": "6k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        corpus_pipeline.mixed_sources(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mixed")
        again = spark.read.parquet(f"{tmp_path}/mixed")
        assert len(again.inputFiles()) > 5 and [x["doc_id"] for x in again.select("doc_id").collect()] != want
        got = corpus_pipeline.token_ids(spark, again, sf_dir).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(x["mix_position"] for x in got) == list(range(1500))
    assert [x["doc_id"] for x in sorted(got, key=lambda x: x["mix_position"])] == want


def test_order_of_files_beyond_five_digits():
    names = [f"part-{n:05d}-0a1b2c-c000.parquet" for n in (2, 10, 99999, 100000)]
    assert sorted(reversed(names), key=mixing._natural) == names


def test_tokens_are_made_of_small_batches(spark, sf_dir, monkeypatch):
    size = F.arrow_udf(lambda text: pa.array([[text.nbytes]] * len(text), pa.list_(pa.int32())), T.ArrayType(T.IntegerType()))
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_column", lambda docs, path: docs.withColumn("token_ids", size("text")))
    limit, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.repeat(F.lit("word "), 2000).alias("text"))
    got = [x["token_ids"][0] for x in corpus_pipeline.token_ids(spark, docs, sf_dir).collect()]
    assert len(got) == 3000 and max(got) < 9 << 20 and spark.conf.get(limit) == before
