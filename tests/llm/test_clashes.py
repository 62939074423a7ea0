"""Input columns named like those the operators use inside or add: their values come back, and nothing crashes."""

import pytest

import corpus_pipeline
from loomspark.llm import bpe, compaction, imatch, langid, line_dedup, mixing, quality, shingles, simhash, sstable, url_filter
from loomspark.llm.queries import URL_RULES, vocabulary

INNER = (
    "row s t u task buckets bucket number before at block rank slot range name n f j k w m id h p d mark pos cut bitmap b_id b_mark hit part kind first "
    "host path fh fp kh rh rp rs spread short salt digest known later best rule verdict page_id good bucket trusted score kept base_failed n_words file "
    "gone twice node keys grams root component_id guest place a b __id __mark __b_n __bitmap __cut __h __p __best __task __s __w __k __bucket __row __name __key __new __hash __gone"
).split()
ADDED = "__block __slot __rank __n_words __word_chars __n_symbols __n_dup_lines __n_repeat_words __base_failed __score __kept __host __path __rule __verdict __n_lines __n_dropped __shard mix_position token_ids".split()


@pytest.fixture(scope="module")
def clashing(spark):
    names = sorted({*INNER, *ADDED, "dotted.name", "back`tick"})
    schema = "doc_id long, text string, lang string, source string, n_chars long, url string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    line, long = "a line that several documents share", " ".join(f"w{i % 61}" for i in range(120))
    rows = [(i, f"{line}\n{long} own{i}", "en", f"s{i % 2}", 7, f"http://a{i}.example.org/es/{i}", *(f"{n}-{i}" for n in names)) for i in range(9)]
    rows += [(None, None, None, None, None, None, *([None] * len(names)))] * 2
    return spark.createDataFrame(rows, schema).repartition(3)


def _same(made, docs, added=(), without=()):
    names = [c for c in docs.columns if c not in added and c not in without]
    cols = ["`" + c.replace("`", "``") + "`" for c in names]
    assert len(made.columns) == len(set(made.columns)) and set(added) <= set(made.columns)
    assert sorted(map(repr, made.select(*cols).collect())) == sorted(map(repr, docs.select(*cols).collect()))


def test_operators_keep_all_other_columns(spark, clashing, tmp_path):
    _same(mixing.mix(clashing), clashing, ["__block", "__slot", "__rank"])
    _same(mixing.mixed_order(clashing), clashing)
    _same(mixing.positions(clashing), clashing, ["mix_position"])
    _same(quality.judge(clashing, clashing.select("doc_id")), clashing, [f"__{n}" for n in quality.NAMES])
    _same(url_filter.judge_urls(clashing, url_filter.rule_table(spark, URL_RULES)), clashing, ["__host", "__path", "__rule", "__verdict"])
    _same(line_dedup.dedup_lines(clashing), clashing, ["__n_lines", "__n_dropped"], ["text"])
    _same(bpe.encode_column(clashing, vocabulary()), clashing, ["token_ids"])
    shards = compaction.ShardSet(spark, f"file://{tmp_path}/s")
    shards.append(clashing.drop("dotted.name", "back`tick"))
    _same(shards.read(), clashing, ["__shard"], ["dotted.name", "back`tick"])


def test_added_values_are_the_operators(spark, clashing):
    got = quality.judge(clashing, clashing.select("doc_id")).where("doc_id = 3").first()
    assert got["__n_words"] == 127 and got["n_words"] == "n_words-3"
    urls = url_filter.judge_urls(clashing, url_filter.rule_table(spark, URL_RULES)).where("doc_id = 3").first()
    assert (urls["__rule"], urls["__verdict"], urls["rule"]) == ("example.org/es/", "block", "rule-3")
    lines = line_dedup.dedup_lines(clashing).where("doc_id = 3").first()
    assert lines["__n_dropped"] == 1 and lines["__n_lines"] == 2 and lines["bitmap"] == "bitmap-3" and lines["text"].startswith("w0 ")


def test_readers_of_texts_do_not_mind(clashing, tmp_path):
    n = clashing.count()
    assert simhash.near_duplicates(clashing).count() == shingles.near_duplicates(clashing).count() == n
    assert imatch.fingerprints(clashing).count() == bpe.round_trip(clashing, vocabulary()).count() == n
    assert imatch.with_next(clashing, lambda i, a, b: (i, a, b), "id long, text string, following string").count() == n
    assert langid.identify(clashing, langid.fit(clashing)).count() == n
    assert sum(s["records"] for s in sstable.write_tokens(clashing, f"file://{tmp_path}/t", vocabulary())) == n


def test_stages_hand_on_values(spark, clashing, sf_dir):
    clean = clashing.drop("url")
    good = {x["doc_id"]: x for x in clean.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, clean, sf_dir)
        assert made.columns == clean.columns, name
        for x in made.collect():
            if x["doc_id"] is not None:
                assert all(x[c] == good[x["doc_id"]][c] for c in clean.columns if c not in ("text", "n_chars")), name
