"""Queries over the retrieval operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import values as V
from loomspark.operators import dense, fusion, sparse
from loomspark.operators.term_index import TermIndex
from loomspark.operators.vector_index import VectorIndex
from loomspark.scratch import fresh_path


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _first_line(text: str = "text"):
    return F.substring_index(text, "\n", 1)


def bm25_idf(spark, d):
    return sparse.idf_table(read(spark, d, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 6))


def bm25_corpus(spark, d):
    return sparse.corpus_size(read(spark, d, "documents"), "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_doc_weights(spark, d):
    made = sparse.doc_weights(read(spark, d, "documents"))
    return made.select(F.col("id").alias("doc_id"), "term", "tf", F.round("weight", 6).alias("weight"))


def _hits(spark, d, k=10):
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark")
    return sparse.search(docs.select("doc_id", "text"), items, k)


def bm25_search_topk(spark, d):
    return _hits(spark, d).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _term_index(spark, d):
    """All documents in an index, written in two parts."""
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    made = TermIndex(spark, fresh_path(spark, "term-index"), keep=("lang",)).add(docs.where("doc_id % 3 > 0"))
    return made.add(docs.where("doc_id % 3 = 0"))


def term_index_topk(spark, d):
    found = _term_index(spark, d).search(read(spark, d, "benchmark"), 10)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def term_index_filtered(spark, d):
    found = _term_index(spark, d).search(read(spark, d, "benchmark"), V.SEARCH_K, where=F.col("lang") == "en", threshold=1.0)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def term_index_terms(spark, d):
    """What the blocks of every term add up to."""
    blocks = _term_index(spark, d).blocks().select("term", "n", "top_tf", "ratio")
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top_tf").alias("top_tf"), F.round(F.min("ratio"), 6).alias("ratio"))


def dense_topk(spark, d):
    vectors = read(spark, d, "embeddings")
    return dense.search(vectors, vectors.where("vec_id % 100 = 0"), 10).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def dense_filtered_topk(spark, d):
    vectors = read(spark, d, "embeddings")
    points = dense.payload_filter(vectors.withColumn("year", F.lit(2000) + F.col("vec_id") % 20), sections=[1, 3, 5], year_from=2005, section_col="label")
    found = dense.search(points, vectors.where("vec_id % 100 = 0"), V.SEARCH_K, threshold=V.SCORE_MIN)
    return found.select("qid", F.col("id").alias("vec_id"), "score", "rank")


def _indexed(spark, d):
    """All vectors in an index, written in two parts."""
    vectors = read(spark, d, "embeddings").withColumn("year", F.lit(2000) + F.col("vec_id") % 20)
    made = VectorIndex(spark, fresh_path(spark, "vector-index")).create(vectors.where("vec_id % 3 > 0"))
    return made.add(vectors.where("vec_id % 3 = 0")), vectors


def index_topk(spark, d):
    index, vectors = _indexed(spark, d)
    return index.search(vectors.where("vec_id % 100 = 0"), 10, exact=True).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def index_filtered_topk(spark, d):
    index, vectors = _indexed(spark, d)
    found = index.search(vectors.where("vec_id % 100 = 0"), V.SEARCH_K, exact=True, where=F.col("label").isin(1, 3, 5) & (F.col("year") >= 2005), threshold=V.SCORE_MIN)
    return found.select("qid", F.col("id").alias("vec_id"), "score", "rank")


def index_probed_topk(spark, d):
    # the answers of the nearest cells only; recall is held against the exact search in a test
    index, vectors = _indexed(spark, d)
    cells = index.cells().count()
    return index.search(vectors.where("vec_id % 100 = 0"), 10, max(8, 2 * cells // 3)).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def index_cells(spark, d):
    index, _ = _indexed(spark, d)
    return index.cells().agg(F.sum("rows").alias("n"), (F.max("radius") <= 3.1416).alias("bounded"))


def question_embedding(spark, d):
    """Questions embedded as the documents are, then searched."""
    docs = dense.embed(read(spark, d, "documents").select("doc_id", "text"))
    asked = dense.embed(read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    found = dense.search(docs, asked, 10, "doc_id", "embedding")
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def hybrid_rrf(spark, d):
    vectors, docs = read(spark, d, "embeddings"), read(spark, d, "documents").select("doc_id", "text")
    both = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    asked = both.where("doc_id % 100 = 0")
    near = dense.search(both, asked, 20, "doc_id", "embedding")
    lexical = sparse.search(both.select("doc_id", "text"), asked.select(F.col("doc_id").alias("item_id"), "text"), 20)
    return fusion.hybrid(near, lexical, 10).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def query_fusion(spark, d):
    vectors = read(spark, d, "embeddings")
    phrasing = vectors.where("vec_id % 100 < 3").select("vec_id", "embedding")
    hits = dense.search(vectors, phrasing, 10).withColumn("qid", F.col("qid") - F.col("qid") % 100)
    return fusion.variation_scores(hits, 10).select("qid", F.col("id").alias("vec_id"), "n", "score", "rank")


def _picked(spark, d, most=V.CONTEXT_CHUNKS):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("document"), F.col("lang").alias("section"))
    return fusion.diverse(_hits(spark, d, V.SEARCH_K).join(docs, "id"), most)


def diverse_select(spark, d):
    return _picked(spark, d).select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "pick")


def _taken(spark, d):
    chunks = _picked(spark, d).withColumn("title", F.col("document")).withColumn("year", F.lit(None).cast("int"))
    return fusion.budgeted(chunks)


def context_budget(spark, d):
    made = _taken(spark, d)
    return made.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "citation_id", "block_tokens", "running_tokens", F.md5("block").alias("block_md5"))


def context_assembly(spark, d):
    return fusion.contexts(_taken(spark, d)).select(F.col("qid").alias("item_id"), F.md5("context").alias("context_md5"), "n_citations", "used_tokens")


def answer_fallback(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    made = fusion.fallback_answers(asked, fusion.citation_rows(_taken(spark, d)))
    return made.select(F.col("qid").alias("item_id"), "answer", "confidence")


def mmr_select(spark, d):
    vectors = read(spark, d, "embeddings")
    found = dense.search(vectors, vectors.where("vec_id % 100 = 0"), V.SEARCH_K)
    return dense.mmr(found.join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id"), V.RERANK_K)


QUERIES = {f.__name__: f for f in (bm25_search_topk, bm25_idf, bm25_corpus, bm25_doc_weights, term_index_topk, term_index_filtered, term_index_terms, dense_topk, dense_filtered_topk, index_topk, index_filtered_topk, index_probed_topk, index_cells, question_embedding, hybrid_rrf, query_fusion, diverse_select, context_budget, context_assembly, answer_fallback, mmr_select)}

_STOP = "[" + ",".join(f"'{w}'" for w in V.STOPWORDS) + "]"


def _tok(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+-?[a-z0-9]*'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))"


def _bm25(docs: str) -> str:
    return f"""
toks AS (SELECT doc_id, {_tok("text")} AS tok FROM {docs}),
size AS (SELECT count(*) AS n, CASE WHEN avg(coalesce(len(tok), 0)) > 0 THEN avg(coalesce(len(tok), 0)) ELSE 200.0 END AS avgdl FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, unnest(tok) AS term, len(tok) AS dl FROM toks) GROUP BY doc_id, term),
idf AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, size GROUP BY term, n),
w AS (SELECT doc_id, term, tf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN idf USING (term), size)"""


def _search(docs: str, questions: str, k: int) -> str:
    return f"""{_bm25(docs)},
qtf AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({_tok("text")}) AS term FROM {questions}) GROUP BY qid, term),
qw AS (SELECT qid, term, idf * 2.5 * qn / (1.5 + qn) AS qw FROM qtf JOIN idf USING (term)),
sc AS (SELECT qid, doc_id, round(sum(qw * weight), 6) AS score FROM qw JOIN w USING (term) GROUP BY qid, doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


_ITEMS = "(SELECT item_id AS qid, text FROM benchmark)"
_PICK = f"""WITH {_search("documents", _ITEMS, V.SEARCH_K)},
m AS (SELECT h.*, text, source AS document, lang AS section,
 CASE WHEN count(*) OVER (PARTITION BY qid) <= 18 THEN 1
      WHEN row_number() OVER (PARTITION BY qid, source ORDER BY rank) = 1 THEN 1
      WHEN row_number() OVER (PARTITION BY qid, source, lang ORDER BY rank) = 1 THEN 2 ELSE 3 END AS pass
 FROM hits h JOIN documents USING (doc_id)),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pass, rank) AS pick FROM m) WHERE pick <= 18)"""
_TAKEN = f"""{_PICK},
b AS (SELECT qid, doc_id, text, document, pick AS citation_id,
 '[' || pick || ']' || chr(10) || 'Source: ' || document || ' Section: ' || section || chr(10) || text AS block FROM picked),
r AS (SELECT *, length(block) // 4 AS block_tokens, sum(length(block) // 4) OVER (PARTITION BY qid ORDER BY citation_id) AS running FROM b),
taken AS (SELECT * FROM r WHERE running <= 6000)"""


def _cos(k: int, points: str, queries: str, floor: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
SELECT q.qid, p.id, round(list_cosine_similarity(q.e::DOUBLE[], p.e::DOUBLE[]), 6) AS score FROM {queries} q, {points} p) {floor}) WHERE rank <= {k}"""


_ALL, _HUNDREDS = "(SELECT vec_id AS id, embedding AS e FROM embeddings)", "(SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)"

def _embedded(table: str, id_col: str, name: str) -> str:
    """Rows (id, b, v) of the unit vectors of hashed terms of a table's texts."""
    return f"""{name}t AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {table}), {name}n AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, count(*) AS n FROM {name}t GROUP BY ALL),
{name}f AS (SELECT id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}n), {name} AS (SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {name}f)"""


ORACLES = {
    "bm25_idf": f"WITH {_bm25('documents')} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_corpus": f"WITH {_bm25('documents')} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM size",
    "bm25_doc_weights": f"WITH {_bm25('documents')} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM w",
    "bm25_search_topk": f"WITH {_search('documents', _ITEMS, 10)} SELECT qid AS item_id, doc_id, score, rank FROM hits",
    "dense_topk": f"SELECT qid, id AS vec_id, score, rank FROM ({_cos(10, _ALL, _HUNDREDS)})",
    "dense_filtered_topk": f"""SELECT qid, id AS vec_id, score, rank FROM ({_cos(30, "(SELECT vec_id AS id, embedding AS e FROM embeddings WHERE label IN (1, 3, 5) AND 2000 + vec_id % 20 >= 2005)", _HUNDREDS, "WHERE score >= 0.2")})""",
    "question_embedding": f"""WITH {_embedded("documents", "doc_id", "dv")}, {_embedded("benchmark", "item_id", "qv")},
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.v * d.v), 6) AS score FROM qv q JOIN dv d USING (b) GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "index_cells": "SELECT count(*) AS n, true AS bounded FROM embeddings WHERE embedding IS NOT NULL",
    "hybrid_rrf": f"""WITH ed AS (SELECT doc_id, text, embedding AS e FROM documents JOIN embeddings ON vec_id = doc_id),
{_search("ed", "(SELECT doc_id AS qid, text FROM ed WHERE doc_id % 100 = 0)", 20)},
legs AS (SELECT qid, id, rank FROM ({_cos(20, "(SELECT doc_id AS id, e FROM ed)", "(SELECT doc_id AS qid, e FROM ed WHERE doc_id % 100 = 0)")}) UNION ALL SELECT qid, doc_id, rank FROM hits),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM legs GROUP BY qid, id)
SELECT qid, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "query_fusion": f"""WITH h AS (SELECT qid - qid % 100 AS qid, id, score FROM ({_cos(10, _ALL, "(SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 < 3)")})),
f AS (SELECT qid, id, count(*) AS n, round(0.6 * list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0::DOUBLE / (60 + i))) + 0.4 * avg(score), 9) AS score FROM h GROUP BY qid, id)
SELECT qid, id AS vec_id, n, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""",
    "diverse_select": f"{_PICK} SELECT qid AS item_id, doc_id, pick FROM picked",
    "context_budget": f"{_TAKEN} SELECT qid AS item_id, doc_id, citation_id, block_tokens, running AS running_tokens, md5(block) AS block_md5 FROM taken",
    "context_assembly": f"{_TAKEN} SELECT qid AS item_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY citation_id)) AS context_md5, count(*) AS n_citations, sum(block_tokens) AS used_tokens FROM taken GROUP BY qid",
    "answer_fallback": f"""{_TAKEN},
s AS (SELECT qid, string_agg(chr(10) || '[' || citation_id || '] ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, '' ORDER BY citation_id) AS t FROM taken WHERE citation_id <= 3 GROUP BY qid)
SELECT item_id, CASE WHEN t IS NULL THEN 'I couldn''t find relevant information to answer your question.' ELSE 'Based on the retrieved documents, here are the relevant excerpts:' || chr(10) || t END AS answer, 0.3::DOUBLE AS confidence
FROM benchmark LEFT JOIN s ON qid = item_id""",
}
ORACLES["term_index_topk"] = ORACLES["bm25_search_topk"]
ORACLES["term_index_filtered"] = f"""WITH {_search("documents", _ITEMS, 10)} SELECT qid AS item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM sc JOIN documents USING (doc_id) WHERE lang = 'en' AND score > 1 QUALIFY rank <= {V.SEARCH_K}"""
ORACLES["term_index_terms"] = f"WITH {_bm25('documents')} SELECT term, count(*) AS df, max(tf) AS top_tf, round(min(dl::DOUBLE / tf), 6) AS ratio FROM tf GROUP BY term"
ORACLES |= {"index_topk": ORACLES["dense_topk"], "index_filtered_topk": ORACLES["dense_filtered_topk"]}
