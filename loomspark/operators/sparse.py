"""Sparse retrieval: corpus statistics, BM25 weights, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.functions.text import sparse_tokens
from loomspark.scratch import materialize


def run_lengths(ordered: Column) -> Column:
    """(term, tf) of each distinct value of a sorted array, by the places where a new value begins."""

    def counted(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        pairs = lambda at: F.transform(at, lambda p, i: F.struct(F.get(v, p).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(v)) - p).cast("long").alias("tf")))
        return F.element_at(F.transform(F.array(starts), pairs), 1)

    # bound once a row, so that the lambdas never evaluate `ordered` again
    return F.element_at(F.transform(F.array(ordered), lambda v: F.when(F.size(v) > 0, counted(v))), 1)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): term frequency and document length.

    Terms are counted inside the row, over its sorted tokens, so nothing is shuffled.
    """
    tokens = docs.select(F.col(id_col).alias("id"), F.sort_array(sparse_tokens(F.col(text_col))).alias("tokens"))
    return tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.inline(run_lengths(F.col("tokens")))).select("id", "term", "tf", "dl")


def corpus_size(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n documents and the mean token count (the default length without tokens)."""
    n = F.size(sparse_tokens(F.coalesce(F.col(text_col), F.lit(""))))
    mean = F.avg(n)
    return docs.agg(F.count("*").alias("n_docs"), F.when(mean > 0, mean).otherwise(V.DEFAULT_AVGDL).alias("avgdl"))


def idf_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df, idf): distinct terms are taken within each document, so only (term, 1) pairs are shuffled."""
    terms = docs.select(F.explode(F.array_distinct(sparse_tokens(F.col(text_col)))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    return df.crossJoin(n).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def doc_weight(idf_col: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf_col * tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl))


def query_weight(idf_col: Column, tf: Column) -> Column:
    return idf_col * (V.BM25_K1 + 1) * tf / (V.BM25_K1 + tf)


def doc_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_df: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, weight) of every document; a term missing from idf_df weighs as the default says."""
    table = idf_table(docs, id_col, text_col) if idf_df is None else idf_df
    size = F.broadcast(corpus_size(docs, text_col))  # one row
    counts = term_counts(docs, id_col, text_col).join(table.select("term", "idf"), "term", "left").crossJoin(size.select("avgdl"))
    own = F.coalesce("idf", F.lit(V.DEFAULT_IDF))
    return counts.select("id", "term", "tf", doc_weight(own, F.col("tf"), F.col("dl"), F.col("avgdl")).alias("weight"))


def query_weights(questions: DataFrame, idf_df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, q_weight): only terms that the corpus knows."""
    counts = term_counts(questions, id_col, text_col).select(F.col("id").alias("qid"), "term", "tf")
    return counts.join(idf_df, "term").select("qid", "term", query_weight(F.col("idf"), F.col("tf")).alias("q_weight"))


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each query with their rank, ties by id."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Question terms that are sent to the scan of the documents; more are joined by a shuffle.
SENT_TERMS = 500_000


def search(
    docs: DataFrame,
    questions: DataFrame,
    k: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    qid_col: str = "item_id",
    q_text_col: str = "text",
    statistics: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(qid, id, score, rank): dot product of query and document weights.

    Texts are read once: their tokens are cut to the questions' terms before anything is counted or shuffled. These terms
    are few, which is checked, and sent to the scan. What is left, one row for each document and matched term and one for each
    document, is written to the shared folder; size, mean length and frequencies of the corpus are taken from there.
    Matched terms are shuffled by document and never as (question, document) pairs, of which each task hands on its k best
    a question. With statistics, as
    read_statistics() returns them, nothing is written.
    """
    asked = term_counts(questions, qid_col, q_text_col).select(F.col("id").alias("qid"), "term", F.col("tf").alias("qn"))
    few = asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    sent = F.broadcast if few else lambda rows: rows
    mark = F.lit("")  # no term; stands for its document
    terms = asked.select("term").union(questions.sparkSession.range(1).select(mark.alias("term"))).distinct()
    rows = docs.select(F.col(id_col).alias("id"), sparse_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    tokens = rows.select("id", F.size("tokens").cast("long").alias("dl"), F.explode(F.concat("tokens", F.array(mark))).alias("term"))
    postings = tokens.join(sent(terms), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    if statistics is None:
        postings = materialize(postings, "postings")
        mean = F.avg("dl")
        size = postings.where(F.col("term") == mark).agg(F.count("*").alias("n_docs"), F.when(mean > 0, mean).otherwise(V.DEFAULT_AVGDL).alias("avgdl"))
        found = postings.where(F.col("term") != mark).groupBy("term").agg(F.count("*").alias("df"))
        known = found.crossJoin(F.broadcast(size)).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"))  # one row
    else:
        known, size = statistics[0].select("term", "idf"), statistics[1]
    wanted = known.join(asked, "term").select("qid", "term", "idf", query_weight(F.col("idf"), F.col("qn")).alias("q_weight"))
    # a document's terms meet in one task, which sums its pairs with all questions and hands on the k best a question
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data and much work: not to be put together
    held = postings.where(F.col("term") != mark).repartition(tasks, "id") if few else postings
    hits = held.join(sent(wanted), "term").crossJoin(F.broadcast(size.select("avgdl")))  # one row
    product = F.col("q_weight") * doc_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    scores = hits.groupBy("qid", "id").agg(F.round(F.sum(product), 6).alias("score"))
    return top_k(scores, k)


# --- stored statistics ---


def vocabulary(terms: DataFrame) -> DataFrame:
    """terms(term, ...) with term_index: 0, 1, ... in the order of the terms, the same in every run.

    Terms are numbered through their first three signs, so no task sees the whole vocabulary.
    """
    head = terms.withColumn("__head", F.substring("term", 1, 3))
    sizes = head.groupBy("__head").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__head", before.alias("__before"))  # a row for each three signs
    number = F.row_number().over(Window.partitionBy("__head").orderBy("term")) - 1
    return head.withColumn("__number", number).join(starts, "__head").withColumn("term_index", (F.col("__before") + F.col("__number")).cast("long")).drop("__head", "__before", "__number")


def write_statistics(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Fit on docs and store (term, df, idf, term_index) and the corpus row under path, a folder that must be new."""
    vocabulary(idf_table(docs, id_col, text_col)).write.parquet(f"{path}/terms")
    corpus_size(docs, text_col).write.parquet(f"{path}/corpus")


def read_statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, corpus) as write_statistics() stored them."""
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus")


def encode(docs: DataFrame, statistics: tuple[DataFrame, DataFrame], id_col: str = "doc_id", text_col: str = "text", question: bool = False) -> DataFrame:
    """(id, indices, values): sparse vectors, ascending by index, with a frozen vocabulary; unknown terms are left out."""
    terms, corpus = statistics
    rows = term_counts(docs, id_col, text_col).join(terms.select("term", "idf", "term_index"), "term").crossJoin(F.broadcast(corpus.select("avgdl")))  # one row
    weight = query_weight(F.col("idf"), F.col("tf")) if question else doc_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    pairs = F.array_sort(F.collect_list(F.struct("term_index", weight.alias("value"))))  # a document's own terms
    made = rows.groupBy("id").agg(pairs.alias("pairs"))
    return made.select("id", F.col("pairs.term_index").alias("indices"), F.col("pairs.value").alias("values"))
