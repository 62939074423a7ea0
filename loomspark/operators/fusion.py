"""Fusing ranked lists, choosing diverse chunks and assembling a budgeted context with citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark import values as V
from loomspark.functions.answer import chunk_block, irrelevant, snippet, stripped
from loomspark.functions.text import sparse_tokens, token_count
from loomspark.operators.sparse import top_k


def reciprocal_ranks(legs: list[DataFrame], k: int, constant: int = V.FUSION_K, weights: list[float] | None = None) -> DataFrame:
    """legs of (qid, id, rank) -> (qid, id, score, rank): sums of weight / (constant + rank) over the lists."""
    weights = weights or [1.0] * len(legs)
    parts = [leg.select("qid", "id", (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("part")) for leg, w in zip(legs, weights, strict=True)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return top_k(rows.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, constant: int = V.FUSION_K) -> DataFrame:
    """Fuse the 2k best of both legs; a query without sparse hits keeps its dense order."""
    return reciprocal_ranks([dense.where(F.col("rank") <= 2 * k), sparse.where(F.col("rank") <= 2 * k)], k, constant)


def variation_scores(hits: DataFrame, k: int) -> DataFrame:
    """hits(qid, id, score) of several phrasings -> top k by the number of hits and their mean score.

    The first part adds 1/(61+i) for the i-th time a chunk was found, whatever its rank there.
    """
    found = hits.groupBy("qid", "id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    ordinal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (i + V.FUSION_K))
    fused = F.round(V.RRF_WEIGHT * ordinal + V.MEAN_WEIGHT * F.col("mean"), 9)
    return top_k(found.select("qid", "id", "n", fused.alias("score")), k)


def diverse(hits: DataFrame, most: int, qid: str = "qid", document: str = "document", section: str = "section", order: str = "rank") -> DataFrame:
    """hits with pick: first one chunk a document, then one for each unseen (document, section), then the rest.

    A query with no more than `most` hits keeps its order.
    """
    by_doc = Window.partitionBy(qid, document).orderBy(order)
    by_section = Window.partitionBy(qid, document, section).orderBy(order)
    marked = hits.withColumn("__pass", F.when(F.row_number().over(by_doc) == 1, 1).when(F.row_number().over(by_section) == 1, 2).otherwise(3))
    whole = Window.partitionBy(qid)
    few = F.count("*").over(whole) <= most
    marked = marked.withColumn("__pass", F.when(few, 1).otherwise(F.col("__pass")))
    pick = F.row_number().over(Window.partitionBy(qid).orderBy("__pass", order))
    return marked.withColumn("pick", pick).where(F.col("pick") <= most).drop("__pass")


def budgeted(chunks: DataFrame, tokens: int = V.CONTEXT_TOKENS, most: int = V.CONTEXT_CHUNKS, qid: str = "qid", order: str = "pick") -> DataFrame:
    """chunks(title, year, section, text) taken in order until the next one would pass the budget.

    Adds citation_id, block and block_tokens; block tokens never fall below 0, so the running sum tells where to stop.
    """
    w = Window.partitionBy(qid).orderBy(order)
    ranked = chunks.withColumn("citation_id", F.row_number().over(w)).where(F.col("citation_id") <= most)
    block = chunk_block(F.col("citation_id"), F.col("title"), F.col("year"), F.col("section"), F.col("text"))
    ranked = ranked.withColumn("block", block).withColumn("block_tokens", token_count(F.col("block")))
    running = F.sum("block_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("running_tokens", running).where(F.col("running_tokens") <= tokens)


def contexts(taken: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, context, n_citations, used_tokens): blocks in order, a blank line between them."""
    blocks = F.array_sort(F.collect_list(F.struct("citation_id", "block")))
    return taken.groupBy(qid).agg(
        F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"),
        F.count("*").alias("n_citations"),
        F.sum("block_tokens").alias("used_tokens"),
    )


def citation_rows(taken: DataFrame, qid: str = "qid") -> DataFrame:
    """Citations of a context: number, title (Unknown where missing) and the first 200 characters."""
    return taken.select(qid, "citation_id", F.coalesce("title", F.lit("Unknown")).alias("title"), snippet(F.col("text")).alias("snippet"))


#: What is answered where nothing can be generated.
FALLBACK_LEAD = "Based on the retrieved documents, here are the relevant excerpts:\n"
FALLBACK_NONE = "I couldn't find relevant information to answer your question."


def fallback_answers(questions: DataFrame, citations: DataFrame, most: int = 3, qid: str = "qid") -> DataFrame:
    """(qid, answer, confidence): a lead and the first snippets of each question, or that nothing was found."""
    first = citations.where(F.col("citation_id") <= most).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("citation_id", "snippet"))).alias("__c"))
    lines = F.transform(F.col("__c"), lambda c: F.concat(F.lit("\n["), c["citation_id"].cast("string"), F.lit("] "), c["snippet"]))
    answer = F.when(F.col("__c").isNull(), F.lit(FALLBACK_NONE)).otherwise(F.concat(F.lit(FALLBACK_LEAD), F.array_join(lines, "")))
    return questions.select(qid).join(first, qid, "left").select(qid, answer.alias("answer"), F.lit(0.3).alias("confidence"))


# --- reranking and evidence ---


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text holds; 0 without terms."""
    asked = F.array_distinct(sparse_tokens(question))
    return F.coalesce(F.size(F.array_intersect(asked, sparse_tokens(text))) / F.when(F.size(asked) > 0, F.size(asked)), F.lit(0.0))


def rerank(hits: DataFrame, k: int = V.RERANK_K, scorer: Callable[[pd.Series, pd.Series], pd.Series] | Callable[[Column, Column], Column] | None = None, model: bool = False) -> DataFrame:
    """hits(qid, id, rank, question, text) with rerank_score and rerank_rank, the k best of each query.

    scorer rates pairs of question and text: an expression on columns such as lexical_overlap(), or, with model, a
    function on series such as a cross-encoder's, which gets Arrow batches. Ties keep their order. Without scorer
    the first k by rank stay, unscored, as where a model is missing.
    """
    if scorer is None:
        rated = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    elif model:
        rated = hits.withColumn("rerank_score", F.pandas_udf(scorer, "double")("question", "text"))
    else:
        rated = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("text")).cast("double"))
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return rated.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)


def cited_chunks(cited: DataFrame, taken: DataFrame, qid: str = "qid") -> DataFrame:
    """cited(qid, citation_id) with the chunk each number stands for in its question's context; others go."""
    return cited.join(taken, [qid, "citation_id"])


def relevant_summaries(summaries: DataFrame, text: str = "text", summary: str = "summary", error: str = "error") -> DataFrame:
    """summaries with evidence: the trimmed summary, or the whole text where making it failed.

    Without an error, empty and null summaries go, and those that say in any case, anywhere, that nothing is relevant.
    """
    told, failed = stripped(F.coalesce(F.col(summary), F.lit(""))), F.col(error).isNotNull()
    kept = summaries.where(failed | ((told != "") & ~irrelevant(told)))
    return kept.withColumn("evidence", F.when(failed, F.col(text)).otherwise(told))


def first_answer(replies: DataFrame, providers: list[str], qid: str = "qid") -> DataFrame:
    """replies(qid, provider, answer, error) -> (qid, provider, answer): of the listed providers the first without error."""
    order = F.coalesce(*[F.when(F.col("provider") == p, F.lit(n)) for n, p in enumerate(providers)])
    good = replies.withColumn("__order", order).where(F.col("__order").isNotNull() & F.col("error").isNull() & F.col("answer").isNotNull())
    return good.groupBy(qid).agg(F.min_by(F.struct("provider", "answer"), "__order").alias("__first")).select(qid, "__first.*")


def answer_events(taken: DataFrame, tokens: DataFrame, qid: str = "qid", evidence: int = 5) -> DataFrame:
    """(qid, seq, kind, payload) of a streamed answer: its first evidence, then tokens(qid, seq, kind, payload), then done."""
    first = taken.where(F.col("citation_id") <= evidence).select(qid, F.lit(0).alias("part"), F.col("citation_id").alias("n"), F.lit("evidence").alias("kind"), snippet(F.col("text")).alias("payload"))
    told = tokens.select(qid, F.lit(1).alias("part"), F.col("seq").alias("n"), "kind", "payload")
    last = tokens.select(qid).union(taken.select(qid)).distinct().select(qid, F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit("done").alias("kind"), F.lit("").alias("payload"))
    w = Window.partitionBy(qid).orderBy("part", "n")
    return first.union(told).union(last).select(qid, (F.row_number().over(w) - 1).alias("seq"), "kind", "payload")
