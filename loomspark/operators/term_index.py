"""A stored inverted index with block maxima: lexical top-k that scores only the slices of documents that can matter.

Documents are laid out so that similar ones stand together and are cut into slices of 16. A block holds the
postings of one term in one slice, beside its number of postings, its largest frequency and its least length for a frequency.
These bound every weight in the block, whatever the corpus becomes, so blocks stay right when documents are added.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import values as V
from loomspark.functions.text import sparse_tokens
from loomspark.operators import sparse
from loomspark.scratch import drop_tables, materialize, own_paths

#: Documents of a slice (a power of two, as a shift), folders that terms are dealt to, slices of a question scored before any is skipped.
SLICE_BITS, BUCKETS, SEEDS = 4, 32, 16
#: Rows of questions' terms that are sent to the index; more meet it in a join.
SENT_ROWS = 500_000
#: Scores are rounded, which a bound has to allow for.
SLACK = 1e-6


@dataclass(frozen=True)
class Ranking:
    """tokens(text); question(idf, tf in the question) and document(idf, tf, length, mean length), whose product is summed.

    `document` may not fall with the frequency, nor rise with the length while the frequency stays or both grow alike.
    """

    tokens: Callable[[Column], Column]
    question: Callable[[Column, Column], Column]
    document: Callable[[Column, Column, Column, Column], Column]


def label_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, none left out."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _label_weight(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * tf / (tf + V.LABEL_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl))


#: The weights of sparse.search(), and those of a full-text index over short labels, where a question's words count as often as they stand there.
BM25 = Ranking(sparse_tokens, sparse.query_weight, sparse.doc_weight)
LABELS = Ranking(label_tokens, lambda idf, tf: tf.cast("double"), _label_weight)

_POSTINGS = "term string, slice long, n long, top_tf long, ratio double, postings array<struct<id: long, tf: long, dl: long>>, segment string, bucket int"


class TermIndex:
    """Folders under path: postings/ (a row a block, in a folder a segment and bucket of terms), docs/ (slice, id and the columns
    of `keep`) and corpus/, one row a segment with its documents and tokens.

    That row is written last and makes the segment count: what a lost writer leaves behind is never read. Ids are long,
    not null, and distinct over all segments; null and empty texts count as documents without terms.
    """

    def __init__(self, spark: SparkSession, path: str, ranking: Ranking = BM25, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.ranking = spark, path.rstrip("/"), ranking
        self.id_col, self.text_col, self.keep = id_col, text_col, keep

    def add(self, docs: DataFrame) -> TermIndex:
        """Store more documents. Texts are read once; only their terms and frequencies are shuffled, first by document, then by block."""
        segment = uuid.uuid4().hex
        counts = sparse.run_lengths(F.sort_array(self.ranking.tokens(F.coalesce(self.text_col, F.lit("")))))
        rows = docs.select(F.col(self.id_col).cast("long").alias("id"), F.struct(*self.keep or [F.lit(0)]).alias("kept"), counts.alias("counts"))
        least = F.slice(F.array_sort(F.transform("counts", lambda c: F.xxhash64(c["term"]))), 1, 3)
        length = F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda n, c: n + c["tf"]), F.lit(0).cast("long"))
        keyed = rows.withColumns({"least": least, "dl": length}).withColumns({f"m{i}": F.get("least", F.lit(i)) for i in range(3)}).drop("least")
        # texts with the same least hashes of terms are alike; copies stand next to each other
        near = ["m0", "m1", "m2", "dl", "id"]
        plain = keyed.select(*near, "kept", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"))  # lists of structs are twice the data
        dealt = plain.repartitionByRange(*near).sortWithinPartitions(*near).drop("m0", "m1", "m2")
        with own_paths() as made:
            number = F.xxhash64(F.lit(segment), F.shiftright(F.monotonically_increasing_id(), SLICE_BITS))
            kept = dealt.schema["kept"].dataType.simpleString()
            slices = dealt.withColumn("slice", number).select("slice", "id", "dl", "kept", "terms", "tfs")
            placed = materialize(slices.mapInArrow(_slices, f"slice long, docs array<struct<id: long, dl: long, kept: {kept}>>, terms array<string>, codes array<array<long>>"), "index-slices")
            told = placed.select("slice", F.explode("docs").alias("d")).select("slice", "d.id", "d.dl", *(F.col("d.kept").getField(c).alias(c) for c in self.keep))
            told.write.parquet(f"{self.path}/docs/segment={segment}")
            # the blocks of a slice travel in a list for each bucket; postings are spelt out where they are written
            lists = placed.select("slice", F.col("docs.id").alias("ids"), F.col("docs.dl").alias("dls"), _by_bucket())
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            part = F.pmod(F.xxhash64("slice"), F.lit(-(-tasks // BUCKETS)))
            blocks = lists.repartition(tasks, "bucket", part).select("bucket", "slice", "ids", "dls", F.inline("blocks")).drop("b")
            place = lambda c: c.bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int")
            posting = F.transform("codes", lambda c: F.struct(F.get("ids", place(c)).alias("id"), F.shiftright(c, SLICE_BITS).alias("tf"), F.get("dls", place(c)).alias("dl")))
            put = blocks.select("bucket", F.col("terms").alias("term"), "slice", posting.alias("postings"))
            put = put.sortWithinPartitions("bucket", "term", "slice").select(
                "term", "slice", F.size("postings").cast("long").alias("n"), F.array_max(F.col("postings.tf")).alias("top_tf"),
                F.array_min(F.transform("postings", lambda x: x["dl"] / x["tf"])).alias("ratio"), "postings", F.lit(segment).alias("segment"), "bucket",
            )
            put.write.partitionBy("segment", "bucket").mode("append").parquet(f"{self.path}/postings")
            size = placed.select(F.inline("docs")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
            size.select(F.lit(segment).alias("segment"), "n_docs", "n_tokens").write.mode("append").parquet(f"{self.path}/corpus")
        drop_tables(self.spark, made)
        return self

    @staticmethod
    def _bucket() -> Column:
        return _bucket_of(F.col("term"))

    def segments(self) -> list[str]:
        """Segments that count: one an add()."""
        return [x["segment"] for x in self.spark.read.parquet(f"{self.path}/corpus").select("segment").collect()]

    def blocks(self) -> DataFrame:
        """(term, slice, n, top_tf, ratio, postings, segment, bucket) of all segments that count."""
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").where(F.col("segment").isin(self.segments()))

    def documents(self) -> DataFrame:
        """(slice, id, dl, the columns of keep) of all segments that count."""
        return self.spark.read.parquet(*(f"{self.path}/docs/segment={s}" for s in self.segments()))

    def corpus(self) -> DataFrame:
        """One row: n_docs and avgdl, the default length where there are no tokens."""
        sums = self.spark.read.parquet(f"{self.path}/corpus").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n"))
        return sums.select("n_docs", F.when(F.col("n") > 0, F.col("n") / F.col("n_docs")).otherwise(V.DEFAULT_AVGDL).alias("avgdl"))

    def search(self, questions: DataFrame, k: int, qid_col: str = "item_id", q_text_col: str = "text", where: Column | None = None, threshold: float | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best documents of each question, ties to the smaller id: those that scoring every posting would give.

        Each question's SEEDS slices of the highest bounds are scored, then those others whose bound reaches its k-th
        score, or all if it has fewer than k. Bounds come from the blocks' figures alone, so postings of the slices that are
        skipped are never read into a join. `where`, over the columns of keep, filters documents before they count; frequencies
        are those of all documents. Scores must be above `threshold`, where given.
        """
        with own_paths() as made:
            found = materialize(self._search(questions, k, qid_col, q_text_col, where, threshold)[0], "index-found")
        drop_tables(self.spark, made[:-1])
        return found

    def reach(self, questions: DataFrame, k: int, qid_col: str = "item_id", q_text_col: str = "text") -> DataFrame:
        """(qid, slices, scored): the slices that hold a term of a question, and those of them that search() scores."""
        _, same, bounds, seeds, rest = self._search(questions, k, qid_col, q_text_col, None, None)
        scored = seeds.select("qid", "slice").union(rest.select("qid", "slice")).groupBy("qid").agg(F.count("*").alias("scored"))
        told = bounds.groupBy("qid").agg(F.count("*").alias("slices")).join(scored, "qid")
        return same.join(told.withColumnRenamed("qid", "first"), "first").drop("first")

    def _search(self, questions: DataFrame, k: int, qid_col: str, q_text_col: str, where: Column | None, threshold: float | None) -> tuple[DataFrame, ...]:
        tokens = questions.select(F.col(qid_col).alias("qid"), F.explode(self.ranking.tokens(F.col(q_text_col))).alias("term"))
        counted = tokens.groupBy("qid", "term").agg(F.count("*").alias("qn"))
        # questions of the same words have the same answers: the first of them is asked for all
        words = counted.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "qn"))).alias("words"))
        words = materialize(words, "index-questions")
        firsts = words.groupBy("words").agg(F.min("qid").alias("first"))
        same = materialize(words.join(firsts, "words").select("qid", "first"), "index-same")
        asked = materialize(firsts.select(F.col("first").alias("qid"), F.inline("words")).withColumn("bucket", self._bucket()), "index-asked")
        sent = _sent(asked)
        folders = [x["bucket"] for x in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        stored = self.blocks().where(F.col("bucket").isin(folders)).join(sent(asked.select("term").distinct()), "term", "left_semi")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        figures = materialize(stored.select("term", "slice", "n", "top_tf", "ratio"), "index-figures")
        corpus = F.broadcast(self.corpus())  # one row
        known = figures.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(corpus)
        known = known.select("term", "avgdl", sparse.idf(F.col("n_docs"), F.col("df")).alias("idf"))
        wanted = materialize(known.join(asked, "term").select("qid", "term", "avgdl", "idf", self.ranking.question(F.col("idf"), F.col("qn")).alias("weight")), "index-wanted")
        live = None if where is None else self.documents().where(where).groupBy("slice").agg(F.collect_list("id").alias("live"))  # at most a slice's documents
        near = figures if live is None else figures.join(live.select("slice"), "slice", "left_semi")
        most = F.col("weight") * self.ranking.document(F.col("idf"), F.col("top_tf"), F.col("ratio") * F.col("top_tf"), F.col("avgdl"))
        # a slice's blocks meet in one task, which sums its bounds for all questions
        bounds = near.repartition(tasks, "slice").join(sent(wanted), "term").groupBy("qid", "slice").agg(F.sum(most).alias("bound"))
        bounds = materialize(bounds, "index-bounds")
        seeds = materialize(sparse.top_k(bounds, SEEDS, score="bound", tie="slice").select("qid", "slice", "bound"), "index-first")
        scores = lambda chosen: self._scores(stored, chosen, wanted, live, tasks, threshold)
        first = materialize(sparse.top_k(scores(seeds), k), "index-seeds")
        worst = first.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        left = bounds.join(seeds.select("qid", "slice"), ["qid", "slice"], "left_anti").join(worst, "qid", "left")
        rest = materialize(left.where(F.coalesce("least", F.lit(float("-inf"))) <= F.col("bound") + SLACK).select("qid", "slice"), "index-rest")
        found = sparse.top_k(first.select("qid", "id", "score").union(scores(rest)), k).withColumnRenamed("qid", "first")
        return same.join(found, "first").select("qid", "id", "score", "rank"), same, bounds, seeds, rest

    def _scores(self, stored: DataFrame, chosen: DataFrame, wanted: DataFrame, live: DataFrame | None, tasks: int, threshold: float | None) -> DataFrame:
        """(qid, id, score) of all documents of the chosen (qid, slice).

        What is known of a slice, its questions and its live documents, meets its blocks as one row, so all joins but that
        with the questions' terms go by slice and no (question, term, slice) is made that has no block.
        """
        known = chosen.groupBy("slice").agg(F.collect_set("qid").alias("qids"))  # as many as ask for the slice
        known = known if live is None else known.join(live, "slice")
        weights = wanted.groupBy("term", "idf", "avgdl").agg(F.collect_list(F.struct("qid", "weight")).alias("weights"))  # as many as ask for the term
        read = stored.select("term", "slice", "postings").repartition(tasks, "slice").join(known, "slice")
        if live is not None:
            read = read.withColumn("postings", F.filter("postings", lambda p: F.array_contains("live", p["id"]))).where(F.size("postings") > 0)
        met = read.join(_sent(wanted)(weights), "term").withColumn("weights", F.filter("weights", lambda w: F.array_contains("qids", w["qid"])))
        hits = met.select("slice", "idf", "avgdl", "postings", F.inline("weights")).select("qid", "slice", "weight", "idf", "avgdl", F.inline("postings"))
        product = F.col("weight") * self.ranking.document(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
        scores = hits.groupBy("qid", "slice", "id").agg(F.round(F.sum(product), 6).alias("score")).select("qid", "id", "score")
        return scores if threshold is None else scores.where(F.col("score") > threshold)


def _bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _by_bucket() -> Column:
    """(bucket, blocks) for each bucket of a slice's terms and codes."""
    dealt = F.zip_with("terms", "codes", lambda t, c: F.struct(_bucket_of(t).alias("b"), t.alias("terms"), c.alias("codes")))
    every = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    # bound once a row, so that no term is hashed again for each bucket
    parts = F.element_at(F.transform(F.array(dealt), lambda blocks: F.transform(every, lambda b: F.struct(b.alias("bucket"), F.filter(blocks, lambda x: x["b"] == b).alias("blocks")))), 1)
    return F.inline(F.filter(parts, lambda x: F.size(x["blocks"]) > 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a slice of sorted rows (slice, id, dl, kept, terms, tfs): its documents, and of each term the postings, as frequency and place in the slice."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        terms = pa.concat_arrays(rows["terms"].chunks)
        place = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
        found = terms.flatten().dictionary_encode()
        codes = (pa.concat_arrays(rows["tfs"].chunks).flatten().to_numpy() << SLICE_BITS) | place
        order = np.argsort(found.indices.to_numpy(), kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        docs = pa.StructArray.from_arrays([pa.concat_arrays(rows[c].chunks) for c in ("id", "dl", "kept")], ["id", "dl", "kept"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[order], pa.int64()))
        return pa.RecordBatch.from_arrays([rows["slice"][:1].combine_chunks(), whole(docs), whole(found.dictionary), whole(lists)], ["slice", "docs", "terms", "codes"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and end > start and held[-1].column(0)[0] != batch.column(0)[start]:
                yield made(pa.Table.from_batches(held))
                held = []
            if end > start:
                held.append(batch.slice(start, end - start))
    if held:
        yield made(pa.Table.from_batches(held))


def _sent(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """broadcast() for tables no larger than rows, if these are few; else nothing."""
    return F.broadcast if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else lambda other: other
