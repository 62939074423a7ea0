"""Quality rules: counts of a text's words and lines, and a hashed n-gram log-likelihood ratio. Built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import packed, unpacked

#: Words end at these bytes.
_SPACE = r"[\x20\x09-\x0D]+"
#: N-grams run over letters, digits and signs apart, so that signs glued to words count as signs.
_TOKENS = r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules; the table of ratios has `buckets` numbers whatever the corpus's size.

    trusted_rows bounds the ids that the target model is fitted on: all trusted ones where there are no more, else
    those with the smallest hashes, ties by id. The raw model counts every document.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    buckets: int = 1 << 14
    smoothing: float = 1.0
    trusted_rows: int = 20_000
    #: Least mean log ratio a token; a text that is as likely under either model has 0.
    threshold: float = -0.3


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Window hashes are made distinct to find texts with repeated ones; the others stop there. The rest sort (hash, place)
    and add up, over repeated places in order, the words that each window adds to the one before: n log n throughout.
    """

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            last = F.size(s) - 1
            return F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]) & (i < last)),
            )

        places = F.sort_array(F.transform(_bind(placed, twins), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    none = F.lit(0).cast("long")
    return _bind(F.when(F.size(w) >= 4, windows), lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), count(h)).otherwise(none))


def _duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _bind(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))


def base_metrics(text: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text, all zero for null; w, its words(),
    has to be bound: it is read once a word."""
    whole = F.coalesce(text, F.lit(""))
    signs = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": signs.cast("long"),
        "n_dup_lines": _duplicate_lines(text),
        "n_repeat_words": _repeated_words(w),
    }


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKENS), F.lit(1))


def _bucket(rules: QualityRules, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(rules.buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log of trusted over raw probability of each bucket of hashed unigrams and bigrams, in bucket order.

    trusted(id) names the trusted documents; every document counts for the raw model, those of up to rules.trusted_rows
    trusted ids (all rows of an id) for the target model. These ids are few enough to be sent to the scan, so texts are
    never shuffled. Buckets are counted in map tasks first: at most `buckets` rows a task are shuffled, and `buckets`
    numbers reach the driver, whatever the corpus's size.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted")).where("trusted is not null").distinct()
    ids = F.broadcast(ids.orderBy(F.xxhash64("trusted"), "trusted").limit(rules.trusted_rows))
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("trusted"), "left")
    t = F.col("t")
    pairs = F.arrays_zip(t.alias("a"), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))).alias("b"))
    tokens = flagged.select(_tokens(F.col("text")).alias("t"), F.when(F.col("trusted").isNotNull(), 1).alias("good"))
    grams = tokens.select("good", F.inline(pairs).alias("a", "b"))
    both = grams.select("good", F.explode(F.array(_bucket(rules, F.col("a")), F.when(F.col("b").isNotNull(), _bucket(rules, F.col("a"), F.col("b"))))).alias("bucket"))
    counts = both.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    found = {x["bucket"]: (x["raw"], x["good"]) for x in counts.collect()}  # rules.buckets rows at most
    raw, good = (sum(v[k] for v in found.values()) for k in (0, 1))
    if not good:
        return [0.0] * rules.buckets
    share = lambda n, total: (n + rules.smoothing) / (total + rules.smoothing * rules.buckets)
    counted = (found.get(b, (0, 0)) for b in range(rules.buckets))
    return [math.log(share(g, good) / share(r, raw)) for r, g in counted]


def ratio_table(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket int, ratio double): the numbers of log_ratios() as a table."""
    return docs.sparkSession.createDataFrame(list(enumerate(log_ratios(docs, trusted, rules, id_col, text_col))), "bucket int, ratio double")


def _score(text: Column, ratios: list[float], rules: QualityRules) -> Column:
    """Mean ratio over the hashed unigrams and bigrams of a text; 0 where it has none."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in ratios)), " ").cast("array<double>")  # folded to one constant

    def mean(t: Column) -> Column:
        n = F.size(t)
        ones = F.aggregate(t, F.lit(0.0), lambda s, x: s + F.get(table, _bucket(rules, x)))
        twos = F.aggregate(F.sequence(F.lit(2), n), F.lit(0.0), lambda s, i: s + F.get(table, _bucket(rules, F.element_at(t, i - 1), F.element_at(t, i))))
        return F.when(n >= 2, (ones + twos) / (2 * n - 1)).when(n == 1, ones).otherwise(F.lit(0.0))

    return _bind(_tokens(text), mean)


#: What a judgement says of a document.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _failed(m: Column, rules: QualityRules) -> Column:
    """Whether the base rules reject a text of these metrics."""
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def judgement(text: Column, ratios: list[float], rules: QualityRules) -> Column:
    """A struct of NAMES, one expression whose parts are each computed once a row, wherever the optimizer moves it."""

    def told(m: Column) -> Column:
        failed = _failed(m, rules)
        values = {"base_failed": failed, "score": m["score"], "kept": ~failed & (m["score"] >= rules.threshold)}
        return F.struct(*(m[n].alias(n) for n in NAMES[:5]), *(c.alias(n) for n, c in values.items()))

    score = F.round(_score(text, ratios, rules), 6).alias("score")
    return _bind(_bind(words(text), lambda w: F.struct(*(c.alias(n) for n, c in base_metrics(text, w).items()), score)), told)


def verdict(text: Column, ratios: list[float], rules: QualityRules) -> Column:
    """What judgement() says of kept, without the metrics that no rule asks for; texts that fail the base rules aren't scored."""
    good = lambda m: ~_failed(m, rules) & (F.round(_score(text, ratios, rules), 6) >= rules.threshold)
    asked = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))
    return _bind(_bind(words(text), asked), good)


def judge(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __base_failed, __score, __kept.

    Every row is judged on its own whole text, however long, repeated rows and null ids included. A null or empty text
    has no words and fails the base rules. Without trusted documents every score is 0 and the base rules decide alone.
    An empty table gives an empty result. Input columns named like the added ones are replaced; no other name can clash.
    """
    ratios = log_ratios(docs, trusted, rules, id_col, text_col)
    return unpacked(packed(docs, j=judgement(F.col(text_col), ratios, rules)).select("row", "j.*"), docs.columns, *NAMES)


def good_documents(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that judge() keeps, with exactly the columns and values they came with."""
    return docs.where(verdict(F.col(text_col), log_ratios(docs, trusted, rules, id_col, text_col), rules))
